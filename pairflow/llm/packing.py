"""Packing of tokenised documents into training sequences.

Documents are tokenised, an end id is appended, and each is cut into pieces of
``CAPACITY`` ids and one remainder. Pieces are dealt at random into groups of
about ``GROUP_ROWS`` documents; in each group first-fit decreasing, with a
tournament tree over the sequences' free room, puts every piece into a sequence.

The table's columns may be null or clash with ours: only ``doc_id`` and ``text``
are read. Null and empty texts are the end id alone; a null id stays null;
repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, inner, one_dictionary, releasing, strings, together

CAPACITY = 4096
END_ID = 2
GROUP_ROWS = 2000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text whose distinct words are tokenised together; of texts, and of distinct words, that are worked on at a time.
GATHERED_BYTES, TEXT_BYTES, WORD_BYTES = 32 << 20, 4 << 20, 1 << 18


#: Ends a word in the fast path; texts that hold it, or any character outside ``_PLAIN``, take the slow path.
_END = "\ue000"
#: Words of ASCII and Latin letters and signs: composed as they are, and lower-cased one by one.
_PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u012f\u0131-\u024f\n]*")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _bytes_of_signs() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as one visible character: itself if it is one in Latin-1, else the next from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _merger(model: dict) -> tuple:
    """The vocabulary's merges as ranks of byte strings for tiktoken, and the ids by rank.

    ``_END`` stands for the end of a word; the lowest ranks join it to the byte
    before it, so that merging then starts where the vocabulary's does.
    """
    import tiktoken

    signs, end, vocab = _bytes_of_signs(), _END.encode(), model["vocab"]
    mark = "</w>"
    ranks = {end[:2]: 0, end: 1}
    ids = {}
    for sign, byte in signs.items():
        ranks[bytes([byte]) + end] = len(ranks)
        ids[ranks[bytes([byte]) + end]] = vocab[sign + mark]
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ended = right.endswith(mark)
        raw = bytes(signs[c] for c in left + right.removesuffix(mark)) + end * ended
        ids[ranks.setdefault(raw, len(ranks))] = vocab[left + right]
    for sign, byte in signs.items():
        ids[ranks.setdefault(bytes([byte]), len(ranks))] = vocab[sign]
    lookup = np.zeros(len(ranks), dtype="<u4")
    lookup[list(ids)] = list(ids.values())
    core = tiktoken.Encoding("words", pat_str=f"[^{_END}\\n]+{_END}|\\n", mergeable_ranks=ranks, special_tokens={})
    return core, lookup, ranks[b"\n"]


def _is_plain(words: str) -> bool:
    return "<|" not in words and bool(_PLAIN.fullmatch(words))


class WordTokenizer:
    """A tokenizer that drops white space; each distinct word is tokenised once.

    No token spans white space, so a text's ids are those of its words between
    blanks and line feeds, one after another. Plain words are merged by the
    vocabulary's own merges many at a time; the tokenizer itself does the others.
    Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.core, self.lookup, self.newline = _merger(json.load(f)["model"])
        self.whole = Tokenizer.from_file(path)

    def _plain_ids(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one a line, and how many each has."""
        ended = _SPLIT.sub(rf"\g<0>{_END}", words.lower() + "\n")
        ranks = np.asarray(self.core.encode_ordinary(ended), dtype=np.int64)
        stops = ranks == self.newline
        return self.lookup[ranks[~stops]], np.diff(np.flatnonzero(stops), prepend=-1) - 1

    def _ids(self, words: list[str]) -> pa.Array:
        """Each word's ids."""
        lines = "\n".join(words)
        if words and _is_plain(lines):
            flat, n = self._plain_ids(lines)
            return strings(np.concatenate(([0], np.cumsum(n))) * 4, flat.view(np.uint8))
        plain = np.array([_is_plain(w) for w in words], bool)
        out = [pa.array([np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w, other in zip(words, ~plain, strict=True) if other], pa.binary())]
        if plain.any():
            out.append(self._ids([w for w, own in zip(words, plain, strict=True) if own]))
        place = np.empty(len(words), np.int64)
        place[np.argsort(plain, kind="stable")] = np.arange(len(words))
        return pa.concat_arrays(out).take(pa.array(place))

    def encode(self, texts: list[str | None] | pa.ChunkedArray) -> Iterator[bytes]:
        """Each text's ids, in order; none of a null."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([texts], pa.string())
        parts, sizes = [], []
        for chunk in texts.chunks:
            for s in together(chunk, TEXT_BYTES):
                words = pc.split_pattern(pc.replace_substring(pc.fill_null(chunk.slice(s.start, s.stop - s.start), ""), "\n", " "), " ")
                parts.append(words.flatten().dictionary_encode())
                sizes.append(words.value_lengths().to_numpy())
        if not parts:
            return
        tokens, vocabulary = one_dictionary(parts)
        del parts
        ids = pa.concat_arrays([self._ids(some.to_pylist()) for some in in_parts(vocabulary, WORD_BYTES)])
        for t, n in zip(tokens, sizes, strict=True):
            offsets, raw = inner(ids.take(pa.array(t)))
            raw, ends = raw.tobytes(), offsets[np.concatenate(([0], np.cumsum(n)))].tolist()
            for a, b in zip(ends, ends[1:]):
                yield raw[a:b]


def cut(raw: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the little-endian ids) of each piece."""
    n = len(raw) // 4
    return [(s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)])) for s in range(0, n, capacity)]


def pieces_of(path: str, capacity: int, end_id: int):
    """For mapInArrow: (doc_id, text) to the rows of ``PIECES``."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.ChunkedArray]]:
        """Ids and texts of so many batches that most words are there more than once."""
        ids, texts, held = [], [], 0
        for batch in batches:
            ids += batch["doc_id"].to_pylist()
            texts.append(batch["text"])
            held += batch["text"].nbytes
            if held >= GATHERED_BYTES:
                yield ids, pa.chunked_array(texts)
                ids, texts, held = [], [], 0
        if ids:
            yield ids, pa.chunked_array(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        ordinal = 0
        for doc_ids, texts in gathered(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, tokenizer.encode(texts), strict=True):
                ids += end
                for start, length, crc in cut(ids, capacity):
                    # Dealt by what the piece is and where it stands, never by its key alone: a key may have a third of all rows.
                    ordinal += 1
                    rows.append((doc_id, start, length, crc, len(ids) // 4, zlib.crc32(f"{doc_id} {start} {crc} {ordinal}".encode())))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: longest first (ties in the given order), each into the first bin with room.

    A tournament tree over the bins holds at each node the most room below it,
    so that the first bin with room is found going down from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
    return bins, offsets


def _pack_group(capacity: int):
    def run(key, rows):
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "start", "deal"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + np.asarray(bins, dtype=np.int64)
        rows["offset"] = offsets
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(pieces_of(path, capacity, end_id)), PIECES)


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Every piece's sequence and offset in it. A group has a few thousand pieces, whatever the input's size."""
    dealt = pieces.withColumn("group", F.pmod(F.col("deal"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_pack_group(capacity), PACKED)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    groups = max(1, math.ceil(docs.count() / group_rows))
    return pack(tokenized_pieces(docs, path, capacity, end_id), groups, capacity)
