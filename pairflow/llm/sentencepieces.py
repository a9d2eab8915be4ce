"""SentencePiece encoding and decoding over a relational lattice.

A text's words (each with the blanks before it) are cut into units wherever no
piece of the model has the two neighbouring characters inside, so that no edge
spans a cut and the best path of a text is that of its units, one after another.

Each distinct unit of the whole input is encoded once. Documents become blocks:
places in a vocabulary of units. A block sends its units, packed, to buckets by
hash; a bucket's distinct units are exploded into substrings of bounded length, an
equi-join with the piece table (broadcast; the model fixes its size) leaves the
lattice's edges, edges are grouped by unit, and Spark's higher-order ``aggregate``
folds Viterbi over them: the path with the largest sum of scores. The ids go back
to the blocks. Only buckets that hold units get a message, so that messages are
never more than units.

Edges are grouped where they are, since a task's rows stay in order between the
explode and the group; a unit whose characters are not all there raises an error.

The path is what unigram models ask for. A byte-pair model's scores are only the
ranks of its merges: for such a model the path of the best sum is well defined and
decodes to the same text, but its pieces are not always those of the merges.

Null and empty texts have no pieces. A character without a piece scores less than
any and becomes its UTF-8 bytes' pieces. Repeated rows are encoded each; an empty
table gives no rows. Decoding gives the text back, but for the sign U+2581, which
counts as a blank. A run of n characters without a cut takes time as n squared.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, in_parts, inner, one_dictionary, release, releasing, strings, together, written
from .language_model import pack, unpack

BLANK = "▁"
#: Occurrences of words in a block, about. Texts count as words of eight bytes at least, so that a few without blanks end a block too.
BLOCK_WORDS = 6_000_000
#: Bytes of text that are cut at a time, and places of units that are looked up at a time.
CUT_BYTES, LOOKED_UP = 4 << 20, 1 << 20
#: Units of all blocks that a bucket gets, about, and buckets in a partition.
BUCKET_UNITS, TOGETHER = 40_000, 4
#: How much less than the worst piece a character without one scores.
UNKNOWN_PENALTY = 10.0


class Model:
    """A model's pieces (with blanks for U+2581), scores and byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.pieces = [(sp.id_to_piece(i).replace(BLANK, " "), i, sp.get_score(i)) for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.unknown_score = min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)
        self.inside = {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)}
        self._kinds = None
        self.spans_blanks = any(pair[1] == " " != pair[0] for pair in self.inside)
        self.raw = [b""] * len(ids)
        for p, i, _ in self.pieces:
            self.raw[i] = p.encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id and score: as many rows as the model has pieces."""
        return spark.createDataFrame(self.pieces, "piece string, id long, score double")

    def of_bytes(self, value: int) -> list[int]:
        """The pieces of a character given by its UTF-8 bytes as a number."""
        raw = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        return [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that begin with one more blank, each with the blanks before it but for one, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), BLANK, " ")
        full = pc.binary_length(texts).to_numpy() > 0
        if self.spans_blanks:
            return texts.filter(pa.array(full)), full.astype(np.int64)
        lists = pc.split_pattern(texts, " ")
        words, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
        there = pc.binary_length(words).to_numpy() > 0
        if there.all():
            return words, n
        # Blanks in a row leave empty strings, which go with the word after them or end their text.
        last = there.copy()
        last[np.cumsum(n) - 1] = True
        at = np.flatnonzero(last)
        blanks = np.diff(at, prepend=-1) - 1
        owner = np.repeat(np.arange(len(n)), n)[at]
        kept = full[owner]
        words = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(" "), pa.array(blanks[kept])), words.take(pa.array(at[kept])), "")
        return words, np.bincount(owner[kept], minlength=len(n))

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of words, one after another, and how many each has: a word is cut wherever no piece has both neighbours."""
        if not len(words):
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        kinds, inside = self._tables()
        offsets, raw = inner(words)
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[chars]
        begin = np.flatnonzero((raw & 0xC0) != 0x80)
        starts = np.ones(len(chars), bool)
        starts[1:] = ~inside[kind[:-1], kind[1:]]
        starts[np.searchsorted(begin, offsets[:-1])] = True
        cuts = np.append(begin[starts], len(raw))
        return strings(cuts, raw), np.diff(np.searchsorted(cuts, offsets))

    def units(self, words: list[str]) -> Iterator[list[str]]:
        """Each word's units."""
        units, n = self.cut(pa.array(words, pa.string()))
        for some in np.split(np.arange(len(units)), np.cumsum(n)[:-1]) if words else ():
            yield [u.decode() for u in units.take(pa.array(some)).to_pylist()]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Every character's number (0: in no pair), and which pairs of numbers are inside a piece."""
        if self._kinds is None:
            known = sorted({c for pair in self.inside for c in pair})
            place = {c: i for i, c in enumerate(known, 1)}
            kinds = np.zeros(0x110000, np.uint16)
            kinds[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
            inside = np.zeros((len(known) + 1, len(known) + 1), bool)
            for a, b in self.inside:
                inside[place[a], place[b]] = True
            self._kinds = kinds, inside
        return self._kinds


def _ragged(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The chosen lists, one after another, of lists that lie one after another."""
    begin, each = np.cumsum(lengths) - lengths if begin is None else begin, lengths[chosen]
    return values[np.repeat(begin[chosen] - (np.cumsum(each) - each), each) + np.arange(each.sum())]


def _coded(places: np.ndarray) -> list[np.ndarray]:
    """Places as bytes: one for the first 192, three for most others, and the few beyond those whole."""
    far = places >= 192
    rest = places[far].astype(np.int64) - 192
    top = np.minimum(rest >> 16, 63)
    first = places.astype(np.uint8)
    first[far] = 192 + top
    return [first, (rest >> 8).astype(np.uint8), rest.astype(np.uint8), rest[top == 63].astype(np.uint32)]


def _decoded(first: np.ndarray, high: np.ndarray, low: np.ndarray, whole: np.ndarray) -> np.ndarray:
    out = first.astype(np.uint32)
    far = first >= 192
    rest = (out[far] - 192 << 16) + (high.astype(np.uint32) << 8) + low
    rest[first[far] == 255] = whole
    out[far] = rest + 192
    return out


def _pack_units(offsets: np.ndarray, raw: np.ndarray) -> bytes:
    return pack([np.diff(offsets).astype(np.uint32), raw[offsets[0] : offsets[-1]]])


def _unpack_units(data: bytes) -> pa.Array:
    sizes, raw = unpack(data)
    return strings(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), raw)


_BLOCK = "block long, n_units long, units binary, documents binary"


def _blocks(model, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every block its distinct units by hash, and its documents as places in order of frequency."""
        own = model.value
        ids, sizes, words = [], [], []
        count = 0

        def flush() -> pa.RecordBatch:
            tokens, vocabulary = one_dictionary(words)
            words.clear()
            vocabulary = pc.binary_join_element_wise(" ", vocabulary, "")
            cut = [own.cut(some) for some in in_parts(vocabulary, CUT_BYTES)]
            n_of = np.concatenate([n for _, n in cut])
            of_word, units = one_dictionary([u.dictionary_encode() for u, _ in cut])
            of_word = np.concatenate(of_word)
            del vocabulary, cut
            order = np.argsort(np.array([zlib.crc32(u) for u in units.to_pylist()], np.uint32), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            n_units = [np.diff(np.concatenate(([0], np.cumsum(n_of[t])))[np.concatenate(([0], np.cumsum(n)))]) for t, n in zip(tokens, sizes, strict=True)]
            # A word's units count as often as it does; places are looked up a part at a time, so that only bytes are held of all.
            seen = sum(np.bincount(t, minlength=len(n_of)) for t in tokens)
            often = np.argsort(-np.bincount(of_word, weights=np.repeat(seen, n_of), minlength=len(units)), kind="stable")
            place = np.empty(len(units), np.uint32)
            place[often] = np.arange(len(units), dtype=np.uint32)
            of_word, begin = place[of_word], np.cumsum(n_of) - n_of
            per_part = [_coded(_ragged(of_word, n_of, t, begin)) for t in tokens]
            documents = [np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.concatenate(n_units), rank[often], *map(np.concatenate, zip(*per_part, strict=True))]
            row = [[int.from_bytes(os.urandom(8), "little", signed=True)], [len(units)], [_pack_units(*inner(units.take(pa.array(order))))], [pack(documents)]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "n_units", "units", "documents"])

        for batch in batches:
            given = batch["doc_id"].to_pylist()
            for s in together(batch["text"], CUT_BYTES):
                texts = batch["text"].slice(s.start, s.stop - s.start)
                found, n = own.words(texts)
                words.append(found.dictionary_encode())
                ids += given[s]
                sizes.append(n)
                count += max(len(found) + len(n), (pc.sum(pc.binary_length(texts)).as_py() or 0) // 8)
                if count >= block_words:
                    yield flush()
                    ids.clear()
                    sizes.clear()
                    count = 0
        if ids:
            yield flush()

    return run


_REQUEST = "bucket int, block long, payload binary"


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's units, in order of their hashes, to the buckets that have any."""
        for batch in batches:
            for block, packed in zip(batch["block"].to_pylist(), batch["units"], strict=True):
                units = _unpack_units(packed.as_py())
                bucket = np.array([zlib.crc32(u) for u in units.to_pylist()], np.int64) >> (32 - bits)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                offsets, raw = inner(units)
                rows = [_pack_units(offsets[a : b + 1], raw) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(units)])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array([block] * len(first), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block", "payload"])

    return run


_UNITS = "bucket int, place int, unit string, payload binary"


def _distinct(rows: pa.Table) -> pa.Table:
    """Of a bucket: a row with every block's units as places (place -1), then the distinct units in order."""
    asked = [_unpack_units(x.as_py()).dictionary_encode() for x in rows["payload"]]
    places, units = one_dictionary(asked)
    payload = pack([rows["block"].to_numpy().astype(np.int64), np.array([len(x) for x in places], np.int64), np.concatenate(places).astype(np.uint32)])
    n = len(units)
    columns = [
        pa.array(np.full(n + 1, rows["bucket"][0].as_py(), np.int32)),
        pa.array(np.arange(-1, n, dtype=np.int32)),
        pa.concat_arrays([pa.nulls(1, pa.string()), units.cast(pa.string())]),
        pa.concat_arrays([pa.array([payload], pa.binary()), pa.nulls(n, pa.binary())]),
    ]
    return pa.Table.from_arrays(columns, names=["bucket", "place", "unit", "payload"])


def edges_of(units: DataFrame, pieces: DataFrame, longest: int, unknown_score: float) -> DataFrame:
    """Each unit's edges as rows: where a substring starts, its length, and the piece's id and score.

    A character without a piece has the number of its bytes, its bits turned, as its id.
    The unit itself stays in its first row only; a row without one stays as it is.
    """
    chars = F.length("unit")
    starts = units.withColumn("start", F.explode_outer(F.sequence(F.lit(0), chars - 1)))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), chars - F.col("start")))
    cut = starts.withColumn("size", F.explode_outer(sizes)).withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size")))
    met = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1 or size is null")
    number = F.when(F.col("size").isNotNull(), -1 - F.conv(F.hex(F.encode("piece", "UTF-8")), 16, 10).cast("long"))
    first = F.when((F.col("start") == 0) & (F.col("size") == 1), chars)
    return met.select("bucket", "place", first.alias("chars"), "payload", "start", "size", F.coalesce("id", number).alias("id"), F.coalesce("score", F.lit(unknown_score)).alias("score"))


#: ``firsts``: where the edges that end after each character begin (from 1), and one more.
_LATTICE = "bucket int, place int, payload binary, chars int, firsts array<int>, edges array<struct<start: int, id: bigint, score: double>>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a unit with its edges by their ends. Edges come unit by unit; that none is missing is checked."""
    edge = pa.struct([("start", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])

    def group(table: pa.Table) -> pa.RecordBatch:
        bucket, place = table["bucket"].to_numpy(), table["place"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(place) != 0))))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bucket))))
        there = table["start"].is_valid().to_numpy()
        start = table["start"].fill_null(0).to_numpy().astype(np.int32)[there]
        size = table["size"].fill_null(0).to_numpy().astype(np.int32)[there]
        owner = of[there]
        chars = table["chars"].take(pa.array(first)).fill_null(0).to_numpy().astype(np.int64)
        alone = np.bincount(owner[size == 1], minlength=len(first))
        if (alone != chars).any() or ((place[first] >= 0) & (chars == 0)).any():
            raise RuntimeError("the edges of a unit did not come together")
        order = np.lexsort((start, start + size, owner))
        made = pa.StructArray.from_arrays([pa.array(start[order]), pa.array(table["id"].fill_null(0).to_numpy()[there][order]), pa.array(table["score"].fill_null(0).to_numpy()[there][order])], fields=list(edge))
        per_unit = np.bincount(owner, minlength=len(first))
        # How many edges end after each character of each unit, and where they begin within their unit.
        base = np.cumsum(chars) - chars
        ending = np.bincount(base[owner] + start + size - 1, minlength=int(chars.sum()))
        within = np.cumsum(ending) - np.repeat(np.cumsum(per_unit) - per_unit, chars)
        n_firsts = chars + (chars > 0)
        firsts = np.ones(int(n_firsts.sum()), np.int32)
        at = np.ones(len(firsts), bool)
        at[(np.cumsum(n_firsts) - n_firsts)[chars > 0]] = False
        firsts[at] = within + 1
        offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*(table[n].take(pa.array(first)).combine_chunks() for n in ("bucket", "place", "payload")), pa.array(chars.astype(np.int32)), pa.ListArray.from_arrays(offsets(n_firsts), pa.array(firsts)), pa.ListArray.from_arrays(offsets(per_unit), made)],
            names=["bucket", "place", "payload", "chars", "firsts", "edges"],
        )

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last unit may go on in the next batch.
        bucket, place = batch["bucket"].to_numpy(), batch["place"].to_numpy()
        other = np.flatnonzero((bucket != bucket[-1]) | (place != place[-1]))
        if held and not len(other) and (held[-1]["bucket"][0].as_py(), held[-1]["place"][0].as_py()) == (bucket[0], place[0]) and held[-1]["place"][-1].as_py() == place[0]:
            held.append(pa.Table.from_batches([batch]))
            continue
        last = int(other[-1]) + 1 if len(other) else 0
        whole = pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, last)])]).combine_chunks()
        if whole.num_rows:
            yield group(whole)
        held = [pa.Table.from_batches([batch.slice(last)])]
    if held:
        yield group(pa.concat_tables(held).combine_chunks())


#: For every position the best sum of a path to it, and the edge that it ends with; of equal sums the longest edge's.
_BEST = """
aggregate(
  sequence(1, chars),
  array(named_struct('sum', 0D, 'start', 0, 'id', 0L)),
  (best, at) -> concat(best, array(aggregate(
    slice(edges, firsts[at - 1], firsts[at] - firsts[at - 1]),
    named_struct('sum', double('-infinity'), 'start', 0, 'id', 0L),
    (top, e) -> if(best[e.start].sum + e.score > top.sum, named_struct('sum', best[e.start].sum + e.score, 'start', e.start, 'id', e.id), top)))))
"""
#: From the last position back to the first.
_PATH = """
aggregate(
  sequence(1, chars),
  named_struct('at', chars, 'ids', cast(array() as array<bigint>)),
  (path, step) -> if(path.at = 0, path, named_struct('at', best[path.at].start, 'ids', array_append(path.ids, best[path.at].id))),
  path -> reverse(path.ids))
"""


def folded(lattice: DataFrame) -> DataFrame:
    """Each unit's ids along the path with the largest sum."""
    best = lattice.select("bucket", "place", "payload", "chars", F.when(F.col("chars") > 0, F.expr(_BEST)).alias("best"))
    return best.select("bucket", "place", "payload", F.when(F.col("chars") > 0, F.expr(_PATH)).alias("ids"))


_ANSWER = "block long, bucket int, payload binary"


def _answers(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each block the ids of the units it sent, in its order. A bucket's first row says what was sent."""
        own = model.value
        asked, bucket, values, lengths = None, None, [], []

        def finish() -> pa.RecordBatch:
            blocks, sizes, places = unpack(asked)
            flat, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (values, lengths))
            rows = []
            for part in np.split(places.astype(np.int64), np.cumsum(sizes)[:-1]):
                rows.append(pack([length[part].astype(np.uint32), _ragged(flat, length, part).astype(np.int32)]))
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["block", "bucket", "payload"])

        for batch in batches:
            edge = np.flatnonzero(batch["place"].to_numpy() == -1).tolist()
            for lo, hi in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if part["place"][0].as_py() == -1:
                    if asked is not None:
                        yield finish()
                    asked, bucket, values, lengths = part["payload"][0].as_py(), part["bucket"][0].as_py(), [], []
                    part = part.slice(1)
                flat, length = part["ids"].flatten().to_numpy(zero_copy_only=False), part["ids"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if (flat < 0).any():
                    lists = [[y for x in i for y in (own.of_bytes(~x) if x < 0 else [x])] for i in part["ids"].to_pylist()]
                    length = np.array([len(x) for x in lists], np.int64)
                    flat = np.array([y for x in lists for y in x], np.int64)
                values.append(flat.astype(np.int64))
                lengths.append(length)
        if asked is not None:
            yield finish()

    return run


def _of_block(blocks: pa.Table, answers: pa.Table) -> tuple:
    """A block's document ids, units of each, all units' places, and every unit's ids as one array with lengths, by place."""
    ids, null, sizes, rank, *tokens = unpack(blocks["documents"][0].as_py())
    parts = [unpack(x.as_py()) for x in answers.sort_by("bucket")["payload"]]
    length = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    if len(length) != len(rank):
        raise RuntimeError("a block's units did not all come back")
    rank = rank.astype(np.int64)
    return pa.array(ids, mask=null.astype(bool)), sizes, _decoded(*tokens), _ragged(flat, length, rank), length[rank]


def _ids_of(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    ids, sizes, tokens, flat, length = _of_block(blocks, answers)
    # Where each document's ids end: those of its units.
    ends = np.concatenate(([0], np.cumsum(length[tokens])))[np.concatenate(([0], np.cumsum(sizes)))]
    return pa.Table.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_ragged(flat, length, tokens)))], names=["doc_id", "ids"])


def _model(path: str | None) -> Model:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Model(path)


def _paths(docs: DataFrame, model: Model, shared: Shared, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and the answers to them: their units' ids."""
    blocks = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(_blocks(shared, block_words)), _BLOCK))
    buckets = 1 << ((blocks.agg(F.sum("n_units")).first()[0] or 0) // BUCKET_UNITS).bit_length()
    asked = blocks.where("n_units > 0").select("block", "units").mapInArrow(releasing(_requests(buckets.bit_length() - 1)), _REQUEST)
    # A bucket is small to move and much to work on, so partitions are not merged by size.
    units = asked.repartition(-(-buckets // TOGETHER), "bucket").groupBy("bucket").applyInArrow(_distinct, _UNITS)
    lattice = edges_of(units, model.table(docs.sparkSession), model.longest, model.unknown_score).mapInArrow(releasing(_grouped), _LATTICE)
    return blocks, folded(lattice).mapInArrow(releasing(_answers(shared)), _ANSWER)


def encoded(docs: DataFrame, path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id and ids of every document."""
    model = _model(path)
    blocks, answers = _paths(docs, model, Shared(docs.sparkSession, model), block_words)
    return blocks.select("block", "documents").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ids_of, "doc_id long, ids array<int>")


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = model.value.raw
        for batch in batches:
            texts = [None if x is None else b"".join([raw[i] for i in x]).decode("utf-8", "replace")[1:] for x in batch["ids"].to_pylist()]
            others = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n != "text"), "text"])

    return run


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(Shared(rows.sparkSession, _model(path))), "doc_id long, ids array<int>, text string")


_DIGEST = "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, decoded_sha256 string"


def _n_chars(texts: pa.Array) -> np.ndarray:
    """Code points of each; what is no character counts as the signs that replace it."""
    try:
        return pc.utf8_length(texts.cast(pa.string())).to_numpy().astype(np.int64)
    except pa.ArrowInvalid:
        return np.array([len(x.decode("utf-8", "replace")) for x in texts.to_pylist()], np.int64)


def _digest(model):
    def digests(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """A text's pieces are its units', and so is the text that they stand for."""
        ids, sizes, tokens, flat, length = _of_block(blocks, answers)
        bounds = np.concatenate(([0], np.cumsum(length)))
        offsets, raw = inner(pa.array(model.value.raw, pa.binary()).take(pa.array(flat)))
        spelt, pieces = strings(offsets[bounds], raw), strings(bounds * 4, flat.astype("<u4").view(np.uint8))
        chars = _n_chars(spelt)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        rows, at = [], 0
        while at < len(sizes):
            # As many documents as have about so many units, one at least.
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + LOOKED_UP, side="right")) - 1)
            part, within = pa.array(tokens[ends[at] : ends[stop]]), ends[at : stop + 1] - ends[at]
            (of_ids, own), (of_text, text) = inner(pieces.take(part)), inner(spelt.take(part))
            n_chars = np.diff(np.concatenate(([0], np.cumsum(chars[tokens[ends[at] : ends[stop]]])))[within]) - (sizes[at:stop] > 0)
            own, text, of_ids, of_text = memoryview(own), memoryview(text), of_ids[within].tolist(), of_text[within].tolist()
            for i, n in enumerate(n_chars.tolist()):
                a, b = of_ids[i], of_ids[i + 1]
                rows.append(((b - a) // 4, zlib.crc32(own[a:b]), n, hashlib.sha256(text[of_text[i] + 1 : of_text[i + 1]]).hexdigest()))
            at = stop
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[x.split()[0] for x in _DIGEST.split(", ")])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = digests(blocks, answers)
        release()
        return out

    return run


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Of every document: how many pieces it has, the checksum of their ids, and length and digest of the text decoded from them.

    Encoding's last step, decoding and the digest run in one Python task.
    """
    model = _model(path)
    shared = Shared(docs.sparkSession, model)
    blocks, answers = _paths(docs, model, shared, BLOCK_WORDS)
    return blocks.select("block", "documents").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_digest(shared), _DIGEST)
