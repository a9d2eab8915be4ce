"""What several operators share: tables, learning folds, shared storage and hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % folds).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _local.setdefault("top", tempfile.mkdtemp(prefix="pairflow-"))
    return f"{top}/pairflow-{uuid.uuid4().hex}"


#: Tables in the shared folder that are there still, with their sessions.
_there: dict[str, SparkSession] = {}


class _Open(threading.local):
    """The scopes that are open in a thread."""

    def __init__(self):
        self.scopes: list[list[tuple[str, DataFrame]]] = []


_open = _Open()


def written(frame: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends there and survives lost executors.

    It goes with the scope that it is written in (``scratch``), or when Python ends.
    """
    spark, path = frame.sparkSession, shared_folder(frame.sparkSession)
    if not _there:
        atexit.register(_clear)
    _there[path] = spark
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    if _open.scopes:
        _open.scopes[-1].append((path, out))
    return out


def _delete(path: str) -> None:
    spark = _there.pop(path)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def _clear() -> None:
    for path in list(_there):
        # The session may be over: then its folder stays to whoever owns it.
        with suppress(Exception):
            _delete(path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those in the list that is given, which the outer scope takes over."""
    kept: list[DataFrame] = []
    _open.scopes.append([])
    try:
        yield kept
    finally:
        for path, frame in _open.scopes.pop():
            if not any(frame is x for x in kept):
                _delete(path)
            elif _open.scopes:
                _open.scopes[-1].append((path, frame))


def rows_upto(frame: DataFrame, bound: int) -> bool:
    """Whether the frame has no more than ``bound`` rows; reads no further than that."""
    return frame.limit(bound + 1).count() <= bound


class Shared:
    """An object for the executors' Python workers: sent once, pickled by value, so that they need no package of ours."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return self._sent

    def __setstate__(self, sent):
        self._sent, self._own = sent, None

    @property
    def value(self):
        if self._own is None:
            self._own = cloudpickle.loads(self._sent.value)
        return self._own


def release() -> None:
    """Gives back to the system what Arrow and the C library keep for later: a worker waits for its next task with all that it ever held."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable) -> Callable:
    """For mapInArrow: the same function, which gives memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def inner(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins, and the end; all bytes."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    raw = strings.buffers()[2]
    return offsets - offsets[0], np.frombuffer(raw or b"", np.uint8)[offsets[0] : offsets[-1]]


def strings(offsets: np.ndarray, raw: np.ndarray) -> pa.Array:
    """The reverse of ``inner``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def one_dictionary(parts: list[pa.DictionaryArray]) -> tuple[list[np.ndarray], pa.Array]:
    """The parts' places in one dictionary, and that."""
    chunks = pa.chunked_array(parts).unify_dictionaries().chunks
    return [c.indices.to_numpy() for c in chunks], chunks[0].dictionary


def in_parts(words: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes; of nothing one, which is empty."""
    begin = inner(words)[0][:-1]
    at = np.flatnonzero(np.diff(begin // most, prepend=-1)).tolist() or [0]
    for a, b in zip(at, [*at[1:], len(words)], strict=True):
        yield words.slice(a, b - a)


U64 = np.uint64
_MUL = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * _MUL[0]
    x ^= x >> U64(33)
    x = x * _MUL[1]
    x ^= x >> U64(33)
    return x


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], dtype=U64)
#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = bytes([32, 9, 10, 11, 12, 13])
_KIND = np.ones(256, dtype=bool)
_KIND[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of some texts joined by blanks: the bytes, each word's start, end and hash, words per text, and where each text and the blank after it end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    per_text: np.ndarray
    text_ends: np.ndarray


def scan_words(texts: list[str | None], lower: bool = True) -> Words:
    """Words are runs of bytes other than ``SPACES``; A-Z count as a-z in hashes if ``lower``.

    A word's hash depends on its bytes alone. Null counts as empty.
    """
    coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    inside = _KIND[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    per_text = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    if not len(starts):
        return Words(raw, starts, ends, np.zeros(0, U64), per_text, text_ends)
    lengths = ends - starts
    since = np.arange(len(raw), dtype=np.int64) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    values = ((_LOWER[raw] if lower else raw).astype(U64) + U64(1)) * _POWERS[since & 63]
    values[~inside] = 0
    sums = np.add.reduceat(values, starts)
    # Past 64 bytes the powers repeat: there each byte is mixed with its place.
    for i in np.flatnonzero(lengths > 64).tolist():
        a, b = starts[i], ends[i]
        sums[i] = mix(values[a:b] ^ mix(since[a:b].astype(U64))).sum(dtype=U64)
    return Words(raw, starts, ends, mix(sums ^ (lengths.astype(U64) * U64(0x9FB21C651E98DF25))), per_text, text_ends)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, words per text, and bytes per word."""
    w = scan_words(texts, lower)
    return w.hashes, w.per_text, w.ends - w.starts


def together(texts: pa.Array, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of a string array with about ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n + 8
    if start < len(sizes):
        yield slice(start, len(sizes))
