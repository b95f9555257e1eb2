"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import remove_scratch, scratch_path

#: The ASCII white space that the contracts name: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A narrow table that several steps read is computed once, and a lost
    executor costs a re-read instead of a recomputation from the corpus.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing still to be computed reads."""
    for t in tables:
        remove_scratch(t.sparkSession, t._stored_path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


#: Byte table: A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def byte_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return (text or b"").translate(WORD_BYTES).split()


_RANDOM = np.random.default_rng(17).integers(0, 1 << 63, 256 + 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE = _RANDOM[:256], _RANDOM[256:]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``byte_words``) of all texts, one after the other, and each text's number of words.

    A word's hash is a sum over its bytes, so that numpy makes all of them at once.
    """
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join([t or b"" for t in texts]).translate(WORD_BYTES) + b" ", np.uint8)
    inside = data != 32
    first = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    letters = np.flatnonzero(inside)
    at = np.searchsorted(letters, first)
    n = np.diff(np.append(at, len(letters)))
    place = (letters - np.repeat(first, n)) & 63
    h = np.add.reduceat(_BYTE[data[letters]] * _PLACE[place], at)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.searchsorted(first, np.cumsum(sizes))
    return h ^ (h >> np.uint64(29)), np.diff(ends, prepend=0)


def row_slices(batch: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts in column ``col`` have at most ``most`` bytes together, or a single row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return to the system what this process has freed, which its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def giving_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``, with the memory given back at its end.

    Spark uses a Python worker for many tasks, so that what one of them needed would stay
    beside the next one's, up to the sum of an executor's largest tasks of any kind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()
    return run


#: At most this many keys are too frequent for a shuffle join.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, total: int, at_least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row per key that counts its rows in column ``count``.

    A key with more than one in ``HOT_KEYS`` of all ``total`` rows would be much work
    for one task. There are fewer than ``HOT_KEYS`` such keys, whatever the input, so
    they are broadcast and their rows stay where they are; the other rows shuffle.
    """
    most = max(at_least, total // HOT_KEYS)
    hot = F.broadcast(keyed.filter(F.col(count) > most).drop(count))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti").join(keyed.filter(F.col(count) <= most).drop(count), list(keys))
    return rows.join(hot, list(keys)).unionByName(rest)
