"""Helpers that several operators use: written tables, size-checked broadcasts, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.session import shared_folder

#: Rows of one narrow table (an id and a few numbers) that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def settled(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written (with writer ``options``) to the shared folder and read back, so that lineage is short and
    work is done once."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow and already written) with a broadcast hint if it has few rows, else without one."""
    return F.broadcast(df) if df.count() <= rows else df


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch that a worker turns into Python objects together.
SMALL_BATCH = 1024


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that a worker never holds all texts of a batch as objects, nor the
    JVM all that a batch gives."""
    for batch in batches:
        for at in range(0, batch.num_rows, SMALL_BATCH):
            yield batch.slice(at, SMALL_BATCH)


def map_rows(df: DataFrame, rows_of: Callable[[dict], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with columns as Python lists: ``rows_of`` gets and gives ``{column: values}``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows_of(batch.to_pydict())
            yield pa.RecordBatch.from_pydict(made)

    return df.mapInArrow(run, schema)


# ---- hashes of word sequences -------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int, forward: bool) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse."""
    if len(_powers[forward]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if forward else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[forward] = np.multiply.accumulate(steps)
    return _powers[forward][:n]


class Words:
    """The words of a text (A-Z lower-cased if ``fold``, else bytes as ``table`` says), and 64-bit hashes of runs of them."""

    def __init__(self, text: str | None, fold: bool = True, table: bytes | None = None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = raw.translate(_LOWER if fold else table).split()
        self.n = len(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        codes = _BYTE[np.frombuffer(b" ".join(self.words), np.uint8)]
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power(len(codes), True), out=self._sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """A hash for each run of k words; one for the whole text if it has fewer; none without words."""
        if not self.n:
            return np.empty(0, np.uint64)
        k = min(k, self.n)
        starts, ends = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        inverse = _power(int(starts[-1]) + 1, False)[starts]
        return mixed((self._sums[ends] - self._sums[starts]) * inverse)


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(offsets, values)
