"""Helpers that several corpus operators share: staged tables, Arrow slicing, rolling hashes, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at together; bounds its memory whatever the batch size.
SLICE_BYTES = 8 << 20

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: a child of ``spark.checkpoint.dir``, which executors and driver share.

    Only where no such folder is configured and all runs on one machine, as in tests, a temporary one is set.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="riskweave-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/riskweave-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, root)
    except Exception:  # the JVM may have ended before this process does
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table's folder through Hadoop's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: lineage ends there.

    A later read survives the loss of any executor, and the plan gets real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, after their last use."""
    for df in tables:
        drop_path(df.sparkSession, df._staged_path)


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished phase go at once: each phase's result is a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (string or binary) holds about ``limit`` bytes at most, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its n rows (n + 1 of them); nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.fill_null(column, b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Rolling:
    """64-bit polynomial hashes of substrings, for whole arrays of symbols at once.

    Each symbol stands for a pseudo-random 64-bit value; sums are modulo 2**64 with an odd base, so that
    dividing a power out is a multiplication by the base's inverse.
    """

    def __init__(self, seed: int, symbols: int = 256) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = int(n * 1.2) + 16
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.cumprod(run, dtype=np.uint64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums, to be handed to ``of``."""
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[symbols] * self.powers[:n], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), mixed so that any bits of them can serve as a bucket."""
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (xor-shift-multiply): every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def crc_of_id(column):
    """crc32 of an id as text, as a column: decides folds."""
    return F.crc32(column.cast("string").cast("binary"))


def crc_of(value: int) -> int:
    return zlib.crc32(str(value).encode())


def connected(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (src, dst: long): one row (id, component = smallest id) per node with an edge.

    Alternating large-star and small-star rounds: every node's larger, then smaller neighbours are hung onto its
    smallest one, until all edges are stars. Only minima per node are aggregated (with map-side combining), no
    neighbour list is ever gathered; a hot centre is one side of an equi-join, which AQE can split. Each round is a
    staged table; the rounds grow with the logarithm of a component's diameter. Empty input gives an empty result.
    """
    with clean_shuffles(edges.sparkSession):
        edges = _stars(edges, tag)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _stars(edges: DataFrame, tag: str) -> DataFrame:
    """The edges (u, v), staged, after rounds until all of them are stars around their smallest node v."""
    edges = stage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), tag)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stage(small, tag)
        drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen = now
