"""Shared plumbing: scratch tables in the cluster's shared folder, connected components, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error,
    because its executors would not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove_local, found[7:])
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Named tables that one operator call writes to the shared folder, which cuts lineage.

    A written table survives the loss of any executor. ``drop`` frees one that is no longer read; what is left goes when
    the application ends, as its result may be read until then.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path, system = _located(spark, self.base)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, *, batch_bytes: int | None = None) -> DataFrame:
        """``batch_bytes``: of the Arrow batches that Python workers get meanwhile, unless the session sets them."""
        schema = df.schema
        before = self.spark.conf.get(CLEANUP, "false")
        bound = batch_bytes is not None and self.spark.conf.get(BATCH_BYTES, None) is None
        self.spark.conf.set(CLEANUP, "true")  # the shuffles of this write are of no use after it
        if bound:
            self.spark.conf.set(BATCH_BYTES, str(batch_bytes))
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
            if bound:
                self.spark.conf.unset(BATCH_BYTES)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """A table that ``save`` has written."""
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def _located(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _located(spark, path)
    return system.exists(at)


def make_dir(spark: SparkSession, path: str) -> None:
    at, system = _located(spark, path)
    system.mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    at, system = _located(spark, path)
    system.delete(at, True)


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct, ``row``, beside which an operator's own columns clash with none; ``row.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Gives freed memory back to the system, as a Python worker outlives its task beside others."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of equal ``key`` in a partition that is sorted by it; a run may span batches."""
    at: object = None
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != at:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


#: Edges that one task joins at most, 32 bytes each; larger graphs take rounds over all tasks.
SINGLE_TASK_EDGES = 1_000_000


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    table = pa.Table.from_batches(batches, pa.schema([("a", pa.binary()), ("b", pa.binary())])).combine_chunks()
    ends = pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks] or [pa.array([], pa.binary())]).dictionary_encode()
    nodes = ends.dictionary.to_pylist()
    by_rank = sorted(range(len(nodes)), key=nodes.__getitem__)
    rank = np.empty(len(nodes), np.int64)
    rank[by_rank] = np.arange(len(nodes))
    a, b = np.split(rank[ends.indices.to_numpy()], 2)
    root = np.arange(len(nodes))
    while True:  # roots sink along edges, and roots of roots are followed
        lower = root.copy()
        np.minimum.at(lower, a, root[b])
        np.minimum.at(lower, b, root[a])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    sorted_nodes = [nodes[i] for i in by_rank]
    for i in range(0, len(nodes), 50_000):
        part = root[i : i + 50_000].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(sorted_nodes[i : i + 50_000], pa.binary()), pa.array([sorted_nodes[r] for r in part], pa.binary())], ["node", "component"])


def connected_components(scratch: Scratch, edges: DataFrame, name: str, single_task_edges: int = SINGLE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)`` of binary nodes; component is the smallest node in it.

    A graph whose count of edges shows it to be small is joined in one task. Else it alternates large-star and small-star steps, so the rounds grow with the logarithm of the diameter. Each
    step moves edges by key only; no task needs the edges of a node together, as minima are pre-aggregated and
    the joins are plain sort-merge joins, which adaptive execution splits at hot nodes.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    if edges.count() <= single_task_edges:
        return map_arrow(edges.repartition(1), _components, "node binary, component binary")
    step = 0
    last = (-1, None)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = scratch.save(least, f"{name}-least-{step}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"{name}-large-{step}")
        # each node keeps its smaller neighbours only: they and the node are linked to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        step += 1
        edges = scratch.save(small.where("a <> b").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-least-{step - 1}", f"{name}-large-{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
