"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. A batch is reduced to one row per digest, matched to
the index by a sort-merge anti-join that moves only the batch, and its digests are appended bucket by bucket: new
ones with the row that stays, known ones with the number of rows that the batch adds. Compaction merges them.

A batch has a key, by default a digest of its ids and texts. Rows that the index has under the same key do not count as
known, and are not appended again: a run that is repeated after a loss gives what the first one gave.

Defined results: a null text counts as empty; texts are compared without any change; of equal texts in a batch the
row with the largest id stays (a null id only if all are null), and exactly one of rows that repeat both id and text;
a text that an earlier batch brought keeps that batch's row. An empty batch gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, exists, remove, row_of, shared_dir

DIGEST = "digest"
ENTRY = [DIGEST, "keep_id", "n_rows", "batch"]


def digest_of(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far: ``digest binary, keep_id long, n_rows long, batch string``, a row for each digest of each batch."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64) -> None:
        """Opens the index at ``path`` (by default in the shared folder), or creates it; its number of buckets is fixed then."""
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or f"{shared_dir(spark)}/index-{name}"
        made = f"{self.path}.buckets"
        if exists(spark, made):
            had = spark.read.schema("buckets int").json(made).first()[0]
            if had != buckets:
                raise ValueError(f"the index at {self.path} has {had} buckets, not {buckets}")
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(made)
        self._declare(name, self.path)

    def _declare(self, name: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({DIGEST} BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """``digest, old_id, old_rows`` of the texts that other batches brought; buckets are grouped where they are."""
        own = self.table().where(F.col("batch") != batch)
        return own.groupBy(DIGEST).agg(F.max("keep_id").alias("old_id"), F.sum("n_rows").alias("old_rows"))

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest no other batch has brought."""
        return groups.join(self.table().where(F.col("batch") != batch).hint("merge"), DIGEST, "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds a batch's digests unless they are there; a task writes whole buckets, so each append adds a file to each."""
        if not self.table().where(F.col("batch") == batch).take(1):
            rows.select(*ENTRY).repartition(self.buckets, DIGEST).write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Merges all batches into one row per digest and one file per bucket; their keys are then forgotten."""
        merged, path = f"{self.name}_merged", f"{self.path}.merged"
        remove(self.spark, path)
        self._declare(merged, path)
        rows = self.table().groupBy(DIGEST).agg(F.max("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows")).withColumn("batch", F.lit("merged"))
        rows.select(*ENTRY).repartition(self.buckets, DIGEST).write.insertInto(merged)
        self.spark.table(merged).write.insertInto(self.name, overwrite=True)
        self.spark.sql(f"DROP TABLE {merged}")
        remove(self.spark, path)
        self.spark.catalog.refreshTable(self.name)

    def remove(self, files: bool = False) -> None:
        """Drops the table; its files stay, as those of any external table, unless they are to go."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            remove(self.spark, self.path)
            remove(self.spark, f"{self.path}.buckets")


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``; the index then has the batch too."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias(DIGEST))
    rows = scratch.save(rows, "rows")
    if batch is None:
        total = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", DIGEST).cast("decimal(38,0)")), F.sum(F.xxhash64(DIGEST, F.lit(1), "doc_id").cast("decimal(38,0)"))).first()
        batch = "-".join(map(str, total))
    groups = scratch.save(rows.groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_rows")), "groups")
    fresh = scratch.save(index.unseen(groups, batch), "fresh")
    seen = groups.join(fresh.select(DIGEST), DIGEST, "left_anti").join(index.before(batch), DIGEST)
    size = F.col("n_rows") + F.col("old_rows")
    decided = fresh.select(DIGEST, "keep_id", "n_rows", F.col("n_rows").alias("group_size"), F.lit(True).alias("fresh")).union(
        seen.select(DIGEST, F.col("old_id").alias("keep_id"), "n_rows", size.alias("group_size"), F.lit(False).alias("fresh"))
    )
    decided = scratch.save(decided, "decided")
    index.append(decided.withColumn("batch", F.lit(batch)), batch)
    # equal rows meet first, so that one of them stays; then each digest's decision joins, split where a digest is hot
    rows = rows.groupBy(DIGEST, "doc_id").agg(F.count("*").cast("int").alias("n"))
    rows = scratch.save(rows, "distinct")
    scratch.drop("rows", "groups", "fresh")
    stays = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    joined = rows.join(decided, DIGEST).withColumn("stays", stays)
    return joined.select("doc_id", "keep_id", "group_size", DIGEST, "stays", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), DIGEST
    )


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = dedup(docs, index, id_col, text_col, batch).where("kept").select("doc_id", DIGEST)
    rows = docs.select(row_of(docs), digest_of(text_col).alias(DIGEST), F.col(id_col).cast("long").alias("doc_id"))
    on = rows[DIGEST].eqNullSafe(kept[DIGEST]) & rows["doc_id"].eqNullSafe(kept["doc_id"])
    found = rows.join(kept, on, "left_semi")
    # rows that repeat both id and text all match: one of each stays
    one = Window.partitionBy(DIGEST, "doc_id").orderBy(F.lit(1))
    return found.withColumn("copy", F.row_number().over(one)).where("copy = 1").select("row.*")
