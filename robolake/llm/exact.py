"""Exact deduplication against a persistent digest index, bucketed and sorted by hash. DataFrame operations only.

The index is a Parquet table with one row for each text ever kept: its digest, the id that stands for it, the name of the batch
that brought it and how many rows that has of it; a later batch adds a row for each known digest with its number of rows. A batch is reduced to
one row a digest before anything is compared; a sort-merge anti-join with the index, whose bucketed and sorted side isn't shuffled, leaves
the new digests, which are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, drop_path, lookup, scratch


def normalise(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalise(text), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the digest of the normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))


class DigestIndex:
    """A table of digests at a path. Opening a path that holds an index goes on with it, in any later application too.

    The number of buckets is written beside the data when the index is made; opening reads it, and raises if another number is asked for or the
    path holds data without one. Without a number a new index gets the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        held = _held_buckets(spark, path)
        if held is not None and buckets not in (None, held):
            raise ValueError(f"the index at {path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if held is None:
            _hold_buckets(spark, path, self.buckets)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING, own BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        if told.get("Num Buckets") != str(self.buckets):
            raise ValueError(f"a table {name} with {told.get('Num Buckets')} buckets exists already")

    def table(self) -> DataFrame:
        """A row for each text ever kept: digest, keep_id, its batch and the number of rows it has there."""
        return self.spark.table(self.name).filter("own").drop("own")

    def drop(self) -> None:
        """Forget the index: its name and its files. What ingest() has given stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)

    def new_digests(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch has brought: a sort-merge anti-join."""
        return groups.join(self.table().filter(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Take the rows (doc_id, digest) of a batch into the index: its new digests, and how many rows it has of known ones.

        What the index already has of this batch, all or a part after a loss, isn't added again.
        """
        with Scratch(self.spark) as tmp:
            groups = tmp.written(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "groups")
            mine = self.spark.table(self.name).filter(F.col("batch") == batch).select("digest")
            todo = groups if mine.isEmpty() else groups.join(mine.hint("merge"), "digest", "left_anti")
            new = tmp.written(self.new_digests(todo, batch), "new")
            added = new.select("*", F.lit(batch).alias("batch"), F.lit(True).alias("own"))
            known = todo.join(new.select("digest").hint("merge"), "digest", "left_anti")
            known = known.select("digest", F.lit(None).cast("long").alias("keep_id"), "n", F.lit(batch).alias("batch"), F.lit(False).alias("own"))
            added.unionByName(known).repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def judge(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """What the index says of written rows (doc_id, digest) that it has taken in: all of them, or those of a batch alone.

        doc_id, keep_id, group_size (rows with the digest, of the batch if one is given), kept, text_sha256.
        """
        n = F.sum("n" if batch is None else F.when(F.col("batch") == batch, F.col("n"))).alias("group_size")
        first = F.max(F.when(F.col("own"), F.struct("keep_id", "batch"))).alias("first")
        with Scratch(self.spark) as tmp:
            groups = self.spark.table(self.name).groupBy("digest").agg(n, first).filter("group_size is not null")
            each = lookup(rows, tmp.written(groups, "groups"), "digest", "group_size")
            own = F.lit(True) if batch is None else F.col("first.batch") == batch
            kept = (own & F.col("doc_id").eqNullSafe(F.col("first.keep_id"))).alias("kept")
            told = each.select("doc_id", "first.keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))
            return tmp.result(told, "op2")

    def ingest(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and the index, append what is new, and tell for each row what became of it.

        Gives doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256. Of equal texts in a
        batch the smallest id stays, unless an earlier batch has kept one. Null texts equal empty ones. A null id never
        stands for a group that has another id; alone it stays with keep_id null. Rows that repeat both id and text stay or go together.
        Other columns aren't read. No rows give no rows.

        Under the same ``batch`` name the same rows can be ingested again, after a loss at any moment: digests that the index has from this
        batch are its own, so the answer is the one that the first run gave or would have given. Without a name each call is a batch of its own.
        """
        batch = batch or uuid.uuid4().hex
        with Scratch(self.spark) as tmp:
            rows = tmp.written(digests(docs, id_col, text_col), "rows")
            self.add(rows, batch)
            return self.judge(rows, batch)


def _marker(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")  # tables don't read names that begin so
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _held_buckets(spark: SparkSession, path: str) -> int | None:
    fs, p = _marker(spark, path)
    if fs.exists(p):
        stream = fs.open(p)
        try:
            return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    if fs.exists(p.getParent()) and len(fs.listStatus(p.getParent())):
        raise ValueError(f"{path} holds files, but no index")
    return None


def _hold_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    fs, p = _marker(spark, path)
    out = fs.create(p, True)
    out.writeBytes(str(buckets))
    out.close()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a table by an index of its own, in two batches of ascending ids; ids that are null come with the last.

    The second half is judged by the anti-join with what the first has left in the index, and what is told of all rows is read from the index. As the
    first batch has the smaller ids, the smallest id of a text stays; the rest is as DigestIndex.ingest() says. The index is dropped.
    """
    spark = docs.sparkSession
    with Scratch(spark) as tmp:
        rows = tmp.written(digests(docs, id_col, text_col), "rows")
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        index = DigestIndex(spark, f"digests_{uuid.uuid4().hex[:12]}", scratch(spark, "digests"))
        late = F.coalesce(F.col("doc_id") > middle, F.lit(True)) if middle is not None else F.lit(True)
        for batch, part in (("smaller ids", ~late), ("larger ids", late)):
            index.add(rows.filter(part), batch)
        told = index.judge(rows)
        index.drop()
        return told


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
