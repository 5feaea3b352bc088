"""What the operators share: input tables, scratch tables in the shared folder, and joins that stand hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here, inside a character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: About how many bytes one Arrow batch carries to Python: texts differ in length, so batches are bounded by bytes, not by rows.
ARROW_BYTES = 4 << 20
_BYTES, _ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless the caller has set a bound.

    Spark reads the setting when a plan runs, which is after an operator that gives a plan has returned; so it is left set.
    """
    if spark.conf.get(_BYTES, None) in (None, "-1", str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set(_BYTES, str(ARROW_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; removed at exit.

    Where the setting is missing, as in tests, a folder of this machine serves, but only in local mode.
    """
    sc = spark.sparkContext
    if sc.applicationId in _roots:
        return _roots[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="robolake-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/robolake-{sc.applicationId}"
    _roots[sc.applicationId] = root
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the session has ended first: the folder is left for the cluster's own cleaning
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The tables that one call writes in the shared folder. Leaving its block drops all but those made by result().

    A written table cuts the lineage and survives the loss of executors. result() serves for what the caller goes on
    reading; it stays until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch(self.spark, tag)
        self.paths.append(path)
        return table_at(df, path)

    def drop_older(self) -> None:
        """Drop all tables but the one written last, which no longer needs them."""
        for path in self.paths[:-1]:
            drop_path(self.spark, path)
        del self.paths[:-1]

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        return table_at(df, scratch(self.spark, tag))


def table_at(df: DataFrame, path: str) -> DataFrame:
    """df written at a new path, and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: lookup() treats a key as hot from this share of all rows on; so at most HOT_PARTS keys are hot.
HOT_PARTS = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left, inner-joined by key with right, which has one row a key and in ``count`` the number of left's rows with it.

    Keys with at least 1/HOT_PARTS of all rows, of which there are at most HOT_PARTS, are broadcast; so a
    row with such a key isn't moved, and what is shuffled has only keys of few rows. Both sides are read
    twice and should be written tables. A null key finds nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    bar = max(2, -(-total // HOT_PARTS))
    hot, cold = right.filter(F.col(count) >= bar), right.filter(F.col(count) < bar)
    a = left.join(F.broadcast(hot), key)
    b = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return a.unionByName(b)


RUNS = "key long, id long, n long, pivot long, pivot_n long, edge long"


def shared_keys(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """rows (key, id, n), no pair (key, id) twice -> those whose key has another id too, with the key's pivot, a smaller id, and its n.

    One shuffle by ranges of (key, id), so that a key of any number of rows is spread over as many tasks as it fills; in a sorted
    task a key's rows are neighbours, and a key of one row is dropped where it stands. Only a task's first and last key
    may go on in another task: for these it says how its part begins, two rows a task, and from those come the rows that join the
    parts: the pivot of each part has the smallest pivot of the key as its own. So a key's rows hang together by their pivots.
    """
    dealt = rows.select("key", "id", F.col("n").cast("long").alias("n")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    runs = tmp.written(dealt.mapInArrow(_runs, RUNS), "runs")
    edges = runs.filter("edge > 0")  # two rows a task
    heads = edges.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.sum("edge").alias("m"), F.count(F.lit(1)).alias("parts"))
    heads = heads.filter("parts > 1").select("key", F.col("p.id").alias("first"), F.col("p.n").alias("first_n"))
    ties = edges.join(F.broadcast(heads), "key").select("key", "id", "n", F.col("first").alias("pivot"), F.col("first_n").alias("pivot_n"))
    return runs.filter("edge = 0").drop("edge").unionByName(ties)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: each row of a key that has another here, edge 0; for the first and the last key its first row, edge its number of rows here."""
    names = [f.split()[0] for f in RUNS.split(", ")]
    first = held = None  # the first key's head; the last key met so far: key, id, n, rows

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for b in batches:
        if not b.num_rows:
            continue
        key, ids, n = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
        more = 0
        if held:
            more = 1 if held[3] == 1 else 0  # a key's first row is told when its second comes
            key, ids, n = (np.concatenate([[h], x]) for h, x in zip(held[:3], (key, ids, n), strict=True))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        count = size.copy()
        if held:
            count[0] += held[3] - 1
        run = np.repeat(np.arange(len(begin)), size)
        shared = count[run] > 1
        if held and not more:
            shared[0] = False
        head = begin[run]
        if shared.any():
            yield batch(key[shared], ids[shared], n[shared], ids[head][shared], n[head][shared], np.zeros(int(shared.sum()), np.int64))
        heads = [(int(key[k]), int(ids[k]), int(n[k]), int(c)) for k, c in ((begin[0], count[0]), (begin[-1], count[-1]))]
        if first is None or first[0] == heads[0][0]:
            first = heads[0]
        held = heads[1]
    if held:
        ends = [first] if first[0] == held[0] else [first, held]
        yield batch(*([e[k] for e in ends] for k in (0, 1, 2, 1, 2, 3)))
