"""Tables written in the shared folder between the rounds of an iteration: they cut the lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, as in tests, on this machine, but only in local mode.

    All folders of an application lie in one, which goes when the application ends.
    """
    sc = spark.sparkContext
    root = _roots.get(sc.applicationId)
    if not root:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="robolake-core-")
        root = _roots[sc.applicationId] = f"{base.rstrip('/')}/robolake-core-{sc.applicationId}"
        atexit.register(_drop_quietly, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session has ended first: the folder is left for the cluster's own cleaning
        pass


class Rounds:
    """Tables of an iteration. Leaving the block drops all but the one given last by result(), which goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[str] = []

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        for p in self.paths:
            drop(self.spark, p)

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "round")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Written so that joins on key don't move its rows: as a table of as many buckets as shuffles have partitions, sorted by key."""
        path = shared_folder(self.spark, "round")
        self.paths.append(path)
        self.tables.append(table := f"robolake_round_{uuid.uuid4().hex[:12]}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def result(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "result")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """Session settings that hold within it; what they were before is set again."""
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
