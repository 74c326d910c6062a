"""Tables written between the phases of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a session on one machine (master local[...]), as in
    tests, gets a temporary folder; any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="cuesmith-"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of a batch that goes to a Python worker: texts are long, and a batch is held on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where they are larger (Spark's own setting is 10,000)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when their query ends, not when the driver's JVM next collects garbage.
    For queries that run once: a plan that ran again would make its files anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Tables:
    """Written tables of one job. drop() deletes those that no later plan reads. With brief, shuffle files stay no longer
    than it takes to write a table."""

    def __init__(self, spark: SparkSession, brief: bool = False):
        self.spark, self.top, self.paths, self.brief = spark, scratch_dir(spark), {}, brief

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df to the shared folder and read it back: ends the lineage, computes once, survives lost executors."""
        path = f"{self.top}/{len(self.paths)}-{name}"
        with shuffles_removed(self.spark) if self.brief else nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """One written table that stays."""
    return Tables(df.sparkSession).cut(df, name)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from df's columns (in any case of letters)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name
