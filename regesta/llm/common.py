"""Shared helpers of the corpus operators: column picking, shared tables, connected components.

Every operator names the columns it reads; other columns are ignored, whatever they are called. Intermediate tables
go to the folder in ``spark.checkpoint.dir`` (all executors see it). Where it is unset a single-machine session
(master local[n]) takes a temporary folder of this process; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="regesta-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        base = f"file://{_own['dir']}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, found by exact name and position, so that `Text` beside `text` does no harm."""
    names = df.columns
    flat = df.toDF(*[f"c{i}_" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(source)}_").alias(out) for out, source in columns.items()])


def kept_columns(df: DataFrame, build) -> DataFrame:
    """build(flat, ref) filters or repeats rows of df under safe names; the original names return afterwards.

    ref(name) is the Column of an original column.
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}_" for i in range(len(names))])
    out = build(flat, lambda name: F.col(f"c{names.index(name)}_"))
    return out.select(*[f"c{i}_" for i in range(len(names))]).toDF(*names)


def located(docs: DataFrame) -> DataFrame:
    """docs with its rows' places in files; a frame that doesn't come straight from files is written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        names = docs.columns
        return stored(docs.toDF(*[f"c{i}_" for i in range(len(names))]), "placed").toDF(*names)


def placed(docs: DataFrame) -> DataFrame:
    """The columns of a located frame, with place_file_ and place_row_ at the end: a row's place, unlike its id, is its own."""
    return docs.select("*", F.col("_metadata.file_path").alias("place_file_"), F.col("_metadata.row_index").alias("place_row_"))


def by_place(docs: DataFrame, marks: DataFrame, how: str, most: int = 250_000) -> DataFrame:
    """A located frame joined by place to marks (file, row, and more); columns c0_, c1_, ... and those of marks. At most
    most rows of marks are broadcast."""
    at = placed(docs).toDF(*[f"c{i}_" for i in range(len(docs.columns))], "place_file_", "place_row_")
    small = marks.count() <= most
    return at.join(F.broadcast(marks) if small else marks, (F.col("place_file_") == F.col("file")) & (F.col("place_row_") == F.col("row")), how)


def let(value: Column, body) -> Column:
    """body(v) with value computed once a row: v is a lambda's variable, which the optimizer can't inline."""
    return F.transform(F.array(value), body)[0]


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Shuffle partitions for the rows of df: the session's setting, or more where a task would get over task_bytes of
    what the scan is known to read."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, known // task_bytes))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node of links; label is the smallest node reachable.

    Min-label rounds with pointer jumping; each round is aggregations and joins of one row a node or link, written to
    the shared folder. Links with a null end are ignored.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = stored(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-links")
    labels = stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node"), "cc-labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        step = step.join(jump, step.label == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = stored(step, "cc-labels")
        labels = step.select("node", "label")
        if step.where("was <> label").limit(1).count() == 0:
            return labels
