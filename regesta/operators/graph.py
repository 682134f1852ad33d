"""Connected components and guarded clustering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .resolve import folded

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset a single-machine session takes a temporary
    folder; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="regesta-graph-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder."""
    path = folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def onward(hops: list[DataFrame]) -> DataFrame:
    """node, label of hops (node, label) that follow each other: a label that is no node of the next hop stays."""
    labels = hops[0]
    for hop in hops[1:]:
        up = hop.select(F.col("node").alias("at"), F.col("label").alias("up"))
        labels = labels.join(up, labels.label == up["at"], "left").select("node", F.coalesce("up", "label").alias("label"))
    return labels


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for edges (a, b). In each round every node goes to the smallest of itself and
    its neighbours, on to the end of that chain, and the edges between the ends are left for the next: the nodes halve at
    least, and edges within a tree are gone."""
    rest, hops = saved(edges.select("a", "b").where("a <> b")), []
    while not hops or not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
        while True:
            ends = hop.select(F.col("label").alias("node")).distinct()
            up = saved(hop.where("node <> label").join(ends, "node", "left_semi").select(F.col("node").alias("at"), F.col("label").alias("up")))
            if up.isEmpty():
                break
            hop = saved(hop.join(up, hop.label == up["at"], "left").select("node", F.coalesce("up", "label").alias("label")))
        hops.append(hop)
        for e in "ab":
            rest = rest.join(hop.select(F.col("node").alias(e), F.col("label").alias(f"{e}_")), e)
        rest = saved(rest.where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    return onward(hops)


PAIRS = 2_000_000  # pairs merged by one task at a time


def guard(xs: list, ys: list, xlo: list, xhi: list, ylo: list, yhi: list, cap: int) -> list[list]:
    """The smallest nodes of the groups of x and y after all pairs were merged in order."""
    place, up, size, least, lo, hi = {}, [], [], [], [], []

    def find(n, low, high) -> int:
        i = place.get(n)
        if i is None:
            i = place[n] = len(up)
            up.append(i), size.append(1), least.append(n), lo.append(low), hi.append(high)
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for x, y, a0, a1, b0, b1 in zip(xs, ys, xlo, xhi, ylo, yhi):
        i, j = find(x, a0, a1), find(y, b0, b1)
        if i == j:
            continue
        low = lo[i] if lo[j] is None else lo[j] if lo[i] is None else min(lo[i], lo[j])
        high = hi[i] if hi[j] is None else hi[j] if hi[i] is None else max(hi[i], hi[j])
        if low is None or high is None or high - low <= cap:
            if size[i] < size[j]:
                i, j = j, i
            up[j], lo[i], hi[i], least[i] = i, low, high, min(least[i], least[j])
            size[i] += size[j]
    return [[least[find(x, None, None)], least[find(y, None, None)]] for x, y in zip(xs, ys)]


def guarded_clusters(nodes: DataFrame, pairs: DataFrame, cap: int = 80) -> DataFrame:
    """node, cluster (its smallest node): pairs (a, b, seq) are merged in the order of seq, a, b unless the joint span of
    years (lo, hi) would pass cap. nodes: node, lo, hi; an unknown bound, or a node without a row, refuses nothing.

    Spans only grow, so a pair that is refused now is refused for good and goes. What is left falls into components that
    don't touch each other: each is merged pair by pair in one task. Of one with more than PAIRS pairs the first PAIRS in
    order are merged; the others then join the groups made of them, lose the pairs refused by now, and go on.
    """
    span = nodes.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = saved(pairs.where("a <> b").select("a", "b", "seq"))
    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rest, hops = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("seq", "a", "b").alias("at")), []
    kind = rest.schema["x"].dataType
    while True:
        for e in "xy":
            rest = rest.join(span.select(F.col("node").alias(e), F.col("lo").alias(f"{e}lo"), F.col("hi").alias(f"{e}hi")), e, "left")
        joint = F.greatest("xhi", "yhi") - F.least("xlo", "ylo")
        rest = saved(rest.where("x <> y").where(~F.coalesce(joint > cap, F.lit(False))))
        if rest.isEmpty():
            break
        labels = component_labels(rest.select(F.col("x").alias("a"), F.col("y").alias("b")))
        rest = saved(rest.join(labels.withColumnRenamed("node", "x"), "x"))
        large = saved(rest.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS).select("label"))
        first, more = rest, not large.isEmpty()
        if more:
            begun = rest.join(large, "label", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("at"))).where(F.col("rank") <= PAIRS)
            ends = saved(begun.groupBy("label").agg(F.max("at").alias("upto")))
            rest = saved(rest.join(ends, "label", "left"))
            first = rest.where("upto is null or at <= upto").drop("upto")
        dealt = first.select("label", "at", "x", "y", "xlo", "xhi", "ylo", "yhi").repartition("label").sortWithinPartitions("label", "at").drop("at")
        done = folded(dealt, ["label"], "into", T.ArrayType(kind), lambda *c: guard(*c, cap), ["x", "y", "xlo", "xhi", "ylo", "yhi"])
        into = F.explode(F.array(*[F.struct(F.col(e).alias("node"), F.get("into", F.lit(k)).alias("label"), F.col(f"{e}lo").alias("lo"), F.col(f"{e}hi").alias("hi")) for k, e in enumerate("xy")])).alias("r")
        hop = saved(done.select(into).select("r.*").distinct())
        hops.append(hop.select("node", "label"))
        if not more:
            break
        grown = hop.groupBy(F.col("label").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        span = saved(grown.unionByName(span.join(hop.select("node"), "node", "left_anti")))
        rest = rest.where("at > upto").select("x", "y", "at")
        for e in "xy":
            rest = rest.join(hop.select(F.col("node").alias(e), "label"), e, "left").withColumn(e, F.coalesce("label", e)).drop("label")
    labels = members.select("node", F.col("node").alias("label"))
    return onward([labels, *hops]).select("node", F.col("label").alias("cluster"))
