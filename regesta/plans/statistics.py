"""Association and correlation measures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query

c = F.col


@query("zscore_log1p", "WITH l AS (SELECT o_orderkey, ln(1 + greatest(o_totalprice, 0)) AS x FROM orders), s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM l) SELECT o_orderkey, round((x - m) / sd, 5) AS z FROM l CROSS JOIN s")
def zscore_log1p(table):
    """Standardised logarithms; mean and deviation are one row, joined back."""
    x = table("orders").select("o_orderkey", F.log1p(F.greatest("o_totalprice", F.lit(0.0))).alias("x"))
    return x.crossJoin(F.broadcast(x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")))).select("o_orderkey", F.round((c("x") - c("m")) / c("sd"), 5).alias("z"))


def average_ranks(df, column: str, out: str):
    """df with the average rank of column: counts per value, then a running sum over the distinct values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_"))
    ranks = counts.withColumn(out, F.sum("n_").over(W.orderBy(column)) - (c("n_") - 1) / 2).drop("n_")
    return df.join(ranks, column)


@query(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r""",
)
def spearman(table):
    """Rank correlation with average ranks."""
    t = table("lineitem").select("l_quantity", "l_discount")
    return average_ranks(average_ranks(t, "l_quantity", "a"), "l_discount", "b").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("residual_one_control", "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS res FROM lineitem")
def residual_one_control(table):
    """Residuals on one control: group means by aggregation, joined back, as a control has few values."""
    t = table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    means = t.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return t.join(means, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(c("l_quantity") - c("m"), 6).alias("res"))


@query(
    "lift_pmi",
    """WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS t FROM orders), n AS (SELECT count(DISTINCT k) AS n FROM d), f AS (SELECT t, count(*) AS f FROM d GROUP BY t),
       p AS (SELECT a.t AS x, b.t AS y, count(*) AS together FROM d a JOIN d b ON a.k = b.k AND a.t < b.t GROUP BY 1, 2)
       SELECT x, y, together, round(CAST(together AS DOUBLE) * n / (fx.f * fy.f), 6) AS lift, round(log2(CAST(together AS DOUBLE) * n / (fx.f * fy.f)), 6) AS pmi FROM p JOIN f fx ON fx.t = x JOIN f fy ON fy.t = y CROSS JOIN n WHERE together >= 50""",
)
def lift_pmi(table):
    """Co-occurrence of classes in a dossier: a dossier's set holds each class once, so its pairs are bounded by the classes."""
    sets = table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    single = sets.select(F.explode("s").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    n = sets.agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    both = pairs.groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("together")).where("together >= 50")
    fx, fy = single.select(c("t").alias("x"), c("f").alias("fx")), single.select(c("t").alias("y"), c("f").alias("fy"))
    lift = c("together").cast("double") * c("n") / (c("fx") * c("fy"))
    return both.join(fx, "x").join(fy, "y").crossJoin(F.broadcast(n)).select("x", "y", "together", F.round(lift, 6).alias("lift"), F.round(F.log2(lift), 6).alias("pmi"))


@query(
    "cramers_v",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
       t AS (SELECT n, sum(n) OVER (PARTITION BY a) * CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) / sum(n) OVER () AS e FROM m), s AS (SELECT sum((n - e) * (n - e) / e) AS chi, CAST(sum(n) AS DOUBLE) AS n FROM t), k AS (SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS q FROM c)
       SELECT round(sqrt(greatest(0, chi / n - (r - 1) * (q - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, q - (q - 1) * (q - 1) / (n - 1) - 1)), 6) AS v FROM s CROSS JOIN k""",
)
def cramers_v(table):
    """Bias-corrected association of two classes, from their table of counts alone."""
    n = table("lineitem").groupBy(c("l_returnflag").alias("a"), c("l_linestatus").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    full = n.select("a").distinct().crossJoin(n.select("b").distinct()).join(n, ["a", "b"], "left").na.fill(0, ["n"])
    e = F.sum("n").over(W.partitionBy("a")) * F.sum("n").over(W.partitionBy("b")).cast("double") / F.sum("n").over(W.partitionBy(F.lit(1)))
    s = full.withColumn("e", e).agg(F.sum((c("n") - c("e")) * (c("n") - c("e")) / c("e")).alias("chi"), F.sum("n").cast("double").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("q"))
    r, q, m = c("r"), c("q"), c("n") - 1
    phi = F.greatest(F.lit(0.0), c("chi") / c("n") - (r - 1) * (q - 1) / m)
    return s.select(F.round(F.sqrt(phi / F.least(r - (r - 1) * (r - 1) / m - 1, q - (q - 1) * (q - 1) / m - 1)), 6).alias("v"))


@query(
    "corr_ratio",
    """WITH g AS (SELECT count(*) AS n, avg(value) AS m FROM events GROUP BY event_type), t AS (SELECT avg(value) AS m, var_pop(value) * count(*) AS ss FROM events) SELECT round(sqrt(sum(g.n * (g.m - t.m) * (g.m - t.m)) / min(t.ss)), 6) AS eta FROM g CROSS JOIN t""",
)
def corr_ratio(table):
    """Correlation ratio of a value and a class."""
    e = table("events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("gm"))
    t = e.agg(F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"))
    return g.crossJoin(F.broadcast(t)).agg(F.round(F.sqrt(F.sum(c("n") * (c("gm") - c("m")) * (c("gm") - c("m"))) / F.min("ss")), 6).alias("eta"))


@query("ratio_nullsafe", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def ratio_nullsafe(table):
    """NULL for a zero denominator."""
    return table("lineitem").select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_tax", F.nullif("l_discount", F.lit(0.0))), 6).alias("ratio"))


@query("clip_2_98", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.02) AS a, quantile_cont(o_totalprice, 0.98) AS b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 4) AS v FROM orders CROSS JOIN q")
def clip_2_98(table):
    """Values clipped at their outer quantiles."""
    q = table("orders").agg(F.percentile("o_totalprice", 0.02).alias("a"), F.percentile("o_totalprice", 0.98).alias("b"))
    return table("orders").crossJoin(F.broadcast(q)).select("o_orderkey", F.round(F.least(F.greatest("o_totalprice", "a"), "b"), 4).alias("v"))
