"""Distribution summaries behind the comparison charts.

Values are pre-aggregated to (value, weight) before any per-bin or per-grid-point work, so the
cost follows the number of distinct values; national and per-group results come from one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def hist_by_width(df: DataFrame, value: str, width: float, group: str) -> DataFrame:
    """Density histogram with fixed bin width, bins starting at the scope's minimum:
    ``bin = floor((x - min) / width)``, ``density = count / (n * width)``; national rows
    (``scope='national'``, group NULL) and every group at once via GROUPING SETS."""
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(group), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_c"))
    v = cut_lineage(v)  # read four times below
    mins_g = v.groupBy(group).agg(F.min("x").alias("_min_g"), F.sum("_c").alias("_n_g"))
    mins_n = v.agg(F.min("x").alias("_min_n"), F.sum("_c").alias("_n_n"))
    j = v.join(mins_g, group).crossJoin(F.broadcast(mins_n))
    j = j.withColumn("_bg", F.floor((F.col("x") - F.col("_min_g")) / F.lit(width)).cast("bigint"))
    j = j.withColumn("_bn", F.floor((F.col("x") - F.col("_min_n")) / F.lit(width)).cast("bigint"))
    per_group = j.groupBy(group, "_bg", "_min_g", "_n_g").agg(F.sum("_c").alias("count")).select(
        F.lit("state").alias("scope"), F.col(group), F.col("_bg").alias("bin"),
        (F.col("_min_g") + F.col("_bg") * F.lit(width)).alias("bin_start"), F.col("count").cast("bigint").alias("count"),
        (F.col("count") / (F.col("_n_g") * F.lit(width))).alias("density"),
    )
    nation = j.groupBy("_bn", "_min_n", "_n_n").agg(F.sum("_c").alias("count")).select(
        F.lit("national").alias("scope"), F.lit(None).cast(v.schema[group].dataType).alias(group), F.col("_bn").alias("bin"),
        (F.col("_min_n") + F.col("_bn") * F.lit(width)).alias("bin_start"), F.col("count").cast("bigint").alias("count"),
        (F.col("count") / (F.col("_n_n") * F.lit(width))).alias("density"),
    )
    return per_group.unionByName(nation)


def hist_by_count(long: DataFrame, variable: str, value: str, bins: int) -> DataFrame:
    """Density histogram with ``bins`` equal bins between each variable's min and max; the
    maximum belongs to the last bin. density = count / (n * bin width)."""
    v = long.where(F.col(value).isNotNull()).groupBy(F.col(variable), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_c"))
    st = v.groupBy(variable).agg(F.min("x").alias("_mn"), F.max("x").alias("_mx"), F.sum("_c").alias("_n"))
    j = v.join(st, variable)
    rng = F.col("_mx") - F.col("_mn")
    b = F.when(rng == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("_mn")) / rng * F.lit(bins)), F.lit(bins - 1)))
    j = j.withColumn("bin", b.cast("int"))
    g = j.groupBy(variable, "bin", "_mn", "_mx", "_n").agg(F.sum("_c").alias("count"))
    width = F.when(rng == 0, F.lit(1.0)).otherwise(rng / F.lit(bins))
    return g.select(
        variable,
        "bin",
        (F.col("_mn") + F.col("bin") * width).alias("bin_start"),
        F.col("count").cast("bigint").alias("count"),
        (F.col("count") / (F.col("_n") * width)).alias("density"),
    )


def kde_curve(df: DataFrame, value: str, grid: int = 100) -> DataFrame:
    """Gaussian kernel density on ``grid`` evenly spaced points from min to max, Scott's
    bandwidth ``h = std(ddof=1) * n^(-1/5)``.

    Values are first reduced to (value, weight); each distinct value then contributes to every
    grid point (an ``explode`` of the fixed-size grid, not a join), and the sums are one
    aggregate per grid point.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    st = v.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd")).first()
    if st["n"] is None or st["n"] == 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    n, mn, mx, sd = st["n"], st["mn"], st["mx"], st["sd"] or 1.0
    h = sd * n ** (-1.0 / 5.0)
    step = (mx - mn) / (grid - 1) if grid > 1 and mx > mn else 0.0
    w = v.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    e = w.select("x", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    gx = F.lit(mn) + F.col("point") * F.lit(step)
    z = (gx - F.col("x")) / F.lit(h)
    k = F.col("w") * F.exp(F.lit(-0.5) * z * z)
    g = e.groupBy("point").agg(F.sum(k).alias("_s"))
    return g.select("point", (F.lit(mn) + F.col("point") * F.lit(step)).alias("x"),
                    (F.col("_s") / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


#: Cells of a density sketch between a scope's least and greatest value.
SKETCH_CELLS = 512


def density_curves(df: DataFrame, value: str, group: str, grid: int = 100, cells: int = SKETCH_CELLS) -> DataFrame:
    """(scope, group, point, x, density): the density of the nation and of every group on ``grid`` points each, in one job.

    Each scope's values are first laid on ``cells + 1`` evenly spaced nodes, a value's weight shared by the two beside it in
    proportion to its nearness. That sketch adds up in any order and is bounded whatever the values; only its nodes meet
    the grid's points, with a Gaussian of Scott's bandwidth ``h = std(ddof=1) * n^(-1/5)`` (std 0 or one value: 1).
    With nodes ``d`` apart a density is off by at most ``(d / h)^2 / (8 h sqrt(2 pi))``. A null group is a group of its own.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_group"), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    both = F.array(F.struct(F.lit("state").alias("scope"), F.col("_group").alias("member")), F.struct(F.lit("national").alias("scope"), F.lit(None).cast(v.schema["_group"].dataType).alias("member")))
    v = cut_lineage(v.select("x", "c", F.inline(both)).groupBy("scope", "member", "x").agg(F.sum("c").alias("c")))
    same = lambda a, b: (a["scope"] == b["scope"]) & a["member"].eqNullSafe(b["member"])
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    square = F.sum(F.col("c") * F.col("x") * F.col("x"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(square - total * total / n, n - 1)))
    stats = v.groupBy("scope", "member").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), n.alias("n"), spread.alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) < 1e-9, F.lit(1.0)).otherwise(F.col("sd"))
    stats = stats.select("scope", "member", "mn", "n", ((F.col("mx") - F.col("mn")) / F.lit(cells)).alias("cell"), ((F.col("mx") - F.col("mn")) / F.lit(grid - 1)).alias("step"), (sd * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    stats = cut_lineage(stats)  # a row for each scope
    a, b = v.alias("a"), stats.alias("b")
    at = F.when(F.col("cell") > 0, (F.col("x") - F.col("mn")) / F.col("cell")).otherwise(F.lit(0.0))
    placed = a.join(b, same(v, stats)).select("a.scope", "a.member", "c", at.alias("at"))
    low = F.floor("at")
    shares = F.array(F.struct(low.alias("node"), (F.lit(1.0) - (F.col("at") - low)).alias("share")), F.struct((low + 1).alias("node"), (F.col("at") - low).alias("share")))
    sketch = placed.select("scope", "member", "c", F.inline(shares)).groupBy("scope", "member", "node").agg(F.sum(F.col("c") * F.col("share")).alias("w"))
    points = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("point") * F.col("step") - F.col("node") * F.col("cell")) / F.col("h")
    joined = points.join(sketch, same(points, sketch)).select(points["scope"], points["member"], "point", "mn", "step", "n", "h", (F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("k"))
    out = joined.groupBy("scope", "member", "point", "mn", "step", "n", "h").agg(F.sum("k").alias("k"))
    return out.select("scope", F.col("member").alias(group), "point", (F.col("mn") + F.col("point") * F.col("step")).alias("x"), (F.col("k") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
