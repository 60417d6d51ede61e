"""Exact k-nearest-donor averages without a cross join.

Distance is the NaN-aware Euclidean distance of the reference's imputer:
``sqrt(p / |S| * sum_{j in S} (q_j - d_j)^2)`` over the features ``S`` present in both rows (NaN
counts as NULL); pairs sharing no feature have no distance. A target cell is the average of the
target over the ``k`` nearest donors having that target (ties: smaller donor key first). Items
without any donor get no row (callers fall back to the column mean).

Donors with identical values are one weighted row (``w`` copies, smallest key) on every path, so
a hot group of copies is one row, and top-k takes ``min(w, k - taken)`` from it.

While a group's donors fit into a task the search is one step (``knn_local``). Otherwise it goes by blocks (``knn_blocks``): donors and queries are laid along one order and cut into blocks, and only pairs of
blocks that the index of the blocks' bounds can't rule out are looked at. With at most ``NARROW`` features donors are laid out
once for each missing pattern of the queries (fewer than 2^NARROW), by the features of that pattern alone, so a donor block is
small in every feature that its queries have. Nothing collects rows; the result is checkpointed into the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import knn_local
from .knn_blocks import NARROW, nearest

#: Tables of so many distinct donors or fewer need no layout for each pattern.
SCARCE_DONORS = 256


def number(c: str) -> Column:
    """The column as a double, NaN as NULL."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _top(items: DataFrame, k: int) -> DataFrame:
    """(qkey, ti, _found, value, n_donors) of the nearest donors of weight ``k`` among the candidates."""
    win = Window.partitionBy("qkey", "ti").orderBy("dist", "dkey").rowsBetween(Window.unboundedPreceding, -1)
    ranked = items.withColumn("_before", F.coalesce(F.sum("w").over(win), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("w"), F.lit(k) - F.col("_before")))
    return ranked.groupBy("qkey", "ti").agg(
        F.sum("w").alias("_found"),
        (F.sum(take * F.col("tv")) / F.sum(take)).alias("value"),
        F.sum(take).alias("n_donors"),
    )


def _block_search(q: DataFrame, d: DataFrame, p: int, m: int, k: int) -> DataFrame:
    """Top k of every asked (query, target) over the donor blocks of its group that can hold one of them."""
    return _top(nearest(q, d, p, m, k), k).select("qkey", "ti", "value", "n_donors")


def prepare_donors(donors: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], group: str | None = None) -> DataFrame:
    """Identical donors -> one row with weight ``w`` and the smallest key (per group)."""
    gcol = F.col(group).cast("string") if group else F.lit("")
    x = donors.select(
        gcol.alias("_g"), F.col(key).alias("dkey"),
        *[number(c).alias(f"d{j}") for j, c in enumerate(features)],
        *[number(c).alias(f"t{i}") for i, c in enumerate(targets)],
    )
    values = [c for c in x.columns if c != "dkey"]
    return x.groupBy(*values).agg(F.count(F.lit(1)).alias("w"), F.min("dkey").alias("dkey"))


def _by_pattern(q: DataFrame, d: DataFrame, p: int, m: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries and donors with a group for each of the queries' patterns, in which donors have only the pattern's features.

    A distance looks at shared features alone, so it stays as it is; donors of a group lie along the features that count there.
    Donors that share no feature with the pattern, or have no target asked for in it, are left out; of donors alike in
    the pattern's features and in which targets they have, those of the k smallest keys go first at every distance.
    """
    here = F.concat(*[F.when(F.col(f"q{j}").isNull(), "0").otherwise("1") for j in range(p)])
    q = q.withColumn("_p", here)
    asked = q.select("_p", F.explode("_need").alias("i")).groupBy("_p").agg(F.collect_set("i").alias("i")).collect()  # < 2^NARROW rows
    patterns = F.array(*[F.struct(F.lit(r["_p"]).alias("_p"), F.array(*[F.lit(i) for i in sorted(r["i"])]).alias("_asked")) for r in asked])
    has = F.array(*[F.col(f"t{i}").isNotNull() for i in range(m)])
    d = d.select("*", F.inline(patterns)).where(F.exists("_asked", lambda i: F.get(has, i)))
    d = d.withColumns({f"d{j}": F.when(F.substring("_p", j + 1, 1) == "1", F.col(f"d{j}")) for j in range(p)})
    d = d.where(F.coalesce(*[F.col(f"d{j}") for j in range(p)]).isNotNull())
    group = F.concat("_g", F.lit("\u0001"), "_p")
    alike = Window.partitionBy("_g", "_p", *[f"d{j}" for j in range(p)], has).orderBy("dkey")
    d = d.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k)
    return q.withColumn("_g", group).drop("_p"), d.withColumn("_g", group).drop("_p", "_asked", "_nth")


def _search(q: DataFrame, d: DataFrame, p: int, m: int, k: int, same: Sequence[int | None]) -> DataFrame:
    """(qkey, ti, value, n_donors), in one step or by blocks; ``same`` tells which feature a target is."""
    donors = d.where(F.col("_g").isNotNull()).groupBy("_g").count().orderBy(F.desc("count")).limit(knn_local.GROUPS + 1).collect()
    if donors and len(donors) <= knn_local.GROUPS and donors[0]["count"] * knn_local.row_bytes(p, m) <= knn_local.LOCAL_BYTES:
        sizes = {r["_g"]: r["count"] for r in donors}
        # rows of one key share their k nearest donors, which only the search by blocks knows
        repeated = cut_lineage(q.groupBy("qkey").count().where(F.col("count") > 1).select("qkey"))
        if repeated.isEmpty():
            return knn_local.means(q, d, p, m, k, same, sizes)
        once, more = q.join(repeated, "qkey", "left_anti"), q.join(repeated, "qkey", "left_semi")
        return knn_local.means(cut_lineage(once), d, p, m, k, same, sizes).unionByName(_by_blocks(cut_lineage(more), d, p, m, k))
    return _by_blocks(q, d, p, m, k)


def _by_blocks(q: DataFrame, d: DataFrame, p: int, m: int, k: int) -> DataFrame:
    if p <= NARROW and d.count() > SCARCE_DONORS and not q.isEmpty():
        q, d = map(cut_lineage, _by_pattern(q, d, p, m, k))
    return _block_search(q, d, p, m, k)


def knn_target_means(
    queries: DataFrame,
    donors: DataFrame,
    key: str,
    features: Sequence[str],
    targets: Sequence[str],
    need: dict[str, Column] | None,
    k: int,
    group: str | None = None,
) -> DataFrame:
    """(key, target, value, n_donors) for every needed (query row, target).

    ``need`` maps target -> Column (on ``queries``) telling whether the row needs that target;
    None means every row needs every target. With ``group`` (a column on both sides) a query
    only takes donors of its own group — e.g. all cross-validation folds in one job — and the
    output carries the group column.
    """
    features, p, m = list(features), len(features), len(targets)
    wanted = F.array(*[F.when(need[t], F.lit(i)) if need else F.lit(i) for i, t in enumerate(targets)])
    gcol = F.col(group).cast("string") if group else F.lit("")
    # The test reads the input columns, not q0..: a filter over columns that are renamed after it makes the
    # optimizer try every mix of old and new names, 2^p of them.
    known = F.exists(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v.isNotNull() & ~F.isnan(v))
    q = queries.where(known).select(
        F.concat(gcol, F.lit("\u0001"), F.col(key).cast("string")).alias("qkey"),
        gcol.alias("_g"),
        *[number(c).alias(f"q{j}") for j, c in enumerate(features)],
        F.filter(wanted, lambda i: i.isNotNull()).alias("_need"),
    )
    q = cut_lineage(q.where(F.size("_need") > 0))
    d = cut_lineage(prepare_donors(donors, key, features, targets, group))

    out = cut_lineage(_search(q, d, p, m, k, [features.index(t) if t in features else None for t in targets]))
    names = F.get(F.array(*[F.lit(t) for t in targets]), F.col("ti"))
    parts = F.split(F.col("qkey"), "\u0001", 2)
    cols = [parts[1].alias(key), names.alias("target"), "value", F.col("n_donors").cast("bigint").alias("n_donors")]
    if group:
        cols.insert(0, parts[0].alias(group))
    return out.select(*cols)


def knn_impute(table: DataFrame, fit: DataFrame, key: str, features: Sequence[str], k: int = 5,
               group: str | None = None) -> DataFrame:
    """Fill NULL (and NaN) feature cells of ``table`` with the mean of that feature over the ``k`` nearest
    ``fit`` rows having it; no usable donor -> the fit column mean (per group). Other cells
    unchanged."""
    features = list(features)
    need = {f: number(f).isNull() for f in features}
    vals = knn_target_means(table, fit, key, features, features, need, k, group=group)
    ids = [group, key] if group else [key]
    wide = vals.groupBy(*ids).pivot("target", features).agg(F.first("value"))
    wide = wide.select(*ids, *[F.col(f).alias(f"_imp_{f}") for f in features])
    # fit column means: one row (or one row per group: bounded by the number of groups)
    means = fit.groupBy(*([group] if group else [])).agg(*[F.avg(number(f)).alias(f"_mu_{f}") for f in features])
    out = table.join(wide, ids, "left")
    out = out.join(F.broadcast(means), group, "left") if group else out.crossJoin(F.broadcast(means))
    filled = {f: F.coalesce(number(f), F.col(f"_imp_{f}"), F.col(f"_mu_{f}")) for f in features}
    return out.withColumns(filled).drop(*[f"_imp_{f}" for f in features], *[f"_mu_{f}" for f in features])


def knn_regress(queries: DataFrame, train: DataFrame, key: str, features: Sequence[str], label: str, k: int = 30,
                out: str = "prediction", group: str | None = None) -> DataFrame:
    """Mean label of the ``k`` nearest training rows (uniform weights), per group if given."""
    vals = knn_target_means(queries, train, key, features, [label], None, k, group=group)
    ids = [group, key] if group else [key]
    return queries.join(vals.select(*ids, F.col("value").alias(out)), ids, "left")
