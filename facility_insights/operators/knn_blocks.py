"""Exact nearest-donor search in blocks, pruned by an index of the blocks' feature bounds.

Donors and queries are laid along one space-filling order of the features that spread most and cut into blocks
of ``BLOCK_ROWS`` rows, so a block's rows lie close together and mostly lack the same features. The index
keeps, for each block and feature, the least and greatest value and how many rows have one. From two blocks' entries
follows a lower bound of the distance between any of their rows: features that all rows of both have are
shared for sure; of the others at least so many are shared as the rows' numbers of features leave no choice, and the
bound takes those that differ least.

Queries meet donor blocks by rising bound, a few blocks in the first round and four times as many in each further
one. A query block is done when the next bound is above the distance of the k-th donor of each of its items; the blocks
left are never read. Items for which fewer than ``k`` donors exist visit every block that may hold one.
The index is read in slices of ``SLICE`` entries, so neither a task nor the driver holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

#: Rows of a block; a task holds two blocks and a slab of distances.
BLOCK_ROWS = 2_000
#: Features beyond which bounds rule out little: query blocks are large there, so that donors are sent less often, and small below.
NARROW = 6
NARROW_ROWS, WIDE_ROWS = 500, 4_000
#: Blocks that a query block meets in the first round.
FIRST_BLOCKS = 3
#: Donor blocks that one task holds at once.
HELD_BLOCKS = 32
#: Tasks of a round at most.
TASKS = 1_000
#: Donor blocks whose bounds are held at once.
SLICE = 4_096
#: Bits of the order.
ORDER_BITS = 48


def _order(sides: Sequence[tuple[DataFrame, str]], p: int) -> list[Column]:
    """The place of a row along the order, one column for each side.

    Every bit halves the cell of the feature that is widest just then, widths being those of the donors between their 5th and 95th
    percentile. Before a feature's first bit stands one that tells whether the row has it.
    """
    donors, side = sides[-1]
    spread = donors.agg(*[F.percentile_approx(f"{side}{j}", F.array(F.lit(0.05), F.lit(0.95)), F.lit(1000)).alias(f"b{j}") for j in range(p)]).first()
    bounds = {j: spread[f"b{j}"] for j in range(p) if spread[f"b{j}"] and spread[f"b{j}"][1] > spread[f"b{j}"][0]}
    width = {j: high - low for j, (low, high) in bounds.items()}
    bits: list[tuple[int, int | None]] = []  # (feature, bit of its cell); None: whether the row has it
    depth = dict.fromkeys(bounds, 0)
    while width and len(bits) < ORDER_BITS:
        j = max(width, key=lambda c: (width[c], -c))
        if not depth[j]:
            bits.append((j, None))
        depth[j] += 1
        bits.append((j, depth[j]))
        width[j] /= 2
    out = []
    for _, name in sides:
        place = F.lit(0).cast("bigint")
        for j, bit in bits:
            value = F.col(f"{name}{j}")
            if bit is None:
                one = value.isNotNull()
            else:
                low, high = bounds[j]
                inside = F.greatest(F.lit(0.0), F.least(F.lit(1 - 2.0**-20), (value - F.lit(low)) / F.lit(high - low)))
                one = F.floor(inside * F.lit(float(1 << bit))) % 2 == 1
            place = place * 2 + F.when(one, F.lit(1)).otherwise(F.lit(0))
        out.append(place)
    return out


def _in_blocks(df: DataFrame, order: Column, name: str, rows: int) -> DataFrame:
    """The rows with a column ``_block``, written along the order to the shared folder."""
    n = df.count()
    placed = df.withColumn("_z", order).repartitionByRange(max(1, -(-n // (8 * rows))), "_g", "_z").sortWithinPartitions("_g", "_z")
    names = placed.columns
    at = names.index("_g")

    def number(batches):
        block, held, group = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            numbers = []
            for g in b.column(at).to_pylist():
                if held == rows or (held and g != group):
                    block, held = block + 1, 0
                group, held = g, held + 1
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*names, "_block"])

    path = scratch_path(df.sparkSession, name)
    placed.mapInArrow(number, placed.withColumn("_block", F.lit(0).cast("bigint")).schema).drop("_z").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _index(df: DataFrame, side: str, p: int) -> DataFrame:
    """(_g, _block, rows, least, and low, high, have for each feature); least: fewest features of a row."""
    have = sum((F.col(f"{side}{j}").isNotNull().cast("int") for j in range(p)), F.lit(0))
    none = F.lit(0.0)
    return df.groupBy("_g", "_block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(have).alias("least"),
        F.array(*[F.coalesce(F.min(f"{side}{j}"), none) for j in range(p)]).alias("low"),
        F.array(*[F.coalesce(F.max(f"{side}{j}"), none) for j in range(p)]).alias("high"),
        F.array(*[F.count(f"{side}{j}") for j in range(p)]).alias("have"),
    )


def bounds(query: dict, low: np.ndarray, high: np.ndarray, have: np.ndarray, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances between one query block's rows and those of each donor block."""
    p = low.shape[1]
    gap = np.maximum(0.0, np.maximum(query["low"] - high, low - query["high"])) ** 2
    sure = (query["have"] == query["rows"]) & (have == rows[:, None])
    maybe = (query["have"] > 0) & (have > 0) & ~sure
    fixed, n_fixed = np.where(sure, gap, 0.0).sum(axis=1), sure.sum(axis=1)
    # features that may be shared, those that differ least first
    rest = np.sort(np.where(maybe, gap, np.inf), axis=1)
    n_rest = maybe.sum(axis=1)
    shared = np.arange(p + 1)
    sums = np.concatenate([np.zeros((len(low), 1)), np.cumsum(np.where(np.isfinite(rest), rest, 0.0), axis=1)], axis=1)
    total = n_fixed[:, None] + shared
    possible = (shared <= n_rest[:, None]) & (total >= np.maximum(1, query["least"] + least - p)[:, None])
    mean = np.where(possible, (fixed[:, None] + sums) / np.maximum(total, 1), np.inf).min(axis=1)
    return np.sqrt(p * mean)


def _candidates(state: DataFrame, index: DataFrame, n_blocks: int, most: int) -> DataFrame:
    """(_g, qb, db, bound, place): of each open query block the donor blocks of places seen+1 to seen+most by (bound, block)."""
    parts = []
    slices = -(-n_blocks // SLICE)
    state = state.repartition(min(TASKS, max(1, state.count() // 64)), "_block")
    for number in range(slices):
        held = index if slices == 1 else index.where(F.pmod(F.xxhash64("_block"), F.lit(slices)) == number)
        rows = held.toPandas()  # about SLICE rows
        by_group = {
            g: (x["_block"].to_numpy(), np.stack(x["low"].to_list()), np.stack(x["high"].to_list()), np.stack(x["have"].to_list()), x["rows"].to_numpy(), x["least"].to_numpy())
            for g, x in rows.groupby("_g")
        }

        def nearest(batches, by_group=by_group):
            for batch in batches:
                out = []
                for q in batch.to_dict("records"):
                    if q["_g"] not in by_group:
                        continue
                    blocks, *entries = by_group[q["_g"]]
                    query = {c: np.asarray(q[c]) for c in ("low", "high", "have")} | {"rows": q["rows"], "least": q["least"]}
                    bound = bounds(query, *entries)
                    order = np.lexsort((blocks, bound))
                    order = order[bound[order] <= q["radius"] * (1 + 1e-9)][: q["seen"] + most]  # bounds and distances round apart
                    out.append(pd.DataFrame({"_g": q["_g"], "qb": q["_block"], "seen": q["seen"], "db": blocks[order], "bound": bound[order]}))
                if out:
                    yield pd.concat(out)

        parts.append(state.mapInPandas(nearest, "_g string, qb long, seen long, db long, bound double"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("qb").orderBy("bound", "db"))
    return found.withColumn("place", place).where((F.col("place") > F.col("seen")) & (F.col("place") <= F.col("seen") + most))


def _screen(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """(values, their squares, marks), centred and zero where there is none: factors of the distances' matrix products."""
    mark = ~np.isnan(x)
    value = np.where(mark, x - centre, 0.0)
    return value, value * value, mark.astype(float)


def _nearest_in_blocks(p: int, k: int, asked: Sequence[int]):
    """The k nearest donors of every item of one query block in a few donor blocks, which come by rising bound.

    Matrix products give the distances of a slab of queries to one donor block but for rounding; only pairs that are not clearly
    beyond the k-th donor found so far get their exact distance.
    """

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["place", "dkey"], kind="stable")
        x = right[[f"d{j}" for j in range(p)]].to_numpy(dtype=float)
        values = {i: right[f"t{i}"].to_numpy(dtype=float) for i in asked}
        by_key = np.empty(len(right), dtype=int)
        by_key[np.argsort(right["dkey"].to_numpy(), kind="stable")] = np.arange(len(right))
        place = right["place"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1), len(x)]
        at = left[[f"q{j}" for j in range(p)]].to_numpy(dtype=float)
        needs = left["_need"].tolist()
        some = ~np.isnan(x)
        centre = np.where(some, x, 0.0).sum(axis=0) / np.maximum(some.sum(axis=0), 1)
        donors = [np.hstack([m, s, v]) for v, s, m in (_screen(x[lo:hi], centre) for lo, hi in zip(edges[:-1], edges[1:], strict=True))]
        usable = {i: [np.flatnonzero(~np.isnan(values[i][lo:hi])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)] for i in asked}
        out = []
        slab = max(1, 500_000 // max(1, max(np.diff(edges))))
        for start in range(0, len(at) if len(x) else 0, slab):
            part = at[start : start + slab]
            v, s, m = _screen(part, centre)
            factors = np.hstack([s, m, -2.0 * v])
            rows = {i: np.array([r for r in range(len(part)) if i in needs[start + r]], dtype=int) for i in asked}
            held = {i: (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)) for i in asked if len(rows[i])}
            far = {i: np.full(len(part), np.inf) for i in held}
            for n, (lo, block) in enumerate(zip(edges[:-1], donors, strict=True)):
                shared = m @ block[:, :p].T
                near = factors @ block.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    near *= p / shared
                near[shared == 0] = np.inf
                rounding = 1e-11 * p * (s.sum(axis=1).max() + block[:, p : 2 * p].sum(axis=1).max())
                for i in held:
                    own, mine = rows[i], usable[i][n]
                    if not len(mine):
                        continue
                    whole = len(own) == len(part) and len(mine) == near.shape[1]
                    seen = near if whole else near[np.ix_(own, mine)]
                    limit = far[i][own] ** 2
                    if np.isinf(limit).any() and seen.shape[1] > k:
                        limit = np.minimum(limit, np.partition(seen, k - 1, axis=1)[:, k - 1])
                    r, c = np.nonzero(~(seen > (limit * (1 + 1e-9) + rounding)[:, None]))  # NaN: may be near
                    r, c = own[r], lo + mine[c]
                    dist = _distances(part, x, r, c)
                    met = np.isfinite(dist) & (dist <= far[i][r])
                    if met.any():
                        held[i], far[i] = _kept(k, by_key, far[i], *(np.concatenate(pair) for pair in zip(held[i], (r[met], c[met], dist[met]), strict=True)))
            for i, (r, c, dist) in held.items():
                out.append((start + r, np.full(len(r), i), c, dist, values[i][c]))
        r, i, c, dist, tv = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int),) * 5
        return pd.DataFrame({"qkey": left["qkey"].to_numpy()[r], "ti": i, "dkey": right["dkey"].to_numpy()[c], "w": right["w"].to_numpy()[c], "dist": dist.astype(float), "tv": tv.astype(float)})

    return search


def _distances(at: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of row r of ``at`` and row c of ``x``, pair by pair; infinite where no feature is shared."""
    p = at.shape[1]
    sq, shared = np.zeros(len(r)), np.zeros(len(r))
    for j in range(p):
        diff = at[r, j] - x[c, j]
        present = ~np.isnan(diff)
        sq += np.where(present, diff * diff, 0.0)
        shared += present
    return np.where(shared > 0, np.sqrt(p / np.maximum(shared, 1.0) * sq), np.inf)


def _kept(k: int, by_key: np.ndarray, far: np.ndarray, r: np.ndarray, c: np.ndarray, dist: np.ndarray) -> tuple:
    """Each row's k nearest (equal distances: smaller keys), and the rows' k-th distances."""
    order = np.lexsort((by_key[c], dist, r))
    r, c, dist = r[order], c[order], dist[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    nth = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    far = far.copy()
    far[r[nth == k - 1]] = dist[nth == k - 1]
    keep = nth < k
    return (r[keep], c[keep], dist[keep]), far


def nearest(q: DataFrame, d: DataFrame, p: int, m: int, k: int, *, rows: int | None = None, counts: list[int] | None = None) -> DataFrame:
    """(qkey, ti, dkey, w, dist, tv): for every asked (query, target) its donors up to a weight of ``k``, nearest first.

    ``q`` has qkey, _g, q0.., _need (targets by number); ``d`` has dkey, _g, d0.., t0.., w. Donors serve queries of
    their own group. ``counts`` gets the pairs of blocks that each round joined.
    """
    key_type = d.schema["dkey"].dataType.simpleString()
    schema = f"qkey string, ti int, dkey {key_type}, w long, dist double, tv double"
    asked = sorted(row["ti"] for row in q.select(F.explode("_need").alias("ti")).distinct().collect())  # <= m
    spark = q.sparkSession
    if not asked:
        return spark.createDataFrame([], schema)
    useful = F.lit(False)
    for i in asked:
        useful = useful | F.col(f"t{i}").isNotNull()
    d = d.where(useful)
    if d.isEmpty():
        return spark.createDataFrame([], schema)
    q_order, d_order = _order([(q, "q"), (d, "d")], p)
    q_rows = rows or min(BLOCK_ROWS, NARROW_ROWS) if p <= NARROW else rows or min(2 * BLOCK_ROWS, WIDE_ROWS)
    q, d = _in_blocks(q, q_order, "knn-queries", q_rows), _in_blocks(d, d_order, "knn-donors", rows or BLOCK_ROWS)
    index = cut_lineage(_index(d, "d", p))
    n_blocks = index.count()
    state = cut_lineage(_index(q, "q", p).withColumns({"radius": F.lit(math.inf), "seen": F.lit(0).cast("bigint")}))
    search = _nearest_in_blocks(p, k, asked)
    items = q.select("qkey", "_block", F.explode("_need").alias("ti"))
    best, most = None, FIRST_BLOCKS
    while not state.isEmpty():
        pairs = cut_lineage(_candidates(state, index, n_blocks, most).select("_g", "qb", "db", "place", F.floor((F.col("place") - F.col("seen") - 1) / HELD_BLOCKS).alias("part")))
        if counts is not None:
            counts.append(pairs.count())
        left = q.withColumnRenamed("_block", "qb").join(pairs.select("qb", F.col("part").alias("share")).distinct(), "qb")
        right = d.withColumnRenamed("_block", "db").join(pairs.select("qb", "part", "db", "place"), "db")
        shares = pairs.select("qb", "part").distinct().count()
        tasks = min(max(1, 2 * shares), TASKS)  # by number, as a share's work is in its pairs, not its bytes
        left, right = left.repartition(tasks, "qb", "share"), right.repartition(tasks, "qb", "part")
        found = left.groupBy("qb", "share").cogroup(right.groupBy("qb", "part")).applyInPandas(search, schema)
        before = Window.partitionBy("qkey", "ti").orderBy("dist", "dkey").rowsBetween(Window.unboundedPreceding, -1)
        every = found if best is None else best.unionByName(found)
        best = cut_lineage(every.withColumn("_before", F.coalesce(F.sum("w").over(before), F.lit(0))).where(F.col("_before") < k).drop("_before"))
        # a block's radius: the farthest k-th donor of its items, without bound while one has fewer
        met = best.groupBy("qkey", "ti").agg(F.when(F.sum("w") >= k, F.max("dist")).otherwise(F.lit(math.inf)).alias("far"))
        radius = items.join(met, ["qkey", "ti"], "left").groupBy("_block").agg(F.max(F.coalesce("far", F.lit(math.inf))).alias("radius"))
        # pairs up to the last place are done; a block with fewer places than asked for has no more under its old radius
        full = pairs.groupBy(F.col("qb").alias("_block")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most)
        state = cut_lineage(state.drop("radius").join(full, "_block").join(radius, "_block").withColumn("seen", F.col("seen") + F.col("_n")).drop("_n"))
        most *= 4
    return best
