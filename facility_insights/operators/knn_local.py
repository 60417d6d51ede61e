"""Exact nearest-donor search in one step, while the donors of a group fit into a task.

Each task gets a share of a group's queries and all donors of the group. Donors alike in which features and targets they have make a
class; a class is cut along its widest feature, again and again, into leaves of a few rows. All pairs of a query group with one missing
pattern and a leaf share the same features, so their boxes give a lower bound of the distances. Leaves are visited by rising bound until the next bound is above
the k-th donor of every query of the group; matrix products screen a visit's pairs, and those that may be near get their exact distance.

With at most ``NARROW`` features there are few patterns: leaves are cut for each of them by its own features, from the k smallest keys of
donors alike there. Otherwise leaves are cut once by all features, and as a group's box says little in many features, each query has
its own bounds: after a first visit of the leaves that are near on average, a leaf meets just those queries whose k-th donor
is not nearer than it. ``knn_blocks`` does the search in rounds for more donors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn_blocks import NARROW, _distances, _kept

#: Bytes of a group's donors that one task holds.
LOCAL_BYTES = 3 << 27
#: Queries that are worth a share.
SHARE_ROWS = 2_000
#: Rows of a packed slab.
SLAB_ROWS = 100_000
#: Groups beyond which the search goes by blocks.
GROUPS = 1_000
SCHEMA = "qkey string, ti int, value double, n_donors long"
#: Rows of a leaf, twice as many in wide tables, and of a group of queries, and leaves of the first visit.
LEAF_ROWS, QUERY_ROWS, FIRST_LEAVES = 64, 64, 8
#: Pairs of one visit at most, about.
PAIRS = 1 << 21
#: Queries of one pattern with bounds of their own that go together, and as few as are worth it.
TOGETHER, FEW = 2_048, 48


def _cut(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """``rows`` of ``x`` in parts of at most ``most``, halved along the feature that is widest there."""
    out, open_ = [], [rows]
    while open_:
        mine = open_.pop()
        if len(mine) <= most:
            out.append(mine)
            continue
        part = x[mine]
        order = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], len(mine) // 2)
        open_ += [mine[order[len(mine) // 2 :]], mine[order[: len(mine) // 2]]]
    return out


class _Leaves:
    """Donors ``rows`` of ``x`` in leaves; ``code`` is their class."""

    def __init__(self, x: np.ndarray, code: np.ndarray, rows: np.ndarray):
        order = rows[np.argsort(code[rows], kind="stable")]
        parts = []
        for mine in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
            have = ~np.isnan(x[mine[0]])
            parts += _cut(x[:, have], mine, LEAF_ROWS * (1 + (x.shape[1] > NARROW))) if have.any() else []
        self.rows = np.concatenate(parts) if parts else np.zeros(0, dtype=int)
        self.edges = np.cumsum([0, *map(len, parts)])
        begin = self.edges[:-1]
        self.x = x[self.rows]
        self.have = ~np.isnan(self.x[begin])
        for name, least, fill in (("low", np.minimum, np.inf), ("high", np.maximum, -np.inf)):
            ends = [least.reduceat(np.where(np.isnan(v), fill, v), begin) for v in self.x.T] if parts else [np.zeros(0)] * x.shape[1]
            setattr(self, name, np.where(self.have, np.column_stack(ends), -fill))
        # factors of the distances' matrix products: which features a row has, and their values, centred and zero where there is none
        self.mark = ~np.isnan(self.x)
        self.centre = np.array([v[m].sum() for v, m in zip(self.x.T, self.mark.T, strict=True)]) / np.maximum(self.mark.sum(axis=0), 1)
        self.value = np.empty(self.x.shape, dtype=np.float32 if x.shape[1] > NARROW else float)
        for j, c in enumerate(self.centre):
            self.value[:, j] = np.where(self.mark[:, j], self.x[:, j] - c, 0.0)
        self.most = max((float((v * v).sum(axis=1).max()) for v in np.array_split(self.value, 16) if len(v)), default=0.0)

    def block(self, dims: np.ndarray) -> np.ndarray:
        """Factors of all rows for queries with the features ``dims``, scaled by the features that a pair shares."""
        out, n = np.empty((len(self.x), 2 * len(dims) + 1), dtype=self.value.dtype), len(dims)
        for lo in range(0, len(out), SLAB_ROWS):
            value, mark, here = self.value[lo : lo + SLAB_ROWS, dims], self.mark[lo : lo + SLAB_ROWS, dims], out[lo : lo + SLAB_ROWS]
            here[:, :n], here[:, n : 2 * n], here[:, 2 * n] = value, mark, (value * value).sum(axis=1)
            here *= (self.x.shape[1] / np.maximum(mark.sum(axis=1, keepdims=True), 1)).astype(out.dtype)
        return out


def _visit(at: np.ndarray, leaves: _Leaves, classes: np.ndarray, dims: np.ndarray, asked: Sequence[int], k: int, rank: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """For each asked target (row of ``at``, place in the leaves, distance) of each row's k nearest donors. Rows have the features ``dims``; ``classes``
    tells which targets a leaf has."""
    p, q = at.shape[1], at[:, dims]
    shared = leaves.have[:, dims].sum(axis=1)
    some = np.flatnonzero(classes[:, asked].any(axis=1) & (shared > 0))
    gap = np.maximum(0.0, np.maximum(q.min(axis=0) - leaves.high[some][:, dims], leaves.low[some][:, dims] - q.max(axis=0)))
    bound = np.sqrt(p / shared[some] * (gap * gap).sum(axis=1)) * (1 - 1e-9)  # bounds and distances round apart
    order = np.argsort(bound, kind="stable")
    some, bound = some[order], bound[order]
    value = q - leaves.centre[dims]
    factors = np.hstack([-2.0 * value, value * value, np.ones((len(q), 1))]).astype(leaves.value.dtype)
    size, eps = (value * value).sum(axis=1), 4.0 * (2 * p + 1) * np.finfo(factors.dtype).eps
    held = {i: (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)) for i in asked}
    far, most = {i: np.full(len(at), np.inf) for i in asked}, FIRST_LEAVES
    while len(some):
        open_ = (classes[some][:, asked] & (bound[:, None] <= np.array([far[i].max() for i in asked]))).any(axis=1)
        some, bound = some[open_], bound[open_]
        now, some, bound = some[:most], some[most:], bound[most:]
        if not len(now):
            break
        most = min(2 * most, max(FIRST_LEAVES, PAIRS // (len(at) * LEAF_ROWS)))
        sizes = leaves.edges[now + 1] - leaves.edges[now]
        place = np.repeat(leaves.edges[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        scale = np.repeat(p / shared[now], sizes)
        values = leaves.value[place][:, dims]
        squares = (values * values).sum(axis=1)
        block = np.hstack([values, leaves.mark[place][:, dims], squares[:, None]]) * scale[:, None].astype(squares.dtype)
        near = factors @ block.T
        rounding = eps * p * (size + squares.max())
        for i in asked:
            cols = np.flatnonzero(np.repeat(classes[now, i], sizes))
            if not len(cols):
                continue
            seen = near if len(cols) == len(place) else near[:, cols]
            top = far[i] ** 2
            if np.isinf(top).any() and len(cols) > k:
                top = np.minimum(top, np.partition(seen, k - 1, axis=1)[:, k - 1] + rounding)
            beyond = seen > (top * (1 + 1e-9) + rounding).astype(seen.dtype)[:, None]
            r, c = np.divmod(np.flatnonzero(~beyond), len(cols))  # NaN: may be near
            c = place[cols[c]]
            dist = _distances(at, leaves.x, r, c)
            met = np.isfinite(dist) & (dist <= far[i][r])
            if met.any():
                held[i], far[i] = _kept(k, rank, far[i], *(np.concatenate(pair) for pair in zip(held[i], (r[met], c[met], dist[met]), strict=True)))
    return held


def _bounds(q: np.ndarray, leaves: _Leaves, some: np.ndarray, dims: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(leaf, query): lower bounds of the distances, in single precision and rounded down."""
    out = np.zeros((len(some), len(q)), dtype=np.float32)
    step = max(1, (1 << 19) // len(q))
    for n, j in enumerate(dims):
        low, high, at = leaves.low[some, j], leaves.high[some, j], q[:, n]
        known = leaves.have[some, j]
        if not known.any():
            continue
        slack = 1e-6 * max(np.abs(low[known]).max(), np.abs(high[known]).max(), np.abs(at).max())
        low, high, at = (low - slack).astype(np.float32), (high + slack).astype(np.float32), at.astype(np.float32)
        for lo in range(0, len(some), step):
            gap = at[None, :] - high[lo : lo + step, None]
            np.maximum(gap, low[lo : lo + step, None] - at[None, :], out=gap)
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            out[lo : lo + step] += gap
    out *= scale[:, None].astype(np.float32)
    return np.sqrt(out, out=out) * np.float32(1 - 1e-5)


def _visit_each(at: np.ndarray, leaves: _Leaves, classes: np.ndarray, dims: np.ndarray, asked: Sequence[int], k: int, rank: np.ndarray, block: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """As ``_visit``, with bounds for each row; ``block`` has the factors of all leaves' rows for ``dims``."""
    p, q = at.shape[1], at[:, dims]
    shared = leaves.have[:, dims].sum(axis=1)
    some = np.flatnonzero(classes[:, asked].any(axis=1) & (shared > 0))
    has = classes[some][:, asked]
    bound = _bounds(q, leaves, some, dims, p / shared[some])
    value = q - leaves.centre[dims]
    factors = np.hstack([-2.0 * value, value * value, np.ones((len(q), 1))]).astype(block.dtype)
    rounding = 4.0 * (2 * p + 1) * np.finfo(block.dtype).eps * p * ((value * value).sum(axis=1) + leaves.most)
    held = {i: (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)) for i in asked}
    far = {i: np.full(len(at), np.inf) for i in asked}

    def near_of(rows: np.ndarray, n: int) -> np.ndarray:
        return factors[rows] @ block[leaves.edges[some[n]] : leaves.edges[some[n] + 1]].T

    def keep(i: int, r: np.ndarray, c: np.ndarray) -> None:
        dist = _distances(at, leaves.x, r, c)
        met = np.isfinite(dist) & (dist <= far[i][r])
        if not met.any():
            return
        r, c, dist = r[met], c[met], dist[met]
        touched = np.zeros(len(at), dtype=bool)
        touched[r] = True
        old = touched[held[i][0]]
        (r, c, dist), far[i] = _kept(k, rank, far[i], *(np.concatenate([v[old], w]) for v, w in zip(held[i], (r, c, dist), strict=True)))
        held[i] = tuple(np.concatenate([v[~old], w]) for v, w in zip(held[i], (r, c, dist), strict=True))

    for part in _cut(q, np.arange(len(q)), QUERY_ROWS):
        mean = bound[:, part].mean(axis=1)
        for number, i in enumerate(asked):
            usable = np.flatnonzero(has[:, number] & np.isfinite(mean))
            first = usable[np.argsort(mean[usable], kind="stable")[:FIRST_LEAVES]]
            for n in first:
                mean[n] = np.inf
                bound[n, part] = np.inf
            if not len(first):
                continue
            place = np.concatenate([np.arange(leaves.edges[n], leaves.edges[n + 1]) for n in some[first]])
            near = factors[part] @ block[place].T
            for other, h in enumerate(asked):
                cols = np.flatnonzero(np.repeat(has[first, other], np.diff(leaves.edges)[some[first]]))
                if len(cols):
                    seen, top = near[:, cols], far[h][part] ** 2
                    if len(cols) > k:
                        top = np.minimum(top, np.partition(seen, k - 1, axis=1)[:, k - 1] + rounding[part])
                    beyond = seen > (top * (1 + 1e-9) + rounding[part]).astype(seen.dtype)[:, None]
                    r, c = np.divmod(np.flatnonzero(~beyond), len(cols))
                    keep(h, part[r], place[cols[c]])
    order = np.argsort(np.where(np.isfinite(bound), bound, 0.0).mean(axis=1), kind="stable")
    kinds, kind = np.unique(has, axis=0, return_inverse=True)
    kind, seen, most = kind.reshape(-1), 0, 2 * FIRST_LEAVES
    while seen < len(order):
        now, seen, most = order[seen : seen + most], seen + most, min(2 * most, 64 * FIRST_LEAVES)
        limit = [np.max([far[i] for i, one in zip(asked, some_kind, strict=True) if one], axis=0) for some_kind in kinds]
        top = {i: (far[i] ** 2 * (1 + 1e-9) + rounding).astype(block.dtype) for i in asked}
        found: dict[int, list] = {i: [] for i in asked}
        for n in now:
            rows = np.flatnonzero((bound[n] <= limit[kind[n]]) & (bound[n] < np.inf))
            if not len(rows):
                continue
            near = near_of(rows, n)
            for number, i in enumerate(asked):
                if has[n, number]:
                    hit = np.flatnonzero(~(near > top[i][rows][:, None]))
                    if len(hit):
                        r, c = np.divmod(hit, near.shape[1])
                        found[i].append((rows[r], leaves.edges[some[n]] + c))
        for i, hits in found.items():
            if hits:
                keep(i, *(np.concatenate(v) for v in zip(*hits, strict=True)))
    return {i: _kept(k, rank, far[i], *v)[0] for i, v in held.items() if len(v[0])}


def search(at: np.ndarray, need: np.ndarray, x: np.ndarray, t: np.ndarray, w: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, target, value, weight): the mean of each needed target over the nearest donors up to a weight of ``k``, equal distances by ``rank``."""
    p, m = x.shape[1], t.shape[1]
    has = ~np.isnan(t)
    of_queries = np.unique(np.packbits(np.hstack([~np.isnan(at), need]), axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    whole, out = None, []
    for pattern in range(of_queries.max() + 1 if len(at) else 0):
        mine = np.flatnonzero(of_queries == pattern)
        dims, asked = np.flatnonzero(~np.isnan(at[mine[0]])), np.flatnonzero(need[mine[0]])
        if not len(dims) or not len(asked):
            continue
        if p <= NARROW:
            here = np.full(x.shape, np.nan)
            here[:, dims] = x[:, dims]
            leaves, classes = _laid_out(here, has, rank, k, np.flatnonzero(has[:, asked].any(axis=1)))
        else:
            whole = whole or _laid_out(x, has, rank, None, np.flatnonzero(has.any(axis=1)))
            leaves, classes = whole
        places = rank[leaves.rows]
        each = p > NARROW and len(mine) >= FEW
        block = leaves.block(dims) if each else None
        for part in _cut(at[:, dims], mine, TOGETHER if each else QUERY_ROWS):
            found = _visit_each(at[part], leaves, classes, dims, asked, k, places, block) if each else _visit(at[part], leaves, classes, dims, asked, k, places)
            for i, (r, c, _) in found.items():
                if len(r):
                    out.append(_averages(part, i, r, leaves.rows[c], t, w, k))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), np.zeros(0))


def _laid_out(x: np.ndarray, has: np.ndarray, rank: np.ndarray, k: int | None, rows: np.ndarray) -> tuple[_Leaves, np.ndarray]:
    """Leaves of ``rows``, and which targets each has; with ``k`` only the k smallest keys of rows that are alike."""
    _, code = np.unique(np.packbits(np.hstack([~np.isnan(x), has]), axis=1), axis=0, return_inverse=True)
    code = code.reshape(-1)
    if k is not None and len(rows):
        keys = [np.where(np.isnan(v), 0.0, v) for v in x[rows].T] + [code[rows]]
        order = np.lexsort([rank[rows], *keys])
        new = np.r_[True, np.any([v[order][1:] != v[order][:-1] for v in keys], axis=0)]
        first = np.flatnonzero(new)
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        rows = rows[order[nth < k]]
    leaves = _Leaves(x, code, rows)
    return leaves, has[leaves.rows[leaves.edges[:-1]]] if len(leaves.rows) else np.zeros((0, has.shape[1]), dtype=bool)


def _averages(part: np.ndarray, i: int, r: np.ndarray, donor: np.ndarray, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of donors that lie by query and distance."""
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    sums = np.cumsum(w[donor])
    before = sums - w[donor] - np.repeat(np.r_[0, sums[first[1:] - 1]], np.diff(np.r_[first, len(r)]))
    take = np.clip(k - before, 0, w[donor])
    weight = np.add.reduceat(take, first)
    return part[r[first]], np.full(len(first), i), np.add.reduceat(take * t[donor, i], first) / weight, weight


def _packed(df: DataFrame) -> DataFrame:
    """(_g, part, rows): slabs of a group's rows, by the task that packed them."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SLAB_ROWS:
                yield from slabs(pa.Table.from_batches(held))
                held = []
        if held:
            yield from slabs(pa.Table.from_batches(held))

    def slabs(table):
        part = TaskContext.get().partitionId()
        for g in pc.unique(table["_g"]).to_pylist():
            mine, sink = table.filter(pc.equal(table["_g"], g)).drop_columns(["_g"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, mine.schema) as writer:
                writer.write_table(mine)
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_g", "part", "rows"])

    return df.mapInArrow(run, "_g string, part int, rows binary")


def means(q: DataFrame, d: DataFrame, p: int, m: int, k: int, same: Sequence[int | None], sizes: dict[str, int]) -> DataFrame:
    """(qkey, ti, value, n_donors). ``same`` has for each target the feature that it is, if any; ``sizes`` each group's donors."""
    spark, own = q.sparkSession, [i for i in range(m) if same[i] is None]
    cores, n = spark.sparkContext.defaultParallelism, q.count()
    shares = max(1, min(2 * max(cores, len(sizes)), -(-n // SHARE_ROWS)))  # shares differ in work
    here = F.concat(*[F.when(F.col(f"q{j}").isNull(), "0").otherwise("1") for j in range(p)])
    q = q.where(F.col("_g").isin(sorted(sizes))).withColumn("_p", here).repartitionByRange(shares, "_g", "_p", "qkey").drop("_p")  # a share has few patterns
    q = q.withColumn("_need", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.array_contains("_need", i)))
    queries = cut_lineage(_packed(q.select("_g", "qkey", *[f"q{j}" for j in range(p)], *[F.get("_need", F.lit(i)).alias(f"n{i}") for i in range(m)])))
    places: dict[str, dict[int, int]] = {}
    for number, r in enumerate(queries.select("_g", "part").distinct().orderBy("_g", "part").collect()):  # about as many as shares and groups
        places.setdefault(r["_g"], {})[r["part"]] = number
    if not places:
        return spark.createDataFrame([], SCHEMA)
    donors = _packed(d.where(F.col("_g").isin(sorted(places))).select("_g", "dkey", *[f"d{j}" for j in range(p)], *[f"t{i}" for i in own], "w"))
    asking = F.element_at(F.create_map(*[F.lit(v) for g, at in places.items() for part, number in at.items() for v in (f"{g}\u0001{part}", number)]), F.concat("_g", F.lit("\u0001"), F.col("part").cast("string")))
    giving = F.element_at(F.create_map(*[v for g, at in places.items() for v in (F.lit(g), F.array(*map(F.lit, at.values())))]), F.col("_g"))
    both = queries.select("rows", F.lit(True).alias("ask"), asking.alias("place")).unionByName(donors.select("rows", F.lit(False).alias("ask"), F.explode(giving).alias("place")))
    dealt = both.repartitionById(sum(map(len, places.values())), F.col("place").cast("int"))

    def table(blobs: list[bytes]) -> pa.Table:
        return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blobs)

    def matrix(rows: pa.Table, names: list[str], kind=float) -> np.ndarray:
        return np.column_stack([rows[c].to_numpy().astype(kind) for c in names]) if names else np.zeros((rows.num_rows, 0), dtype=kind)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for rows, ask, place in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(place, ([], []))[ask].append(rows)
        while held:
            given, asked = held.popitem()[1]
            if not asked or not given:
                continue
            asked, given = table(asked), table(given)
            rank = np.empty(given.num_rows, dtype=np.int64)
            rank[pc.sort_indices(given["dkey"], null_placement="at_start").to_numpy()] = np.arange(given.num_rows)
            x, w = matrix(given, [f"d{j}" for j in range(p)]), given["w"].to_numpy().copy()
            more = matrix(given, [f"t{i}" for i in own])
            del given
            t = x if list(same) == list(range(p)) else np.column_stack([more[:, own.index(i)] if j is None else x[:, j] for i, j in enumerate(same)])
            found = search(matrix(asked, [f"q{j}" for j in range(p)]), matrix(asked, [f"n{i}" for i in range(m)], bool), x, t, w, rank, k)
            row, ti, value, weight = found
            names = asked["qkey"].combine_chunks().take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([names, pa.array(ti, pa.int32()), pa.array(value, pa.float64()), pa.array(weight.astype(np.int64))], names=["qkey", "ti", "value", "n_donors"])

    return dealt.mapInArrow(run, SCHEMA)


def row_bytes(p: int, m: int) -> int:
    """What a donor takes in a task, about: its values, the factors of the products and its key."""
    return 8 * ((4 if p > NARROW else 6) * p + m * (p <= NARROW)) + 64
