"""Gradient boosting by histograms of first and second derivatives.

Features become bins between quantiles. Each step of a tree is one job: tasks sum the derivatives of their rows by
(group, member, node, feature, bin), Spark deals the sums by node, where they are added up, running sums along the bins give
every split's gain, and the best split of each node, a few numbers, comes to the driver. ``gamma`` is taken off each gain, the least child weight
bounds a child's sum of second derivatives, and columns are drawn anew for each tree.

Many models grow in the same jobs: ``group`` keys rows (folds, splits, targets), ``members`` are parameter sets that share
rows. A tree grows level by level, or, with ``leaves``, the leaf of the largest gain first. For that the tree is
laid out ahead of what is chosen: all leaves that a choice by the gains known so far would split get their children looked
at in one job, until the choice needs no unknown gain. The result is that of one split after another, in about as many jobs
as the tree is deep.

With ``alpha`` the loss is the pinball loss: second derivatives are 1, and a leaf's value is the alpha-quantile of its residuals from
mergeable sketches, all leaves of all models in one aggregate.

While the rows of every group fit into ``LOCAL_BYTES`` no tree is worth a job a level: a task gets one model's binned rows and grows all
its trees, so all models take one job. A search's tasks score their test rows too, and only the errors leave them.

Rows with their bins and scores so far lie in the shared folder. In jobs, they are written anew every ``REWRITE`` trees; in between, tasks
apply the trees since then. Missing features go right. Rows without a label are left out of fits.
"""

from __future__ import annotations

import heapq
import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import scratch_path

#: Bins of a feature; one more is for missing values.
BINS = 255
#: Trees after which the rows' scores are written anew.
REWRITE = 10
#: Rows of a task, about.
TASK_ROWS = 100_000
#: Rows that are worth a task of their own while cores are free.
LEAST_ROWS = 5_000
#: Cells that a task sums up in one array; beyond, only those that its rows meet.
DENSE_CELLS = 1 << 22
#: Bytes of a model's rows that one task holds, and what a row takes there besides its bins.
LOCAL_BYTES, ROW_BYTES = 1 << 28, 80
#: Nodes whose splits are looked for at once.
SCANNED = 128


@dataclass(frozen=True)
class Settings:
    """One member's parameters."""

    rate: float = 0.1
    depth: int = 3
    child_weight: float = 1.0
    gamma: float = 0.0
    columns: float = 1.0
    penalty: float = 1.0
    leaves: int | None = None
    alpha: float | None = None

    @classmethod
    def of(cls, drawn: dict) -> "Settings":
        """From a draw of the search grid."""
        return cls(rate=drawn["learning_rate"], depth=drawn["max_depth"], child_weight=drawn["min_child_weight"], gamma=drawn["gamma"], columns=drawn["colsample_bytree"])


@dataclass
class Tree:
    """Nodes by number; feature -1 marks a leaf. ``known`` holds the best split of nodes that were looked at."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    total: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])
    known: dict[int, tuple] = field(default_factory=dict)
    pending: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature), "bin": np.array(self.bin), "left": np.array(self.left), "right": np.array(self.right), "value": np.array(self.value)}

    def chosen(self, s: Settings) -> set[int]:
        """Nodes to split by the gains known so far."""
        if s.leaves is None:
            return {n for n, split in self.known.items() if split and self.level[n] < s.depth}
        heap, out = [(-self.known[0][0], 0)] if self.known.get(0) else [], set()
        while heap and len(out) + 1 < s.leaves:
            _, n = heapq.heappop(heap)
            out.add(n)
            if self.feature[n] >= 0:
                for child in (self.left[n], self.right[n]):
                    if self.known.get(child) and self.level[child] < s.depth:
                        heapq.heappush(heap, (-self.known[child][0], child))
        return out

    def advance(self, s: Settings) -> None:
        """Gives children to the chosen nodes that have none; those that may be split are looked at next."""
        self.pending = []
        for n in sorted(self.chosen(s)):
            if self.feature[n] >= 0:
                continue
            gain, feature, bin_, g, h = self.known[n]
            self.feature[n], self.bin[n], self.gain[n] = feature, bin_, gain
            self.left[n], self.right[n] = len(self.feature), len(self.feature) + 1
            for child_g, child_h in ((g, h), (self.total[n] - g, self.cover[n] - h)):
                if child_h >= 2 * max(1.0, s.child_weight) and self.level[n] + 1 < s.depth:
                    self.pending.append(len(self.feature))
                for name, v in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", -child_g / (child_h + s.penalty)), ("cover", child_h), ("total", child_g), ("gain", 0.0), ("level", self.level[n] + 1)):
                    getattr(self, name).append(v)

    def prune(self, s: Settings) -> None:
        """Leaves only the chosen splits."""
        chosen = self.chosen(s)
        for n in range(len(self.feature)):
            if n not in chosen:
                self.feature[n], self.gain[n] = -1, 0.0


def _leaf(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Each row's leaf."""
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        feature = tree["feature"][node]
        inner = feature >= 0
        if not inner.any():
            return node
        below = bins[rows, np.maximum(feature, 0)] <= tree["bin"][node]
        node = np.where(inner, np.where(below, tree["left"][node], tree["right"][node]), node)


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, cut in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), BINS, np.searchsorted(cut, x[:, j], side="left"))
    return out


def _cuts(rows: DataFrame, p: int) -> dict[int, list[np.ndarray]]:
    """For each group and feature, the highest values of the bins but the last."""
    shares = F.array(*[F.lit((k + 1) / BINS) for k in range(BINS - 1)])
    found = rows.groupBy("g").agg(*[F.percentile_approx(f"x{j}", shares, F.lit(S.QUANTILE_ACCURACY)).alias(f"x{j}") for j in range(p)]).collect()  # groups x features x BINS
    return {r["g"]: [np.unique(np.array(r[f"x{j}"] or [], dtype=float)) for j in range(p)] for r in found}


def _derivative(score: np.ndarray, y: np.ndarray, alpha: float | None) -> np.ndarray:
    return score - y if alpha is None else np.where(y > score, -alpha, 1.0 - alpha)


def _read(batch: pa.RecordBatch, p: int, m: int) -> tuple[np.ndarray, ...]:
    g, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, p)
    scores = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(len(y), m).copy()
    return g, y, bins, scores


def _packed(state: DataFrame, p: int, fit: bool) -> DataFrame:
    """(g, fit, y, bins): the rows of a slab and group in one."""

    def run(batches):
        for b in _slabs(batches):
            g, y, bins, _ = _read(b, p, 0)
            found = np.unique(g)
            columns = [[v[g == k].tobytes() for k in found] for v in (y, bins)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([fit] * len(found)), *(pa.array(c, pa.binary()) for c in columns)], names=["g", "fit", "y", "bins"])

    return state.mapInArrow(run, "g int, fit boolean, y binary, bins binary")


STATE = "g int, y double, bins binary, scores binary"


def _write_state(rows: DataFrame, run) -> DataFrame:
    path = scratch_path(rows.sparkSession, "boosting")
    rows.mapInArrow(run, STATE).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _first_state(rows: DataFrame, cuts: dict, start: dict[int, list[float]], p: int) -> DataFrame:
    def run(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            x = np.column_stack([b.column(2 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(p)])
            bins, scores = np.zeros(x.shape, dtype=np.uint8), np.zeros((len(g), len(next(iter(start.values())))))
            for k in np.unique(g):
                bins[g == k], scores[g == k] = _binned(x[g == k], cuts[k]), start[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([r.tobytes() for r in scores], pa.binary())], names=["g", "y", "bins", "scores"])

    return _write_state(rows, run)


def _apply(scores: np.ndarray, g: np.ndarray, bins: np.ndarray, done: list[dict]) -> np.ndarray:
    """Adds the trees of ``done`` ({(group, member): (arrays, rate)}) to the scores."""
    for k in np.unique(g):
        rows = np.flatnonzero(g == k)
        for trees in done:
            for member in range(scores.shape[1]):
                if (k, member) in trees:
                    tree, rate = trees[k, member]
                    scores[rows, member] += rate * tree["value"][_leaf(tree, bins[rows])]
    return scores


def _slabs(batches):
    """The batches of a task, several at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TASK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


CELLS = "g int, member int, node int, at binary, first binary, second binary"


def _cells(state: DataFrame, p: int, m: int, done: list[dict], now: dict, alphas: list[float | None]) -> DataFrame:
    """(g, member, node, at, first, second): sums over a slab's rows in nodes that are looked at, a row for each node; ``at`` numbers
    the met cells of (feature, bin). ``now`` has (arrays, nodes, features)."""

    def run(batches):
        for b in _slabs(batches):
            g, y, bins, scores = _read(b, p, m)
            scores = _apply(scores, g, bins, done)
            for k in np.unique(g):
                mine = np.flatnonzero(g == k)
                for member in range(m):
                    if (k, member) not in now:
                        continue
                    tree, nodes, features = now[k, member]
                    place = np.searchsorted(nodes, leaf := _leaf(tree, bins[mine]))
                    place[place == len(nodes)] = 0
                    met = nodes[place] == leaf
                    rows, place = mine[met], place[met]
                    if not len(rows):
                        continue
                    first = _derivative(scores[rows, member], y[rows], alphas[member])
                    keys = ((place[:, None] * p + np.asarray(features)) * (BINS + 1) + bins[rows][:, features]).ravel()
                    weights = np.repeat(first, len(features))
                    cells = len(nodes) * p * (BINS + 1)
                    if cells <= DENSE_CELLS:
                        second = np.bincount(keys, minlength=cells)
                        at = np.flatnonzero(second)
                        first, second = np.bincount(keys, weights=weights, minlength=cells)[at], second[at]
                    else:
                        at, back = np.unique(keys, return_inverse=True)
                        first, second = np.bincount(back, weights=weights), np.bincount(back)
                    node, at = np.divmod(at, p * (BINS + 1))
                    found = np.unique(node)
                    lo, hi = np.searchsorted(node, found), np.searchsorted(node, found, side="right")
                    cut = lambda v, kind, lo=lo, hi=hi: pa.array([v[i:j].astype(kind).tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), v, dtype=np.int32)) for v in (k, member)] + [pa.array(nodes[found].astype(np.int32)), cut(at, np.int32), cut(first, np.float64), cut(second, np.float64)],
                        names=["g", "member", "node", "at", "first", "second"],
                    )

    return state.mapInArrow(run, CELLS)


SPLITS = "g int, member int, node int, total double, cover double, gain double, feature int, bin int, gl double, hl double"


def best_splits(cells: DataFrame, members: Sequence[Settings], p: int, columns: dict[tuple[int, int], Sequence[int]], nodes: int) -> DataFrame:
    """(g, member, node, total, cover, gain, feature, bin, gl, hl): the nodes' sums, and the best split with the sums of
    its left child, or nulls. Nodes are dealt to tasks, which add up the cells of one row after another."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for g, member, node, at, first, second in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                held = sums.setdefault((g, member, node), np.zeros((2, p * (BINS + 1))))
                at = np.frombuffer(at, dtype=np.int32)
                held[0, at] += np.frombuffer(first)
                held[1, at] += np.frombuffer(second)
        out = [(*key, *_best(held.reshape(2, p, BINS + 1), members[key[1]], columns[key[:2]])) for key, held in sums.items()]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 3 + [pa.int32()] * 2 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds], names=[x.split(" ")[0] for x in SPLITS.split(", ")])

    tasks = max(1, min(nodes, cells.sparkSession.sparkContext.defaultParallelism))
    return cells.repartition(tasks, "g", "member", "node").mapInArrow(run, SPLITS)


def _best(held: np.ndarray, s: Settings, features: Sequence[int]) -> tuple:
    """(total, cover, gain, feature, bin, gl, hl) of one node; ties go to the first feature, then the lowest bin."""
    first, second = held[0, features], held[1, features]
    gl, hl = first.cumsum(axis=1), second.cumsum(axis=1)
    gt, ht = gl[:, -1:], hl[:, -1:]
    gr, hr = gt - gl, ht - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gl * gl / (hl + s.penalty) + gr * gr / (hr + s.penalty) - gt * gt / (ht + s.penalty)) / 2 - s.gamma
    least = max(s.child_weight, 1.0)
    allowed = (hl >= least) & (hr >= least) & (second > 0) & (gain > 1e-12)
    allowed[:, BINS] = False
    total, cover = float(gt.max()), float(ht.max())
    if not allowed.any():
        return total, cover, None, None, None, None, None
    j, k = np.unravel_index(np.argmax(np.where(allowed, gain, -np.inf)), gain.shape)
    return total, cover, float(gain[j, k]), int(features[j]), int(k), float(gl[j, k]), float(hl[j, k])


def _leaf_quantiles(state: DataFrame, p: int, m: int, done: list[dict], now: dict, alphas: list[float | None]) -> list:
    """The alpha-quantile of the residuals in each leaf, all models in one aggregate."""

    def run(batches):
        for b in batches:
            g, y, bins, scores = _read(b, p, m)
            scores = _apply(scores, g, bins, done)
            for k in np.unique(g):
                mine = np.flatnonzero(g == k)
                for member in range(m):
                    if (k, member) in now and alphas[member] is not None:
                        leaf = _leaf(now[k, member], bins[mine])
                        n = len(mine)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.full(n, member, dtype=np.int32)), pa.array(leaf.astype(np.int32)), pa.array(y[mine] - scores[mine, member])], names=["g", "member", "leaf", "residual"])

    rows = state.mapInArrow(run, "g int, member int, leaf int, residual double")
    alpha = [a for a in alphas if a is not None][0]
    return rows.groupBy("g", "member", "leaf").agg(F.percentile_approx("residual", F.lit(alpha), F.lit(S.QUANTILE_ACCURACY)).alias("q")).collect()


@dataclass
class Ensemble:
    """Start value and trees with thresholds in the features' own units; a node's value is what the trees below give on average."""

    start: float
    trees: list[dict[str, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t["value"][self.leaves(t, x)] for t in self.trees), np.zeros(len(x)))

    @staticmethod
    def leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        return Ensemble.path(tree, x)[-1]

    @staticmethod
    def path(tree: dict[str, np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        node, rows, out = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), []
        while True:
            out.append(node)
            inner = tree["feature"][node] >= 0
            if not inner.any():
                return out
            below = x[rows, np.maximum(tree["feature"][node], 0)] <= tree["threshold"][node]  # NaN: right
            node = np.where(inner, np.where(below, tree["left"][node], tree["right"][node]), node)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Each feature's part of a prediction: the change of the nodes' values along each path, by the feature that it is split on."""
        out = np.zeros(x.shape)
        rows = np.arange(len(x))
        for tree in self.trees:
            path = self.path(tree, x)
            for node, child in zip(path[:-1], path[1:], strict=True):
                moved = node != child
                np.add.at(out, (rows[moved], tree["feature"][node[moved]]), (tree["value"][child] - tree["value"][node])[moved])
        return out

    @property
    def mean(self) -> float:
        """Average prediction over the fit rows."""
        return self.start + sum(float(t["value"][0]) for t in self.trees)

    def importances(self, p: int) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(p)
        for t in self.trees:
            inner = t["feature"] >= 0
            np.add.at(out, t["feature"][inner], t["gain"][inner])
        return out / out.sum() if out.sum() else out


def _finished(tree: dict[str, np.ndarray], rate: float, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """A grown tree with thresholds; ``tree`` has each node's level and cover besides."""
    value, cover, level, inner = rate * tree["value"], tree["cover"], tree["level"], tree["feature"] >= 0
    for k in range(int(level.max()) - 1, -1, -1):
        at = np.flatnonzero(inner & (level == k))
        left, right = tree["left"][at], tree["right"][at]
        value[at] = (value[left] * cover[left] + value[right] * cover[right]) / (cover[left] + cover[right])
    threshold = np.full(len(value), np.inf)
    for f, cut in enumerate(cuts):
        at = np.flatnonzero((tree["feature"] == f) & (tree["bin"] < len(cut)))
        threshold[at] = cut[tree["bin"][at]]
    return {"feature": tree["feature"], "threshold": threshold, "left": tree["left"], "right": tree["right"], "value": value, "gain": tree["gain"]}


# ---------------------------------------------------------------------------------------------
# growth in one task
# ---------------------------------------------------------------------------------------------

def _dense_splits(keys: np.ndarray, grad: np.ndarray, nodes: int, width: int, s: Settings) -> tuple[np.ndarray, ...]:
    """(gain, bin, gl, hl, gt) of each node's best split by one feature; gain is -inf where there is none. ``keys`` are node * width + bin."""
    first = np.bincount(keys, weights=grad, minlength=nodes * width).reshape(nodes, width)
    second = np.bincount(keys, minlength=nodes * width).reshape(nodes, width)
    out = [np.empty(nodes), np.empty(nodes, dtype=np.int64), np.empty(nodes), np.empty(nodes), np.empty(nodes)]
    least = max(s.child_weight, 1.0)
    for lo in range(0, nodes, SCANNED):
        some = second[lo : lo + SCANNED] > 0
        gl, hl = first[lo : lo + SCANNED].cumsum(axis=1), second[lo : lo + SCANNED].cumsum(axis=1, dtype=float)
        gt, ht = gl[:, -1:], hl[:, -1:]
        gr, hr = gt - gl, ht - hl
        allowed = some & (hl >= least) & (hr >= least)
        allowed[:, BINS:] = False
        gain = _gains(gl, hl, gr, hr, gt, ht, s)
        gain[~(allowed & (gain > 1e-12))] = -np.inf
        at = gain.argmax(axis=1)
        rows = np.arange(len(at))
        for held, v in zip(out, (gain[rows, at], at, gl[rows, at], hl[rows, at], gt[:, 0]), strict=True):
            held[lo : lo + SCANNED] = v
    return tuple(out)


def _sparse_splits(keys: np.ndarray, grad: np.ndarray, nodes: int, width: int, s: Settings) -> tuple[np.ndarray, ...]:
    """The same from the cells that rows meet, for many nodes of few rows. Every node has rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True])
    node, bin_ = np.divmod(keys[last], width)
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    end = np.r_[begin[1:], len(node)] - 1
    g, h = grad[order].cumsum()[last], last + 1.0
    before_g, before_h = np.r_[0.0, g[end[:-1]]], np.r_[0.0, h[end[:-1]]]
    gl, hl = g - before_g[node], h - before_h[node]
    gt, ht = gl[end], hl[end]
    gr, hr = gt[node] - gl, ht[node] - hl
    least = max(s.child_weight, 1.0)
    gain = _gains(gl, hl, gr, hr, gt[node], ht[node], s)
    gain[~((hl >= least) & (hr >= least) & (bin_ < BINS) & (gain > 1e-12))] = -np.inf
    best = np.maximum.reduceat(gain, begin)
    at = np.minimum.reduceat(np.where(gain == best[node], np.arange(len(node)), len(node)), begin)
    return best, bin_[at], gl[at], hl[at], gt


def _gains(gl, hl, gr, hr, gt, ht, s: Settings) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (gl * gl / (hl + s.penalty) + gr * gr / (hr + s.penalty) - gt * gt / (ht + s.penalty)) / 2 - s.gamma


def _level_tree(bins: np.ndarray, grad: np.ndarray, s: Settings, features: Sequence[int], widths: Sequence[int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree grown level by level, and each row's leaf. ``bins`` has a row for each feature."""
    n = len(grad)
    leaf, slot, rows, grad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n), grad.copy()
    held = {j: bins[j] for j in features}  # of the open rows
    at, total, cover = np.zeros(1, dtype=np.int64), np.array([grad.sum()]), np.array([float(n)])
    kinds = {"feature": np.int64, "bin": np.int64, "left": np.int64, "right": np.int64, "value": float, "cover": float, "gain": float, "level": np.int64}
    levels = [{name: np.zeros(1, dtype=kind) for name, kind in kinds.items()}]
    levels[0]["feature"][:], levels[0]["value"], levels[0]["cover"] = -1, -total / (cover + s.penalty), cover
    first = 0  # number of the level's first node
    for level in range(s.depth):
        gain, split, tops = np.full(len(at), -np.inf), [np.zeros(len(at), dtype=kind) for kind in (np.int64, np.int64, float, float)], []
        for j, b in held.items():
            keys = slot * widths[j]
            keys += b
            cells = len(at) * widths[j]
            dense = cells <= max(1 << 16, min(DENSE_CELLS, 32 * len(rows)))
            one, bin_, gl, hl, gt = (_dense_splits if dense else _sparse_splits)(keys, grad, len(at), widths[j], s)
            tops.append(gt)
            better = one > gain
            for kept, v in zip((gain, *split), (one, np.full(len(at), j), bin_, gl, hl), strict=True):
                kept[better] = v[better]
        if not level:
            total = np.max(tops, axis=0)
            levels[0]["value"] = -total / (cover + s.penalty)
        done = np.flatnonzero(gain > -np.inf)
        if not len(done):
            break
        size = first + len(levels[-1]["feature"])
        left = size + 2 * np.arange(len(done))
        for name, v in (("feature", split[0][done]), ("bin", split[1][done]), ("left", left), ("right", left + 1), ("gain", gain[done])):
            levels[-1][name][at[done] - first] = v
        child_g, child_h = (np.column_stack([v[done], whole[done] - v[done]]).reshape(-1) for v, whole in ((split[2], total), (split[3], cover)))
        new = {name: np.zeros(2 * len(done), dtype=kind) for name, kind in kinds.items()}
        new["feature"][:], new["value"], new["cover"], new["level"][:] = -1, -child_g / (child_h + s.penalty), child_h, level + 1
        levels.append(new)
        pending = (child_h >= 2 * max(1.0, s.child_weight)) & (level + 1 < s.depth)
        # by 2 * slot and side: the node that rows go to, and its slot in the next level
        node, place = np.repeat(at, 2).reshape(-1, 2), np.full((len(at), 2), -1)
        node[done], place[done] = np.column_stack([left, left + 1]), np.where(pending, np.cumsum(pending) - 1, -1).reshape(-1, 2)
        above = np.zeros(len(rows), dtype=bool)
        for j, b in held.items():
            above |= b > np.where((gain > -np.inf) & (split[0] == j), split[1], BINS).astype(np.uint8)[slot]
        slot += slot
        slot += above
        if (place < 0).any():
            open_ = (place >= 0).reshape(-1)[slot]
            ended = ~open_
            leaf[rows[ended]] = node.reshape(-1)[slot[ended]]
            rows, slot, grad, held = rows[open_], slot[open_], grad[open_], {j: b[open_] for j, b in held.items()}
        if not pending.any():
            return {name: np.concatenate([x[name] for x in levels]) for name in kinds}, leaf
        slot = place.reshape(-1)[slot]
        first, at, total, cover = size, size + np.flatnonzero(pending), child_g[pending], child_h[pending]
    leaf[rows] = at[slot]
    return {name: np.concatenate([x[name] for x in levels]) for name in kinds}, leaf


def _route(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Each row's leaf; ``bins`` has a row for each feature."""
    n, flat = bins.shape[1], bins.reshape(-1)
    inner = tree["feature"] >= 0
    feature, bin_ = np.where(inner, tree["feature"], 0) * n, np.where(inner, tree["bin"], BINS)
    left, node, rows = np.where(inner, tree["left"], np.arange(len(inner))), np.zeros(n, dtype=np.int64), np.arange(n)
    for _ in range(int(tree["level"].max())):  # a leaf's rows stay: no bin is above BINS
        node = left[node] + (flat[feature[node] + rows] > bin_[node])
    return node


def _leaf_tree(bins: np.ndarray, grad: np.ndarray, s: Settings, features: Sequence[int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree of at most ``s.leaves`` leaves, laid out as in jobs, and each row's leaf."""
    t, rows = Tree(), {0: np.arange(len(grad))}
    while t.pending:
        for n in t.pending:
            held = np.zeros((2, len(bins), BINS + 1))
            for j in features:
                b = bins[j][rows[n]].astype(np.int64)
                held[0, j], held[1, j] = np.bincount(b, weights=grad[rows[n]], minlength=BINS + 1), np.bincount(b, minlength=BINS + 1)
            total, cover, *split = _best(held, s, features)
            if n == 0:
                t.total[0], t.cover[0], t.value[0] = total, cover, -total / (cover + s.penalty)
            t.known[n] = tuple(split) if split[0] is not None else ()
        t.advance(s)
        for n in [n for n in rows if t.feature[n] >= 0]:
            mine = rows.pop(n)
            below = bins[t.feature[n]][mine] <= t.bin[n]
            rows[t.left[n]], rows[t.right[n]] = mine[below], mine[~below]
    t.prune(s)
    tree = t.arrays() | {"cover": np.array(t.cover), "gain": np.array(t.gain), "level": np.array(t.level)}
    return tree, _route(tree, bins)


def _grown(y: np.ndarray, bins: np.ndarray, start: float, s: Settings, columns: Sequence[Sequence[int]]):
    """One model's trees, one after another; ``columns`` has the drawn features of each."""
    score, widths = np.full(len(y), start), [int(b.max()) + 1 for b in bins]
    for features in columns:
        grad = _derivative(score, y, s.alpha)
        tree, leaf = _leaf_tree(bins, grad, s, features) if s.leaves is not None else _level_tree(bins, grad, s, features, widths)
        if s.alpha is not None:
            order = np.argsort(leaf, kind="stable")
            found, begin = np.unique(leaf[order], return_index=True)
            for n, mine in zip(found, np.split(order, begin[1:]), strict=True):
                k = max(1, int(np.ceil(s.alpha * len(mine)))) - 1
                tree["value"][n] = np.partition(y[mine] - score[mine], k)[k]
        score += s.rate * tree["value"][leaf]
        yield tree


def _models(prepared: "_Prepared", members: Sequence[Settings], columns: list[list[Sequence[int]]], tests: DataFrame | None, run, schema: str) -> DataFrame:
    """What ``run`` gives for each model, a task each. It gets (g, member, y, bins, the test rows' y and bins)."""
    p, m, places = prepared.p, len(members), {k: i for i, k in enumerate(sorted(prepared.starts))}
    bare = {k: [] for k in places}
    rows = _packed(_first_state(prepared.spread(), prepared.cuts, bare, p), p, True)
    if tests is not None:
        rows = rows.unionByName(_packed(_first_state(tests, prepared.cuts, bare, p), p, False))
    place = F.element_at(F.create_map(*[F.lit(v) for pair in places.items() for v in pair]), F.col("g"))
    rows = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def each(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for g, fit, y, bins, member in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                held.setdefault((g, member), ([], []))[not fit].append((np.frombuffer(y), np.frombuffer(bins, dtype=np.uint8).reshape(-1, p)))
        while held:
            (g, member), sides = held.popitem()
            whole = []
            for parts in sides:
                whole += [np.concatenate([y for y, _ in parts]) if parts else np.zeros(0), np.ascontiguousarray(np.concatenate([b for _, b in parts]).T) if parts else np.zeros((p, 0), dtype=np.uint8)]
            del sides
            if len(whole[0]):
                yield from run(g, member, *whole)

    dealt = rows.repartitionById(len(places) * m, (place * m + F.col("member")).cast("int"))
    return dealt.mapInArrow(each, schema)


TREES = "g int, member int, turn int, feature binary, threshold binary, left binary, right binary, value binary, gain binary"
_TREE_KINDS = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "value": float, "gain": float}


def _local_models(prepared: "_Prepared", members: Sequence[Settings], columns: dict) -> dict[tuple[int, int], Ensemble]:
    starts, cuts = prepared.starts, prepared.cuts

    def run(g, member, y, bins, *_):
        s = members[member]
        for turn, tree in enumerate(_grown(y, bins, starts[g][member], s, columns[g, member])):
            done = _finished(tree, s.rate, cuts[g])
            ids = [pa.array([v], pa.int32()) for v in (g, member, turn)]
            yield pa.RecordBatch.from_arrays(ids + [pa.array([done[name].astype(kind).tobytes()], pa.binary()) for name, kind in _TREE_KINDS.items()], names=[x.split(" ")[0] for x in TREES.split(", ")])

    out = {(k, member): Ensemble(start[member], []) for k, start in starts.items() for member in range(len(members))}
    found = _models(prepared, members, columns, None, run, TREES).toArrow().sort_by("turn")  # the models' own size
    for g, member, *arrays in zip(*(found.column(c).to_pylist() for c in ("g", "member", *_TREE_KINDS)), strict=True):
        out[g, member].trees.append({name: np.frombuffer(v, dtype=kind) for v, (name, kind) in zip(arrays, _TREE_KINDS.items(), strict=True)})
    return out


@dataclass
class _Prepared:
    """The fit rows (g, y, x0..), written; by group their number, start values and bins."""

    rows: DataFrame
    p: int
    sizes: dict[int, int]
    starts: dict[int, list[float]]
    cuts: dict[int, list[np.ndarray]]
    alpha: float | None

    def spread(self) -> DataFrame:
        n, cores = sum(self.sizes.values()), self.rows.sparkSession.sparkContext.defaultParallelism
        return self.rows.repartition(max(-(-n // TASK_ROWS), min(cores, -(-n // LEAST_ROWS))))

    @property
    def local(self) -> bool:
        return max(self.sizes.values()) * (self.p + ROW_BYTES) <= LOCAL_BYTES


def _rows(df: DataFrame, features: Sequence[str], label: str, group: str | None) -> DataFrame:
    g = F.col(group).cast("int") if group else F.lit(0)
    return df.where(F.col(label).isNotNull()).select(g.alias("g"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])


def _prepare(df: DataFrame, features: Sequence[str], label: str, members: Sequence[Settings], group: str | None) -> _Prepared | None:
    p, path = len(features), scratch_path(df.sparkSession, "boosting-rows")
    _rows(df, features, label, group).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    alphas = [s.alpha for s in members]
    if len({a for a in alphas if a is not None}) > 1:
        raise ValueError("members must share their quantile")
    alpha = next((a for a in alphas if a is not None), None)
    at = F.percentile_approx("y", F.lit(0.5 if alpha is None else alpha), F.lit(S.QUANTILE_ACCURACY))
    found = rows.groupBy("g").agg(F.avg("y").alias("mean"), at.alias("q"), F.count("y").alias("n")).collect()
    if not found:
        return None
    starts = {r["g"]: [float(r["mean"] if a is None else r["q"]) for a in alphas] for r in found}
    return _Prepared(rows, p, {r["g"]: r["n"] for r in found}, starts, _cuts(rows, p), alpha)


def _drawn(s: Settings, p: int, seed: int, k: int, member: int, turn: int) -> list[int]:
    return sorted(random.Random(f"{seed}|{k}|{member}|{turn}").sample(range(p), max(1, round(s.columns * p))))


def grow(df: DataFrame, features: Sequence[str], label: str, members: Sequence[Settings] = (Settings(),), *, group: str | None = None, rounds: int = S.BOOST_ROUNDS, seed: int = S.DEFAULT_SEED, jobs: list[int] | None = None) -> dict[tuple[int, int], Ensemble]:
    """Ensembles by (group, member), all grown in the same jobs. ``jobs`` gets the number of jobs of each tree."""
    prepared = _prepare(df, features, label, members, group)
    if prepared is None:
        return {}
    if prepared.local:
        if jobs is not None:
            jobs.extend([1] + [0] * (rounds - 1))
        return _local_models(prepared, members, _all_drawn(prepared, members, rounds, seed))
    return _grow_in_jobs(prepared, members, rounds, seed, jobs)


def _all_drawn(prepared: _Prepared, members: Sequence[Settings], rounds: int, seed: int) -> dict[tuple[int, int], list[list[int]]]:
    return {(k, i): [_drawn(s, prepared.p, seed, k, i, turn) for turn in range(rounds)] for k in prepared.starts for i, s in enumerate(members)}


def search_errors(df: DataFrame, test: DataFrame, features: Sequence[str], label: str, members: Sequence[Settings], group: str, *, rounds: int = S.BOOST_ROUNDS, seed: int = S.DEFAULT_SEED, jobs: list[int] | None = None) -> DataFrame:
    """(member, g, mse) of models grown on ``df``, each on its group's rows of ``test``."""
    schema, spark = "member int, g int, mse double", df.sparkSession
    prepared = _prepare(df, features, label, members, group)
    if prepared is None:
        return spark.createDataFrame([], schema)
    if not prepared.local:
        return test_errors(test, _grow_in_jobs(prepared, members, rounds, seed, jobs), features, label, group)
    if jobs is not None:
        jobs.extend([1] + [0] * (rounds - 1))
    starts, columns = prepared.starts, _all_drawn(prepared, members, rounds, seed)

    def run(g, member, y, bins, test_y, test_bins):
        score, s = np.full(len(test_y), starts[g][member]), members[member]
        for tree in _grown(y, bins, starts[g][member], s, columns[g, member]):
            score += s.rate * tree["value"][_route(tree, test_bins)]
        if len(test_y):
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.int32()), pa.array([g], pa.int32()), pa.array([float(np.mean((test_y - score) ** 2))])], names=["member", "g", "mse"])

    tests = _rows(test, features, label, group).where(F.col("g").isin(sorted(starts)))
    found = _models(prepared, members, columns, tests, run, schema).collect()  # groups x members
    return spark.createDataFrame(found, schema)


def _grow_in_jobs(prepared: _Prepared, members: Sequence[Settings], rounds: int, seed: int, jobs: list[int] | None) -> dict[tuple[int, int], Ensemble]:
    p, m, starts, cuts, alpha = prepared.p, len(members), prepared.starts, prepared.cuts, prepared.alpha
    alphas = [s.alpha for s in members]
    state, since = _first_state(prepared.spread(), cuts, starts, p), []
    out = {(k, member): Ensemble(start[member], []) for k, start in starts.items() for member in range(m)}
    for turn in range(rounds):
        trees = {key: Tree() for key in out}
        columns = {}
        for k, member in out:
            columns[k, member] = _drawn(members[member], p, seed, k, member, turn)
        n_jobs = 0
        while now := {key: (t.arrays(), np.array(sorted(t.pending)), columns[key]) for key, t in trees.items() if t.pending}:
            n_jobs += 1
            found = best_splits(_cells(state, p, m, since, now, alphas), members, p, columns, sum(len(nodes) for _, nodes, _ in now.values()))
            for r in found.collect():  # a row for each node looked at
                t = trees[r["g"], r["member"]]
                if r["node"] == 0:
                    t.total[0], t.cover[0] = r["total"], r["cover"]
                    t.value[0] = -r["total"] / (r["cover"] + members[r["member"]].penalty)
                t.known[r["node"]] = (r["gain"], r["feature"], r["bin"], r["gl"], r["hl"]) if r["feature"] is not None else ()
            for (_, member), t in trees.items():
                if t.pending:
                    t.advance(members[member])
        for (_, member), t in trees.items():
            t.prune(members[member])
        if alpha is not None:
            n_jobs += 1
            for r in _leaf_quantiles(state, p, m, since, {key: t.arrays() for key, t in trees.items()}, alphas):
                trees[r["g"], r["member"]].value[r["leaf"]] = r["q"]
        if jobs is not None:
            jobs.append(n_jobs)
        since.append({key: (t.arrays(), members[key[1]].rate) for key, t in trees.items()})
        for (k, member), t in trees.items():
            out[k, member].trees.append(_finished(t.arrays() | {"cover": np.array(t.cover), "gain": np.array(t.gain), "level": np.array(t.level)}, members[member].rate, cuts[k]))
        if len(since) == REWRITE and turn + 1 < rounds:

            def rewrite(batches, done=tuple(since)):
                for b in batches:
                    k, _, bins, scores = _read(b, p, m)
                    scores = _apply(scores, k, bins, done)
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in scores], pa.binary())], names=["g", "y", "bins", "scores"])

            state, since = _write_state(state, rewrite), []
    return out


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=float) for c in columns])


def predict(df: DataFrame, models: dict[int, Ensemble], features: Sequence[str], *, group: str | None = None, out: str = "prediction") -> DataFrame:
    """The rows with their group's prediction; rows of a group without a model get null."""

    @F.pandas_udf("double")
    def score(g, *columns):
        import pandas as pd

        x, found = _matrix(columns), np.full(len(g), np.nan)
        for k in g.unique():
            if k in models:
                found[(g == k).to_numpy()] = models[k].predict(x[(g == k).to_numpy()])
        return pd.Series(found).where(~np.isnan(found), None)

    return df.withColumn(out, score(F.col(group).cast("int") if group else F.lit(0), *[F.col(c).cast("double") for c in features]))


def test_errors(df: DataFrame, models: dict[tuple[int, int], Ensemble], features: Sequence[str], label: str, group: str) -> DataFrame:
    """(member, g, mse) of all models on their groups' rows, in one pass."""
    m = 1 + max((member for _, member in models), default=-1)

    @F.pandas_udf("array<double>")
    def scores(g, *columns):
        import pandas as pd

        x, found = _matrix(columns), np.full((len(g), m), np.nan)
        for (k, member), model in models.items():
            mine = (g == k).to_numpy()
            if mine.any():
                found[mine, member] = model.predict(x[mine])
        return pd.Series(list(found))

    rows = df.where(F.col(label).isNotNull()).select(F.col(group).cast("int").alias("g"), F.col(label).cast("double").alias("y"), F.posexplode(scores(F.col(group).cast("int"), *[F.col(c).cast("double") for c in features])).alias("member", "score"))
    return rows.where(~F.isnan("score")).groupBy("member", "g").agg(F.avg(F.pow(F.col("y") - F.col("score"), 2)).alias("mse"))


def contributions(df: DataFrame, model: Ensemble, features: Sequence[str]) -> DataFrame:
    """The rows with ``contributions``, a number for each feature; they add up to prediction minus mean."""

    @F.pandas_udf("array<double>")
    def parts(*columns):
        import pandas as pd

        return pd.Series(list(model.contributions(_matrix(columns))))

    return df.withColumn("contributions", parts(*[F.col(c).cast("double") for c in features]))


def attribution(df: DataFrame, model: Ensemble, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs_contribution, direction, importance): direction is the sign of the correlation between a feature and its contribution."""
    long = contributions(df, model, features).select(F.posexplode(F.arrays_zip(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col("contributions").alias("c"))).alias("j", "v"))
    found = long.groupBy("j").agg(F.avg(F.abs("v.c")).alias("mean_abs_contribution"), F.covar_pop("v.x", "v.c").alias("together"))
    names, shares = F.array(*[F.lit(c) for c in features]), F.array(*[F.lit(float(v)) for v in model.importances(len(features))])
    return found.select(F.get(names, F.col("j")).alias("feature"), "mean_abs_contribution", F.signum(F.coalesce("together", F.lit(0.0))).cast("int").alias("direction"), F.get(shares, F.col("j")).alias("importance"))


class _BoostingParams(Params):
    featureCols = Param(Params._dummy(), "featureCols", "features", typeConverter=TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", typeConverter=TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees", typeConverter=TypeConverters.toInt)
    settings = Param(Params._dummy(), "settings", "parameters as JSON", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="prediction", rounds=S.BOOST_ROUNDS, settings="{}")


class HistogramBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, predictionCol=None, rounds=None, settings=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**{name: v for name, v in kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "HistogramBoostingModel":
        cols = self.getOrDefault(self.featureCols)
        settings = Settings(**json.loads(self.getOrDefault(self.settings)))
        found = grow(df, cols, self.getOrDefault(self.labelCol), [settings], rounds=self.getOrDefault(self.rounds))
        model = HistogramBoostingModel(featureCols=cols, predictionCol=self.getOrDefault(self.predictionCol))
        model.ensemble = found.get((0, 0), Ensemble(float("nan"), []))
        return model


class HistogramBoostingModel(Model, _BoostingParams, MLReadable, MLWritable):
    """Saved as a table of its nodes beside the stage's metadata."""

    @keyword_only
    def __init__(self, *, featureCols=None, predictionCol=None):
        super().__init__()
        self.ensemble: Ensemble | None = None
        kwargs = self._input_kwargs
        self._set(**{name: v for name, v in kwargs.items() if v is not None})

    def copy(self, extra=None) -> "HistogramBoostingModel":
        that = super().copy(extra)
        that.ensemble = self.ensemble
        return that

    def _transform(self, df: DataFrame) -> DataFrame:
        return predict(df, {0: self.ensemble}, self.getOrDefault(self.featureCols), out=self.getOrDefault(self.predictionCol))

    def write(self) -> "_NodeWriter":
        return _NodeWriter(self)

    @classmethod
    def read(cls) -> "_NodeReader":
        return _NodeReader(cls)


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double"
_NODE_FIELDS = [x.split(" ")[0] for x in NODES.split(", ")][2:]


class _NodeWriter(MLWriter):
    def __init__(self, model: HistogramBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        first = {"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [self.model.ensemble.start], "gain": [0.0]}
        trees = [first, *self.model.ensemble.trees]
        sizes = [len(t["feature"]) for t in trees]
        number, node = np.repeat(np.arange(-1, len(sizes) - 1), sizes), np.concatenate([np.arange(n) for n in sizes])
        columns = [number, node, *(np.concatenate([t[name] for t in trees]) for name in _NODE_FIELDS)]
        kinds = [pa.int32() if x.endswith(" int") else pa.float64() for x in NODES.split(", ")]
        table = pa.table([pa.array(v).cast(kind) for v, kind in zip(columns, kinds, strict=True)], names=["tree", "node", *_NODE_FIELDS])
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/nodes")


class _NodeReader(MLReader):
    def __init__(self, cls: type[HistogramBoostingModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> HistogramBoostingModel:
        spark = self.sparkSession or SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().to_pandas().sort_values(["tree", "node"])  # the model's own size
        start = float(nodes.loc[nodes["tree"] == -1, "value"].iloc[0])
        model.ensemble = Ensemble(start, [{name: t[name].to_numpy() for name in _NODE_FIELDS} for number, t in nodes.groupby("tree") if number >= 0])
        return model
