"""SimHash fingerprints and near-duplicate components by a generalised pigeonhole join.

The join follows the generalised pigeonhole principle for Hamming search. The 64 bits are dealt
into parts, correlated bits together. If two fingerprints differ in at most ``most`` bits, then
for any integer thresholds T_i >= -1 that sum to ``most - parts + 1`` some part differs in at
most T_i bits (-1: the part is not looked at). Each fingerprint takes its own thresholds: a
dynamic programme over the parts finds those of the least estimated cost, from histograms of
eight-bit groups, whose distances are convolved. The number of parts with the least estimated
cost of all fingerprints is taken. Each fingerprint then probes the index at every part value
within T_i bits of its own, and candidates are verified by their whole distance.

Only a component of each document is asked for, so copies never meet in pairs:

* equal fingerprints are one node before any join;
* a part value held by more than ``crowd`` fingerprints is a crowded bucket. All its members and
  probers link exactly by another road: two fingerprints are within 2 bits if and only if some
  64-bit value is within 1 bit of both. Each emits the 65 values of its ball, and each value's
  fingerprints (65 at most) link to the smallest of them. That is 65 rows for a fingerprint,
  however many share the bucket. (For an even ``most`` in general, the radius is its half.)
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.llm.shared import components, utf8
from facility_insights.session import cut_lineage

BITS = 64
#: Relative costs in the threshold programme: one probe, one candidate to verify.
PROBE_COST, VERIFY_COST = 1.0, 2.0


def fingerprint(text: bytes | None, words: int = 3, block: int = 1 << 16) -> int:
    """The SimHash of one text's word shingles (XXH64, seed 42); 0 without words.

    A-Z are lower-cased and words end at ASCII white space. A bit is set if over half the
    shingles, repeats included, have it set. Hashes are counted in blocks, so memory does not grow
    with 64 times the text.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    size = min(words, len(found))
    starts = [0, *ends[: len(ends) - size]]
    shingles = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :], strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), block):
        part = shingles[at : at + block]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, itertools.repeat(42)), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    of = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(rows):
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([fingerprint(x, words) for x in utf8(b.column(1))], pa.int64())], schema=schema)

    return of.mapInArrow(run, "id long, fp long")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of nearly equal size, strongly correlated bits together."""
    strength = np.abs(correlation).astype(float)
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        block = strength[np.ix_(left, left)]
        group = [left[int(block.sum(axis=1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            left = sorted(free)
            nearest = left[int(strength[np.ix_(left, group)].mean(axis=1).argmax())]
            group.append(nearest)
            free.discard(nearest)
        groups.append(sorted(group))
    return groups


def _octets(group: list[int]) -> list[list[int]]:
    return [group[i : i + 8] for i in range(0, len(group), 8)]


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def thresholds(fps: np.ndarray, groups: list[list[int]], tables: list[list[np.ndarray]], n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's cheapest thresholds (rows by parts) and its estimated cost.

    ``tables[i][o]`` holds, for each value of octet o of part i, the share of all fingerprints at
    0 ... most bits from it. The programme's state is the sum of the thresholds so far.
    """
    total = most - len(groups) + 1
    infinite = np.full(len(fps), np.inf)
    best = {0: (np.zeros(len(fps)), [])}
    layers = []
    for group, octets in zip(groups, tables, strict=True):
        share = np.zeros((len(fps), most + 1))
        share[:, 0] = 1
        for bits, table in zip(_octets(group), octets, strict=True):
            near = table[_gather(fps, bits)]
            share = np.stack([sum(share[:, k] * near[:, e - k] for k in range(e + 1)) for e in range(most + 1)], axis=1)
        within = np.cumsum(share, axis=1) * n
        probes = np.cumsum([comb(len(group), e) for e in range(most + 1)])
        cost = {-1: np.zeros(len(fps))} | {t: PROBE_COST * probes[t] + VERIFY_COST * within[:, t] for t in range(min(most, len(group)) + 1)}
        now = {}
        for state, (so_far, _) in best.items():
            for t, c in cost.items():
                old = now.get(state + t, (infinite, None))[0]
                new = so_far + c
                choice = now.get(state + t, (None, np.zeros(len(fps), np.int64)))[1].copy()
                choice[new < old] = t
                now[state + t] = (np.minimum(old, new), choice)
        layers.append({s: choice for s, (_, choice) in now.items()})
        best = now
    out = np.empty((len(fps), len(groups)), np.int64)
    state = np.full(len(fps), total)
    for k in range(len(groups) - 1, -1, -1):
        for s, choice in layers[k].items():
            at = state == s
            out[at, k] = choice[at]
        state = state - out[:, k]
    return out, best[total][0]


def _masks(group: list[int], t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for e in range(t + 1) for chosen in itertools.combinations(group, e)], np.uint64)


def _part_mask(group: list[int]) -> int:
    value = sum(1 << b for b in group)
    return value - (1 << 64) if value >> 63 else value


class Plan:
    """Parts and octet tables, made on the driver from two fixed-size aggregates of all fingerprints."""

    def __init__(self, nodes: DataFrame, most: int):
        self.most = most
        sums = dict(map(tuple, nodes.mapInArrow(_pair_sums, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()))
        self.n = sums.get(BITS * BITS, 0)
        joint = np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS) / max(1, self.n)
        single = np.diag(joint)
        spread = np.sqrt(np.maximum(single * (1 - single), 1e-12))
        correlation = (joint - np.outer(single, single)) / np.outer(spread, spread)
        options = {m: group_bits(correlation, m) for m in range(2, most + 3)}
        cells = [(m, i, o, bits) for m, groups in options.items() for i, g in enumerate(groups) for o, bits in enumerate(_octets(g))]
        counts = nodes.mapInArrow(_histograms([c[3] for c in cells]), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()
        filled = np.zeros((len(cells), 256))
        for cell, count in counts:
            filled[cell // 256, cell % 256] = count
        ones = np.array([bin(x).count("1") for x in range(256)])
        away = ones[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        tables: dict[int, list[list[np.ndarray]]] = {m: [[] for _ in g] for m, g in options.items()}
        for (m, i, _, _), histogram in zip(cells, filled, strict=True):
            share = histogram / max(1, self.n)
            tables[m][i].append(np.stack([(share[None, :] * (away == e)).sum(axis=1) for e in range(most + 1)], axis=1))
        costs = dict(map(tuple, nodes.mapInArrow(_costs(options, tables, self.n, most), "m int, cost double").groupBy("m").agg(F.sum("cost")).collect()))
        self.parts = min(options, key=lambda m: (costs.get(m, 0.0), m))
        self.groups, self.tables = options[self.parts], tables[self.parts]


def _longs(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _cells(total: np.ndarray):
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["cell", "n"])


def _pair_sums(rows):
    """Counts of both bits set, for each pair; the last cell counts the fingerprints."""
    total = np.zeros(BITS * BITS + 1, np.int64)
    for b in rows:
        fps = _longs(b)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total[:-1] += np.rint(bits.T @ bits).astype(np.int64).ravel()
        total[-1] += len(fps)
    yield _cells(total)


def _histograms(octets: list[list[int]]):
    def run(rows):
        total = np.zeros(len(octets) * 256, np.int64)
        for b in rows:
            fps = _longs(b)
            for k, bits in enumerate(octets):
                total[k * 256 : (k + 1) * 256] += np.bincount(_gather(fps, bits), minlength=256)
        yield _cells(total)

    return run


def _costs(options, tables, n, most):
    def run(rows):
        total = dict.fromkeys(options, 0.0)
        for b in rows:
            for m, groups in options.items():
                total[m] += float(thresholds(_longs(b), groups, tables[m], n, most)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["m", "cost"])

    return run


def _probes(plan: Plan):
    groups, tables, n, most = plan.groups, plan.tables, plan.n, plan.most
    part_masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    offsets = {(i, t): _masks(g, t) for i, g in enumerate(groups) for t in range(min(most, len(g)) + 1)}

    def run(rows):
        for b in rows:
            whole = _longs(b)
            for at in range(0, len(whole), 2048):
                fps = whole[at : at + 2048]
                chosen = thresholds(fps, groups, tables, n, most)[0]
                parts, values, owners = [], [], []
                for (i, t), flips in offsets.items():
                    own = fps[chosen[:, i] == t]
                    if len(own):
                        parts.append(np.full(len(own) * len(flips), i, np.int32))
                        values.append(((own & part_masks[i])[:, None] ^ flips[None, :]).ravel().view(np.int64))
                        owners.append(np.repeat(own, len(flips)).view(np.int64))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, values, owners)], names=["part", "value", "fp"])

    return run


def _ball(radius: int):
    flips = _masks(list(range(BITS)), radius)

    def run(rows):
        for b in rows:
            whole = _longs(b)
            for at in range(0, len(whole), 2048):
                fps = whole[at : at + 2048]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fps[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], names=["centre", "fp"]
                )

    return run


def links(nodes: DataFrame, *, most: int = 2, crowd: int = 32) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of fingerprints within ``most`` bits.

    ``nodes`` has distinct fingerprints in column fp. Pairs out of buckets of ``crowd`` members at
    most are listed; crowded buckets give star edges (see the module's text).
    """
    if most % 2:
        raise ValueError("most must be even: the crowded buckets' road halves it")
    plan = Plan(nodes, most)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_part_mask(g))).alias("value")) for i, g in enumerate(plan.groups)])
    index = nodes.select("fp", F.explode(parts).alias("at")).select("at.part", "at.value", "fp")
    probes = cut_lineage(nodes.mapInArrow(_probes(plan), "part int, value long, fp long"))
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    crowded = cut_lineage(sizes.where(F.col("n") > crowd).select("part", "value"))
    key = ["part", "value"]
    near = (
        probes.join(crowded, key, "left_anti")
        .join(index.withColumnRenamed("fp", "other"), key)
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most))
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )
    # Every pair of the two crowded sides: members and probers of the same bucket.
    heavy = probes.join(crowded, key, "left_semi").select("fp").unionByName(index.join(crowded, key, "left_semi").select("fp")).distinct()
    centres = heavy.mapInArrow(_ball(most // 2), "centre long, fp long")
    stars = centres.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    star = stars.select(F.col("all")[0].alias("u"), F.explode(F.slice("all", 2, F.size("all") - 1)).alias("v"))
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, most: int = 2, crowd: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest id reachable over links of at most ``most`` differing bits. Null
    and empty texts have fingerprint 0 and link to each other. A null id never is a component_id
    unless a component has no other. Repeated rows stay; an empty table gives no row; other columns
    of the input are not looked at.
    """
    of = cut_lineage(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    nodes = cut_lineage(of.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(links(nodes.select("fp"), most=most, crowd=crowd))
    named = nodes.join(label, nodes.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(component, "label").select("fp", "component_id")
    return of.join(of_fp, "fp").select(F.col("id").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
