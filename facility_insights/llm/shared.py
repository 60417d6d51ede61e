"""Helpers of several operators: state of a Python worker, row identity, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.session import cut_lineage


def worker_state(name: str, stamp: object, make: Callable[[], object]) -> object:
    """One object per Python worker, made anew when the name or stamp changes.

    It outlives a task, so words that one task has looked up are known to the next one. It is
    only a memory of computed values: results never depend on it. A worker keeps one such object at
    a time, so the memories of several operators don't add up.
    """
    store = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if (getattr(store, "held", None) or (None,))[0] != (name, stamp):
        store.held = None  # frees the old one first
        store.held = ((name, stamp), make())
    return store.held[1]


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return pc.cast(column, pa.binary()).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weight: Callable[[tuple], int] | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows, or of about ``most`` bytes by ``weight``."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row) if weight else 0
        if len(held) >= size or heavy >= most:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_key(id_col: str, text_col: str) -> Column:
    """Identity of a document: hash of its id and text, so that equal rows are one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): the smallest node of each node's connected component.

    Alternating large-star and small-star rounds over long node ids. A hub is never gathered:
    its smallest neighbour comes from a pre-aggregated minimum and goes back by a join, whose
    skewed keys Spark splits. Each round is written to the checkpoint folder; the rounds end when
    the edges no longer change. Nodes without an edge to another node are left out.
    """
    low, high = F.least(u, v), F.greatest(u, v)
    held = cut_lineage(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    before = None
    while (now := held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
