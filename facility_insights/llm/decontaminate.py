"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive item words. Texts and patterns are word sequences, and the
blocks of Wu and Manber's search are pairs of words (single words for patterns of one word). For
patterns of one length m, SHIFT says for each block of a pattern how far its last place in any
pattern is from the pattern's end; any other block lets the search skip m - B + 1 words. At shift 0
the block's bucket lists the patterns that end in it, with a hash of their first words; those
whose hash fits are compared word by word. Patterns of different lengths (items shorter than the
window) are searched in tables of their own, so that a short item does not shorten the skips.

The items are cut into blocks of a bounded number of patterns, and each block of tables goes over
all documents, so that what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facility_insights.llm.shared import utf8

#: Lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, and turns the other ASCII characters into blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Patterns that one pass over the documents holds (about 0.3 KB each).
PASS_PATTERNS = 400_000


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return (text or b"").translate(_TABLE).split()


class Search:
    """Tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], size: int):
        self.size, self.block = size, min(2, size)
        self.skip = size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, size + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.skip), size - end)
            self.buckets[self._key(pattern, size)][hash(pattern[: self.block])].append((pattern, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _key(self, found: Sequence[bytes], end: int):
        return (found[end - 2], found[end - 1]) if self.block == 2 else found[end - 1]

    def occurrences(self, found: list[bytes]) -> Iterable[tuple[int, list[int]]]:
        """(first word's place, items) of every pattern that occurs."""
        size, block, skip, shift, n = self.size, self.block, self.skip, self.shift, len(found)
        end = size
        while end <= n:
            key = (found[end - 2], found[end - 1]) if block == 2 else found[end - 1]
            jump = shift.get(key, skip)
            if jump:
                end += jump
                continue
            at = end - size
            for pattern, items in self.buckets[key].get(hash(tuple(found[at : at + block])), ()):
                if tuple(found[at:end]) == pattern:
                    yield at, items
            end += 1


def patterns(items: Iterable[tuple[int, bytes | None]], window: int) -> dict[int, dict[tuple[bytes, ...], list[int]]]:
    """For each length, its patterns and the items (by number) that have them."""
    found: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for number, text in items:
        of = words(text)
        size = min(window, len(of))
        for at in range(len(of) - size + 1 if size else 0):
            held = found[size][tuple(of[at : at + size])]
            if not held or held[-1] != number:
                held.append(number)
    return found


def hits(found: list[bytes], searches: Sequence[Search]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged spans [start, end) of words inside occurrences, and the items that occur."""
    spans, items = [], set()
    for search in searches:
        for at, of in search.occurrences(found):
            spans.append((at, at + search.size))
            items.update(of)
    return merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterable[list[tuple[int, bytes]]]:
    """Item blocks of about ``most`` patterns, one after another; an item's id may be null or repeated."""
    block, held = [], 0
    for item, text in benchmark.select(id_col, F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        raw = text.encode("utf-8")
        block.append((item, raw))
        held += max(1, len(words(raw)) - window + 1)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


SPANS = "array<struct<start:int,end:int>>"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    share: int = 20,
    most: int = PASS_PATTERNS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) and the columns named in ``keep``, a row for each input row.

    A document is contaminated if it has a hit word and share * n_hit >= n_words. ``items`` are the
    distinct ids of occurring items, sorted; ``spans`` the merged word spans. Null and empty texts
    have no words and are clean; a null item text gives no window; an item without id counts under
    null, which is left out of ``items``. Without items, nothing is hit. Repeated rows stay.
    ``keep`` may not name one of the result's own columns but doc_id.
    """
    named = text_col if text_col in keep else "_text"
    now = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(named), *[c for c in keep if c not in (id_col, text_col)])
    now = now.withColumns({"_items": F.lit(None).cast("array<long>"), "_spans": F.lit(None).cast(SPANS)})
    blocks = list(_blocks(benchmark, item_col, item_text_col, window, most)) or [[]]
    for block in blocks:
        now = now.mapInArrow(_pass(block, window, now.schema, named), now.schema)
    n_words = F.coalesce(F.element_at("_spans", -1)["end"], F.lit(0))  # the last span is a mark: (-1, number of words)
    spans = F.filter("_spans", lambda s: s["start"] >= 0)
    measured = now.withColumns({"n_words": n_words.cast("long"), "spans": spans})
    measured = measured.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    contaminated = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    return measured.select("doc_id", "n_words", "n_hit", F.array_sort("_items").alias("items"), "spans", contaminated.alias("contaminated"), *[c for c in keep if c != id_col])


def _pass(block: list[tuple[int, bytes]], window: int, schema: StructType, text_name: str):
    """One block of items over all documents; adds to the items and spans that earlier blocks found."""
    ids = [item for item, _ in block]
    names = schema.names
    text_at, items_at, spans_at = names.index(text_name), names.index("_items"), names.index("_spans")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(rows):
        searches = [Search(of, size) for size, of in patterns(enumerate(raw for _, raw in block), window).items()]
        for b in rows:
            all_items, all_spans = [], []
            for text, items, spans in zip(utf8(b.column(text_at)), b.column(items_at).to_pylist(), b.column(spans_at).to_pylist(), strict=True):
                found = words(text)
                more, numbers = hits(found, searches)
                old = [(s["start"], s["end"]) for s in spans or () if s["start"] >= 0]
                all_items.append(sorted({*(items or ()), *(ids[k] for k in numbers if ids[k] is not None)}))
                all_spans.append([{"start": s, "end": e} for s, e in (merge(old + more) if old else more)] + [{"start": -1, "end": len(found)}])
            columns = [b.column(k) for k in range(len(names))]
            columns[items_at], columns[spans_at] = pa.array(all_items, pa.list_(pa.int64())), pa.array(all_spans, span_type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the items as a count and a SHA-256 of their sorted, joined ids."""
    ids = F.transform("items", lambda x: x.cast("string"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        "contaminated",
    )
