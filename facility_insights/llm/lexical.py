"""Ranked lexical search by presence masks.

A first pass reads the whole texts once and writes, for each document, its number of terms and how
often it holds each term that some item asks for. Document counts, lengths and frequencies come
from that table by grouped sums. The second pass takes the documents in blocks. In a block every term
has a bitmap of the documents that hold it. An item lays its terms' bitmaps one above the other and reads
them by columns: a column is the mask of the terms that a document has, and documents of one mask are a
group. No document of a group can score more than the sum, over the mask's terms, of the term's weight times
the best share that any document of the block reaches with it. Groups are evaluated by this bound, highest
first, until the next bound is below the k-th best score so far; a group on a level with it is still
evaluated, as ties go to smaller ids. A task carries an item's best scores from block to block, so
most masks end unread. Each task gives k rows for an item at most; two ranked rounds make one list of them.

Items are dealt to passes by hash, so that a pass asks for a bounded number of terms; each pass reads
the documents anew.

Terms are runs of 0-9, A-Z, a-z and non-ASCII characters, A-Z lower-cased. Null and empty texts have none
and count for nothing; documents without an id are documents (their ids come after the others on ties, and
stay null); repeated rows are documents of their own. Equal item rows are one item, rows of one id and
different texts items of their own. An item without terms, or that no document scores for, has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facility_insights.llm.decontaminate import words
from facility_insights.llm.shared import batches, utf8
from facility_insights.session import scratch_path

#: Distinct terms of items that one pass asks for, about (its items' terms with repeats are counted).
PASS_TERMS = 400_000
#: Documents of a block; a term's bitmap is an eighth of that in bytes.
BLOCK_DOCS = 4096
#: Documents that are evaluated together, at least.
AT_ONCE = 512
#: A score's constants: the contract's whole numbers.
SHARE, LENGTH, FREQUENCY, SLOPE = 1_000_000_000, 100, 1000, 50
_SATURATION = 20
#: An id above all others, for documents without one.
_NO_ID = 2**63 - 1

INDEX = "doc_id long, n long, terms array<int>, times array<int>"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): each distinct item that has terms, with its distinct terms."""

    def run(rows):
        for b in rows:
            terms = [sorted({w.decode() for w in words(text)}) for text in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    given = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return given.mapInArrow(run, given.select("item_id", F.array(F.lit("")).alias("terms")).schema).where(F.size("terms") > 0)


def index(docs: DataFrame, vocabulary: dict[bytes, int], *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times): documents with terms; those in the vocabulary by number, ascending."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(rows):
        def made():
            for b in rows:
                for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    found = words(text)
                    if found:
                        asked = sorted((vocabulary[w], times) for w, times in Counter(found).items() if w in vocabulary)
                        yield doc, len(found), [t for t, _ in asked], [times for _, times in asked]

        yield from batches(made(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


def weights(frequencies: Iterable[tuple[int, int]], n_docs: int, n_terms: int) -> np.ndarray:
    """Weight of each term by its document frequency; terms that no document has weigh 0, as they are never met."""
    out = np.zeros(n_terms, dtype=np.int64)
    for term, df in frequencies:
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


def _share(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A term's share of its weight by its occurrences and the document's length norm."""
    return (SHARE * times) // (FREQUENCY * times + _SATURATION * norm)


class Block:
    """Postings and bitmaps of some documents."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray):
        self.ids, self.norms = ids, norms
        docs = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.docs, self.times = docs[order], times[order]
        self.starts = np.append(starts, len(docs))
        shares = _share(self.times, norms[self.docs])
        self.best = np.maximum.reduceat(shares, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        self.shares = shares
        self.bitmaps = np.zeros((len(self.terms), (len(ids) + 7) // 8), dtype=np.uint8)
        row = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        np.bitwise_or.at(self.bitmaps, (row, self.docs >> 3), (128 >> (self.docs & 7)).astype(np.uint8))

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct masks as 0/1 rows, group of each document that has a term, those documents)."""
        any_term = np.unpackbits(np.bitwise_or.reduce(self.bitmaps[rows], axis=0), count=len(self.ids))
        docs = np.flatnonzero(any_term)
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.ids))[:, docs]
        columns = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        width = columns.shape[1]
        keys = np.zeros((len(docs), -(-width // 8) * 8), dtype=np.uint8)
        keys[:, :width] = columns
        whole = keys.view(np.uint64)
        if whole.shape[1] == 1:
            _, first, group = np.unique(whole[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, group = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        return bits[:, first].T, group.ravel(), docs

    def scores(self, rows: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents (ascending places) for some terms."""
        out = np.zeros(len(docs), dtype=np.int64)
        for row, w in zip(rows, weight, strict=True):
            held = slice(self.starts[row], self.starts[row + 1])
            place = np.searchsorted(docs, self.docs[held])
            place[place == len(docs)] = 0
            met = docs[place] == self.docs[held]
            out[place[met]] += w * self.shares[held][met]
        return out


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def floor(self) -> int:
        """Scores below this are out; no document scores below 1."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(block: Block, item: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the block's documents to an item's best; returns how many documents were evaluated.

    ``item`` holds ascending term numbers, ``weight`` all terms' weights.
    """
    at = np.searchsorted(block.terms, item)
    at[at == len(block.terms)] = 0
    rows = at[block.terms[at] == item] if len(block.terms) else at[:0]
    rows = rows[weight[block.terms[rows]] > 0]
    w = weight[block.terms[rows]]
    top = w * block.best[rows]
    if not len(rows) or int(top.sum()) < best.floor:
        return 0
    masks, group, docs = block.masks(rows)
    bounds = masks @ top
    order = np.argsort(-bounds, kind="stable")
    sizes = np.bincount(group, minlength=len(bounds))[order]
    by_group = docs[np.argsort(np.argsort(order)[group], kind="stable")]  # documents, groups of high bounds first
    upto = np.cumsum(sizes)
    done = first = 0
    while first < len(order) and bounds[order[first]] >= best.floor:
        # further groups that may still count, until there are enough documents for one step
        last = min(len(order), max(first + 1, int(np.searchsorted(upto, done + AT_ONCE)) + 1))
        last = first + int(np.searchsorted(-bounds[order[first:last]], -best.floor, side="right"))
        chosen = np.sort(by_group[done : upto[last - 1]])
        scores = block.scores(rows, w, chosen)
        fit = scores >= best.floor
        best.add(scores[fit], block.ids[chosen[fit]])
        done, first = int(upto[last - 1]), last
    return done


def _blocks(rows: Iterable[pa.RecordBatch], n_docs: int, n_words: int) -> Iterator[Block]:
    for b in rows:
        for at in range(0, b.num_rows, BLOCK_DOCS):
            part = b.slice(at, BLOCK_DOCS)
            lists = part.column(2)
            norms = LENGTH - SLOPE + (SLOPE * part.column(1).to_numpy() * n_docs) // n_words
            ids = part.column(0).fill_null(_NO_ID).to_numpy()
            yield Block(ids, norms, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64))


def _candidates(held: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(item, doc_id, score, task): k rows for an item from each task at most."""

    def run(rows):
        best = [Best(k) for _ in items]
        for block in _blocks(rows, n_docs, n_words):
            for item, held_best in zip(items, best, strict=True):
                search_block(block, item, weight, held_best)
        task = TaskContext.get().partitionId()
        for first in range(0, len(items), 2048):
            part = best[first : first + 2048]
            ids, scores = np.concatenate([x.ids for x in part]), np.concatenate([x.scores for x in part])
            numbers = np.repeat(np.arange(first, first + len(part), dtype=np.int32), [len(x.ids) for x in part])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(ids, mask=ids == _NO_ID), pa.array(scores), pa.array(np.full(len(ids), task, dtype=np.int32))], names=["item", "doc_id", "score", "task"])

    return held.mapInArrow(run, "item int, doc_id long, score long, task int")


def rank(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents, ids as long."""
    spark = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    held = scratch_path(spark, "lexical-items")
    asked.write.parquet(held)
    asked = spark.read.parquet(held)
    passes = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // pass_terms)
    out = None
    for number in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == number)
        found = _pass(docs, mine.collect(), asked, id_col, text_col, k)  # about pass_terms terms
        out = found if out is None else out.unionByName(found)
    return out if out is not None else asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)


def _pass(docs: DataFrame, mine: list, asked: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t.encode(): number for number, t in enumerate(sorted({t for row in mine for t in row["terms"]}))}
    held = scratch_path(spark, "lexical-index")
    index(docs, vocabulary, id_col=id_col, text_col=text_col).write.parquet(held)
    held = spark.read.parquet(held)
    n_docs, n_words = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequencies = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the pass
    weight = weights(frequencies, n_docs, len(vocabulary))
    numbered = [np.array(sorted(vocabulary[t.encode()] for t in row["terms"]), dtype=np.int64) for row in mine]
    found = _candidates(held.select("doc_id", "n", "terms", "times"), numbered, weight, n_docs, n_words or 1, k)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # tasks meet in a square root of their number first, so that no task gets k rows of each
    groups = F.floor(F.sqrt(F.col("task")))
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("item", groups).orderBy(*best))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, row["item_id"]) for n, row in enumerate(mine)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
