"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after ., ! or ? before white space, and at line ends); a sentence of
more than ``long`` words is cut after words that the hash of the word and the one before it chooses,
and ``long`` words after the last cut at the latest. So text without full stops has spans too, and an
equal passage is cut alike from its first chosen word on, wherever it begins. From every sentence a
span runs until it has at least ``sentences`` sentences and ``words`` words. Backwards by the same
rule another one runs from every line's end, or, with ``every_end``, from every sentence, so that the
last words of a repeated passage that ends inside a line are covered as well. Spans are hashed and
joined over all documents, and sentences under a span that occurs earlier (by doc_id, then place) go.

Spans travel as numbers only. A span that its own text has further in front is settled where the text
is cut, so a text sends a hash once. The first place of a hash is a pre-aggregated minimum, and only
hashes with several places go back to their spans, by a join whose skewed keys Spark splits. Beside its
spans a text sends one row with its number of sentences, so that only texts that lose some are cut again.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facility_insights.llm.shared import text_key

#: A stop with the white space after it, or line ends; all begin with one of four characters, which are searched fast.
_BREAK = re.compile(r"[.!?\n](?:(?<=\n)\n*|\s+)")
#: Stands for a null id: the last one.
_NONE = 9223372036854775807
_WORD = re.compile(r"\S+")


class _Hashes(dict):
    """Hashes of the words that the worker met last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


_HASHES = _Hashes()


def _edges(sentence: str, found: list[str], long: int) -> tuple[list[int], list[int]]:
    """(places where the pieces of a long sentence begin, words of each piece); ``found`` are its words."""
    every, n = max(2, long // 2), len(found)
    hashes = [_HASHES[w] for w in found]
    cuts, last = [], -1  # a piece's last word
    for at in [k for k, (before, word) in enumerate(zip(hashes, hashes[1:], strict=False), 1) if (word ^ before >> 5) % every == 0 and k < n - 1] + [n - 1]:
        while at - last > long:
            last += long
            cuts.append(last)
        if at < n - 1:
            last = at
            cuts.append(at)
    if len(sentence) == sum(map(len, found)) + n - 1:  # one blank between words
        places = [0, *accumulate([len(w) + 1 for w in found])]
    else:
        places = [m.start() for m in _WORD.finditer(sentence)]
    bounds = [-1, *cuts, n - 1]
    return [0, *(places[k + 1] for k in cuts)], [b - a for a, b in zip(bounds, bounds[1:], strict=False)]


def _sentences(text: str, long: int) -> list[tuple[str, int, bool, str]]:
    """(sentence with the white space after it, words, whether a line ends here, its words with one blank between)."""
    found, at = [], 0
    bounds = [m.span() for m in _BREAK.finditer(text)]
    if not bounds or bounds[-1][1] < len(text):
        bounds.append((len(text), len(text)))
    for stop, past in bounds:
        whole = text[at:past]
        of = whole.split()
        n, last = len(of), past == len(text) or "\n" in whole
        if n > long:
            starts, sizes = _edges(text[at : stop + (text[stop : stop + 1] != "\n")], of, long)
            word = 0
            for a, b, size in zip(starts, [*starts[1:], len(whole)], sizes, strict=True):
                found.append((whole[a:b], size, last and b == len(whole), " ".join(of[word : word + size])))
                word += size
        else:
            found.append((whole, n, last, " ".join(of)))
        at = past
    return found


def cut(text: str, long: int = 16) -> list[tuple[str, int, bool]]:
    """(sentence with the white space after it, words, whether a line ends here): joined, they are the text."""
    return [p[:3] for p in _sentences(text, long)]


#: Sentence hashes are combined in powers of this odd number, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(texts: list[str], sentences: int = 2, words: int = 20, long: int = 16, every_end: bool = False) -> tuple[np.ndarray, ...]:
    """(text, first, past, hash) of every span of the cut texts, and (sentences of each text); empty sentences are passed over.

    A span's hash is the sum of its sentences' hashes, each times a power of an odd number by its place in the span.
    """
    size, hashes, place, ends, counts = [], [], [], [], []
    for text in texts:
        n = 0
        for k, (_, many, last, plain) in enumerate(_sentences(text, long)):
            if many:
                size.append(many)
                hashes.append(xxhash.xxh64_intdigest(plain))
                place.append(k)
                ends.append(last)
                n += 1
            elif last and n:
                ends[-1] = True  # an empty sentence ends the line
        counts.append(n)
    total, n = len(size), np.array(counts, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(np.array(size, dtype=np.int64))])
    of = np.repeat(np.arange(len(texts)), n)
    stop = np.cumsum(n)
    here = np.arange(total)
    # From each sentence on, the shortest run; it must end inside the text.
    end = np.maximum(here + sentences, np.searchsorted(upto, upto[:-1] + words, "left"))
    forward = end <= stop[of] if total else np.zeros(0, bool)
    end = np.where(forward, end, -1)
    # Backwards from each sentence; not where the run is a forward one already.
    start = np.minimum(here + 1 - sentences, np.searchsorted(upto, upto[1:] - words, "right") - 1)
    backward = start >= (stop - n)[of] if total else np.zeros(0, bool)
    if not every_end:
        backward &= np.array(ends, dtype=bool)
    backward &= end[np.maximum(start, 0)] != here + 1 if total else backward
    first = np.concatenate([here[forward], start[backward]])
    past = np.concatenate([end[forward], here[backward] + 1])
    order = np.lexsort((past, first))
    first, past = first[order], past[order]
    # Sums of hash times inverse power up to each sentence; a span's difference is moved to the span's start.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(hashes, dtype=np.uint64) * _powers(_INVERSE, total), dtype=np.uint64)])
    values = (sums[past] - sums[first]) * _powers(_BASE, total + 1)[first]
    at = np.array(place, dtype=np.int32)
    return of[first], at[first], at[past - 1] + 1, values.view(np.int64), n


def span_rows(docs: DataFrame, sentences: int, words: int, long: int, every_end: bool) -> DataFrame:
    """(key, id, first, past, hash) of every span; ``docs`` has key, id and text.

    ``past`` is negative if the text itself has the span's hash further in front. Each text has one more row, with
    ``first`` -1, its number of sentences as ``past`` and its key as ``hash``.
    """
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("past", pa.int32()), ("hash", pa.int64())])

    def parts(b):
        """Texts of some million characters together, or one longer one."""
        held, size = [], 0
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[2] or "")
            if size > 2_000_000:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for b in batches:
            for part in parts(b):
                key = np.array([r[0] for r in part], dtype=np.int64)
                of, first, past, value, n = spans([r[2] or "" for r in part], sentences, words, long, every_end)
                # Spans are in order within a text, so the first of equal ones is the earliest.
                order = np.lexsort((np.arange(len(of)), value, of))
                again = np.zeros(len(of), bool)
                again[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
                columns = [
                    np.concatenate([key[of], key]),
                    None,
                    np.concatenate([first, np.full(len(key), -1)]).astype(np.int32),
                    np.concatenate([np.where(again, -past, past), n]).astype(np.int32),
                    np.concatenate([value, key]),
                ]
                ids = pa.array([r[1] for r in part], pa.int64()).take(pa.array(np.concatenate([of, np.arange(len(key))])))
                yield pa.RecordBatch.from_arrays([ids if c is None else pa.array(c) for c in columns], schema=schema)

    return docs.select("key", "id", "text").mapInArrow(run, "key long, id long, first int, past int, hash long")


def dedup(docs: DataFrame, *, sentences: int = 2, words: int = 20, long: int = 16, every_end: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and n_sentences, n_removed, words_removed.

    The first place of a span (smallest id, nulls last, then place) stays. Rows equal in id and text
    are one document and keep the same sentences; at equal ids and places with different texts, all are
    first; a null text stays null with zeros; an empty text
    has no sentence; a document may lose all its text and stays as a row. Columns of the input named
    like the three counts are replaced.
    """
    counts = ["n_sentences", "n_removed", "words_removed"]
    kept = [c for c in docs.columns if c not in counts]
    keyed = docs.select(*kept, text_key(id_col, text_col).alias("__key"))
    rows = span_rows(docs.select(text_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), sentences, words, long, every_end)
    # One number for id and sentence, so that the minimum is kept in a hash aggregate.
    place = F.coalesce(F.col("id"), F.lit(_NONE)).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("first")
    place = place.cast("decimal(38,0)")
    firsts = rows.where("first >= 0 and past >= 0").groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).where("n > 1").select("hash", "earliest")
    again = rows.join(firsts, "hash", "left").where((F.col("first") < 0) | (F.col("past") < 0) | (F.col("earliest") != place))
    span = F.when(F.col("first") >= 0, F.struct("first", F.abs("past").alias("past")))
    covered = again.groupBy(F.col("key").alias("__key")).agg(F.collect_set(span).alias("__spans"), F.max(F.when(F.col("first") < 0, F.col("past"))).alias("__count"))
    joined = keyed.join(covered, "__key", "left").select(*kept, "__spans", "__count")
    schema = joined.drop("__spans", "__count").select("*", *[F.lit(0).cast("long").alias(c) for c in counts]).schema
    at, n = kept.index(text_col), len(kept)

    def rebuild(batches):
        for b in batches:
            texts, numbers = [], []
            for text, found, count in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                if not found:
                    texts.append(text)
                    numbers.append((count, 0, 0))
                    continue
                pieces = cut(text, long)
                gone = {k for s in found for k in range(s["first"], s["past"])}
                texts.append("".join(p for k, (p, _, _) in enumerate(pieces) if k not in gone))
                numbers.append((count, sum(1 for k in gone if pieces[k][1]), sum(pieces[k][1] for k in gone)))
            columns = list(b.columns[:n])
            columns[at] = pa.array(texts, columns[at].type)
            columns += [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *counts])

    return joined.mapInArrow(rebuild, schema)
