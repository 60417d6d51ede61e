"""Toxicity scores of whole texts by the subword-bag classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.llm.shared import worker_state
from facility_insights.llm.subword import Model, Scorer, train
from facility_insights.session import cut_lineage

#: Labelled rows that are learnt from, at most, and the longest text among them (longer ones are scored, not learnt).
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 100_000
#: Characters of all texts that are learnt from, at most: what the driver holds, whatever the rows are.
SAMPLE_TOTAL = 64_000_000
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that is never learnt from: crc32 of the id as text, modulo 3, is 1. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """The model of a bounded sample of labelled rows that are not held out.

    The sample is the first ``rows`` labelled ids by hash, so it does not depend on the order of the
    tables; it ends before the id whose text would bring it over ``total`` characters. Null ids, labels
    and texts are not learnt from; an id that is labelled twice counts by its largest label, and of
    several texts under an id the least one counts. Repeats are reduced on the executors.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    short = docs.where(F.length(text_col) <= chars).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # At most ``rows`` small rows: the bound of this broadcast does not depend on the data.
    found = short.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    found = cut_lineage(found.withColumn("_at", F.xxhash64("_id")))
    taken, left = 0, total
    for row in found.select("_at", "_id", F.length("_text").alias("size")).orderBy("_at", "_id").collect():
        left -= row.size
        if left < 0:
            break
        taken += 1
    found = found.orderBy("_at", "_id").limit(taken).select("_id", "_text", "_label").toPandas().sort_values("_id")
    return train(found["_text"].tolist(), found["_label"].tolist(), **options)


def scores(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Whole texts are read. Null, empty and wordless texts have the model's prior score. Columns named
    score or predicted are replaced; repeated rows stay; an empty table gives no row.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    of = docs.select(*kept)
    schema = of.select("*", F.lit(0.0).alias("score")).schema
    at = kept.index(text_col)
    stamp = (float(model.table.sum()), model.bias, model.slope, model.length_slope, model.offset)

    def run(batches):
        scorer = worker_state("toxicity", stamp, lambda: Scorer(model))
        for b in batches:
            found = np.fromiter((scorer.score(x) for x in b.column(at).to_pylist()), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*kept, "score"])

    return of.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
