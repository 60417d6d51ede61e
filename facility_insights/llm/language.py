"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined by Bayes' rule: the likelihood of the page's text under
character n-gram models, the language that the markup declares, the suffix of the address, and a
prior of the page's host. The weight of the last three is learnt from the pages: a first pass takes
each page's posterior from its text alone, and grouped sums of these posteriors say how often a
declaration or suffix goes with a language, and which languages a host, its site and the corpus
have. A host's prior is smoothed towards its site's, and that towards the corpus's, so that a host
of few pages follows its site; a page's own share is left out of its host's sums.

What is held for a page is one number for each language; declarations, suffixes, hosts and sites
meet their pages by joins, and all sums are pre-aggregated.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.llm import dom, subword
from facility_insights.llm.shared import worker_state
from facility_insights.llm.wrapper import host
from facility_insights.session import cut_lineage

#: Labelled documents that are learnt from, at most, and the longest of them.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
BUCKETS = 1 << 15
#: Shortest and longest n-gram.
GRAMS = (2, 3)
#: N-grams of a text overlap, so a text counts as so many independent ones at most.
WORTH = 60.0
#: Pseudo-pages of the smoothing: a declaration or suffix, a host towards its site, a site towards the corpus.
EVIDENCE_ROWS, HOST_ROWS, SITE_ROWS = 2.0, 4.0, 8.0
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,8})", re.I)


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # buckets by languages


def _grams(word: bytes) -> list[int]:
    return subword.grams(word, BUCKETS, GRAMS)


def train(texts: list[str | None], labels: list[str]) -> Model:
    """Smoothed log probabilities of n-gram buckets for each language; words count once for each text they are in."""
    languages = sorted(set(labels))
    counts = np.full((BUCKETS, max(1, len(languages))), 0.1)
    number = {x: k for k, x in enumerate(languages)}
    known: dict[bytes, list[int]] = {}
    for text, label in zip(texts, labels, strict=True):
        for word in set(subword.words(text)):
            if word not in known:
                known[word] = _grams(word)
            np.add.at(counts, (known[word], number[label]), 1.0)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample of documents with a language: the first by a hash of their id and text."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & (F.length(text_col) <= chars))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    # The bound on the hash comes from hashes alone: tasks send numbers to the driver, not texts.
    bound = known.select(order.alias("o")).distinct().orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    near = known.where(order <= F.lit(bound)).groupBy(order.alias("o")).agg(F.min(F.col(text_col)).alias("t"), F.min(lang_col).alias("l"))
    sample = near.toPandas().sort_values("o")
    if not len(sample):
        raise ValueError("no document has a text and a language")
    return train(sample["t"].tolist(), sample["l"].tolist())


class Reader:
    """Text log-likelihoods; remembers words up to a fixed number, a row of numbers for each."""

    def __init__(self, model: Model, remember: int = 400_000):
        self.model, self.known = model, {}
        self.rows = np.empty((remember, len(model.languages) + 1), np.float32)

    def likelihood(self, text: str) -> np.ndarray:
        found, known = subword.words(text), self.known
        new = [w for w in dict.fromkeys(found) if w not in known]
        if len(known) + len(new) > len(self.rows):
            known.clear()
            new = list(dict.fromkeys(found))
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), self.rows.shape[1]), np.float32)
        for word in new:
            ids = _grams(word)
            row = self.rows[len(known)]
            row[:-1], row[-1] = self.model.log_p[ids].sum(axis=0), len(ids)
            known[word] = len(known)
        total = self.rows[[known[w] for w in found]].sum(axis=0, dtype=np.float64) if found else np.zeros(self.rows.shape[1])
        return total[:-1] * (min(total[-1], WORTH) / total[-1]) if found else total[:-1]


def text_evidence(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, site, suffix, declared, l_0 ...): one log-likelihood for each language."""
    of = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    names = [f"l_{k}" for k in range(len(model.languages))]
    stamp = float(model.log_p.sum())

    def run(rows):
        reader = worker_state("languages", stamp, lambda: Reader(model))
        for b in rows:
            found, declared = [], []
            for html in b.column(2).to_pylist():
                m = _LANG.search(html or "")
                declared.append(m[1].lower() if m else "")
                found.append(reader.likelihood("\n".join(r.text for r in dom.runs(dom.article(dom.parse(html)), True))))
            scores = np.array(found).reshape(len(found), len(names))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(declared, pa.string()), *[pa.array(scores[:, k]) for k in range(len(names))]], names=["page_id", "url", "declared", *names]
            )

    id_type = of.schema["page_id"].dataType.simpleString()
    found = of.mapInArrow(run, f"page_id {id_type}, url string, declared string, " + ", ".join(f"{n} double" for n in names))
    found = found.withColumn("host", host(F.col("url")))
    return found.withColumns(
        {"site": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("host", r"([^.]+)$", 1)}
    ).withColumn("site", F.when(F.col("site") == "", F.col("host")).otherwise(F.col("site")))


def _softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    powers = [F.exp(v - top) for v in values]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def identify(pages: DataFrame, model: Model, **columns: str) -> DataFrame:
    """(page_id, url, declared, text_lang, lang, probability), a row for each input row.

    ``text_lang`` is the best language by the text alone, ``lang`` by all evidence, with its posterior
    probability rounded to six places. A page without text goes by the other evidence. A null page
    declares nothing, a null url has the empty host; the empty declaration, suffix, host and site are
    values like others. Equal posteriors give the first language in alphabetical order; repeated
    rows stay; an empty table gives no row; other columns are not looked at.
    """
    n = len(model.languages)
    ks = range(n)
    likelihood = [F.col(f"l_{k}") for k in ks]
    seen = cut_lineage(text_evidence(pages, model, **columns))
    first = seen.select("*", *[p.alias(f"p_{k}") for k, p in enumerate(_softmax(likelihood))])
    sums = lambda name: [F.sum(f"p_{k}").alias(f"{name}_{k}") for k in ks]
    corpus = first.agg(*sums("c")).first()
    share = [(x or 0.0) + 1.0 for x in (corpus if corpus else [0.0] * n)]
    share = [x / sum(share) for x in share]
    rows = [(x or 0.0) for x in corpus]

    now = first
    for name in ("declared", "suffix"):
        table = first.groupBy(name).agg(*sums("e"))
        all_rows = sum(rows) or 1.0
        total = sum((F.col(f"e_{k}") for k in ks[1:]), F.col("e_0"))
        # log P(value | language), smoothed by the value's share of all pages.
        given = [F.log((F.col(f"e_{k}") + EVIDENCE_ROWS * total / all_rows) / (rows[k] + EVIDENCE_ROWS)) for k in ks]
        now = now.join(table.select(name, *[x.alias(f"{name}_{k}") for k, x in enumerate(given)]), name)
    sites = first.groupBy("site").agg(*sums("s"))
    hosts = first.groupBy("host", "site").agg(*sums("h"))
    s_total = sum((F.col(f"s_{k}") for k in ks[1:]), F.col("s_0"))
    prior = hosts.join(sites, "site").select("host", *[f"h_{k}" for k in ks], *[((F.col(f"s_{k}") + SITE_ROWS * share[k]) / (s_total + SITE_ROWS)).alias(f"b_{k}") for k in ks])
    now = now.join(prior, "host")
    others = [F.greatest(F.lit(0.0), F.col(f"h_{k}") - F.col(f"p_{k}")) for k in ks]
    o_total = sum(others[1:], others[0])
    log_prior = [F.log((others[k] + HOST_ROWS * F.col(f"b_{k}")) / (o_total + HOST_ROWS)) for k in ks]
    fused = now.select("page_id", "url", "declared", *[f"l_{k}" for k in ks], *[(likelihood[k] + F.col(f"declared_{k}") + F.col(f"suffix_{k}") + log_prior[k]).alias(f"f_{k}") for k in ks])

    def best(prefix: str) -> Column:
        top = F.greatest(*[F.col(f"{prefix}_{k}") for k in ks]) if n > 1 else F.col(f"{prefix}_0")
        return F.coalesce(*[F.when(F.col(f"{prefix}_{k}") == top, F.lit(model.languages[k])) for k in ks])

    post = _softmax([F.col(f"f_{k}") for k in ks])
    return fused.select(
        "page_id", "url", "declared", best("l").alias("text_lang"), best("f").alias("lang"), F.round(F.greatest(*post) if n > 1 else post[0], 6).alias("probability")
    )
