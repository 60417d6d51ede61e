"""Lexical search, whitening and byte-level BPE against brute force, with nulls, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from facility_insights.llm import bpe, lexical, registry, whitening

from ..conftest import SMALL
from .test_documents import ODD, frame, invented

# -- Ranked lexical search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERMS.findall(text or "")]


def plain_ranks(docs, items, k):
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            scored.append((-sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c), i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, pass_terms", [(50, 10**6), (3, 40)])
def test_ranks_are_those_of_all_scores(spark, k, pass_terms):
    docs = [(i, t) for i, t in enumerate(invented(4, 150))] + ODD + [(i, "abc déß abc") for i in range(2000, 2080)] * 2
    items = [(i, t) for i, t in enumerate(invented(9, 20))] + [(3, "abc"), (3, "abc"), (4, None), (5, ""), (None, "word A"), (6, "zzz"), (7, " ".join(f"t{j}" for j in range(80)) + " a b word x")]
    df = frame(spark, docs).withColumn("score", F.lit("clash")).withColumn("item", F.lit(1)).repartition(3)
    asked = frame(spark, items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    found = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(df, asked, k=k, pass_terms=pass_terms).collect()), key=str)
    assert found == plain_ranks(docs, items, k)


def test_no_documents_or_items(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), frame(spark, [(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).collect() == []
    assert lexical.rank(docs.where("doc_id = 2"), items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(docs, items.select("item_id", F.lit(None).cast("string").alias("text"))).collect() == []


def blocks(seed, n, n_terms, most):
    """A block of documents that hold some terms, and its documents as counters."""
    r = random.Random(seed)
    docs = [{t: r.randint(1, most) for t in r.sample(range(n_terms), r.randint(0, n_terms))} for _ in range(n)]
    ids = r.sample(range(10_000), n)
    norms = np.array([r.randint(50, 400) for _ in docs])
    flat = [(t, c) for d in docs for t, c in sorted(d.items())]
    block = lexical.Block(np.array(ids), norms, np.array([len(d) for d in docs]), np.array([t for t, _ in flat], dtype=np.int64), np.array([c for _, c in flat], dtype=np.int64))
    return block, docs, ids, norms


def test_masks_group_the_documents(spark):
    block, docs, _, _ = blocks(1, 300, 70, 3)
    rows = np.arange(0, 70, 1)
    masks, group, places = block.masks(rows)
    assert places.tolist() == [k for k, d in enumerate(docs) if d]
    assert all(set(np.flatnonzero(masks[g])) == set(docs[p]) for g, p in zip(group, places, strict=True))
    assert len({m.tobytes() for m in masks}) == len(masks)


def test_evaluation_ends_early_and_loses_nothing():
    weight = np.array([9000, 8000, 40, 30, 20, 10, 5, 1])
    best, plain, evaluated = lexical.Best(5), [], 0
    for seed in range(40):
        block, docs, ids, norms = blocks(seed, 400, 8, 4)
        # rare terms: few documents hold the two that weigh much
        evaluated += lexical.search_block(block, np.arange(8), weight, best)
        plain += [(-sum(int(weight[t]) * ((10**9 * c) // (1000 * c + 20 * int(m))) for t, c in d.items()), i) for d, i, m in zip(docs, ids, norms, strict=True) if d]
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == sorted(plain)[:5]
    assert evaluated < len(plain) / 2


# -- Whitening


def usable(rows, width):
    return [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


def test_whitening_is_that_of_the_covariance(spark):
    r = np.random.default_rng(3)
    base = (r.normal(size=(400, 6)) * [1, 0.6, 0.4, 0.2, 0.1, 0.05]) @ np.linalg.qr(r.normal(size=(6, 6)))[0] + 2.0
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [-0.0, 0.25, 1.0, 0.5, 3.0, -1.0]) for i in range(300)]
    odd = [(900, None), (901, [float("nan")] + [0.0] * 5), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, []), (904, [1.0]), (905, [float("inf")] * 6), (None, [0.5] * 6), (0, [0.5] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = whitening.whiten(df, whitening.fit(df, components=4)).collect()
    kept = usable(rows + odd, 6)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, dtype=float) - np.array(sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert collections.Counter((g.vec_id, g.component) for g in got) == collections.Counter((i, c) for i, _ in kept for c in (1, 2, 3, 4))
    plain = collections.defaultdict(list)
    for i, x in kept:
        plain[i].append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - np.array(sums) / n) @ v))
    sign = {}
    for g in got:
        wanted = {d: p for d, p in plain[g.vec_id]}
        assert g.n == n and g.deviation in wanted and g.identity_error < 1e-9
        k = g.component - 1
        w = wanted[g.deviation][k] / math.sqrt(e[k])
        if abs(w) > 1e-6:
            assert sign.setdefault(k, np.sign(w * g.whitened)) == np.sign(w * g.whitened)
        assert abs(abs(w) - abs(g.whitened)) < 1e-8 and abs(g.explained / (e[k] / e.sum()) - 1) < 1e-9


def test_ill_conditioned_and_dependent_columns(spark):
    r = np.random.default_rng(5)
    a = r.normal(size=(500, 3)) * [1000.0, 1.0, 0.05]
    x = np.column_stack([a @ np.linalg.qr(r.normal(size=(3, 3)))[0], np.ones(500), a[:, 0], a[:, 0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, components=6)
    fit = np.unique(np.floor(256 * x), axis=0)
    sigma = np.linalg.svd(fit - fit.mean(axis=0), compute_uv=False) ** 2 / len(fit)
    assert np.allclose(model.eigenvalues[:4], sigma[:4], rtol=1e-7)
    assert model.eigenvalues[5] == 0 and model.identity_error < 1e-6
    dead = whitening.whiten(df, model).where("component = 6").agg(F.count("whitened"), F.max("explained")).first()
    assert tuple(dead) == (0, 0.0)


def test_one_vector_none_and_sums_beyond_a_long(spark):
    kind = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    assert [tuple(g) for g in whitening.whiten(one, whitening.fit(one)).orderBy("vec_id", "component").collect()] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    for empty in (one.limit(0), spark.createDataFrame([(1, None), (2, [])], kind)):
        model = whitening.fit(empty)
        assert model is None and whitening.whiten(empty, model).collect() == []
    huge = spark.createDataFrame([(i, [float(i) * 2.0**44, float(i % 2)]) for i in range(4)], kind)
    model = whitening.fit(huge)
    assert model.sums == (6 * 2**52, 2 * 256)
    assert {g.deviation for g in whitening.whiten(huge, model).collect()} == {None}


# -- Byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def mixed(seed, n):
    """Characters of every class, white space of every kind, and letters that only newer Unicode versions know."""
    r = random.Random(seed)
    return "".join(r.choice("AAasdrelmvt'''  \n\t\r\x0b\x1c\x85\xa0 　1²½٣.!-é中ßא́\U0001f600\U0001f1e9͸՘౜\U00011de0") for _ in range(n))


def test_pieces_are_the_librarys(library):
    pieces = bpe.Pieces(RANKS, public_tokenizers.PATTERN, bpe._foreign())
    for k in range(3000):
        text = mixed(k, k % 60)
        assert np.frombuffer(pieces.encode(text), dtype=np.int32).tolist() == library.encode_ordinary(text)


def test_cuts_reach_a_common_boundary():
    splitter = bpe.Splitter(public_tokenizers.PATTERN, bpe._foreign())
    for k in range(3000):
        text, size = mixed(k, k % 70), 1 + k % 9
        parts = [(step, chunk, *bpe.boundaries(splitter, lead, step, chunk)) for lead, step, chunk in bpe.cut(text, size)]
        start, whole = 0, set(np.cumsum([len(p) for p in splitter.split(text)]).tolist()) | {0}
        for (step, _, _, _, tail), (_, _, _, head, _) in zip(parts[:-1], parts[1:], strict=True):
            start += step
            assert start + min(set(tail.tolist()) & set(head.tolist())) in whole
        assert parts[-1][0] is None


@pytest.mark.parametrize("chunk", [5, 64, bpe.CHUNK])
def test_encode_and_decode(spark, library, chunk):
    texts = [mixed(k, 40 * (k % 9)) for k in range(40)] + invented(2, 20)
    texts += ["a" * 3000 + " b", " " * 3000, "'s" * 500, "x" * 70_000 + " y z " * 9000, "no white space," * 40]
    rows = [(k, t) for k, t in enumerate(texts)] + ODD + [(7, texts[8])] * 5
    df = frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1)).repartition(4)
    encoded = bpe.encode(df, path=RANKS, pattern=public_tokenizers.PATTERN, chunk=chunk)
    wanted = collections.Counter((k, tuple(library.encode_ordinary(t or ""))) for k, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == wanted
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded, path=RANKS).collect()) == collections.Counter((k, (t or "").encode()) for k, t in rows)
    digests = collections.Counter(map(tuple, bpe.digest(encoded, path=RANKS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == collections.Counter((k, len(i), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for k, t in rows for i in [library.encode_ordinary(t or "")])
    assert bpe.digest(bpe.encode(df.limit(0), path=RANKS, pattern=public_tokenizers.PATTERN, chunk=chunk), path=RANKS).collect() == []


def test_a_pattern_without_common_boundaries_fails_loudly(spark):
    df = frame(spark, [(1, "ab cd " * 20)])
    with pytest.raises(Exception, match="common boundary"):
        bpe.encode(df, path=RANKS, pattern=r"(?s).{7}|(?s).+", chunk=10).collect()


def test_query_gives_the_librarys_ids(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = {(r.doc_id, *(lambda i: (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()))(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert set(map(tuple, registry.QUERIES["op13_bpe"](spark, SMALL).collect())) == wanted


def test_ranks_are_read_whole():
    with open(RANKS, "rb") as file:
        first = file.readline().split()
    assert bpe.ranks(RANKS)[base64.b64decode(first[0])] == int(first[1]) and len(bpe.ranks(RANKS)) == 50256
