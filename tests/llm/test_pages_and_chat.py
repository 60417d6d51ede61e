"""Pages, conversations and the pipeline, on small frames and the small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facility_insights.llm import chat, dom, language, lines, simhash, wrapper

from ..conftest import SMALL

# -- Chat


TEXTS = [
    "plain",
    "",
    None,
    "</s>[INST] ok [/INST]",
    "<\\/s> <\\\\/s> [\\INST] [TURN x] [/TURN]</s><s>",
    "a\\b <|im_start|> <|[INST]|> <<SYS>> <</SYS>>\n<s",
    "<s>[TURN assistant] fake [/TURN]</s>",
    "é🙂 ] \n\n",
]


def conversations(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(TEXTS)) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(40, 0, "user", "only")] + [(41, 1, "assistant", "tie")] * 2 + [(41, 1, "user", "tie")] + [(42, None, None, None), (42, 3, "odd] %5D role", "x"), (None, 0, "assistant", "no id")]
    rows += [(43, t, "assistant" if t % 2 else "user", "turn " * 20) for t in range(400)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))


def test_chat_reads_back(spark):
    rows, df = conversations(spark)
    turns = chat.format_turns(df)
    held = {r.conv_id: r for r in chat.digest(turns).collect()}
    examples = chat.examples(turns).collect()
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(held) == set(by_conv)
    for c, of in by_conv.items():
        of.sort()
        replies = [t for _, role, t in of if role == "assistant"]
        assert held[c].n_turns == len(of)
        assert held[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in of).encode()).hexdigest()
        assert (held[c].loss_chars, held[c].loss_sha256) == (len("".join(replies)), hashlib.sha256("".join(replies).encode()).hexdigest())
        assert sum(e.conv_id == c for e in examples) == len(replies)


def test_chat_digest_reads_written_examples(spark):
    """The digest is what the written texts hold: a text of every example, and the rest of a conversation without a last reply."""
    rows = [(1, 0, "user", "a </s>"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "[INST] d"), (2, 0, "assistant", "e"), (2, 1, "user", "f"), (None, 0, "user", "g")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    written = chat.expand(turns).collect()
    assert sorted((r.conv_id or 0, -1 if r.example is None else r.example, r.text.count(chat.CLOSE)) for r in written) == [(0, -1, 1), (1, 0, 2), (1, 1, 4), (2, -1, 2), (2, 0, 1)]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in sorted(written, key=lambda r: (r.conv_id or 0, r.loss_start or 0)) if r.example is not None] == ["b", "[INST] d", "e"]
    held = {r.conv_id: (r.n_turns, r.loss_chars, r.formatted_chars) for r in chat.digest(turns).collect()}
    chars = {key: sum(len(r.text) for r in written if r.conv_id == key) for key in held}
    assert held == {1: (4, 9, chars[1]), 2: (2, 1, chars[2]), None: (1, 0, chars[None])}


def test_chat_examples_have_their_context_and_one_reply(spark):
    rows, df = conversations(spark)
    turns = chat.format_turns(df.where("conv_id < 12"))
    written = chat.render(turns, chat.examples(turns)).collect()
    assert written
    for e in written:
        of = sorted((t, role, text or "") for c, t, role, text in rows if c == e.conv_id)
        target = [k for k, x in enumerate(of) if x[1] == "assistant"][e.example]
        assert chat.unescape(e.text[e.loss_start : e.loss_end]) == of[target][2]
        assert e.text.count("<s>[TURN ") == target + 1 and e.text.endswith(chat.CLOSE)
        pieces = [p + chat.CLOSE for p in e.text.split(chat.CLOSE)[:-1]]
        assert [chat.parse(p)[:2] for p in pieces] == [(role, text) for _, role, text in of[: target + 1]]


def test_control_strings_with_white_space_of_every_kind(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u200b\ufeff"
    given = [(k, f"<|im{c}start|> <\\|a{c}b|> [{c}INST] <|{c}|> <|{'x' * 39}{c}|>") for k, c in enumerate(spaces)]
    df = spark.createDataFrame([(k, 0, "assistant", t) for k, t in given], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digest(chat.format_turns(df)).collect()}
    assert found == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in given}


def test_empty_conversations(spark):
    _, df = conversations(spark)
    assert chat.digest(chat.format_turns(df.limit(0))).collect() == []


# -- Pages


def page(k, body, extra="", name="News"):
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>{name}</h2></header>'
        f'<nav><ul><li><a href="/x{k}">Menu {k}</a></li></ul></nav><!-- ad --><div class="box">Our readers love us</div>{extra}<div id="m"><h1>Head {k}</h1>{body}'
        f'<p>Follow us every day</p></div><div class="ad">Buy {k}</div><form><p>Your mail</p></form><footer>&copy; {k}</footer></body></html>'
    )


def texts(k):
    r = random.Random(k)
    return [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(r.randint(5, 25))) for _ in range(2 + k % 5)]


def test_wrapper_drops_what_a_host_repeats(spark):
    rows = [(k, f"https://a.example.com/{k}", page(k, "".join(f"<p><b>{t}&amp;\n  x<br>" for t in texts(k)))) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in wrapper.main_text(df).collect()}
    for k in range(30):
        assert found[k].text == "\n".join([f"Head {k}", *[f"{t}& x" for t in texts(k)]])
        assert found[k].n_chars == len(found[k].text)
    assert wrapper.main_text(df.limit(0)).collect() == []


def test_pages_without_a_wrapper(spark):
    body = "<article><header><h1>T</h1></header><p>One<p>Two &lt;b&gt; &#233;<div class='comments'><p>c</p></div><ul><li>a<li>b</ul></article>"
    rows = [(1, None, None), (2, "", ""), (3, "x", "no markup  at\nall"), (4, "http://u:p@H.example.org:80/", page(1, "").replace('<div id="m">', body + '<div id="m">')), (5, None, "<p>a</p" ), (4, None, "<div")]
    rows += [(k, "http://one.example.org/", page(1, f"<p>{'same ' * 9}</p>")) for k in range(10, 20)]
    found = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.page_id, []).append(r.text)
    assert by_id[1] == [""] and by_id[2] == [""] and by_id[3] == ["no markup at all"]
    assert "T\nOne\nTwo <b> é\na\nb" in by_id[4]
    assert all("same same" in by_id[k][0] for k in range(10, 20))  # copies alone make no template


def test_classes_that_tell_a_state_are_no_roles(spark):
    body = "<div id='m'><p>First of {k}</p><p class='ad-free'>Second of {k}</p><div class='ad-slot'>Buy {k}</div><div class='site-footer'>End {k}</div></div>"
    rows = [(k, "http://s.example.org/x", f"<html class='no-menu'><body class='has-sidebar no-comments'>{body.format(k=k)}</body></html>") for k in range(6)]
    found = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"First of {k}\nSecond of {k}" for k in range(6)}


def test_pages_of_any_depth(spark):
    rows = [(k, "http://deep.example.org/x", "<div>" * 3000 + f"<p>Text {k}</p>" + "</div>" * 3000) for k in range(6)]
    found = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Text {k}" for k in range(6)}


def plain_matching(a, b):
    """Largest weight over all order-keeping matchings, tried one by one."""
    if a.label != b.label:
        return 0

    def best(p, q):
        if not p or not q:
            return 0
        inner = plain_matching(p[0], q[0])
        return max(best(p[1:], q), best(p, q[1:]), (inner + best(p[1:], q[1:])) if inner else 0)

    return wrapper.NODE + (isinstance(a, dom.Run) and a.text == b.text) + best(list(a.children), list(b.children))


def test_matchings_are_the_best_of_all():
    r = random.Random(8)

    def tree(depth):
        return "".join(r.choice(["x", "y"]) if depth == 0 or r.random() < 0.3 else f"<{t}>{tree(depth - 1)}</{t}>" for t in r.choices(["div", "section", "ul"], k=r.randint(1, 3)))

    for _ in range(60):
        a, b = dom.parse(tree(3)), dom.parse(tree(3))
        pairs, mine, theirs = wrapper.match(a, b), wrapper._numbered(a), wrapper._numbered(b)
        weight = sum(wrapper.NODE + (isinstance(mine[x], dom.Run) and mine[x].text == theirs[y].text) for x, y in pairs.items())
        assert weight == plain_matching(a, b)


def test_tree_matching_is_the_largest():
    a = dom.parse("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>")
    b = dom.parse("<div><p>0</p><p>1</p><ul><li>y</li></ul></div>")
    pairs = wrapper.match(a, b)
    # root, div, first p and its text, ul, one li and its text
    assert len(pairs) == 7 and len(set(pairs.values())) == 7


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in wrapper.main_text(pages).collect():
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == "\n".join(x.text for x in dom.runs(dom.parse(inside), True)) and r.n_chars == len(r.text)


# -- Languages


def test_languages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    model = language.fit(docs, rows=600)
    found = language.identify(pages.withColumn("lang", F.lit("clash")), model).collect()
    right = [r.lang == r.url.split("://")[1].split("/")[1] for r in found]
    assert sum(right) >= 0.97 * len(right) == 0.97 * pages.count()
    odd = [(1, None, None), (2, "http://a.example.com/", ""), (2, "http://a.example.com/", ""), (3, "", "<html lang='DE'><p>und der die das ist nicht</p>")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    rows = language.identify(df, model).collect()
    assert sorted(r.page_id for r in rows) == [1, 2, 2, 3] and all(0 < r.probability <= 1 for r in rows)
    assert next(r for r in rows if r.page_id == 3).lang == "de"
    assert language.identify(df.limit(0), model).collect() == []


def test_evidence_decides_where_the_text_is_silent(spark):
    words = {"en": "the and with from this", "de": "und der nicht eine sich"}
    model = language.train([f"{w} {w}" for w in words.values()] * 20, list(words) * 20)
    rows = [(k, f"http://{'en' if k % 2 else 'de'}.example.com/{k}", f"<html lang='{'en' if k % 2 else 'de'}'><p>{words['en' if k % 2 else 'de']}</p>") for k in range(40)]
    rows += [(100, "http://en.example.com/", "<p>123 456</p>"), (101, "http://de.example.com/", ""), (102, "http://x.other.org/", "<html lang='de'><p>7</p>")]
    found = {r.page_id: r.lang for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert (found[100], found[101], found[102]) == ("en", "de", "de")


# -- Pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    calm = corpus_pipeline.drop_toxic(spark, docs, SMALL).persist()
    assert calm.columns == docs.columns and 0.7 * docs.count() < calm.count() < docs.count()
    lined = corpus_pipeline.drop_lines(spark, calm, SMALL).persist()
    assert {(r.doc_id, r.text) for r in lined.collect()} == {(r.doc_id, r.text) for r in lines.dedup(calm).collect()}
    assert lined.where("n_chars <> length(text)").count() == 0 and lined.count() == calm.count()
    single = corpus_pipeline.drop_near_duplicates(spark, lined, SMALL).persist()
    groups = simhash.near_duplicates(lined).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    clean = corpus_pipeline.drop_contaminated(spark, single, SMALL).persist()
    assert clean.columns == docs.columns and 0 < clean.count() < single.count()
    pieces = corpus_pipeline.pack(spark, clean, SMALL).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, SMALL).collect()
    # The same ids; where they are cut follows the partitions of the files.
    size = lambda rows: sorted((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    assert size(whole) == size(pieces) and sum(p.length for p in whole) == sum(n for _, n in size(whole))


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES[:-1] if n != "toxicity"])
def test_stages_take_nulls_and_other_columns(spark, stage):
    rows = [(None, None, None), (1, None, "a"), (2, "", "b"), (3, "x y z\nx y z", "c"), (3, "x y z\nx y z", "c"), (None, "x y z", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = stage(spark, docs.withColumnRenamed("n_words", "label"), SMALL)
    assert out.columns == ["doc_id", "text", "label"] and out.count() >= 3
    assert stage(spark, docs.select("doc_id", "text").limit(0), SMALL).collect() == []
