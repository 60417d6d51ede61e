"""Main text by wrapper induction: same-host pages aligned by simple tree matching.

Every page is aligned with its host's reference page by simple tree matching: equal labels match,
children are matched in order by dynamic programming, and the matched tree of most nodes wins. For
each node of the reference, pages that match it with the reference's own text and pages that match
it with another text are counted, together with the text they have there. A text node that
nearly all pages hold unchanged is template; the others are slots. The host's content element is the
one that slots fill with the most varying text outside menus, adverts and other boilerplate roles.
A page's main text is what stands under the element matched to it, without template and boilerplate
roles. Hosts with too few different pages, and pages that match no content element, go by
roles alone.

No host is gathered: a page meets one reference (the page at the median length of its host), counts
are pre-aggregated in each task and summed by host and node, and wrappers go back by a join on
the host. References and wrappers are broadcast only if their total size is below a bound.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.llm import dom
from facility_insights.llm.shared import worker_state
from facility_insights.session import cut_lineage

#: Pages a host must have, and the share of them that must hold a node unchanged, for a template.
LEAST_PAGES, CONSTANT_SHARE = 5, 0.9
#: References and wrappers of up to so many bytes in all may be broadcast; more are joined by shuffle.
SMALL_BYTES = 16 << 20
#: Hosts up to which the choice of references (about 60 bytes each) may be broadcast.
SMALL_HOSTS = 200_000


def host(url: Column) -> Column:
    """The address's host in lower case, without user and port; empty for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: Weight of a matched node: matchings of equally many nodes are told apart by their equal texts.
NODE = 1 << 24


def match(a, b) -> dict[int, int]:
    """Numbers of a's nodes that are matched, with those of b's: the largest order-keeping top-down matching.

    Of several, one with the most equal texts.
    """
    pairs: dict[int, int] = {}
    weights: dict[tuple[int, int], int] = {}
    if a.label == b.label:
        _weigh(a, b, weights)
        _trace(a, b, weights, pairs)
    return pairs


def _table(x, y, weights) -> list[list[int]]:
    """Best weights of the children up to each pair; those of inner pairs must be known."""
    p, q = x.children, y.children
    rows = [[0] * (len(q) + 1)]
    for c in p:
        last, row = rows[-1], [0]
        for j, d in enumerate(q):
            best = last[j + 1] if last[j + 1] > row[j] else row[j]
            if c.label == d.label:
                w = weights[c.number, d.number] if c.children and d.children else NODE + (type(c) is dom.Run and c.text == d.text)
                if last[j] + w > best:
                    best = last[j] + w
            row.append(best)
        rows.append(row)
    return rows


def _weigh(a, b, weights) -> None:
    """Weights of all pairs of inner nodes that a matching may meet, the deepest first; pages may be nested to any depth."""
    waiting = [(a, b, False)]
    while waiting:
        x, y, ready = waiting.pop()
        if (x.number, y.number) in weights:
            continue
        if ready:
            weights[x.number, y.number] = NODE + _table(x, y, weights)[-1][-1]
            continue
        waiting.append((x, y, True))
        waiting += [(c, d, False) for c in x.children if c.children for d in y.children if d.children and c.label == d.label and (c.number, d.number) not in weights]


def _trace(a, b, weights, pairs) -> None:
    waiting = [(a, b)]
    while waiting:
        x, y = waiting.pop()
        pairs[x.number] = y.number
        if not x.children or not y.children:
            continue
        table, i, j = _table(x, y, weights), len(x.children), len(y.children)
        while i and j:
            c, d = x.children[i - 1], y.children[j - 1]
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                waiting.append((c, d))
                i, j = i - 1, j - 1


def _numbered(root) -> dict:
    found, waiting = {}, [root]
    while waiting:
        at = waiting.pop()
        found[at.number] = at
        waiting.extend(at.children)
    return found


def observe(page, reference) -> list[tuple[int, int, int]]:
    """(reference node, 1 if its text is unchanged, varying characters under it), for each matched node.

    Text nodes carry the first number; elements the second: text outside boilerplate that differs
    from the reference's.
    """
    pairs, theirs = match(page, reference), _numbered(reference)
    allowed = {r.number for r in dom.runs(page)}
    order, waiting = [], [page]
    while waiting:
        at = waiting.pop()
        order.append(at)
        waiting.extend(at.children)
    weight: dict[int, int] = {}
    found = []
    for at in reversed(order):  # children come before their parents
        n = at.number
        met = pairs.get(n)
        if type(at) is dom.Run:
            same = met is not None and at.text == theirs[met].text
            weight[n] = len(at.text) if not same and n in allowed else 0
            if same:
                found.append((met, 1, 0))
        else:
            weight[n] = sum([weight[c.number] for c in at.children])
            if met is not None and weight[n]:
                found.append((met, 0, weight[n]))
    return found


def induce(reference, pages: int, counts: dict[int, tuple[int, int]]) -> tuple[int, list[int]]:
    """(content element, template text nodes) of a reference out of (unchanged, varying characters) by node.

    The content element is the deepest one that has at least nine tenths of the varying characters
    of the page; -1 if nothing varies or the host has too few pages.
    """
    total = counts.get(0, (0, 0))[1]
    if pages < LEAST_PAGES or not total:
        return -1, []
    at = reference
    while True:
        inner = [c for c in at.children if isinstance(c, dom.Node) and counts.get(c.number, (0, 0))[1] * 10 >= total * 9]
        if not inner:
            break
        at = inner[0]
    if at.number == 0:
        return -1, []
    same = [n for n, (unchanged, _) in counts.items() if unchanged >= CONSTANT_SHARE * pages]
    return at.number, sorted(same)


def extract(page, reference, content: int, template: list[int]) -> str:
    """The page's main text by a host's wrapper, or by roles if the wrapper finds none in it."""
    root, gone = None, set()
    if reference is not None and content > 0:
        pairs, mine = match(page, reference), _numbered(page)
        root = next((mine[n] for n, r in pairs.items() if r == content), None)
        held = set(template)
        gone = {n for n, r in pairs.items() if r in held}
    if root is not None:
        text = "\n".join(r.text for r in dom.runs(root, True) if r.number not in gone)
        if text:
            return text
    return "\n".join(r.text for r in dom.runs(dom.article(page), True))


def _references(pages: DataFrame) -> DataFrame:
    """(host, reference): the html of the page nearest above the median length of its host."""
    sizes = pages.where("html is not null").select("host", "id", F.length("html").alias("size"))
    middle = sizes.groupBy("host").agg(F.percentile_approx("size", 0.5, 1000).alias("middle"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    chosen = sizes.join(middle, "host").where("size >= middle").groupBy("host").agg(F.min(F.struct("size", "id")).alias("at"), F.max("pages").alias("pages"))
    chosen = cut_lineage(chosen.select(F.col("host").alias("of_host"), "pages", F.col("at.id").alias("of_id"), F.col("at.size").alias("size")))
    if chosen.count() <= SMALL_HOSTS:
        chosen = F.broadcast(chosen)
    # By the page's id, so that a host's pages do not meet in one task where the join shuffles.
    met = pages.join(chosen, F.col("id") == F.col("of_id")).where((F.col("host") == F.col("of_host")) & (F.length("html") == F.col("size")))
    return met.groupBy("host").agg(F.min("html").alias("reference"), F.max("pages").alias("pages"))


def _sized(small: DataFrame, column: str) -> DataFrame:
    """A broadcast hint if the column's bytes in all are below the bound."""
    total = small.agg(F.coalesce(F.sum(F.length(F.col(column).cast("binary"))), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= SMALL_BYTES else small


def _tree(name: str, text: str | None):
    """A reference's tree; the last ones that the worker parsed are kept."""
    if text is None:
        return None
    held = worker_state(f"trees {name}", 0, dict)
    if text not in held:
        if len(held) >= 256:
            held.clear()
        held[text] = dom.parse(text)
    return held[text]


def wrappers(pages: DataFrame, references: DataFrame) -> DataFrame:
    """(host, reference, content, template) of each host that has a reference."""

    def count(rows):
        total: Counter = Counter()
        for b in rows:
            for name, html, reference in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for node, unchanged, varying in observe(dom.parse(html), _tree("count", reference)):
                    total[name, node, 0] += unchanged
                    total[name, node, 1] += varying
            if len(total) > 200_000:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    met = pages.where("html is not null").join(_sized(references, "reference").select("host", "reference"), "host").select("host", "html", "reference")
    counts = met.mapInArrow(count, "host string, node int, unchanged long, varying long")
    summed = counts.groupBy("host", "node").agg(F.sum("unchanged").alias("unchanged"), F.sum("varying").alias("varying"))
    # A host's nodes are those of its one reference page.
    by_host = summed.groupBy("host").agg(F.collect_list(F.struct("node", "unchanged", "varying")).alias("counts"))

    def learn(rows):
        for b in rows:
            found = [
                induce(dom.parse(reference), pages, {c["node"]: (c["unchanged"], c["varying"]) for c in counts})
                for reference, pages, counts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], names=["host", "reference", "content", "template"]
            )

    return references.join(by_host, "host").select("host", "reference", "pages", "counts").mapInArrow(learn, "host string, reference string, content int, template array<int>")


def _counted(total: Counter) -> pa.RecordBatch:
    keys = {(name, node) for name, node, _ in total}
    rows = [(name, node, total[name, node, 0], total[name, node, 1]) for name, node in keys]
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["host", "node", "unchanged", "varying"])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each input row.

    Blocks of the article in page order, joined by \\n. A null or empty page has an empty text, a null
    url belongs to the host without name; pages of hosts with fewer than five pages go by roles; repeated rows
    stay; an empty table gives no row; other columns are not looked at.
    """
    of = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    references = cut_lineage(_references(of))
    known = cut_lineage(wrappers(of, references))
    joined = of.join(_sized(known, "reference"), "host", "left").select("id", "url", "html", "reference", "content", "template")
    id_type = of.schema["id"].dataType.simpleString()

    def run(rows):
        for b in rows:
            found = [
                extract(dom.parse(html), _tree("extract", reference), content or 0, template or [])
                for html, reference, content, template in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
