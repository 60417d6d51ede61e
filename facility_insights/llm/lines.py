"""Line dedup by a deletion-neighbourhood join over words.

Two lines are alike if one word replaced, added or left out makes them equal (lines of fewer than
``least_words`` words must be equal). A line goes if an earlier line (by doc_id, then place) is
alike; the earliest stays.

A line's variants are itself and the line without one word. Alike lines share a variant: equal
lines the line itself, an added word the longer line's variant, and a replaced word the variant
without the word at the same place. So the smallest place of each (variant, left-out place) and of each
variant tell every line whether an earlier one is alike: grouped minima, no pairs, however many lines share a variant.
Both texts of a hit are then fetched and their word distance is verified.

Work is cut before variants are emitted. Equal lines become one row of hashes and their earliest
place. Then lines of n words with 2^j <= n < 2^(j+1) are hashed by their first and their last 2^(j-1)
words (at n = 2^j also by half as many): one edit leaves the one or the other as it is, so lines
that share neither with any other line have no alike line and emit no variant. A line that shares only its
first words leaves out later words alone, and one that shares only its last words earlier ones: an edit
inside a shared end would change it, and a word left out of a run of equal words may as well be the run's outermost.

Variants meet in two steps. How often each hash occurs is a grouped count of the hashes alone; only
the few variants whose hash occurs again carry their lines' places into the minima. There a line is
told by a number that grows with its place.

A variant's hash is the exclusive or over its words of a 64-bit hash of word and place, so that all
variants of a line come from running values, in time proportional to the line. It keeps all 64 bits: a
colliding earlier line would hide the alike one.

Everything on this path is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facility_insights.llm.shared import text_key
from facility_insights.session import cut_lineage

SPACE = " \t\x0b\f\r"
#: Running values are made in blocks of so many words.
BLOCK = 64
#: Sides of up to so many rows (about 40 bytes each) may be broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 500_000
#: Places are compared as one number: doc_id (nulls last), then line.
_NONE = 9223372036854775807


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, line_no, place, line) of every line with a visible character; lines are trimmed."""
    of = docs.select(text_key(id_col, text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    place = F.col("id").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("line_no")
    trimmed = of.select("key", "line_no", place.cast("decimal(38,0)").alias("place"), F.btrim("line", F.lit(SPACE)).alias("line"))
    return trimmed.where("line <> ''")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g")]


def _anchors(least_words: int) -> list[Column]:
    """Hashes of the first and last words that an edit at the other end leaves as they are."""
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    size = F.expr("shiftleft(1, length(bin(n)) - 2)")
    out = []
    for name, count, if_ in (("1", size, F.col("n") >= least_words), ("2", F.expr("shiftright(shiftleft(1, length(bin(n)) - 2), 1)"), (F.col("n") > least_words) & (F.col("n") == size * 2))):
        for side, sign in (("first", 1), ("last", -1)):
            words = F.call_function("substring_index", F.col("line"), F.lit(" "), count * sign)
            out.append(F.when(if_, F.xxhash64(F.lit(side), count, words)).alias(f"{side}_{name}"))
    return [n, *out]


def _running(values: Column) -> Column:
    """The exclusive ors of the values before each place, block by block."""

    def block(a: Column, at: Column) -> Column:
        inner = F.aggregate(
            F.slice(values, at + 1, F.lit(BLOCK)),
            F.struct(a["s"].alias("s"), F.array().cast("array<bigint>").alias("sums")),
            lambda u, x: F.struct(u["s"].bitwiseXOR(x).alias("s"), F.concat(u["sums"], F.array(u["s"])).alias("sums")),
        )
        return _let(inner, lambda v: F.struct(v["s"].alias("s"), F.concat(a["all"], F.array(v["sums"])).alias("all")))

    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK))
    none = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.flatten(F.aggregate(starts, none, block, lambda a: a["all"]))


def _variants(line: Column, lo: Column, hi: Column) -> Column:
    """Array of (v, i): the hash without the word at place i from lo to before hi, and of the whole line at i = -1."""

    def hashed(word: Column, place: Column) -> Column:
        return F.xxhash64(word, place)

    def of(w: Column) -> Column:
        here = F.transform(w, lambda x, i: hashed(x, i))
        moved = F.transform(w, lambda x, i: hashed(x, i - 1))
        return _let(F.struct(here.alias("a"), moved.alias("b")), sums)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s.bitwiseXOR(y))

    def sums(t: Column) -> Column:
        change = F.zip_with(t["a"], t["b"], lambda a, b: a.bitwiseXOR(b))
        return _let(F.struct(_let(change, _running).alias("before"), t["b"].alias("b"), total(t["a"]).alias("whole"), total(t["b"]).alias("rest")), out)

    def out(t: Column) -> Column:
        cut = F.zip_with(t["before"], t["b"], lambda s, b: t["rest"].bitwiseXOR(s).bitwiseXOR(b))
        each = F.transform(cut, lambda v, i: F.struct(v.alias("v"), i.cast("int").alias("i")))
        return F.concat(F.array(F.struct(t["whole"].alias("v"), F.lit(-1).alias("i"))), F.slice(each, lo + 1, hi - lo))

    return _let(F.split(line, " "), of)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays differ by one element replaced, added or left out at most."""

    def after(p: Column) -> Column:
        rest = [F.slice(x, p + k, F.size(x)) for x in (a, b) for k in (0, 1)]
        by_size = F.when(F.size(a) == F.size(b), rest[1] == rest[3]).when(F.size(a) == F.size(b) + 1, rest[1] == rest[2]).when(F.size(b) == F.size(a) + 1, rest[0] == rest[3])
        return F.when(p == 0, True).otherwise(F.coalesce(by_size, F.lit(False)))

    # The first place that differs; 0 if none does.
    return _let(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), after)


def _shared_ends(distinct: DataFrame) -> DataFrame:
    """(h, g, place, lo, hi) of lines that share an anchor: an edit lies at a word from lo to before hi."""
    m = F.expr("shiftleft(1, greatest(0, length(bin(words)) - 2))")
    whole = F.lit(0)
    ends = []
    for name, size in (("1", m), ("2", F.shiftright(m, 1))):
        ends.append(F.struct(F.col(f"first_{name}").alias("k"), size.cast("int").alias("lo"), F.col("words").alias("hi")))
        ends.append(F.struct(F.col(f"last_{name}").alias("k"), whole.alias("lo"), (F.col("words") - size).cast("int").alias("hi")))
    keyed = distinct.select("h", "g", "place", F.inline(F.array(*ends))).where("k is not null")
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return keyed.join(shared, "k", "left_semi").groupBy("h", "g", "place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def alike(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, g) of distinct lines that are alike to an earlier, different line."""
    suspects = cut_lineage(_shared_ends(distinct))
    # Hashes tell apart lines at the same place, of rows with equal ids and different texts.
    held = lines.select("place", "line").join(_small(suspects), "place").where((F.col("h") == _hashes()[0]) & (F.col("g") == _hashes()[1]))
    # Numbers in the order of places; equal places get different ones and are told apart below.
    held = cut_lineage(held.select("h", "g", "place", "lo", "hi", "line").distinct().orderBy("place").withColumn("o", F.monotonically_increasing_id()))
    rows = held.select("o", F.inline(_variants(F.col("line"), F.col("lo"), F.col("hi"))))
    again = cut_lineage(rows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"))
    rows = cut_lineage(rows.join(_small(again), "v", "left_semi"))
    replaced = rows.where("i >= 0").groupBy("v", "i").agg(F.min("o").alias("earliest"), F.count("*").alias("n")).where("n > 1").select("v", "i", "earliest")
    added = rows.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("o"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("o"))).alias("cut"))
    added = added.where("whole is not null and cut is not null")
    by_replaced = rows.join(replaced, ["v", "i"]).where("earliest < o").select("o", "earliest")
    by_added = rows.join(added, "v").select("o", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.col("whole")).alias("earliest")).where("earliest < o")
    hits = by_replaced.unionByName(by_added).distinct()
    one = held.select("o", "h", "g", "place", F.col("line").alias("a"))
    other = held.select(F.col("o").alias("earliest"), F.col("place").alias("before"), F.col("line").alias("b"))
    verified = hits.join(one, "o").join(other, "earliest").where("before < place").where(_one_edit(F.split("a", " "), F.split("b", " ")))
    return verified.select("h", "g").distinct()


def dedup(docs: DataFrame, *, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that an earlier line is equal or alike to, and n_lines, n_removed.

    Lines end at \\n and are compared trimmed; blank lines count for nothing and stay. Kept lines are
    joined as they were. A null text stays null with zeros; a document may lose all its lines and stays as a
    row with an empty text. Rows equal in id and text are one document; lines of rows with equal ids and
    different texts at the same place count as equally early. Null ids come last. Columns of the
    input named n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = _lines(docs, id_col, text_col)
    n, *anchors = _anchors(least_words)
    hashed = lines.withColumn("n", n).select(*_hashes(), "place", F.col("n").alias("words"), *anchors)
    names = ["first_1", "last_1", "first_2", "last_2"]
    distinct = cut_lineage(hashed.groupBy("h", "g").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.min("words").alias("words"), *[F.min(c).alias(c) for c in names]))
    near = alike(distinct, lines)
    gone = distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("near or n > 1").select("h", "g", F.col("place").alias("earliest"), F.coalesce("near", F.lit(False)).alias("near"))
    places = lines.select(*_hashes(), "key", "line_no", "place")
    removed = places.join(gone, ["h", "g"]).where("near or place > earliest").groupBy(F.col("key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.select(*kept, text_key(id_col, text_col).alias("__key")).join(removed, "__key", "left")
    return _rebuild(joined, kept, text_col)


def _rebuild(joined: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    gone = F.col("__gone")
    every = F.split(text_col, "\n")
    blank = F.lit(SPACE)

    def without(e: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(e) - 1), gone)  # in order, by a hash set
        return F.array_join(F.transform(left, lambda i: F.get(e, i)), "\n")

    text = F.when(gone.isNull(), F.col(text_col)).otherwise(_let(every, without))
    count = F.size(F.filter(every, lambda x: F.btrim(x, blank) != ""))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in kept]
    return joined.select(*columns, F.coalesce(F.when(F.col(text_col).isNotNull(), count), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(gone.isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_removed"))
