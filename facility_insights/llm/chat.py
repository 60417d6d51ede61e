"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context, and its own
text alone is trainable. The examples of one conversation are prefixes of one formatted stream: the
turns are formatted once, a row each, and an example is the stream up to the end of its
reply with a loss span at that reply. ``expand`` writes every example out, its texts as long as the method makes them; shuffled
and sorted are the turns alone, and a task holds one conversation's stream. ``digest`` reads the written examples back.
``render`` writes chosen examples out.

The template marks a turn by ``<s>[TURN role] `` before and `` [/TURN]</s>`` after the text; in
a role, per cent signs and closing brackets are written %25 and %5D. Control strings inside texts are escaped
reversibly: a backslash goes after their first character, and one more where some stand there.
"""

from __future__ import annotations

import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facility_insights.llm.shared import batches

OPEN, MIDDLE, CLOSE = "<s>[TURN ", "] ", " [/TURN]</s>"
#: What may not stand in a text as it is: the template's and other common templates' control strings.
#: White space is listed, as "\s" means other characters to each of the engines that run this.
CONTROL = r"(/?s>|/?TURN|/?INST\]|</?SYS>>|\|[^|<>\[ \t\n\x0B\f\r]{1,40}\|>)"
ESCAPABLE = r"([<\[])(\\*)" + CONTROL
ESCAPED = r"([<\[])\\(\\*)" + CONTROL
_ESCAPED = re.compile(ESCAPED)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """A row for each turn of each conversation's formatted stream.

    (conv_id, pos, role, piece, start, end, loss_start, loss_end, example): ``piece`` is the
    formatted turn, at code points [start, end) of the stream. A turn whose role is ``target`` is
    example number ``example`` of its conversation: the stream up to ``end``, trainable at
    [loss_start, loss_end); other turns have nulls there. Turns are ordered by turn (nulls first),
    then role and text; null roles and texts are empty; repeated rows are turns of their own; a null
    conv_id is a conversation like any other. Other columns are not looked at.
    """
    of = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    role = F.replace(F.replace(F.col("role"), F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE))
    parts = of.withColumn("head", head).withColumn("body", escape(F.col("text")))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_target = F.col("role") == target
    placed = parts.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        "role",
        "piece",
        F.sum(F.length("piece").cast("long")).over(so_far).alias("end"),
        F.sum(is_target.cast("long")).over(so_far).alias("targets"),
        F.length("head").alias("before"),
        F.length("body").alias("size"),
    )
    placed = placed.withColumn("start", F.col("end") - F.length("piece"))
    loss_start = F.when(is_target, F.col("start") + F.col("before"))
    return placed.select(
        "conv_id",
        "pos",
        "role",
        "piece",
        "start",
        "end",
        loss_start.alias("loss_start"),
        (loss_start + F.col("size")).alias("loss_end"),
        F.when(is_target, F.col("targets") - 1).alias("example"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_context_turns, chars, loss_start, loss_end): one row for each assistant turn."""
    return turns.where(F.col("example").isNotNull()).select(
        "conv_id", "example", F.col("pos").alias("n_context_turns"), F.col("end").alias("chars"), "loss_start", "loss_end"
    )


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): chosen rows of ``examples`` written out whole."""
    pieces = turns.select("conv_id", "pos", "piece")
    joined = chosen.join(pieces, "conv_id").where(F.col("pos") <= F.col("n_context_turns"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return joined.groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text"))


def parse(piece: str) -> tuple[str, str, int]:
    """(role, text, place of the text) out of a formatted turn."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError(f"not a formatted turn: {piece[:60]!r}")
    role_end = piece.index(MIDDLE, len(OPEN))
    role = unescape(piece[len(OPEN) : role_end]).replace("%5D", "]").replace("%25", "%")
    at = role_end + len(MIDDLE)
    return role, unescape(piece[at : len(piece) - len(CLOSE)]), at


DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _written(rows):
    """Every example of sorted turns as (conv_id, example, text, loss_start, loss_end), its whole context and its reply in its text.

    A conversation that does not end in a target turn has its whole stream once more, with nulls for example and span, as
    the untrained rest that keeps its last turns.
    """
    conv, stream, rest = None, None, False
    for b in rows:
        for key, piece, example, loss_start, loss_end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if stream is None or key != conv:
                if rest:
                    yield conv, None, stream.getvalue(), None, None
                conv, stream = key, io.StringIO()
            stream.write(piece)
            rest = example is None
            if not rest:
                yield key, example, stream.getvalue(), loss_start, loss_end
    if rest:
        yield conv, None, stream.getvalue(), None, None


def _sorted(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "piece", "example", "loss_start", "loss_end")


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): all examples and rests written out, a conversation's one after another."""
    return _sorted(turns).mapInArrow(
        lambda rows: batches(_written(rows), EXAMPLES, weight=lambda row: len(row[2])), "conv_id long, example long, text string, loss_start long, loss_end long"
    )


def digest(turns: DataFrame) -> DataFrame:
    """Read back from the written examples, conversation by conversation in order, one text at a time.

    formatted_chars is the sum of all written texts' lengths, the loss text is what the examples' spans hold, and the turns are
    parsed out of a conversation's last text.
    """

    def run(rows):
        def conversations():
            state, last = None, ""
            for conv, _, text, loss_start, loss_end in _written(rows):
                if state is None or conv != state[0]:
                    if state is not None:
                        yield _closed(state, last)
                    state = [conv, 0, hashlib.sha256(), 0]
                last = text
                state[3] += len(text)
                if loss_start is not None:
                    loss = unescape(text[loss_start:loss_end])
                    state[1] += len(loss)
                    state[2].update(loss.encode())
            if state is not None:
                yield _closed(state, last)

        yield from batches(conversations(), DIGEST)

    return _sorted(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(state: list, last: str) -> tuple:
    conv, chars, loss, total = state
    pieces, turns = last.split(CLOSE)[:-1], hashlib.sha256()
    for piece in pieces:
        role, text, _ = parse(piece + CLOSE)
        turns.update(f"{role}\n{text}\n".encode())
    return conv, len(pieces), turns.hexdigest(), chars, loss.hexdigest(), total
