"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes `<|im_start|>role`, a line feed, its text, `<|im_end|>` and a line feed. Control strings inside a text
are escaped by a backslash that goes away again when the text is read back. A turn's tokens are counted by `PIECE`
(up to six letters, up to three digits, line feeds, or any other character but a blank), or come from a column.

The prefix sum of the tokens says where a turn begins. What the budget leaves beside the system turn and the history is
the room of a window. Turns that begin in one stretch of half the room make a span; a turn of more than half the room
is a span of its own; the system turn belongs to the first span. Each span is one window: the system turn again (if the conversation begins with one), the last
turns before that begin within `history` tokens of it and that the budget still holds, then the span's own turns. So a
window exceeds the budget only if it holds a single turn that does not fit beside the system turn; it has no history.
The loss mask holds the texts of the span's own assistant turns; what is repeated is masked.

Rows: null roles and texts count as empty; turns are ordered by turn (nulls first), then role and text, so ties and
repeated rows have a fixed order up to equal rows. Rows with a null conversation make a conversation of their own. An
empty table gives an empty table. Only the four named columns are read. The prefix sums run in one sorted pass over a
conversation; only a window is ever held in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PIECE = r"[A-Za-z]{1,6}|[0-9]{1,3}|\n+|[^A-Za-z0-9 \t\r\n]"


def escape(text: Column) -> Column:
    """A backslash before the bar of each `<|`, and one more where there are some already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for a, b in (("\\", "\\s"), ("\n", "\\n"), ("|", "\\p")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("|", "\\p"), ("\n", "\\n"), ("\\", "\\s")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def windows(
    df: DataFrame, budget: int = 2048, history: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None
) -> DataFrame:
    """(conv, window, formatted, context_turns, loss, tokens): the turns before the span's own, and [start, length) of
    the loss mask in characters of `formatted`, counted from 1. history is at most half the budget. tokens: a column
    with the tokens of each formatted turn (null: none), if they are not to be counted by `PIECE`."""
    if not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    given = F.lit(None).cast("long") if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    t = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"), given.alias("given"))
    order = Window.partitionBy("c").orderBy("t", "r", "x", "given")
    head = F.concat(F.lit(START), escape_role(F.col("r")), F.lit("\n"))
    t = t.select("c", "r", F.row_number().over(order).alias("n"), head.alias("head"), escape(F.col("x")).alias("body"), "given")
    t = t.withColumn("turn_text", F.concat("head", "body", F.lit(END + "\n"))).withColumn("len", F.length("turn_text"))
    t = t.withColumn("cost", F.coalesce("given", F.regexp_count("turn_text", F.lit(PIECE)).cast("long"))).drop("given")
    by_turn = Window.partitionBy("c").orderBy("n")
    t = t.withColumn("sys", (F.col("n") == 1) & (F.col("r") == "system"))
    t = t.withColumn("reserved", F.coalesce(F.max(F.when(F.col("sys"), F.col("cost"))).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    t = t.withColumn("half", F.greatest(F.lit(1), F.floor((budget - history - F.col("reserved")) / 2)))
    t = t.withColumn("own_cost", F.when(F.col("sys"), F.lit(0)).otherwise(F.col("cost")))
    t = t.withColumn("s", F.coalesce(F.sum("own_cost").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("span", F.floor(F.col("s") / F.col("half")) * 2 + (F.col("own_cost") > F.col("half")).cast("long"))
    t = t.withColumn("span", F.when(F.col("sys"), F.coalesce(F.lead("span").over(by_turn), F.col("span"))).otherwise(F.col("span")))
    t = t.withColumn("span_cost", F.sum("own_cost").over(Window.partitionBy("c", "span")))
    # What later spans look like: the windows run backwards, as a frame that only grows is cheap.
    later = Window.partitionBy("c").orderBy(F.desc("span")).rangeBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("next", F.min(F.struct("span", "s", "span_cost")).over(later))
    opens = (F.col("n") > 1) & ~F.coalesce(F.lag("span").over(by_turn) == F.col("span"), F.lit(False))
    system = F.max(F.when(F.col("sys"), F.col("turn_text"))).over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("again", F.when(opens, system))

    body = F.struct(F.lit(True).alias("own"), F.col("span").alias("span"), "again")
    repeated = F.struct(F.lit(False).alias("own"), F.col("next.span").alias("span"), F.lit(None).cast("string").alias("again"))
    reach = F.least(F.lit(history), budget - F.col("reserved") - F.col("next.span_cost"))
    is_history = ~F.col("sys") & F.coalesce(F.col("next.s") - F.col("s") <= reach, F.lit(False))
    rows = t.withColumn("at", F.explode(F.when(is_history, F.array(repeated, body)).otherwise(F.array(body))))
    rows = rows.select("c", "at.span", "n", "at.own", "at.again", "turn_text", "cost", "reserved", "len", F.length("head").alias("head_len"), F.length("body").alias("body_len"), "r")
    own = Window.partitionBy("c", "span")
    before = F.coalesce(F.sum("len").over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again_len = F.coalesce(F.max(F.length("again")).over(own), F.lit(0))
    rows = rows.withColumn("start", F.when(F.col("own") & (F.col("r") == "assistant"), again_len + before + F.col("head_len") + 1))

    made = rows.groupBy("c", "span").agg(
        F.array_sort(F.collect_list(F.struct("n", "turn_text"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("int").alias("start"), F.col("body_len").alias("length"))))).alias("loss"),
        F.max("again").alias("again"),
        F.sum((~F.col("own")).cast("int")).alias("repeated"),
        (F.sum("cost") + F.coalesce(F.max(F.when(F.col("again").isNotNull(), F.col("reserved"))), F.lit(0))).alias("tokens"),
    )
    return made.select(
        F.col("c").alias(conv),
        F.col("span").alias("window"),
        F.concat(F.coalesce("again", F.lit("")), F.array_join(F.transform("turns", lambda x: x["turn_text"]), "")).alias("formatted"),
        (F.col("repeated") + F.col("again").isNotNull().cast("int")).cast("int").alias("context_turns"),
        "loss",
        "tokens",
    )


def read_back(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, window, turns, loss_text): the span's own turns (role, text) and the text under its loss mask."""
    parts = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>")), F.col("context_turns") + 2, F.length("formatted"))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return made.select(conv, "window", F.transform(parts, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
