"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are written one after the other between control
strings.  Texts may hold anything: a backslash breaks up whatever could be read
as a control string, and is itself doubled, so formatting is reversible.

Long conversations become several windows.  Prefix sums of the turns' token
counts place every turn in a window without looking at its neighbours: the
budget left for new turns is cut into halves (strides), turns that begin in
the same stride share a window, and a turn longer than a stride has its own.
A window so holds less than two strides.  Each window begins with the
conversation's first system turn and, as far as the history budget goes, the
turns before it; the loss mask covers only the assistant texts that are new in
the window, so each is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize

START, END = "<|start|>", "<|end|>\n"
#: Tokens are estimated: one for each four characters as written.
CHARS_PER_TOKEN = 4
BUDGET, HISTORY = 1024, 256
#: Turn numbers that share a bucket when prefix sums are formed in two levels.
BUCKET = 256


def escape(text: Column) -> Column:
    """Break up control strings (the template's own and those of other common templates)."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=[|/s<])", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _running(rows: DataFrame, sums: dict[str, str], by: list[str]) -> DataFrame:
    """Adds for each name the sum of a column over the earlier turns of the conversation, in two levels."""
    parts = rows.groupBy("key", "bucket").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    order = Window.partitionBy("key").orderBy("bucket")
    before = parts.select("key", "bucket", *((F.sum(f"__{k}").over(order) - F.col(f"__{k}")).alias(f"__b_{k}") for k in sums))
    within = Window.partitionBy("key", "bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(before, ["key", "bucket"])
    return met.select(*rows.columns, *((F.col(f"__b_{k}") + F.sum(c).over(within) - F.col(c)).alias(k) for k, c in sums.items()))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, first_turn (place of the first new turn), n_repeated (turns before it), text, loss (start and length of masked-in spans, in code points).

    Turns are ordered by turn, nulls first, then role and text; null roles and
    texts are empty; rows that repeat are turns of their own; rows with a null
    conv_id are one conversation; other columns are ignored; an empty table
    gives no windows.  A turn longer than the budget is kept whole.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    rows = turns.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), r"\n", "\\\\\n"), F.lit("\n"))
    body = escape(F.col("text"))
    tokens = F.ceil((F.length(head) + F.length(body) + len(END)) / CHARS_PER_TOKEN)
    rows = rows.select("*", F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 62))).alias("bucket"), tokens.alias("tokens"), F.lit(1).cast("long").alias("one"))
    rows = _running(rows, {"at": "one", "begin": "tokens"}, ["turn", "role", "text"])
    rows = materialize(rows.select("key", "bucket", "at", "begin", "tokens", "role", head.alias("head"), body.alias("body")), "chat-turns")
    # which turns stand in which windows is worked out without their texts
    narrow = rows.select("key", "bucket", "at", "begin", "tokens", "role")
    system = narrow.where("role = 'system'").groupBy("key").agg(F.min(F.struct("at", "tokens")).alias("s")).select("key", F.col("s.at").alias("s_at"), F.col("s.tokens").alias("s_tokens"))
    # half of what a window has for new turns
    stride = F.greatest(F.floor((F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0))) / 2), F.lit(1))
    narrow = narrow.join(system, "key", "left").withColumn("stride", stride).withColumn("long", (F.col("tokens") > F.col("stride")).cast("long"))
    narrow = _running(narrow.select("key", "bucket", "at", "begin", "s_at", "stride", "long"), {"longs": "long"}, ["at"])
    narrow = narrow.select("key", "at", "begin", "s_at", F.floor(F.col("begin") / F.col("stride")).alias("cell"), (2 * F.col("longs") + F.col("long")).alias("run"))
    narrow = materialize(narrow, "chat-places")
    starts = materialize(narrow.groupBy("key", "cell", "run").agg(F.min("at").alias("first"), F.min("begin").alias("from")), "chat-windows")
    new = narrow.join(starts, ["key", "cell", "run"]).select("key", "at", "first", F.lit(2).alias("kind"))
    # turns that end at most `history` tokens before a window begins: a range join on a grid of that width
    grid = starts.select("key", "first", "from", F.floor(F.col("from") / history).alias("bin"))
    past = narrow.where(F.coalesce(F.col("at") != F.col("s_at"), F.lit(True)))
    past = past.select("key", "at", "begin", F.explode(F.array(F.floor(F.col("begin") / history), F.floor(F.col("begin") / history) + 1)).alias("bin"))
    near = past.join(grid, ["key", "bin"]).where((F.col("from") > F.col("begin")) & (F.col("from") - F.col("begin") <= history))
    old = near.select("key", "at", "first", F.lit(1).alias("kind"))
    kept = starts.join(system, "key").where(F.col("s_at") < F.col("first")).select("key", F.col("s_at").alias("at"), "first", F.lit(0).alias("kind"))
    placed = rows.select("key", "at", "role", "head", "body").join(new.unionByName(old).unionByName(kept), ["key", "at"])
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    item = F.struct("kind", "at", "head", "body", target.alias("target"))
    every = placed.groupBy("key", "first").agg(F.sort_array(F.collect_list(item)).alias("items"))
    written = F.transform("items", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    state = F.struct(F.lit(0).alias("o"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        span = F.struct((a["o"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))
        return F.struct(
            (a["o"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("o"),
            F.when(x["target"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
        )

    loss = F.aggregate("items", state, step, lambda a: a["spans"])
    repeated = F.size(F.filter("items", lambda x: x["kind"] < 2))
    return every.select(F.expr("nullif(key, '')").cast("long").alias("conv_id"), F.col("first").alias("first_turn"), repeated.alias("n_repeated"), F.array_join(written, "").alias("text"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The new turns of each window, parsed from its text: conv_id, first_turn, turns (role, text), learned (texts under the mask), chars."""
    pieces = F.slice(F.split("text", r"<\|start\|>"), 2, F.size(F.split("text", r"<\|start\|>")))
    head = lambda p: F.regexp_extract(p, r"^((?:[^\\\n]|\\[\s\S])*)\n", 1)

    def turn(p: Column) -> Column:
        h = head(p)
        return F.struct(unescape(h).alias("role"), unescape(F.substring(p, F.length(h) + 2, F.length(p) - F.length(h) - 1 - len(END))).alias("text"))

    new = F.filter(pieces, lambda p, i: i >= F.col("n_repeated"))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "first_turn", F.transform(new, turn).alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("chars"))


def digest(turns: DataFrame, **options) -> DataFrame:
    """Format and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a conversation is over its text in order, so one task joins up
    the text of one conversation; all other work is by window.
    """
    read = read_back(windows(turns, **options))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read.select("conv_id", "first_turn", F.size("turns").alias("n"), said.alias("said"), F.array_join("learned", "").alias("learned"), "chars")
    each = each.withColumn("learned_chars", F.length("learned"))
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("learned_chars").cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("first_turn", "said", "learned"))).alias("parts"),
    )
    joined = lambda name: F.sha2(F.array_join(F.transform("parts", lambda p: p[name]), ""), 256)
    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars", joined("learned").alias("loss_sha256"), "formatted_chars")
