"""Chat formatting: windows of whole turns within a token budget, with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.llm.common import named

#: The template writes each turn as HEAD role newline text END. Texts and roles are escaped, so that neither these
#: strings nor instruction marks in brackets occur in them.
HEAD, END = "<s>", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
ROLE_NEWLINE = "&nl;"
#: Tokens of a window, those of them that repeated turns may take, and those that the template adds to a turn.
BUDGET, HISTORY, TURN_TOKENS = 1024, 256, 4
#: Turn numbers that one prefix sum covers; longer conversations take the sum over such blocks first.
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    """A role ends with the line, so its own newlines are coded too."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_NEWLINE))


def count_tokens(text: Column) -> Column:
    """Tokens of a turn: its runs of characters other than white space, and the template's own."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + TURN_TOKENS).cast("bigint")


def windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss_spans, n_tokens) for each window of each conversation.

    Turns are ordered by number, then role and text. If a conversation starts with a system turn,
    every window does. What budget is left after it and ``history`` is a cell of the prefix sum of
    the other turns' tokens. The turns that lie in one cell make a window, and so does one that
    crosses into another cell; it alone may exceed the budget, if it is that long. A window repeats
    the latest whole turns before it, of ``history`` tokens at most. ``n_repeated`` turns at its
    start were in windows before. ``loss_spans`` has the start and length, in code points, of the
    texts of assistant turns that weren't: each is a target once.

    Null or empty texts and roles are empty strings. A null conversation is one of its own, a null
    turn comes first. Repeated rows are turns too. No rows give no rows; other columns are ignored.
    """
    rows = turns.select(
        named(conv_col).cast("bigint").alias("conv_id"), named(turn_col).cast("bigint").alias("turn"),
        *[F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    ).withColumn("tokens", count_tokens(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    rows = rows.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    blocks = rows.groupBy("conv_key", "block").agg(
        F.sum("tokens").alias("sum"), F.count("*").alias("n"), F.min(F.struct("turn", "role", "text", "tokens")).alias("first")
    )
    ahead = Window.partitionBy("conv_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = Window.partitionBy("conv_key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.col("first")).over(firsts)
    blocks = blocks.select(
        "conv_key", "block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("tokens_ahead"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("turns_ahead"),
        F.when(first["role"] == "system", first["tokens"]).otherwise(0).alias("system_tokens"),
    )
    inner = Window.partitionBy("conv_key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_tokens"))
    placed = (
        rows.join(blocks, ["conv_key", "block"])
        .withColumn("n", F.col("turns_ahead") + F.count("*").over(inner))
        .withColumn("stop", F.col("tokens_ahead") + F.sum("tokens").over(inner) - F.col("system_tokens"))
        .withColumn("start", F.col("stop") - F.col("tokens")).withColumn("step", step)
        .withColumn("cell", F.floor(F.col("start") / F.col("step")))
        .withColumn("window", F.when((F.col("n") == 1) & (F.col("system_tokens") > 0), F.lit(-1)).otherwise(
            2 * F.col("cell") + (F.floor((F.col("stop") - 1) / F.col("step")) > F.col("cell")).cast("bigint")))
        .select("conv_id", "conv_key", "n", "role", "text", "tokens", "start", "stop", "step", "cell", "window")
    )
    shown = ["conv_id", "conv_key", "window", "section", "n", "role", "text", "tokens"]
    turn = placed.where("window >= 0")
    opened = turn.groupBy("conv_key", "window", "cell").agg(F.min("start").alias("opens"))
    reach = F.sequence(F.floor(F.col("stop") / F.col("step")), F.floor((F.col("start") + history) / F.col("step")))
    again = (
        turn.where(F.col("tokens") <= history).drop("cell", "window").withColumn("cell", F.explode(reach))
        .join(opened, ["conv_key", "cell"]).where((F.col("stop") <= F.col("opens")) & (F.col("opens") <= F.col("start") + history))
    )
    system = placed.where("window < 0")
    heads = system.drop("window").join(opened.select("conv_key", "window"), "conv_key", "left").withColumn("window", F.coalesce("window", F.lit(0)))
    opening = opened.groupBy("conv_key").agg(F.min("window").alias("opening"))
    heads = heads.join(opening, "conv_key", "left").withColumn("section", F.when(F.col("window") == F.coalesce("opening", F.lit(0)), 1).otherwise(0))
    every = (
        turn.withColumn("section", F.lit(1)).select(*shown)
        .unionByName(again.withColumn("section", F.lit(0)).select(*shown))
        .unionByName(heads.select(*shown))
    )
    lead = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit("\n"))
    every = every.select(
        "conv_id", "conv_key", "window", "n", "section", "tokens", lead.alias("lead"), escape(F.col("text")).alias("body"),
        ((F.col("section") == 1) & (F.col("role") == "assistant")).alias("target"),
    )
    parts = F.array_sort(F.collect_list(F.struct("n", "section", "lead", "body", "target", "tokens")))
    grouped = every.groupBy("conv_id", "conv_key", "window").agg(parts.alias("parts"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def spans(state: Column, part: Column) -> Column:
        at = state["at"] + F.char_length(part["lead"])
        size = F.char_length(part["body"]).cast("bigint")
        found = F.when(part["target"], F.concat(state["spans"], F.array(F.struct(at.alias("start"), size.alias("length"))))).otherwise(state["spans"])
        return F.struct((at + size + len(END)).alias("at"), found.alias("spans"))

    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"], F.lit(END))), "").alias("text"),
        F.size(F.filter("parts", lambda p: p["section"] == 0)).cast("bigint").alias("n_repeated"),
        F.aggregate("parts", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), spans)["spans"].alias("loss_spans"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the windows alone.

    The digests are of a conversation's roles and texts, and of its targets. Turns that a window
    repeats are counted in formatted_chars only.
    """
    pieces = F.slice(F.split("text", END), F.col("n_repeated").cast("int") + 1, F.size(F.split("text", END)) - 1 - F.col("n_repeated").cast("int"))

    def plain(piece: Column) -> Column:
        role = F.replace(F.substring_index(piece, "\n", 1), F.lit(ROLE_NEWLINE), F.lit("\n"))
        text = F.substring(piece, F.instr(piece, "\n"), 1 << 30)  # with the newline before it
        return F.concat(unescape(F.substring(role, len(HEAD) + 1, 1 << 30)), unescape(text), F.lit("\n"))

    told = F.transform(pieces, plain)
    target = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    by_window = formatted.select(
        "conv_id", "window", F.size(told).cast("bigint").alias("turns"), F.array_join(told, "").alias("told"), F.array_join(target, "").alias("target"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "told", "target")))
    whole = by_window.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), ordered.alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("parts.target"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("parts.told"), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
