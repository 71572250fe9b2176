"""Chat formatting (native): budgeted windows over conversations.

Prefix sums of turn tokens choose turn-aligned spans; each window holds the system turn, a limited
repeated history, and the new turns of its span. Repeated turns are never targets: the loss mask
covers the text of each assistant turn in the one window where it is new.

A conversation's turns are numbered and summed up in order, so a conversation is sorted in one task
(which may spill); its windows are chosen in stretches of bounded length and formatted apart. Only
read_back() puts a whole conversation into one row, as its digest is of all its text.

Defined cases: null text and null role are empty; a null conv_id is a conversation of its own;
turns with equal numbers are ordered by role and text; repeated rows are turns of their own; a turn
longer than the budget stands whole, alone with the system turn; an empty table gives no windows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import n_words
from loomrec.session import write_through

#: The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens that the marks and the role add to a turn.
TURN_OVERHEAD = 4
#: Budgets of tokens after which a new window begins in any case.
STRETCH = 64


def escape(text: Column) -> Column:
    """Puts one more backslash between < and |, so no mark can appear in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape(), and on one line: backslash and newline become \\s and \\n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The turns with their place, tokens and prefix sums, and what a window that began with them would repeat."""
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = turns.select(key.alias("key"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("key").orderBy("turn", "role", "text")
    whole = Window.partitionBy("key")
    tokens = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    # Turns that begin within `history` tokens of this one's beginning: their tokens and their number.
    recent = whole.orderBy("start").rangeBetween(-history, -1)
    placed = (
        rows.withColumn("pos", F.row_number().over(in_order))
        .withColumn("tokens", n_words(F.col("text")) + TURN_OVERHEAD)
        .withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
        .withColumn("start", F.coalesce(F.sum(tokens).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("kept", F.sum(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole))
        .withColumn("past", F.col("start") - F.coalesce(F.min(F.when(~F.col("system"), F.col("start"))).over(recent), F.col("start")))
        .withColumn("n_past", F.count(F.when(~F.col("system"), 1)).over(recent))
    )
    fits = F.col("kept") + F.col("past") + F.col("tokens") <= budget
    return placed.select(
        "key", "conv_id", "pos", "role", "text", "tokens", "system", "start",
        F.when(fits, F.col("n_past")).otherwise(0).cast("int").alias("n_past"),
        (F.col("kept") + F.when(fits, F.col("past")).otherwise(0) + F.col("tokens")).alias("used"),
    )


def _windows(placed: DataFrame, budget: int) -> DataFrame:
    """key, pos, window, context: which turns each window holds."""
    light = placed.select("key", "pos", "tokens", "system", "start", "n_past", "used")
    # Windows are chosen one after the other, so within stretches of bounded length; no text is needed for it.
    stretch = F.floor(F.col("start") / (STRETCH * budget)).alias("stretch")
    turn = F.struct("pos", "tokens", "used")
    chosen = f"""aggregate(turns, named_struct('used', cast({budget} as bigint), 'firsts', cast(array() as array<int>)),
        (a, t) -> if(a.used + t.tokens <= {budget} and size(a.firsts) > 0,
            named_struct('used', a.used + t.tokens, 'firsts', a.firsts),
            named_struct('used', t.used, 'firsts', array_append(a.firsts, t.pos)))).firsts"""
    firsts = light.where("not system").groupBy("key", stretch).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("key", F.explode(F.expr(chosen)).alias("pos"), F.lit(True).alias("first"))
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.greatest(F.count("first").over(so_far) - 1, F.lit(0))
    numbered = light.join(firsts.hint("merge"), ["key", "pos"], "left").withColumn("window", number).withColumn("has_system", F.max("system").over(Window.partitionBy("key")))
    began = numbered.where("first and window > 0")
    past = began.where("n_past > 0").select("key", F.explode(F.sequence(F.col("pos") - F.col("n_past"), F.col("pos") - 1)).alias("pos"), "window", F.lit(True).alias("context"))
    system = began.where("has_system").select("key", F.lit(1).alias("pos"), "window", F.lit(True).alias("context"))
    return numbered.select("key", "pos", "window", F.lit(False).alias("context")).unionByName(past).unionByName(system)


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows: conv_id, window, formatted, loss_spans (start, end in characters of formatted), n_context, n_tokens.

    A window holds the system turn, the turns of the last ``history`` tokens before it, and as many
    new turns as the ``budget`` (words and TURN_OVERHEAD a turn) has room for. Where the first new
    turn leaves no room for that history none is repeated, and a turn that is too long by itself
    stands alone with the system turn. A window ends at every STRETCH budgets of a conversation.
    ``n_context`` counts the leading turns that an earlier window has as new ones.
    """
    placed = write_through(_placed(turns, budget, history), "chat-turns")
    pieces = (
        _windows(placed, budget)
        .join(placed.select("key", "pos", "conv_id", "role", "text", "tokens").hint("merge"), ["key", "pos"])
        .withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("target", (F.col("role") == "assistant") & ~F.col("context"))
    )
    piece = F.struct("pos", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("all"), F.length("head").alias("head"), F.length("body").alias("body"), "target")
    spans_of = f"""aggregate(pieces, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>)),
        (a, p) -> named_struct('at', a.at + length(p.all),
            'spans', if(p.target, array_append(a.spans, named_struct('start', a.at + p.head, 'end', a.at + p.head + p.body)), a.spans))).spans"""
    return (
        pieces.groupBy("key", "window")
        .agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum(F.col("context").cast("int")).cast("int").alias("n_context"), F.sum("tokens").alias("n_tokens"))
        .select("conv_id", "window", F.expr("array_join(transform(pieces, p -> p.all), '')").alias("formatted"), F.expr(spans_of).alias("loss_spans"), "n_context", "n_tokens")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    marks = len(CLOSE) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = part.substr(F.length(role) + 2, F.length(part) - F.length(role) - 1 - marks)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    parts = F.split(F.col("formatted"), r"<\|im_start\|>")
    own = (
        windows.withColumn("parts", F.slice(parts, F.col("n_context") + 2, F.size(parts)))
        .withColumn("turns", F.array_join(F.transform("parts", turn), ""))
        .withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))), ""))
        .select("conv_id", F.struct("window", "turns", "loss").alias("own"), F.size("parts").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"))
    )
    joined = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("own")).alias("own"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.expr("array_join(transform(own, w -> w.loss), '')")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.expr("array_join(transform(own, w -> w.turns), '')"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
