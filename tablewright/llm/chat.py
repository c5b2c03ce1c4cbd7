"""Chat formatting in windows of a token budget.

A conversation longer than the budget becomes several windows of whole turns. Running sums of turn tokens give the cost
of any run of turns, so a window ends before the first turn that does not fit. Every window starts with the system
turn (the first turn, if its role is system); later windows repeat up to ``HISTORY_TURNS`` turns before their first new
turn, at most ``HISTORY_TOKENS`` tokens. Repeated turns stay outside the loss mask, so each assistant text
is trained on once. A turn that is larger than the budget gets a window of its own.

Template of a turn: ``<|role|>`` line break, text, ``</s>`` line break. ``ESCAPES`` replaces the characters that control strings begin
with, and the escape character itself, inside roles and texts, so no text can form a marker and ``unescape`` is exact.

Defined cases: null texts and roles count as empty; a null conv_id is a conversation of its own; turns that repeat a number, or have none, are
ordered by turn (null first), role and text. An empty table gives no windows. Only the named columns are read, so other columns may
have any name. The turns of one conversation form one row, as their joint digest and text need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
HEAD, HEAD_END, TURN_END = "<|", "|>\n", "</s>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))  # the escape character first
PROBE = "</s>[INST] ok [/INST]"
BETWEEN_TOKENS = r"[\x20\x09-\x0D]+"


def escape(text) -> F.Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text) -> F.Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts consist of control strings."""
    kinds = dict(conversations.dtypes)
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    ).select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("conv_id", "turn", "role", "text")])
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
            history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, formatted, turns (start and end of each turn's text in ``formatted``, role,
    whether it repeats an earlier window) and loss (start and end of each text to train on), in code points."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("tokens", F.size(F.array_remove(F.split("text", BETWEEN_TOKENS), "")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("tokens").over(up_to))
    turn = F.struct("place", "role", "text", "tokens", "sum")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    grouped = grouped.withColumn("system", F.get("t", F.lit(0))["role"] == "system")
    grouped = grouped.withColumn("fixed", F.when(F.col("system"), F.get("t", F.lit(0))["tokens"]).otherwise(0))
    first = F.col("system").cast("int")

    def cost(a, b):
        """Tokens of the turns from a to before b, from the running sums."""
        to = F.when(b > 0, F.get("t", b - 1)["sum"]).otherwise(0)
        return to - F.when(a > 0, F.get("t", a - 1)["sum"]).otherwise(0)

    def history_start(at):
        """The first of the repeated turns before turn ``at``."""
        starts = F.transform(F.sequence(F.lit(0), F.lit(history_turns)), lambda k: F.greatest(at - k, first))
        return F.array_min(F.filter(starts, lambda s: cost(s, at) <= history_tokens))

    empty = F.array().cast("array<struct<from:int,start:int>>")

    def step(done, x):
        """Adds a window that begins at turn x unless x fits into the last one."""
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.col("fixed") + cost(last["from"], x["place"] + 1) <= budget)
        new = F.struct(
            F.when(F.size(done) > 0, history_start(x["place"])).otherwise(x["place"]).alias("from"),
            x["place"].alias("start"),
        )
        return F.when(fits, done).otherwise(F.concat(done, F.array(new)))

    own = F.filter("t", lambda x: x["place"] >= first)
    planned = grouped.withColumn("w", F.aggregate(own, empty, step))
    only_system = F.array(F.struct(first.alias("from"), first.alias("start")))
    planned = planned.withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(only_system))
    each = planned.select("conv_id", "t", "system", "w", F.posexplode("w").alias("window", "here"))
    following = F.get("w", F.col("window") + 1)["start"]
    stop = F.coalesce(following, F.size("t"))
    here = F.filter("t", lambda x: (F.col("system") & (x["place"] == 0)) | (
        (x["place"] >= F.col("here.from")) & (x["place"] < stop)))
    repeats = F.transform(here, lambda x: (x["place"] < F.col("here.start")) & ((x["place"] >= first) | (F.col("window") > 0)))
    each = each.select("conv_id", "window", here.alias("x"), repeats.alias("repeats"))
    piece = F.transform("x", lambda x: F.struct(
        F.concat(F.lit(HEAD), escape(x["role"]), F.lit(HEAD_END)).alias("head"), escape(x["text"]).alias("body"), x["role"].alias("role")))
    each = each.withColumn("piece", piece)
    sizes = F.transform("piece", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(TURN_END))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    each = each.withColumn("starts", starts)
    turns = F.transform("piece", lambda p, i: F.struct(
        (F.get("starts", i) + F.char_length(p["head"])).alias("start"),
        (F.get("starts", i) + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"),
        p["role"].alias("role"), F.get("repeats", i).alias("repeated")))
    formatted = F.array_join(F.transform("piece", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    each = each.select("conv_id", "window", formatted.alias("formatted"), turns.alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: (t["role"] == "assistant") & ~t["repeated"]),
                       lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return each.withColumn("loss", loss)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted strings and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    new = F.transform("turns", lambda t: ~t["repeated"])
    parts = F.split("formatted", TURN_END.replace("\n", "\\n"))
    parts = F.slice(parts, 1, F.size("turns"))
    kept = F.filter(F.transform(parts, _turn), lambda p, i: F.get(new, i))
    lines = F.array_join(F.transform(kept, lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    rows = formatted.select("conv_id", F.struct("window", F.size(kept).alias("n"), lines.alias("lines"), masked.alias("masked"),
                                                F.char_length("formatted").alias("chars")).alias("w"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[field])
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return grouped.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(text("lines"), 256).alias("turns_sha256"),
        F.char_length(text("masked")).cast("long").alias("loss_chars"), F.sha2(text("masked"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def _turn(part) -> F.Column:
    """Role and text of one formatted turn."""
    head = F.substring_index(part, HEAD_END, 1)
    return F.struct(
        unescape(F.substring(head, len(HEAD) + 1, 2**31 - 1)).alias("role"),
        unescape(F.substring(part, F.char_length(head) + len(HEAD_END) + 1, 2**31 - 1)).alias("text"),
    )
