"""Chat formatting: conversations become windows of whole turns under a token budget.

Prefix sums of the turns' tokens cut a conversation into spans of about ``stride`` tokens that
start and end with a turn. A window shows the system turn, the last turns of the span before
(at most ``history`` tokens), then its own span. Loss falls on the assistant texts of the span
alone, so a repeated target is masked and every target is trained on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import NOT_SPACE, query, table

BUDGET, HISTORY = 512, 96

# Every character that the markers are made of has an escape, so no text can hold a marker.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3")]
OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_turns, n_repeat, tokens, loss.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. ``n_repeat`` leading
    turns of a window repeat earlier ones; ``loss`` is an array of (start, length) in code
    points of ``formatted``, start from 0. Tokens are runs of non-space characters plus one per
    turn. The system turn is the first turn of a conversation if its role is ``system``.

    A window keeps to ``budget`` if each turn has at most (budget - history - system) / 2 tokens;
    a longer turn is never cut, its window exceeds the budget. Null text or role: empty. Rows
    with a null conv_id form one conversation; turns order by turn (null first), then role and
    text, and repeated rows stay repeated turns. No turns: no windows. Rows of a conversation
    pass sorted through one task and are never gathered whole; a window is.
    """
    conv, order = Window.partitionBy("conv_id"), ["turn", "role", "text"]
    running = conv.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("_tokens", F.regexp_count("text", F.lit(NOT_SPACE)).cast("long") + 1)
    rows = rows.withColumns(
        {
            "_i": F.row_number().over(conv.orderBy(*order)),
            "_after": F.sum("_tokens").over(running),
        }
    )
    system = F.when((F.col("_i") == 1) & (F.col("role") == "system"), F.struct("role", "text", "_tokens"))
    rows = rows.withColumn("_system", F.first(system, ignorenulls=True).over(running))
    stride = F.greatest((F.lit(budget - history) - F.coalesce(F.col("_system._tokens"), F.lit(0))) / 2, F.lit(1.0))
    cell = F.floor((F.col("_after") - F.col("_tokens")) / stride)
    # the system turn opens the first span; empty cells behind a long turn leave no gap in the numbers
    opens = F.coalesce(F.lag("_cell").over(conv.orderBy("_i")) != F.col("_cell"), F.lit(True))
    rows = rows.withColumn("_cell", F.when(F.col("_i") == 1, 0).otherwise(cell)).withColumn("_opens", opens.cast("int"))
    rows = rows.withColumn("window", F.sum("_opens").over(conv.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    # where the span ends: what follows the turn up to there says whether the next window repeats it
    behind = conv.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.when(
        F.coalesce(F.lead("window").over(conv.orderBy("_i")) != F.col("window"), F.lit(False)), F.col("_after")
    )
    rows = rows.withColumn("_end", ends).withColumn("_end", F.first("_end", ignorenulls=True).over(behind))
    is_system = (F.col("_i") == 1) & F.col("_system").isNotNull()
    repeats = F.col("_end").isNotNull() & ~is_system & (F.col("_end") - F.col("_after") + F.col("_tokens") <= history)
    placed = rows.withColumn(
        "_at", F.explode(F.when(repeats, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("window", F.col("window") + F.col("_at"))
    # the system turn of later windows rides on their other turns
    grouped = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("_i", "role", "text", "_tokens", (F.col("_at") == 1).alias("rep")))).alias(
            "_turns"
        ),
        F.max("_system").alias("_system"),
    )
    again = F.struct(
        F.lit(0).alias("_i"),
        F.col("_system.role").alias("role"),
        F.col("_system.text").alias("text"),
        F.col("_system._tokens").alias("_tokens"),
        F.lit(True).alias("rep"),
    )
    shown = F.when(F.col("_system").isNotNull() & (F.col("window") > 1), F.concat(F.array(again), "_turns"))
    grouped = grouped.withColumn("_turns", F.coalesce(shown, F.col("_turns")))
    parts = grouped.withColumn(
        "_parts",
        F.transform(
            "_turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("head"),
                escape(t["text"]).alias("body"),
                ((t["role"] == "assistant") & ~t["rep"]).alias("loss"),
            ),
        ),
    )
    spans = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return parts.select(
        "conv_id",
        "window",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias(
            "formatted"
        ),
        F.size("_turns").alias("n_turns"),
        F.size(F.filter("_turns", lambda t: t["rep"])).alias("n_repeat"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + t["_tokens"]).alias("tokens"),
        spans.alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Each turn once, in order, from the formatted text: conv_id, window, new (role, text), loss (texts)."""
    pieces = F.split("formatted", CLOSE)
    own = F.slice(pieces, F.col("n_repeat") + 1, F.col("n_turns") - F.col("n_repeat"))
    cut = lambda p: F.instr(p, ROLE_END)
    return windows.select(
        "conv_id",
        "window",
        F.transform(
            own,
            lambda p: F.struct(
                unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"),
                unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text"),
            ),
        ).alias("new"),
        F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )


def digest_conversations(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: turn count and digests of turns and loss.

    The digests ask for a conversation's whole text, so unlike ``format_windows`` this gathers one conversation
    in a task, all rows without an id being one; it serves to check the windows.
    """
    read = read_turns(windows).select(
        "conv_id",
        "window",
        "chars",
        F.size("new").alias("n"),
        F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias(
            "said"
        ),
        F.array_join("loss", "").alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "</s>[INST] ok [/INST]"


@query("op10_chat_windows")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest_conversations(format_windows(turns.unionByName(probe)))
