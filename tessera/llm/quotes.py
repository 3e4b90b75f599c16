"""Conversations from messages that quote one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: A quote mark at the start of a line, as many as the level, with or without spaces between.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Most rounds of pointer doubling: chains of 2**40 replies.
ROUNDS = 40


def normalised(line: Column) -> Column:
    """Lower case for A to Z, white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\r\f\u000b]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines: an array of (level, body, hash) by line of the text, level 0 for the message's own words.

    Null texts have no lines. The hash is of the normalised body, null where that is empty.
    """
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        body = F.regexp_replace(x, MARKS, "")
        text = normalised(body)
        return F.struct(F.regexp_count(marks, F.lit(">")).alias("level"), body.alias("body"), F.when(text != "", F.md5(text.cast("binary"))).alias("hash"))

    return messages.withColumn("lines", F.when(F.col("text").isNotNull(), F.transform(F.split("text", "\n"), line)).otherwise(F.array().cast("array<struct<level:int,body:string,hash:string>>")))


def conversations(messages: DataFrame) -> DataFrame:
    """For each message: conv_id, turn, role, n_quoted, max_level, n_linked, reply_to, root, position, text without quotes.

    A quoted line links to the messages of the same conversation that have the line as their own words in an earlier
    turn. The reply goes to the earlier message that shares most quoted lines of the lowest level linked, then to the
    latest; without a link, to the latest turn before, and the first turn has no reply_to. root is the turn where a
    message's chain of replies starts; position counts the messages of a conversation by root and then by turn, so that
    replies come after what they answer and threads stay together.

    Only columns conv_id, turn, role and text are read. Rows without conv_id or turn are left out, as they are in no
    conversation; repeated (conv_id, turn) rows are one message, with the least role and text. A line counts for every
    earlier message that said it, and n_linked counts it once. The most often said of a message's quoted lines makes no
    list of pairs.
    """
    one = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    base = stored(parsed(one.select("conv_id", "turn", "m.role", "m.text")), "messages")
    line = base.where(F.contains(F.coalesce("text", F.lit("")), F.lit(">"))).select("conv_id", "turn", F.explode("lines").alias("x")).where("x.level > 0 AND x.hash IS NOT NULL")
    quoted = line.groupBy("conv_id", "turn", F.col("x.hash").alias("hash")).agg(F.min("x.level").alias("level"))
    wanted = quoted.select("conv_id", "hash").distinct()
    own = base.select("conv_id", "turn", F.explode("lines").alias("x")).where("x.level = 0 AND x.hash IS NOT NULL").select("conv_id", "turn", F.col("x.hash").alias("hash"))
    had = own.join(wanted, ["conv_id", "hash"], "left_semi").distinct().withColumn("said", F.lit(True))
    # each quoted line and the last turn before it that said the line: one running value over said and asked
    both = had.select("conv_id", "hash", "turn", F.lit(None).cast("int").alias("level"), F.lit(0).alias("asks")).unionByName(quoted.select("conv_id", "hash", "turn", "level", F.lit(1).alias("asks")))
    last = F.expr("max(CASE WHEN asks = 0 THEN turn END) OVER (PARTITION BY conv_id, hash ORDER BY turn, asks DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    linked = both.withColumn("source", last).where("asks = 1 AND source IS NOT NULL")
    # of the messages that share one line with the asking one, the last to say it is the best; one that shares more also
    # shares another line than the asking message's most often said, so that line makes no pairs
    often = had.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("often"))
    rank = F.expr("row_number() OVER (PARTITION BY conv_id, turn ORDER BY often DESC, hash)")
    rarer = quoted.join(often, ["conv_id", "hash"]).withColumn("rank", rank).where("rank > 1")
    said = had.select("conv_id", "hash", F.col("turn").alias("source"))
    pair = rarer.join(said, ["conv_id", "hash"]).where("source < turn").select("conv_id", "turn", "source")
    pair = pair.unionByName(linked.select("conv_id", "turn", "source")).distinct()
    votes = pair.join(quoted, ["conv_id", "turn"]).join(said, ["conv_id", "source", "hash"]).groupBy("conv_id", "turn", "source").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "source")).alias("b")).select("conv_id", "turn", F.col("b.source").alias("linked"))
    best = best.join(linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked")), ["conv_id", "turn"])
    previous = F.expr("lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)")
    clean = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    rows = base.select(
        "conv_id", "turn", "role", F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("max_level"), F.trim(F.regexp_replace(clean, r"\n{3,}", "\n\n"), F.lit("\n ")).alias("clean_text"), previous.alias("previous"),
    ).join(best, ["conv_id", "turn"], "left")
    rows = stored(rows.withColumn("reply_to", F.coalesce("linked", "previous")).drop("previous"), "replies")
    # threads: a linked reply to other than the previous turn opens no new root; roots come by pointer doubling
    up = rows.select("conv_id", "turn", F.when(F.col("linked").isNotNull() | (F.col("max_level") == 0), F.col("reply_to")).alias("to"))
    if rows.where("linked IS NOT NULL").isEmpty():
        roots = up.groupBy("conv_id").agg(F.min("turn").alias("root"))
        full = rows.join(roots, "conv_id") if rows.where("max_level > 0").isEmpty() else None
    else:
        full = None
    if full is None:
        now = stored(up.select("conv_id", "turn", F.coalesce("to", "turn").alias("root")), "roots")
        for _ in range(ROUNDS):
            far = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
            new = stored(now.join(far, ["conv_id", "root"]).select("conv_id", "turn", F.col("next").alias("root")), "roots")
            done = new.agg(F.sum("root")).first()[0] == now.agg(F.sum("root")).first()[0]
            now = new
            if done:
                break
        full = rows.join(now, ["conv_id", "turn"])
    position = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY root, turn)").cast("long")
    return full.select("conv_id", "turn", "role", "n_quoted", "max_level", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to", "root", position.alias("position"), "clean_text")
