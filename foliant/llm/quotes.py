"""Quotation linking for conversations, in DataFrame functions alone.

A line's quote level is the number of ``>`` it begins with (spaces between them allowed). Its normal form is what
follows, lower-cased, with white space as single spaces and none at the ends. A passage is a run of lines on one level without an
empty one between them; its normal form is that of its lines joined by spaces, so it does not depend on where lines
were wrapped. The hash of each quoted passage is joined to the passages and lines that earlier turns of its conversation have unquoted;
the latest such turn is the passage's source and that of all its lines. Lines of a passage without a source (a part
of what was said, or several parts) are looked for one by one in the same way. A message's parent is the source that most of its level-1 lines
have (the latest on ties). Messages without a linked quote start a thread.

Threads come from pointer jumps over the parents, each round a written table. ``(conv_id, thread_turn, turn)`` is a reply
order: a message always stands after the one it replies to. Texts are returned without their quoted lines and without the
blank lines at their ends. A hot line of a hot conversation is split by blocks of ``BLOCK`` turns: the look-back runs
inside each block, and the blocks pass on only their latest turn.

Null texts have no lines and stay null; rows with a null conversation or turn are returned and never linked; repeated
rows are each returned, with the same parent and counts. Very long texts are taken whole. Empty quotes (``>`` alone) are not counted. Extra columns are
not read. A conversation's messages with one turn number count as one original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 256
MARKS = r"^(?:[ \t]*>)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[ \t\r\f\x0B]+", " "))


def with_passages(messages: DataFrame) -> DataFrame:
    """Columns conv_id, turn, own, run, level, norms for each passage: a row a run of lines that are not empty."""
    lines = messages.select("conv_id", "turn", "own", F.transform(F.split("text", "\n"), lambda x: F.struct(level(x).alias("level"), normal(x).alias("norm"))).alias("lines"))
    line = lambda i: F.get(F.col("lines"), i)
    parts = lambda i: (line(i)["level"] != line(i - 1)["level"]) | (line(i)["norm"] == "") | (line(i - 1)["norm"] == "")
    starts = lines.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.when(i == 0, True).otherwise(parts(i))))
    runs = F.transform("starts", lambda s, j: F.slice(F.col("lines"), s + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size("lines")) - s))
    found = starts.select("conv_id", "turn", "own", F.posexplode(runs).alias("run", "lines"))
    return found.select("conv_id", "turn", "own", "run", F.col("lines")[0]["level"].alias("level"), F.transform("lines", lambda x: x["norm"]).alias("norms")).filter("norms[0] != ''")


def unquoted(text: Column) -> Column:
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: level(x) == 0), "\n")
    return F.regexp_replace(kept, r"\A(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+\z", "")


def linked_lines(messages: DataFrame) -> DataFrame:
    """Columns conv_id, turn, own, level, source for each distinct quoted line of a message, source null if it has none."""
    own = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    passages = written(with_passages(own).withColumn("hash", F.md5(F.array_join("norms", " "))), "passages")
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    of_messages = passages.filter("level > 0").dropDuplicates(["conv_id", "turn", "own", "run"])
    lines = of_messages.select("conv_id", "turn", "own", "run", "level", F.col("hash").alias("whole"), F.posexplode("norms").alias("at", "norm")).withColumn("part", F.md5("norm")).drop("norm")
    quoted = lines.select("conv_id", "turn", block, F.explode(F.array("whole", "part")).alias("hash")).distinct()
    # only what some quote of the conversation repeats goes on
    said = passages.filter("level = 0").select("conv_id", "turn", block, F.explode(F.array_union(F.array("hash"), F.transform("norms", lambda x: F.md5(x)))).alias("hash"))
    originals = said.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    both = quoted.select("conv_id", "turn", "hash", "block", F.lit(None).cast("bigint").alias("source")).unionByName(originals.select("conv_id", "turn", "hash", "block", F.col("turn").cast("bigint").alias("source")))
    before = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max("source").over(before)).filter("source is null").select("conv_id", "turn", "hash", "block", "near")
    blocks = both.groupBy("conv_id", "hash", "block").agg(F.max("source").alias("last"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "hash", "block", F.max("last").over(earlier).alias("far"))
    sources = inside.join(blocks, ["conv_id", "hash", "block"]).select("conv_id", "turn", "hash", F.coalesce("near", "far").alias("source"))
    by = [sources.select("conv_id", "turn", F.col("hash").alias(h), F.col("source").alias(f"of_{h}")) for h in ("whole", "part")]
    found = lines.join(by[0], ["conv_id", "turn", "whole"]).join(by[1], ["conv_id", "turn", "part"])
    return found.select("conv_id", "turn", "own", "level", F.coalesce("of_whole", "of_part").alias("source"))


def roots(parents: DataFrame) -> DataFrame:
    """Columns conv_id, turn, root, depth for each message with a parent, by pointer jumps."""
    now = written(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "replies")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        now_next = written(now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "replies")
        now = now_next.drop("moved")
        if now_next.filter("moved").isEmpty():
            return now


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns conv_id, turn, role, parent_turn, thread_turn, depth, max_level, n_quoted, n_linked, text for every message."""
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64("text"))
    lines = written(linked_lines(base), "quotes")
    counts = lines.groupBy("conv_id", "turn", "own").agg(F.max("level").alias("max_level"), F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"))
    votes = lines.filter("level = 1 and source is not null").groupBy("conv_id", "turn", "source").agg(F.count("*").alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("parent"))
    replies = written(parents, "parents")
    threads = roots(replies) if not replies.isEmpty() else replies.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(0).alias("depth"))
    out = base.join(counts, ["conv_id", "turn", "own"], "left").join(replies, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("parent").cast("bigint").alias("parent_turn"), F.coalesce(F.col("root"), F.col("turn")).cast("bigint").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("max_level", F.lit(0)).cast("bigint").alias("max_level"), F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), unquoted(F.col("text")).alias("text"))


def conversations(linked: DataFrame) -> DataFrame:
    """The messages in reply order."""
    return linked.orderBy("conv_id", "thread_turn", "turn")
