"""Agent runs as tables: transcripts, budgets, stop reasons, tool tallies, grounding and run reports.

A transcript is a table of messages (run, seq, role, content, tool_calls array<struct<id,name>>, tool_call_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passages, urls
from ..functions.text import unwrap
from ..schemas import FAILED_REASONS
from .common import small

SEARCH_TOOL, FETCH_TOOL = "rag_search", "fetch_section"
#: What an agent says without a source; a reply that holds it is a refusal here.
NO_COVERAGE_PHRASE = "don't cover"


def turn_pairs(messages: DataFrame, run: str = "conv_id", seq: str = "turn") -> DataFrame:
    """Each user message with the assistant's next one: columns run, turn_no, question, answer."""
    following = Window.partitionBy(run).orderBy(seq)
    own = messages.filter(F.col("role").isin("user", "assistant")).withColumns({"__next_role": F.lead("role").over(following), "answer": F.lead("text").over(following)})
    pairs = own.filter("role = 'user' AND __next_role = 'assistant'")
    return pairs.select(run, F.row_number().over(Window.partitionBy(run).orderBy(seq)).alias("turn_no"), F.col("text").alias("question"), "answer")


def history(pairs: DataFrame, run: str = "conv_id", last: int = 10, most: int = 4000, marker: str = " […]") -> DataFrame:
    """The last answered turns of each conversation; an answer is cut to ``most`` characters, the marker included."""
    answered = pairs.filter(F.coalesce(F.trim("answer"), F.lit("")) != "")
    recent = answered.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("turn_no")))).filter(F.col("__n") <= last).drop("__n")
    return recent.withColumn("answer", F.when(F.length("answer") > most, F.concat(F.left("answer", F.lit(most - len(marker))), F.lit(marker))).otherwise(F.col("answer")))


def replay(pairs: DataFrame, questions: DataFrame, system: str, run: str = "conv_id") -> DataFrame:
    """The messages a model is sent: the system's, the history's pairs, the question; an array of (role, content) a run."""
    each = F.struct("turn_no", "question", "answer")
    past = pairs.groupBy(run).agg(F.array_sort(F.collect_list(each)).alias("past"))  # a history is bounded
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = F.flatten(F.transform(F.coalesce("past", F.array().cast("array<struct<turn_no:int,question:string,answer:string>>")), lambda p: F.array(said("user", p["question"]), said("assistant", p["answer"]))))
    return questions.join(past, run, "left").select(run, F.concat(F.array(said("system", F.lit(system))), turns, F.array(said("user", F.col("question")))).alias("messages"))


def running_tokens(messages: DataFrame, run: str, seq: str, text: str, budget: int = 4000) -> DataFrame:
    """With tokens, used (so far in the run) and over_budget."""
    so_far = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = messages.withColumn("tokens", passages.token_estimate(F.col(text)))
    return own.withColumn("used", F.sum("tokens").over(so_far)).withColumn("over_budget", F.col("used") > budget)


def stop_reason(n_fatal: Column, n_unavailable: Column, seconds: Column, used: Column, hops: Column, wall_clock: float = 120.0, budget: int = 4000, max_iterations: int = 8) -> Column:
    """Why a run ended, from its totals."""
    return F.when(n_fatal > 0, "fatal_tool_error").when(n_unavailable > 0, "llm_unavailable").when(seconds > wall_clock, "wall_clock").when(used > budget, "context_budget").when(hops >= max_iterations, "max_iters").otherwise("answer")


def failed(reason: Column) -> Column:
    """Whether a run's end counts as a failure (exit code 1)."""
    return reason.isin(*FAILED_REASONS)


def tool_turns(transcript: DataFrame) -> DataFrame:
    return transcript.filter("role = 'tool'").withColumn("content", unwrap(F.coalesce("content", F.lit("")), "<tool_result>\n", "\n</tool_result>"))


def tool_tokens(transcript: DataFrame) -> DataFrame:
    return tool_turns(transcript).groupBy("run").agg(F.sum(passages.token_estimate(F.col("content"))).alias("tool_tokens"))


def tool_tally(transcript: DataFrame) -> DataFrame:
    """Columns run, tool, called, failed. A call without a result is not a failure; a result of an unknown call is ``unknown``."""
    calls = transcript.select("run", F.explode("tool_calls").alias("c")).select("run", F.col("c.id").alias("tool_call_id"), F.col("c.name").alias("tool"))
    bad = tool_turns(transcript).filter(passages.is_failure(F.col("content"))).select("run", "tool_call_id")
    # a call id names the tool of its last call
    names = calls.groupBy("run", "tool_call_id").agg(F.max("tool").alias("tool"))
    failures = bad.join(names, ["run", "tool_call_id"], "left").select("run", F.coalesce("tool", F.lit("unknown")).alias("tool"))
    both = calls.select("run", "tool", F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(failures.select("run", "tool", F.lit(0).alias("c"), F.lit(1).alias("f")))
    return both.groupBy("run", "tool").agg(F.sum("c").alias("called"), F.sum("f").alias("failed"))


def grounding(answers: DataFrame, transcript: DataFrame) -> DataFrame:
    """Columns run, citations (distinct URLs of the answer) and ungrounded (sorted URLs that no tool returned)."""
    cited = answers.select("run", F.explode(urls.found_urls(F.col("text"))).alias("url"))
    returned = tool_turns(transcript).select("run", F.explode(urls.found_urls(F.col("content"))).alias("url")).distinct().withColumn("ok", F.lit(True))
    own = cited.join(returned, ["run", "url"], "left").groupBy("run").agg(F.count("*").alias("citations"), F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("url")))).alias("ungrounded"))
    none = F.array().cast("array<string>")
    return answers.select("run").join(own, "run", "left").select("run", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("ungrounded", none).alias("ungrounded"))


def expected_hit(answer: Column, expected: Column) -> Column:
    """Whether the answer cites an expected page; null if there is none."""
    pages = F.transform(urls.found_urls(answer), urls.page_form)
    return F.when(F.size(expected) > 0, F.arrays_overlap(F.transform(expected, urls.page_form), pages))


def no_coverage(answer: Column) -> Column:
    return F.contains(F.coalesce(answer, F.lit("")), F.lit(NO_COVERAGE_PHRASE))


#: Relative rank error of the sketches that bracket a percentile, as a divisor.
SKETCH = 10_000


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank (element min(n - 1, floor(f n)) of the sorted values), null values left out. Exact.

    A mergeable sketch brackets each percentile; what lies below a bracket is counted, and only the few values inside it are
    put in order, equal ones as one row. So no task orders a key's values, however many they are.
    """
    own = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = [min(1.0, max(0.0, f + d)) for f in fractions.values() for d in (-3 / SKETCH, 3 / SKETCH)]
    sketches = own.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, SKETCH).alias("ends"))
    place = lambda f: F.least(F.col("n") - 1, F.floor(F.lit(f) * F.col("n")))
    points = F.array(*[F.struct(F.lit(name).alias("point"), place(f).alias("at"), F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high")) for i, (name, f) in enumerate(fractions.items())])
    brackets = sketches.select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)], F.explode(points).alias("p"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(keys)]
    inside = F.when(F.col("v") >= F.col("p.low"), F.col("v")).alias("inside")  # null: below
    counts = own.join(small(brackets), [*same, F.col("v") <= F.col("p.high")]).groupBy(*keys, "p.point", "p.at", inside).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "point").orderBy(F.asc_nulls_first("inside"))))
    found = upto.filter(F.col("upto") > F.col("at"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("point") == name, F.col("inside"))).alias(name) for name in fractions])


def rate(part: Column, whole: Column) -> Column:
    """Share, null of nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def quality_columns() -> list[Column]:
    """Per-run rates; cited over labelled runs alone."""
    share = lambda c: F.avg(c.cast("double"))
    return [F.count("*").alias("n"), share(F.col("n_calls") > 0).alias("searched"), F.avg(F.col("expected_hit").cast("double")).alias("cited"), share(F.col("no_coverage")).alias("refused"), share(F.size("ungrounded") > 0).alias("fabricated")]


def loop_columns() -> list[Column]:
    return [F.count("*").alias("n"), F.avg("hops").alias("hops"), F.avg("seconds").alias("seconds"), *[F.sum(c).alias(c) for c in ("searches", "searches_failed", "fetches", "fetches_failed")]]


def report(runs: DataFrame, columns: list[Column]) -> DataFrame:
    """Overall, by type (``untyped`` where null) and by question."""
    from .metrics import grouped

    return grouped(runs, {"type": F.coalesce("type", F.lit("untyped")), "question": F.col("question")}, columns)


def repeats(questions: DataFrame, n: int = 3) -> DataFrame:
    """Each question n times, with ``repeat`` from 0."""
    return questions.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(n)])))


def final_messages(transcript: DataFrame) -> DataFrame:
    """The last message of each run."""
    return transcript.groupBy("run").agg(F.max_by(F.struct("seq", "role", "content"), "seq").alias("m")).select("run", "m.*")
