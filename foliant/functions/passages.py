"""Citations and text windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, unwrap

#: What an answer says if its excerpts don't cover the question; evaluation compares the stripped answer with it.
NO_COVERAGE = "The retrieved excerpts don't cover this."
#: What a failed tool's text may hold.
ERROR_MARKERS = ("[retryable]", "[rephrase]", "[fatal]")
TOOL_ERROR = "Error executing tool"


def cited_numbers(text: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))))


def invented(numbers: Column, n_hits: Column) -> Column:
    return F.filter(numbers, lambda n: (n < 1) | (n > n_hits))


def resolved(numbers: Column, hits: Column) -> Column:
    """The hit that each valid number stands for, as (n, hit)."""
    return F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(hits))), lambda n: F.struct(n.alias("n"), F.element_at(hits, n).alias("hit")))


def refused(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == NO_COVERAGE


def longest_line(chunk: Column) -> Column:
    """The longest line after the first, the first such on ties; empty without one."""
    rest = F.slice(F.split(chunk, "\n"), F.lit(2), F.greatest(F.size(F.split(chunk, "\n")) - 1, F.lit(0)))
    return F.aggregate(rest, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def window(body: Column, chunk: Column, most: Column | int) -> Column:
    """Struct (body, window_start, window_end): up to ``most`` characters about the place of the chunk in the body."""
    most = F.lit(most) if isinstance(most, int) else most
    line = longest_line(chunk)
    n = F.length(body)
    mid = F.greatest(F.call_function("instr", body, line) - 1, F.lit(0)) + F.floor(F.length(line) / 2)
    end = F.least(n, F.greatest(F.lit(0), mid - F.floor(most / 2)) + most)
    start = F.greatest(F.lit(0), end - most)
    start, end = F.when(n <= most, F.lit(0)).otherwise(start).cast("int"), F.when(n <= most, n).otherwise(end).cast("int")
    return F.struct(F.substring(body, start + 1, end - start).alias("body"), start.alias("window_start"), end.alias("window_end"))


def is_failure(content: Column) -> Column:
    """A tool's text that carries no usable result."""
    body = unwrap(F.coalesce(content, F.lit("")), "<tool_result>\n", "\n</tool_result>")
    marked = body.contains(TOOL_ERROR)
    for m in ERROR_MARKERS:
        marked = marked | body.contains(m)
    return marked | F.coalesce(_truthy(F.get_json_object(body, "$.error_category")), F.lit(False))


def _truthy(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "null", "false", "0", "{}", "[]")


def error_category(content: Column) -> Column:
    """retryable, rephrase or fatal: the structured field, else the marker; null for a good result."""
    field = F.get_json_object(content, "$.error_category")
    by_marker = F.when(content.contains("[retryable]"), "retryable").when(content.contains("[rephrase]"), "rephrase").when(content.contains("[fatal]"), "fatal").when(content.contains(TOOL_ERROR), "rephrase")
    return F.coalesce(F.when(_truthy(field), field), by_marker)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def bad_arguments(arguments: Column) -> Column:
    """Whether a call's arguments are no JSON object; the caller is told to rephrase."""
    return F.coalesce(~F.ltrim(arguments).startswith("{"), F.lit(True)) | F.try_parse_json(arguments).isNull()
