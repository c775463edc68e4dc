"""Anchors, groundings and temporal hints as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import as_column, collapse, contains_any, let, strip

MONTHS = "January February March April May June July August September October November December".split()
# The formats that a timestamp may have; others have no anchor.
FORMATS = ("h:m a 'on' d MMMM, y", "h:m a 'on' d MMMM y", "d MMMM, y", "d MMMM y", "MMMM d, y")
# Phrases of questions that ask for an inference, and relative expressions.
INFERENCE_PATTERNS = (
    "would ", "likely", "might ", "personality trait", "personality traits", "be considered", "financial status", "underlying condition", "what job", "what career",
    "what fields", "what state did", "what console", "what pets", "how many", "is it likely",
)
RELATIVE = ("yesterday", "today", "last year", "this year", "last month", "this month")


def parse_anchor(c: Column | str) -> Column:
    """A free-form timestamp as TIMESTAMP_NTZ, or null."""
    x = collapse(as_column(c))
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def temporal_grounding(text: Column | str, timestamp: Column | str) -> Column:
    """Struct of the anchor's date, month and year, and of what the text's first relative expression is grounded to."""
    low, day = F.lower(strip(F.coalesce(as_column(text), F.lit("")))), parse_anchor(timestamp).cast("date")

    def rule_of(x: Column) -> Column:
        has = lambda *m: contains_any(x["low"], m)
        return F.when(x["day"].isNull(), None).when(has("yesterday"), "y").when(has("today"), "t").when(has("last year"), "ly").when(has("this year"), "ty").when(has("last month"), "lm").when(has("this month"), "tm").otherwise("a")

    def grounded(x: Column) -> Column:
        day, rule = x["day"], x["rule"]
        date = F.when(rule == "y", F.date_sub(day, 1)).when(rule.isin("t", "a"), day)
        year = F.when(rule == "ly", F.year(day) - 1).when(rule == "ty", F.year(day))
        month = F.when(rule == "lm", F.add_months(F.trunc(day, "month"), -1)).when(rule == "tm", day)
        precision = F.when(rule.isin("y", "t"), "date").when(rule.isin("ly", "ty"), "year").when(rule.isin("lm", "tm"), "month").when(rule == "a", "anchor")
        return F.struct(
            F.date_format(day, "yyyy-MM-dd").alias("anchor_date"), F.date_format(day, "yyyy-MM").alias("anchor_month"), F.year(day).alias("anchor_year"),
            F.date_format(date, "yyyy-MM-dd").alias("grounded_date"), year.alias("grounded_year"), F.date_format(month, "yyyy-MM").alias("grounded_month"), precision.alias("precision"),
        )

    # The text, the day and the rule are computed once: each is read many times below.
    ruled = let(F.struct(low.alias("low"), day.alias("day")), lambda x: F.struct(x["day"].alias("day"), rule_of(x).alias("rule")))
    return let(ruled, grounded)


def format_grounded(g: Column | str) -> Column:
    """A grounding as year, "Month, year" or "day Month year"."""
    g = as_column(g)
    month_name = lambda n: F.get(F.array(*(F.lit(m) for m in MONTHS)), n.cast("int") - 1)
    d, m = g["grounded_date"], g["grounded_month"]
    return (
        F.when((g["precision"] == "year") & g["grounded_year"].isNotNull(), g["grounded_year"].cast("string"))
        .when((g["precision"] == "month") & m.isNotNull(), F.concat(month_name(F.substring(m, 6, 2)), F.lit(", "), F.substring(m, 1, 4)))
        .when(d.isNotNull(), F.concat_ws(" ", F.substring(d, 9, 2).cast("int").cast("string"), month_name(F.substring(d, 6, 2)), F.substring(d, 1, 4)))
    )


def is_temporal_query(c: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(as_column(c), F.lit(""))), ["when", "date", "day", "month", "year", "time"])


def is_inference_query(c: Column | str) -> Column:
    return contains_any(F.concat(F.lit(" "), F.lower(strip(F.coalesce(as_column(c), F.lit("")))), F.lit(" ")), INFERENCE_PATTERNS)


def temporal_hints(c: Column | str) -> Column:
    """Struct (year, month, day) of a question: first year; first month by the calendar that it names; a day beside that month's name."""
    low = F.lower(F.coalesce(as_column(c), F.lit("")))
    number = lambda x: F.when(x != "", x).cast("int")
    names = [m.lower() for m in MONTHS]
    pick = lambda of: reduce(lambda acc, i: F.when(low.rlike(rf"(?U)\b{names[i]}\b"), of(i)).otherwise(acc), reversed(range(12)), F.lit(None).cast("int"))
    day = lambda i: F.coalesce(number(F.regexp_extract(low, rf"(?U)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{names[i]}\b", 1)), number(F.regexp_extract(low, rf"(?U)\b{names[i]}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b", 1)))
    return F.struct(number(F.regexp_extract(low, r"(?U)\b(?:19|20)\d{2}\b", 0)).alias("year"), pick(lambda i: F.lit(i + 1)).alias("month"), pick(day).alias("day"))


def canonical_temporal_answer(question: Column | str, answer: Column | str, spans: Column | str) -> Column:
    """A relative answer to a temporal question replaced by the best span's grounded value; spans: array of (text, timestamp)."""
    stripped = strip(F.coalesce(as_column(answer), F.lit("")))
    low = F.lower(stripped)
    scored = F.transform(
        as_column(spans),
        lambda s, i: F.struct(
            sum((F.when(low.contains(m) & F.lower(F.coalesce(s["text"], F.lit(""))).contains(m), 4).otherwise(0) for m in ("yesterday", "last year", "this month", "today")), F.lit(0)).alias("hits"),
            temporal_grounding(s["text"], s["timestamp"]).alias("g"),
            (-i).alias("at"),
        ),
    )
    ranked = F.transform(scored, lambda s: F.struct((s["hits"] + F.when((s["hits"] == 0) & s["g"]["precision"].isin("date", "month", "year"), 1).otherwise(0)).alias("score"), s["at"].alias("at"), format_grounded(s["g"]).alias("value")))
    best = F.array_max(F.filter(ranked, lambda s: s["value"].isNotNull()))
    due = (stripped != "") & (F.upper(stripped) != "UNKNOWN") & is_temporal_query(question) & contains_any(low, RELATIVE)
    return F.when(due, F.coalesce(best["value"], as_column(answer))).otherwise(as_column(answer))
