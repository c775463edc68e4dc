"""Answer metrics, and answer views: lines of evidence scored, chosen and rendered; Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.temporal import is_inference_query, is_temporal_query
from memlake.functions.text import as_column, collapse, contains_any, extract_entities, let, query_tokens, semantic_references, strip

# Answers that abstain, categories of questions, and the tokens that a message and a prompt add.
ABSTENTIONS = ("", "unknown", "unanswerable", "not enough information", "insufficient information")
CATEGORIES = {"1": "multi_hop", "2": "temporal", "3": "open_domain", "4": "single_hop", "5": "adversarial"}
NON_ADVERSARIAL = ("1", "2", "3", "4")
MESSAGE_TOKENS, PRIMER_TOKENS = 4, 2


def estimate_tokens(c: Column | str) -> Column:
    n = F.length(F.coalesce(as_column(c), F.lit("")))
    return F.ceil(n / 4).cast("long")


def estimate_message_tokens(messages: Column | str) -> Column:
    """Of an array of (role, content)."""
    each = F.transform(as_column(messages), lambda m: MESSAGE_TOKENS + estimate_tokens(m["role"]) + estimate_tokens(m["content"]))
    return F.aggregate(each, F.lit(PRIMER_TOKENS).cast("long"), lambda a, x: a + x)


def answer_tokens(c: Column | str) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    bare = F.translate(F.lower(strip(F.coalesce(as_column(c), F.lit("")))), string.punctuation, "")
    return F.filter(F.split(collapse(bare), " "), lambda t: (t != "") & ~t.isin("a", "an", "the"))


def normalize_answer(c: Column | str) -> Column:
    return F.array_join(answer_tokens(c), " ")


def is_abstention(c: Column | str) -> Column:
    return normalize_answer(c).isin(*ABSTENTIONS)


def _overlap(g: Column, p: Column) -> Column:
    """Size of the multisets' intersection."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.transform(F.array_distinct(p), lambda t: F.least(count(g, t), count(p, t))), F.lit(0), lambda a, x: a + x)


def _void(gold, predicted):
    return (normalize_answer(gold) == "") & is_abstention(predicted)


def exact_match(gold: Column | str, predicted: Column | str) -> Column:
    return F.when(_void(gold, predicted) | (normalize_answer(gold) == normalize_answer(predicted)), 1.0).otherwise(0.0)


def f1(gold: Column | str, predicted: Column | str) -> Column:
    g, p = answer_tokens(gold), answer_tokens(predicted)
    o = _overlap(g, p)
    precision, recall = o / F.size(p), o / F.size(g)
    return F.when(_void(gold, predicted), 1.0).when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when((F.size(g) == 0) | (F.size(p) == 0), 0.0).when(o == 0, 0.0).otherwise(2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall))


def bleu1(gold: Column | str, predicted: Column | str) -> Column:
    g, p = answer_tokens(gold), answer_tokens(predicted)
    brevity = F.when(F.size(p) > F.size(g), 1.0).otherwise(F.exp(1 - F.size(g) / F.greatest(F.lit(1), F.size(p))))
    return F.when(_void(gold, predicted), 1.0).when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(_overlap(g, p) / F.size(p) * brevity)


def category_label(c: Column | str) -> Column:
    code = as_column(c).cast("string")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), code), code)


def category_codes(names) -> list[str]:
    """Codes of categories given by code or label."""
    by_label = {v: k for k, v in CATEGORIES.items()}
    return [by_label.get(str(n), str(n)) for n in names]


def dia_ids(spans: Column | str) -> Column:
    """Ordered distinct dialogue ids of spans: array of (dia_id, dia_ids)."""
    each = F.transform(as_column(spans), lambda s: F.concat(F.array(F.coalesce(s["dia_id"], F.lit(""))), F.coalesce(s["dia_ids"], F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.transform(F.flatten(each), strip), lambda x: x != ""))


def heuristic_answer(question: Column | str, spans: Column | str) -> Column:
    """Answers of three fixed families of questions from the spans' references, else null; spans: array of (surface, semantic_refs)."""
    low = F.lower(as_column(question))
    refs = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(as_column(spans), lambda s: F.concat(F.coalesce(s["semantic_refs"], F.array().cast("array<string>")), semantic_references(s["surface"])))), lambda x: F.lower(strip(x))), lambda x: x != ""))
    among = lambda *names: F.filter(refs, lambda x: x.isin(*names))
    arts, fields = among("kickboxing", "taekwondo", "karate", "judo", "kung fu"), among("psychology", "counseling certification")
    return (
        F.when(low.contains("martial arts") & (F.size(arts) > 0), F.array_join(arts, ", "))
        .when(contains_any(low, ["destress", "de-stress", "stress relief", "relax"]) & low.contains("both") & F.array_contains(refs, "dancing"), F.lit("by dancing"))
        .when(low.contains("fields") & low.contains("educat") & (F.size(fields) > 0), F.array_join(fields, ", "))
    )


def trim_text(c: Column | str, max_chars: int) -> Column:
    x = collapse(F.coalesce(as_column(c), F.lit("")))
    return F.when(F.length(x) <= max_chars, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, max_chars - 3)), F.lit("...")))


# What a line is scored by, the limits of each section, and the sections' names in the order they are rendered.
MONTH_NAMES = "january february march april may june july august september october november december".split()
INFERENCE_MARKERS = ("identity", "goal", "preference", "plan", "support", "career", "education", "study", "wants to")
SECTIONS = {"raw_evidence": "Direct Evidence", "facts": "Facts", "relations": "Relations", "page_summaries": "Context"}


def answer_line_score(question: Column | str, line: Column | str, section: str, temporal: Column, inference: Column) -> Column:
    """How well a line of evidence serves a question; question: a text, or a struct (entities, tokens) of one."""
    if isinstance(question, str):
        question = question_parts(question)
    text = F.coalesce(as_column(line), F.lit(""))
    low = F.lower(text)
    score = F.size(F.array_intersect(question["tokens"], query_tokens(text))) * 1.5
    named = let(extract_entities(text), lambda held: F.size(F.filter(question["entities"], lambda e: F.array_contains(held, e) | low.contains(e))))
    score = score + named * 2.5
    score = score + F.when(temporal, F.when(text.rlike(r"(?U)\b(19|20)\d{2}\b"), 2.0).otherwise(0.0) + F.when(contains_any(low, MONTH_NAMES), 1.5).otherwise(0.0) + F.when(text.contains("[") & text.contains("]"), 1.0).otherwise(0.0)).otherwise(0.0)
    bonus = {"facts": 1.5, "page_summaries": 1.0}.get(section, 0.0)
    score = score + F.when(inference, bonus + F.when(contains_any(low, INFERENCE_MARKERS), 1.0).otherwise(0.0)).otherwise(0.0)
    return score + (0.75 if section == "raw_evidence" else 0.0)


def question_parts(question: Column | str) -> Column:
    return F.struct(extract_entities(question).alias("entities"), query_tokens(question).alias("tokens"))


def unique_lines(lines: Column | str, limit: Column | int) -> Column:
    """Non-empty lines whose lower-cased text no earlier one has, the first `limit`: sorted by text, the first of equal ones kept, sorted back."""
    said = F.filter(as_column(lines), lambda x: x != "")
    keyed = F.array_sort(F.transform(said, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    before = lambda s: F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda e: e["low"]))
    first = let(keyed, lambda s: F.filter(F.zip_with(s, before(s), lambda e, low: F.when(e.isNotNull() & ~e["low"].eqNullSafe(low), F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e.isNotNull()))
    kept = F.transform(F.array_sort(first), lambda e: e["x"])
    return F.slice(kept, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))


def answer_lines(question: Column | str, lines: Column | str, section: str, limit: Column | int, max_chars: int) -> Column:
    """The best of an array of lines for a question, trimmed: by score, then place; distinct; the first `limit`."""
    temporal, inference = is_temporal_query(question), is_inference_query(question)

    def chosen(parts: Column) -> Column:
        trimmed = F.transform(as_column(lines), lambda x: trim_text(x, max_chars))
        scored = F.transform(trimmed, lambda x, i: F.struct((-answer_line_score(parts, x, section, temporal, inference)).alias("score"), i.alias("at"), x.alias("line")))
        return unique_lines(F.transform(F.array_sort(scored), lambda x: x["line"]), limit)

    return let(question_parts(question), chosen)


def answer_view(question: Column | str, pages: Column | str, facts: Column | str, spans: Column | str) -> Column:
    """Struct of sections, of pages (title, synopsis, summary), facts (strings) and spans (timestamp, speaker, text): a question's bounded evidence."""
    said = lambda c: F.nullif(c, F.lit(""))
    empty = F.array().cast("array<string>")
    page_lines = F.filter(F.transform(as_column(pages), lambda p: F.concat(F.coalesce(p["title"], F.lit("None")), F.lit(": "), F.coalesce(said(p["synopsis"]), said(p["summary"])))), lambda x: x.isNotNull())
    fact_lines = F.filter(as_column(facts), lambda x: x.isNotNull() & (strip(x) != ""))
    stamped = lambda x: F.concat(F.when(said(x["timestamp"]).isNotNull(), F.concat(F.lit("["), x["timestamp"], F.lit("] "))).otherwise(""), F.coalesce(x["speaker"], F.lit("None")), F.lit(": "), x["text"])
    span_lines = F.transform(F.filter(as_column(spans), lambda x: x["text"].isNotNull() & (strip(x["text"]) != "")), stamped)
    temporal, inference = is_temporal_query(question), is_inference_query(question)
    return F.struct(
        answer_lines(question, F.coalesce(page_lines, empty), "page_summaries", F.when(inference, 4).otherwise(3), 180).alias("page_summaries"),
        answer_lines(question, F.coalesce(fact_lines, empty), "facts", F.when(inference, 8).otherwise(6), 160).alias("facts"),
        answer_lines(question, F.coalesce(span_lines, empty), "raw_evidence", F.when(temporal, 8).otherwise(6), 200).alias("raw_evidence"),
        empty.alias("relations"),
    )


def render_view(question: Column | str, view: Column | str) -> Column:
    """An answer view as text, section by section; empty sections are left out."""
    view, none = as_column(view), F.array().cast("array<string>")

    def block(key: str, label: str) -> Column:
        lines = unique_lines(F.transform(view[key], lambda x: trim_text(x, 220)), 1_000)
        return let(lines, lambda a: F.when(F.size(a) > 0, F.concat(F.array(F.lit(f"[{label}]")), F.transform(a, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))).otherwise(none))

    body = F.concat(*(block(*kv) for kv in SECTIONS.items()))
    body = F.when(F.size(body) > 0, body).otherwise(F.array(F.lit("[Evidence]"), F.lit("- No relevant evidence.")))
    return strip(F.array_join(F.concat(F.array(F.concat(F.lit("Question: "), as_column(question)), F.lit(""), F.lit("Evidence:")), body), "\n"))
