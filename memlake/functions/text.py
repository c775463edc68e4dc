"""Text functions as Column expressions: normalisers, entities, references, summaries, token sets. Two are pandas UDFs: first_json_object and fuzzy_similarity."""

from __future__ import annotations

import json
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()

# Word lists that results depend on, one for each normaliser.
ENTITY_STOPWORDS = "the a an of in on for and or to by at from with without into over under after before".split()
KEYWORD_STOPWORDS = "the a an is are was were be to of and or in on for with this that it we i you they he she as at by from our your their his her".split()
NOISE_WORDS = (
    "what when where which who whom whose why how did does do is are was were can could would should may january february march april june july august "
    "september october november december hey hi hello thanks thank wow cool great awesome okay ok yeah yep yup aww woah whoa"
).split()
QUERY_STOPWORDS = (
    "a an the what when where which who whom whose why how did does do is are was were can could would should has have had get got take took went go gone "
    "kind type types sort major main just both common many"
).split()
QUERY_ALIASES = {
    "roadtrip": ["roadtrip", "road trip", "trip", "travel"],
    "roadtrips": ["roadtrip", "road trip", "trip", "trips", "travel"],
    "accomplish": ["accomplish", "accomplished", "achievement", "finish", "finished", "complete", "completed", "print", "printed"],
    "accomplished": ["accomplish", "accomplished", "achievement", "finish", "finished", "complete", "completed", "print", "printed"],
    "achievement": ["achievement", "accomplish", "accomplished", "finish", "finished", "complete", "completed", "print", "printed"],
}
# Fixed values: (concept, its aliases, (phrase, reference) pairs in order).
CONCEPTS = (
    ("martial arts", ("martial arts", "combat sport", "fighting style"), (("kickboxing", "kickboxing"), ("taekwondo", "taekwondo"), ("karate", "karate"), ("judo", "judo"), ("kung fu", "kung fu"))),
    (
        "stress relief",
        ("destress", "de-stress", "stress relief", "relax", "unwind", "escape"),
        (("dance", "dancing"), ("dancing", "dancing"), ("run", "running"), ("running", "running"), ("read", "reading"), ("reading", "reading"), ("paint", "painting"), ("painting", "painting"), ("violin", "playing violin")),
    ),
    (
        "mental health career",
        ("mental health", "counseling", "counselling", "counselor", "counsellor", "psychology"),
        (("mental health", "psychology"), ("psychology", "psychology"), ("counseling", "counseling certification"), ("counselling", "counseling certification"), ("counselor", "counseling certification"), ("counsellor", "counseling certification")),
    ),
)


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: lambdas otherwise compute what they refer to for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(as_column(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Non-empty pieces between single spaces."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def contains_any(c: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(m) for m in markers))


def normalize_text(c: Column | str) -> Column:
    x = F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" "))
    x = F.regexp_replace(x, r"\([^)]*\)", " ")
    return collapse(F.regexp_replace(x, r"(?U)[^a-z0-9\s-]", " "))


def canonicalize_entity(c: Column | str) -> Column:
    return F.array_join(F.filter(tokens(normalize_text(c)), lambda x: ~x.isin(ENTITY_STOPWORDS)), " ")


def canonicalize_entities(c: Column | str, limit: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(as_column(c), canonicalize_entity), lambda x: x != "")), 1, limit)


def distinct_canonical(c: Column, limit: int) -> Column:
    """canonicalize_entities() of elements that are canonical already, as entities and references are: the function changes no value that it gave."""
    return F.slice(F.array_distinct(F.filter(c, lambda x: x != "")), 1, limit)


def repeated(c: Column) -> Column:
    """Distinct elements that occur at least twice, in order of first occurrence; by a sort and a hash lookup, so long arrays stay cheap."""
    again = lambda k: let(F.sort_array(k), lambda o: F.filter(F.zip_with(o, F.slice(o, 2, F.size(o)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    return let(c, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), words_array([])).otherwise(F.array_intersect(k, again(k))))


def _is_noise(canonical: Column) -> Column:
    parts = F.filter(F.split(canonical, r"[^a-z0-9]+"), lambda x: x != "")
    return F.forall(parts, lambda x: x.isin(sorted({*NOISE_WORDS, *KEYWORD_STOPWORDS})))


def extract_entities(c: Column | str, limit: int = 8) -> Column:
    """Quoted strings, capitalised phrases, capitalised tokens outside phrases, and repeated keywords, canonical, distinct, the first `limit`."""
    return let(as_column(c), lambda text: _entities(text, limit))


def _entities(text: Column, limit: int) -> Column:
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]{2,80})"'), 1), strip)
    phrases = _found(text, r"\b(?:[A-Z][a-zA-Z0-9_-]{1,}(?:\s+[A-Z][a-zA-Z0-9_-]{1,}){1,3})\b")
    single = F.transform(_found(text, r"\b[A-Z][a-zA-Z0-9_-]{2,}\b"), _canonical_word)
    keywords = F.filter(let(F.lower(text), lambda low: _found(low, r"\b[a-zA-Z][a-zA-Z0-9_-]{3,}\b")), lambda k: ~k.isin(KEYWORD_STOPWORDS))

    def joined(p: Column) -> Column:
        in_phrases = F.flatten(F.transform(p, lambda x: tokens(canonicalize_entity(x))))
        capitalised = let(in_phrases, lambda held: F.when(F.size(held) == 0, single).otherwise(F.filter(single, lambda t: ~F.array_contains(held, t))))
        return F.concat(F.transform(F.concat(quoted, p), canonicalize_entity), capitalised, F.transform(repeated(keywords), _canonical_word))

    return F.slice(F.filter(F.array_distinct(let(phrases, joined)), lambda x: (x != "") & ~_is_noise(x)), 1, limit)


def _found(text: Column, pattern: str) -> Column:
    """All matches by the classes of Unicode, which are those of ASCII in a text of ASCII alone and take twice the time."""
    return F.when(F.octet_length(text) == F.length(text), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), 0))


def _canonical_word(word: Column) -> Column:
    """canonicalize_entity() of a word of ASCII letters, digits, - and _."""
    return F.array_join(F.filter(F.split(F.replace(F.lower(word), F.lit("_"), F.lit(" ")), " "), lambda x: (x != "") & ~x.isin(ENTITY_STOPWORDS)), " ")


def semantic_references(c: Column | str, limit: int = 10) -> Column:
    """References of the concepts whose phrases stand in the text between spaces: each concept's items first, then the concept."""
    return let(F.concat(F.lit(" "), F.lower(F.coalesce(as_column(c), F.lit(""))), F.lit(" ")), lambda padded: _references(padded, limit))


def _references(padded: Column, limit: int) -> Column:
    out = []
    for concept, aliases, items in CONCEPTS:
        out += [F.when(padded.contains(f" {phrase} "), F.lit(reference)) for phrase, reference in items]
        out.append(F.when(contains_any(padded, [f" {p} " for p in [*aliases, *(i for i, _ in items)]]), F.lit(concept)))
    return F.slice(F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull())), 1, limit)


def memory_references(texts: Column | str, limit: int = 12) -> Column:
    """Over texts in order: entities and references of each, canonical, distinct, the first `limit`."""
    each = F.transform(as_column(texts), lambda t: F.concat(extract_entities(t), semantic_references(t)))
    return distinct_canonical(F.flatten(each), limit)


# The markers of kinds and of statuses, below.


def memory_kind(atom_type: Column | str, content: Column | str) -> Column:
    kind, text = F.lower(strip(F.coalesce(as_column(atom_type), F.lit("")))), F.lower(F.coalesce(as_column(content), F.lit("")))
    return (
        F.when(kind == "preference", "preference")
        .when(kind.isin("goal", "decision", "open_loop"), "plan")
        .when(kind == "relation", "relation")
        .when(kind.isin("profile", "identity", "state"), "state")
        .when(contains_any(text, ["prefer", "favorite", "dislike", "love ", "hate "]), "preference")
        .when(contains_any(text, ["work as", "job", "works at", "live in", "lives in", "located in", "married", "dating"]), "state")
        .when(contains_any(text, ["plan", "goal", "want to", "need to", "will ", "should ", "must "]), "plan")
        .when(contains_any(text, ["because", "therefore", "related to", "with ", "between "]), "relation")
        .otherwise("event")
    )


def atom_status(content: Column | str) -> Column:
    text = F.lower(F.coalesce(as_column(content), F.lit("")))
    return (
        F.when(contains_any(text, ["maybe", "might", "possibly", "unclear", "unsure"]), "uncertain")
        .when(contains_any(text, ["no longer", "used to", "previously", "formerly", "replaced", "instead of", "changed from", "stopped"]), "superseded")
        .otherwise("active")
    )


def summarize_texts(texts: Column | str, max_chars: int = 480) -> Column:
    """Non-blank texts joined by single spaces; cut to max_chars with an ellipsis."""
    joined = collapse(F.array_join(F.filter(F.transform(as_column(texts), strip), lambda x: x != ""), " "))
    cut = lambda x: F.concat(F.regexp_replace(F.substring(x, 1, max_chars - 3), r"\s+$", ""), F.lit("..."))
    return let(joined, lambda x: F.when(F.length(x) <= max_chars, x).otherwise(cut(x)))


def synopsis(texts: Column | str, max_chars: int = 180) -> Column:
    return summarize_texts(texts, max_chars)


def evidence_preview(texts: Column | str, limit: int = 3, max_chars: int = 180) -> Column:
    each = F.transform(as_column(texts), lambda t: summarize_texts(F.array(t), max_chars))
    return F.slice(F.array_distinct(F.filter(each, lambda x: x != "")), 1, limit)


def normalize_value(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(F.coalesce(as_column(c), F.lit(""))), r"(?U)[^a-z0-9\s]+", " "))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_value(c), " "), lambda t: F.length(t) > 1))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of token sets; 0 where either is empty."""
    share = lambda p: F.when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"])))
    return let(F.struct(token_set(a).alias("x"), token_set(b).alias("y")), share)


def query_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(collapse(F.regexp_replace(F.lower(as_column(c)), r"(?U)[^a-z0-9\s]", " ")), " "), lambda t: F.length(t) > 2))


def query_terms(c: Column | str) -> Column:
    """Terms of a question or text: entities, references and tokens, with joined, singular and alias forms; sorted, distinct."""
    # All three are in lower case and without spaces at their ends.
    raw = let(as_column(c), lambda text: F.concat(_entities(text, 8), semantic_references(text), query_tokens(text)))
    base = F.filter(raw, lambda x: (x != "") & ~x.isin(QUERY_STOPWORDS))
    alias = F.create_map(*(y for k, v in QUERY_ALIASES.items() for y in (F.lit(k), words_array(v))))
    none = words_array([])
    forms = F.transform(
        base,
        lambda x: F.concat(
            F.array(x, F.replace(x, F.lit(" "), F.lit(""))),
            F.when(x.endswith("s") & (F.length(x) > 4), F.array(F.substring(x, F.lit(1), F.length(x) - 1))).otherwise(none),
            F.coalesce(F.try_element_at(alias, x), none),
            F.coalesce(F.try_element_at(alias, F.replace(x, F.lit(" "), F.lit(""))), none),
        ),
    )
    return F.sort_array(F.array_distinct(F.filter(F.flatten(forms), lambda x: x != "")))


def term_overlap(query: Column, terms: Column) -> Column:
    """Share of the query's terms among terms; 0 where either is empty."""
    return F.when((F.size(query) == 0) | (F.size(terms) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, terms)) / F.size(query))


def sanitize_id(c: Column | str, default: str = "sample") -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(as_column(c), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(default)).otherwise(x)


def aliases(c: Column | str) -> Column:
    """Normal form, canonical form, last word, first two words and compact form, sorted."""
    canonical = canonicalize_entity(c)
    w = tokens(canonical)
    extra = F.when(F.size(w) >= 2, F.array(F.try_element_at(w, F.lit(-1)), F.array_join(F.slice(w, 1, 2), " "))).otherwise(words_array([]))
    every = F.concat(F.array(normalize_text(c), canonical), extra, F.array(F.replace(canonical, F.lit(" "), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))


def entity_overlap(a: Column | str, b: Column | str) -> Column:
    """1 for equal canonical forms, 0.85 where one is an alias of the other, else shared tokens over the longer's tokens."""
    x, y = canonicalize_entity(a), canonicalize_entity(b)
    tx, ty = F.array_distinct(tokens(x)), F.array_distinct(tokens(y))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.array_contains(aliases(b), x) | F.array_contains(aliases(a), y), 0.85)
        .otherwise(F.size(F.array_intersect(tx, ty)) / F.greatest(F.size(tx), F.size(ty)))
    )


def surface_text(speaker: Column | str, text: Column | str, caption: Column | str | None = None) -> Column:
    first = F.concat(as_column(speaker), F.lit(": "), strip(text))
    if caption is None:
        return first
    image = strip(F.coalesce(as_column(caption), F.lit("")))
    return F.when(image == "", first).otherwise(F.concat(first, F.lit("\nImage: "), image))


def _first_object(text: str | None) -> str | None:
    """From each brace in turn one pass of a parser, which stops at the object's own end or at the first fault."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            _, end = _DECODER.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
        else:
            return text[at:end]
    return None


def first_json_object(c: Column | str) -> Column:
    """The first JSON object that a text holds, from the first brace at which one parses, as text; else null. In Python, by Arrow batches: no built-in function tells where an object ends."""
    return F.pandas_udf(lambda texts: texts.map(_first_object), "string")(as_column(c))


def fuzzy_similarity():
    """A Column function (left, right): the larger matching ratio of canonical forms, as they are and with sorted words; 0 below four characters."""

    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if min(len(a), len(b)) < 4:
            return 0.0
        return max(SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (" ".join(sorted(a.split())), " ".join(sorted(b.split())))))

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=float)

    ratio = F.pandas_udf(run, "double")
    return lambda a, b: ratio(canonicalize_entity(a), canonicalize_entity(b))
