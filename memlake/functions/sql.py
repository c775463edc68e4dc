"""The library's functions in SQL: temporary functions whose bodies are the Columns' own expressions, so nothing runs in Python.

register() makes scalar functions (mem_normalize_text and so on); register_store() makes views of a store's tables and table
functions over them. Catalyst inlines a body where it is called, so a call has the plan that the Column would have.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from memlake.functions import answers as A
from memlake.functions import temporal as TM
from memlake.functions import text as T
from memlake.functions import vectors as V
from memlake.functions.ids import stable_id

PREFIX = "mem_"
_STRING, _STRINGS, _VECTOR = "STRING", "ARRAY<STRING>", "ARRAY<DOUBLE>"

#: Name, arguments, and the Column function that makes the body from them.
FUNCTIONS: dict[str, tuple[list[tuple[str, str]], Callable[..., Column]]] = {
    "normalize_text": ([("t", _STRING)], T.normalize_text),
    "canonical_entity": ([("t", _STRING)], T.canonicalize_entity),
    "canonical_entities": ([("a", _STRINGS)], T.canonicalize_entities),
    "entities": ([("t", _STRING)], T.extract_entities),
    "semantic_references": ([("t", _STRING)], T.semantic_references),
    "memory_references": ([("a", _STRINGS)], T.memory_references),
    "memory_kind": ([("atom_type", _STRING), ("t", _STRING)], T.memory_kind),
    "atom_status": ([("t", _STRING)], T.atom_status),
    "summary": ([("a", _STRINGS)], T.summarize_texts),
    "normalize_value": ([("t", _STRING)], T.normalize_value),
    "token_overlap": ([("a", _STRING), ("b", _STRING)], T.token_overlap),
    "query_tokens": ([("t", _STRING)], T.query_tokens),
    "query_terms": ([("t", _STRING)], T.query_terms),
    "term_overlap": ([("q", _STRINGS), ("terms", _STRINGS)], lambda q, t: T.term_overlap(F.col(q), F.col(t))),
    "sanitize_id": ([("t", _STRING)], T.sanitize_id),
    "aliases": ([("t", _STRING)], T.aliases),
    "entity_overlap": ([("a", _STRING), ("b", _STRING)], T.entity_overlap),
    "anchor": ([("t", _STRING)], TM.parse_anchor),
    "grounding": ([("t", _STRING), ("said_at", _STRING)], TM.temporal_grounding),
    "temporal_hints": ([("t", _STRING)], TM.temporal_hints),
    "is_temporal_query": ([("t", _STRING)], TM.is_temporal_query),
    "is_inference_query": ([("t", _STRING)], TM.is_inference_query),
    "estimate_tokens": ([("t", _STRING)], A.estimate_tokens),
    "normalize_answer": ([("t", _STRING)], A.normalize_answer),
    "is_abstention": ([("t", _STRING)], A.is_abstention),
    "exact_match": ([("gold", _STRING), ("predicted", _STRING)], A.exact_match),
    "f1": ([("gold", _STRING), ("predicted", _STRING)], A.f1),
    "bleu1": ([("gold", _STRING), ("predicted", _STRING)], A.bleu1),
    "category_label": ([("code", _STRING)], A.category_label),
    "cosine": ([("a", _VECTOR), ("b", _VECTOR)], V.cosine),
    "event_id": ([("corpus", _STRING), ("session", _STRING), ("turn", "BIGINT"), ("speaker", _STRING), ("t", _STRING)], lambda *parts: stable_id("evt", *parts)),
}

#: Names of operators and of functions that SQL reads as keywords; in a Column's text they stand before their arguments.
_NAMES = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`.])((?:in|and|or|not|struct|array|map|date|when|if)(?=\()|[=!<>|&+*/%^~-]+(?=\())|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")


def text_of(column: Column) -> str:
    """A Column's expression as SQL: operators, which stand as functions, become quoted names, and doubles are told from decimals."""
    quote = lambda m: m[1] or (m[3] and m[3] + "D") or (m[2] if m[2] in ("struct", "array", "map", "date", "if") else f"`{m[2]}`")
    return _NAMES.sub(quote, column._jc.node().sql())


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Make the scalar functions; their names."""
    for name, (arguments, body) in FUNCTIONS.items():
        listed = ", ".join(f"{a} {kind}" for a, kind in arguments)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({listed}) RETURN {text_of(body(*(a for a, _ in arguments)))}")
    return [prefix + n for n in FUNCTIONS]


def register_store(store, prefix: str = PREFIX) -> list[str]:
    """Make views of a store's current tables, and table functions over them; their names. Views show the version at which they were made."""
    spark = store.spark
    views = {n: store.view(n) for n in ("objects", "versions", "links", "sessions", "entities", "root")} | {n: store.table(n) for n in ("events", "atoms", "actions")}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    tables = {
        "state_of(who STRING) RETURNS TABLE (slot STRING, value STRING, valid_from STRING, version_id STRING)": "SELECT o.slot, v.value, v.valid_from, v.version_id FROM {p}objects o JOIN {p}versions v ON v.version_id = o.latest_version_id WHERE o.subject = who AND v.status = 'active'",
        "history_of(who STRING) RETURNS TABLE (slot STRING, value STRING, operation STRING, valid_from STRING, valid_to STRING)": "SELECT o.slot, v.value, v.operation, v.valid_from, v.valid_to FROM {p}objects o JOIN {p}versions v ON v.object_id = o.object_id WHERE o.subject = who",
        "events_of(session STRING) RETURNS TABLE (turn_index BIGINT, speaker STRING, text STRING, event_id STRING)": "SELECT turn_index, speaker, text, event_id FROM {p}events WHERE session_id = session",
    }
    for head, body in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body.format(p=prefix)}")
    return [prefix + n for n in [*views, *(h.split("(")[0] for h in tables)]]
