"""Turns to events, events to atoms, atoms to state candidates: expressions over rows, without shuffles but one for turn numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.ids import stable_id
from memlake.functions.temporal import temporal_grounding

#: References of one text that may enter a snapshot's.
LINE_REFS = 18
SINGLETON_SLOTS = ("location", "employer", "occupation", "relationship_status", "home_city")


def assign_turn_index(turns: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """turn_index continues from last(corpus_id, session_id, next_index) in the order of seq."""
    w = Window.partitionBy("corpus_id", "session_id").orderBy("seq")
    rows = turns.withColumn("turn_index", F.row_number().over(w).cast("long") - 1)
    if last is None:
        return rows
    rows = rows.join(last, ["corpus_id", "session_id"], "left")
    return rows.withColumn("turn_index", F.col("turn_index") + F.coalesce("next_index", F.lit(0))).drop("next_index")


def events(turns: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """An event for each turn: ids, references, grounding, and line_refs, the references of its line in a snapshot. Turns that have a turn_index keep it."""
    caption = F.get_json_object("metadata", "$.blip_caption")
    numbered = turns if "turn_index" in turns.columns else assign_turn_index(turns, last)
    rows = numbered.withColumns({"caption": T.strip(F.coalesce(caption, F.lit(""))), "surface": T.surface_text("speaker", "text", caption)})
    parts = ("corpus_id", "session_id", "turn_index", "speaker", "text")
    rows = rows.withColumns({"semantic_refs": T.semantic_references("surface"), "text_entities": T.extract_entities("text"), "temporal_grounding": temporal_grounding("surface", "timestamp")})
    refs = F.concat("text_entities", "semantic_refs")
    return rows.withColumns({"event_id": stable_id("evt", *parts), "raw_span_id": stable_id("raw", *parts), "entity_refs": F.slice(F.array_distinct(refs), 1, 12), "canonical_entity_refs": T.distinct_canonical(refs, 8), "line_refs": T.memory_references(F.array(F.concat_ws(": ", "speaker", "text")), LINE_REFS)})


# Families of atoms, their confidence and markers.
_MARKED = (
    ("preference", 0.7, ("prefer", "like", "favorite", "favour", "dislike")),
    ("decision", 0.7, ("decide", "decision", "choose", "selected", "we will", "i will")),
    ("goal", 0.6, ("need to", "want to", "goal", "plan to", "should", "must")),
    ("open_loop", 0.6, ("todo", "follow up", "pending", "open question", "?")),
    ("error_fix", 0.7, ("error", "failed", "fix", "bug", "exception")),
)


def _atom(kind: str, content: Column, key: Column, key_kind: str, entities: Column, canonical: Column, memory_kind: Column, status: Column, confidence: float) -> Column:
    return F.struct(
        stable_id("atom", F.col("raw_span_id"), F.lit(key_kind), key).alias("atom_id"), F.lit(kind).alias("atom_type"), content.alias("content"), entities.alias("entities"),
        canonical.alias("canonical_entities"), memory_kind.alias("memory_kind"), status.alias("status"), F.lit(confidence).alias("confidence"),
    )


def atoms(events_: DataFrame) -> DataFrame:
    """Heuristic atoms of events: an observation, an image observation where there is a caption, and one for each family of markers."""
    captioned = F.col("caption") != ""
    rows = events_.withColumns({"_e": F.array_distinct(F.concat(F.col("text_entities"), F.col("semantic_refs"))), "_x": F.when(captioned, F.array_distinct(F.concat(T.extract_entities("caption"), T.semantic_references("caption"))))})
    rows = rows.withColumns({"_c": T.distinct_canonical(F.col("_e"), 8), "_low": F.lower("text"), "_status": T.atom_status("text")})
    text, low, status = F.col("text"), F.col("_low"), F.col("_status")
    # An atom that isn't kept is null, so that nothing of it is computed.
    found = [_atom("observation", text, text, "observation", F.col("_e"), F.col("_c"), T.memory_kind(F.lit("observation"), "text"), status, 0.4)]
    found.append(F.when(captioned, _atom("observation", F.concat(F.lit("Image evidence: "), "caption"), F.col("caption"), "image_observation", F.col("_x"), T.distinct_canonical(F.col("_x"), 8), F.lit("event"), F.lit("active"), 0.45)))
    for kind, confidence, markers in _MARKED:
        found.append(F.when(T.contains_any(low, markers), _atom(kind, text, text, kind, F.slice("_e", 1, 8), F.col("_c"), T.memory_kind(F.lit(kind), "text"), status, confidence)))
    kept = F.filter(F.array(*found), lambda x: x.isNotNull())
    keep = ["corpus_id", "session_id", "event_id", "raw_span_id", "seq", "turn_index", "speaker", "timestamp", "canonical_entity_refs"]
    return rows.select(*keep, F.posexplode(kept).alias("atom_pos", "atom")).select(*keep, "atom_pos", "atom.*")


def model_atoms(events_: DataFrame, replies: Column) -> DataFrame:
    """Atoms that a model's replies (a text for each event, from any Column function) list in their first JSON object, as {"atoms": [{type, content, entities, confidence}]}.

    Items without a type or content are skipped, and a reply without such an object, or a null one, gives none. A missing confidence is 0.6.
    """
    item = "struct<type:string,content:string,entities:array<string>,confidence:double>"
    listed = F.from_json(T.first_json_object(replies), f"struct<atoms:array<{item}>>")["atoms"]
    keep = ["corpus_id", "session_id", "event_id", "raw_span_id", "seq", "turn_index", "speaker", "timestamp", "canonical_entity_refs"]
    rows = events_.withColumn("_items", listed).select(*keep, F.posexplode("_items").alias("atom_pos", "_i"))
    rows = rows.withColumns({"atom_type": F.lower(T.strip(F.coalesce("_i.type", F.lit("")))), "content": T.strip(F.coalesce("_i.content", F.lit(""))), "entities": F.coalesce("_i.entities", T.words_array([]))}).where("atom_type != '' and content != ''")
    return rows.select(
        *keep, "atom_pos", stable_id("atom", "raw_span_id", "atom_type", "content").alias("atom_id"), "atom_type", "content", "entities", T.canonicalize_entities("entities").alias("canonical_entities"),
        T.memory_kind("atom_type", "content").alias("memory_kind"), T.atom_status("content").alias("status"), F.coalesce("_i.confidence", F.lit(0.6)).alias("confidence"),
    )


def merge_atoms(heuristic: DataFrame, model: DataFrame) -> DataFrame:
    """Atoms of both sources: of equal (event, type, content) the model's values at the heuristic's place; others of the model follow."""
    h = heuristic.withColumns({"_s": F.lit(0)})
    m = model.withColumns({"_s": F.lit(1)})
    both = h.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy("event_id", "atom_type", "content")
    both = both.withColumns({"_at": F.min(F.struct("_s", "atom_pos")).over(w), "_n": F.row_number().over(w.orderBy(F.col("_s").desc(), F.col("atom_pos").desc()))}).where("_n = 1")
    return both.withColumn("atom_pos", F.row_number().over(Window.partitionBy("event_id").orderBy("_at")) - 1).drop("_s", "_at", "_n")


def infer_slots(content: str = "content", kind: str = "memory_kind", atom_type: str = "atom_type") -> Column:
    # The markers of slots.
    low = F.lower(content)
    by_kind = lambda k, slot: F.when(F.col(kind) == k, slot)
    slots = F.array(
        F.when(T.contains_any(low, ["live in", "lives in", "moved to", "located in", "based in", "from "]), "location"),
        F.when(T.contains_any(low, ["works at", "work at", "employed by", "joined ", "company"]), "employer"),
        F.when(T.contains_any(low, ["work as", "works as", "job", "occupation", "profession"]), "occupation"),
        F.when(T.contains_any(low, ["married", "dating", "partner", "boyfriend", "girlfriend", "spouse"]), "relationship_status"),
        by_kind("preference", "preference"), by_kind("plan", "plan"), by_kind("relation", "relationship"),
    )
    found = F.filter(slots, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(F.nullif(F.col(atom_type), F.lit("")), F.col(kind))))


def resolve_subject() -> Column:
    low = F.lower(T.strip("content"))
    speaker = T.canonicalize_entity("speaker")
    own = F.when(speaker != "", speaker).otherwise(F.col("speaker"))
    first_person = low.startswith("i ") | low.startswith("i'") | low.startswith("my ") | low.rlike(r"(?U)\b(i|my|me|i'm)\b")
    return F.when(first_person, own).otherwise(F.coalesce(F.get("canonical_entities", F.lit(0)), F.get("canonical_entity_refs", F.lit(0)), own))


def candidates(atoms_: DataFrame) -> DataFrame:
    """State candidates: (subject, slot, value) for each slot of an atom of state, preference, plan or relation; keyed by object_id."""
    rows = atoms_.where(F.col("memory_kind").isin("state", "preference", "plan", "relation")).withColumns({"subject": resolve_subject(), "value": T.strip("content"), "normalized_value": T.normalize_value(T.strip("content"))})
    rows = rows.where("normalized_value != ''").select("*", F.posexplode(infer_slots()).alias("slot_pos", "slot"))
    rows = rows.withColumn("policy", F.when(F.col("slot").isin(*SINGLETON_SLOTS), "singleton").otherwise("multi"))
    one, many = stable_id("obj", "corpus_id", "subject", "slot"), stable_id("obj", "corpus_id", "subject", "slot", "normalized_value")
    return rows.select(
        "corpus_id", "session_id", "event_id", F.col("raw_span_id").alias("span_id"), "atom_id", stable_id("cand", "event_id", "atom_id", "subject", "slot", "normalized_value").alias("candidate_id"),
        F.when(F.col("policy") == "singleton", one).otherwise(many).alias("object_id"), "subject", "slot", "value", "normalized_value", "memory_kind", "policy", "status", "confidence",
        F.col("timestamp").alias("valid_from"), "canonical_entities", "seq", "atom_pos", "slot_pos",
    )
