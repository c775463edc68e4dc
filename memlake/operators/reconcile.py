"""State reconciliation: each object's candidates, in order, against its current version.

A decision reads its own object's state alone, so objects are independent. Objects of the multi policy hold one value:
their first candidate adds it, all others repeat it; that is a pre-aggregated minimum joined back, whose hot keys Spark
can split. Singleton objects need a fold in order: rows stream, sorted by key, through tasks that hold one current version
each, so a key may have any number of candidates. reconcile_singleton() states the same fold in SQL's aggregate(), for
sessions without Python workers and short keys: it gathers a key's candidates in one array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions.ids import stable_id
from memlake.functions.text import token_overlap, words_array

ORDER = ("seq", "atom_pos", "slot_pos", "event_id")
ACTIONS = ("ADD", "NONE", "PATCH", "SUPERSEDE", "TENTATIVE")
LOW_OVERLAP = 0.2
#: Rows of a key in a run and in a block of reconcile_singleton().
FOLD = (16, 512)


def _order() -> Column:
    return F.struct(*ORDER)


def reconcile_multi(candidates: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """First of each key ADD, the rest NONE; all NONE where current(object_id, ...) holds the key."""
    rows = candidates.where("policy = 'multi'")
    first = rows.groupBy("object_id").agg(F.min(_order()).alias("first"))
    rows = rows.join(first, "object_id")
    is_new = _order() == F.col("first")
    origin = stable_id("ver", F.col("object_id"), F.col("first.event_id"), F.lit("ADD"), F.col("normalized_value"))
    if current is not None:
        rows = rows.join(current.select("object_id", F.col("latest_version_id").alias("held")), "object_id", "left")
        is_new, origin = is_new & F.col("held").isNull(), F.coalesce("held", origin)
    rows = rows.withColumns({"action": F.when(is_new, "ADD").otherwise("NONE"), "reason": F.when(is_new, "new_object").otherwise("same_normalized_value"), "version_id": origin, "previous_version_id": F.lit(None).cast("string")})
    return rows.drop("first", "held")


def decide(cur: Column, nv: Column, status: Column, overlap: Column) -> tuple[Column, Column]:
    """Action and reason of a candidate against the current normalised value (null: none), without a model."""
    action = (
        F.when(cur.isNull(), "ADD").when(cur == nv, "NONE").when(status != "active", "TENTATIVE")
        .when(F.contains(nv, cur), F.when(F.length(nv) > F.length(cur), "PATCH").otherwise("NONE")).when(F.contains(cur, nv), "NONE").otherwise("SUPERSEDE")
    )
    reason = (
        F.when(cur.isNull(), "new_object").when(cur == nv, "same_normalized_value").when(status != "active", "candidate_not_active")
        .when(F.contains(nv, cur), "candidate_more_specific").when(F.contains(cur, nv), "existing_more_specific").when(overlap <= LOW_OVERLAP, "singleton_slot_low_overlap").otherwise("default_supersede")
    )
    return action, reason


def reconcile_singleton(candidates: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The ordered fold; current(object_id, cur_nv) seeds it.

    Each step of aggregate() copies the array that it adds to, so a key is folded in runs of FOLD[0] rows, and runs in blocks of
    FOLD[1] rows: all arrays stay short, and are put together at the end.
    """
    rows = candidates.where("policy = 'singleton'")
    nth = F.row_number().over(Window.partitionBy("object_id").orderBy(*ORDER)) - 1
    rows_at = rows.withColumns({"_run": F.floor(nth / FOLD[0]), "_block": F.floor(nth / FOLD[1])})
    runs = rows_at.groupBy("object_id", "_block", "_run").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "normalized_value", "status"))).alias("steps"))
    blocks = runs.groupBy("object_id", "_block").agg(F.array_sort(F.collect_list(F.struct("_run", "steps"))).alias("runs"))
    keyed = blocks.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("_block", "runs"))).alias("blocks"))
    if current is not None:
        keyed = keyed.join(current.select("object_id", "cur_nv"), "object_id", "left")
    else:
        keyed = keyed.withColumn("cur_nv", F.lit(None).cast("string"))

    def step(acc: Column, x: Column) -> Column:
        action, reason = decide(acc["cur"], x["normalized_value"], x["status"], token_overlap(acc["cur"], x["normalized_value"]))
        out = F.struct(x["seq"].alias("seq"), x["atom_pos"].alias("atom_pos"), x["slot_pos"].alias("slot_pos"), x["event_id"].alias("event_id"), action.alias("action"), reason.alias("reason"))
        moved = F.when(action.isin("ADD", "PATCH", "SUPERSEDE"), x["normalized_value"]).otherwise(acc["cur"])
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), moved.alias("cur"))

    decisions = "array<struct<seq:bigint,atom_pos:int,slot_pos:int,event_id:string,action:string,reason:string>>"

    part = F.array().cast(f"array<struct<out:{decisions},cur:string>>")
    put_together = lambda acc: F.flatten(F.transform(acc, lambda x: x["out"]))

    def of_run(run: Column, cur: Column) -> Column:
        return F.aggregate(run["steps"], F.struct(F.array().cast(decisions).alias("out"), cur.alias("cur")), step)

    def of_block(block: Column, cur: Column) -> Column:
        return F.aggregate(block["runs"], part, added(of_run, cur), lambda acc: F.struct(put_together(acc).alias("out"), F.element_at(acc, -1)["cur"].alias("cur")))

    def added(of: Callable[[Column, Column], Column], cur: Column) -> Callable[[Column, Column], Column]:
        """A part's decisions behind those of the parts before it, the last of which holds the value that is current."""
        return lambda acc, x: F.concat(acc, F.array(of(x, F.when(F.size(acc) == 0, cur).otherwise(F.element_at(acc, -1)["cur"]))))

    folded = F.aggregate("blocks", part, added(of_block, F.col("cur_nv")), put_together)
    decided = keyed.select("object_id", F.inline(folded))
    return rows.join(decided, ["object_id", *ORDER])


def _compare(cur: str, nv: str) -> tuple[str | None, str | None]:
    """What two different values of a singleton decide by themselves, or nothing."""
    if cur in nv:
        return "PATCH", "candidate_more_specific"
    if nv in cur:
        return "NONE", "existing_more_specific"
    a, b = ({t for t in x.split() if len(t) > 1} for x in (cur, nv))
    low = (len(a & b) / len(a | b) if a and b else 0.0) <= LOW_OVERLAP
    return ("SUPERSEDE", "singleton_slot_low_overlap") if low else (None, None)


def decide_one(cur: str | None, nv: str, status: str, compare=_compare, model: Callable[[dict, dict], str | None] | None = None) -> tuple[str, str]:
    """Action and reason of a candidate against the current value of its object (None: there is none)."""
    if cur is None:
        return "ADD", "new_object"
    if cur == nv:
        return "NONE", "same_normalized_value"
    if status != "active":
        return "TENTATIVE", "candidate_not_active"
    action, reason = compare(cur, nv)
    if action:
        return action, reason
    said = model({"normalized_value": cur}, {"normalized_value": nv}) if model else None
    if said in ("PATCH", "SUPERSEDE", "TENTATIVE"):
        return said, "llm_reconciled"
    return ("NONE", "llm_duplicate") if said == "NONE" else ("SUPERSEDE", "default_supersede")


def name_versions(done: DataFrame, held: Column | None = None) -> DataFrame:
    """version_id and previous_version_id of decided rows with _before and _after, the (event_id, action, nv) that name the versions on both sides; held: the version's id where they name none."""
    made = lambda v: F.when(F.col(v).isNotNull(), stable_id("ver", F.col("object_id"), F.col(v)["event_id"], F.col(v)["action"], F.col(v)["nv"]))
    named = lambda v: made(v) if held is None else F.coalesce(made(v), held)
    own = F.when(F.col("action") != "NONE", stable_id("ver", "object_id", "event_id", "action", "normalized_value"))
    return done.withColumns({"version_id": F.coalesce(own, named("_after")), "previous_version_id": F.when(F.col("action").isin("PATCH", "SUPERSEDE"), named("_before"))}).drop("_before", "_after")


def reconcile_streaming_fold(candidates: DataFrame, model: Callable[[dict, dict], str | None] | None = None, current: DataFrame | None = None) -> DataFrame:
    """The fold over rows that stream sorted by key, with a model for ambiguous cases: action, reason, version_id, previous_version_id of each candidate.

    model(current, candidate) gives PATCH, SUPERSEDE, TENTATIVE or NONE; anything else means no answer. Rows pass through as
    they are, with the decision and what names the version before and after it, so nothing is joined back.
    """
    import pyarrow as pa

    rows = candidates.where("policy = 'singleton'")
    if current is not None:
        rows = rows.join(current.select("object_id", F.col("cur_nv").alias("_cur"), F.col("latest_version_id").alias("_held")), "object_id", "left")
    else:
        rows = rows.withColumns({"_cur": F.lit(None).cast("string"), "_held": F.lit(None).cast("string")})

    version = pa.struct([("event_id", pa.string()), ("action", pa.string()), ("nv", pa.string())])

    def run(batches):
        key, cur, last = None, None, None
        compare = lru_cache(maxsize=1 << 16)(_compare)
        for batch in batches:
            actions, reasons, before, after = [], [], [], []
            for obj, event, nv, status, seed in zip(*(batch.column(c).to_pylist() for c in ("object_id", "event_id", "normalized_value", "status", "_cur")), strict=True):
                if obj != key:
                    key, cur, last = obj, seed, None
                action, reason = decide_one(cur, nv, status, compare, model)
                before.append(last)
                if action in ("ADD", "PATCH", "SUPERSEDE"):
                    cur, last = nv, {"event_id": event, "action": action, "nv": nv}
                after.append(last), actions.append(action), reasons.append(reason)
            added = [pa.array(actions, pa.string()), pa.array(reasons, pa.string()), pa.array(before, version), pa.array(after, version)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "action", "reason", "_before", "_after"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("action string, reason string, _before struct<event_id:string,action:string,nv:string>, _after struct<event_id:string,action:string,nv:string>").fields])
    done = rows.repartition("object_id").sortWithinPartitions("object_id", *ORDER).mapInArrow(run, schema)
    return name_versions(done, F.col("_held")).drop("_cur", "_held")


def reconcile(candidates: DataFrame, current: DataFrame | None = None, model: Callable | None = None) -> DataFrame:
    """Candidates with action, reason, version_id (the version that a candidate's evidence points to) and previous_version_id (of effective updates)."""
    return reconcile_multi(candidates, current).unionByName(reconcile_streaming_fold(candidates, model, current))


def versions(actions: DataFrame) -> DataFrame:
    """Rows of object versions: validity windows close where the next effective version begins."""
    rows = actions.where("action != 'NONE'")
    # The next effective row of each row, whatever tentative rows lie between: from the last row backwards it is the last one seen,
    # so the frame only grows and a key of any length takes linear time.
    back = Window.partitionBy("object_id").orderBy(*(F.col(c).desc() for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    then = F.last(F.when(F.col("action") != "TENTATIVE", F.struct("valid_from", "version_id")), ignorenulls=True).over(back)
    rows = rows.withColumn("then", then)
    replaced = F.col("then").isNotNull() & (F.col("action") != "TENTATIVE")
    return rows.select(
        "version_id", "object_id", "corpus_id", "event_id", "atom_id", F.col("action").alias("operation"), F.col("value").alias("value"), "normalized_value",
        F.concat(F.col("subject"), F.lit(" ["), F.col("slot"), F.lit("]: "), F.col("value")).alias("summary"), F.when(F.col("action") == "TENTATIVE", "tentative").when(replaced, "superseded").otherwise("active").alias("status"),
        "confidence", "valid_from", F.when(replaced, F.col("then.valid_from")).alias("valid_to"), "previous_version_id", "reason", "seq", "atom_pos", "slot_pos",
    )


def objects(actions: DataFrame) -> DataFrame:
    """Current row of each object; memory_kind and creation come from the first writer, the latest version from the last effective one."""
    made = actions.where("action != 'NONE'")
    firsts = F.min_by(F.struct("corpus_id", "subject", "slot", "policy", "memory_kind", "event_id"), _order()).alias("f")
    effective = F.when(F.col("action") != "TENTATIVE", _order())
    last, value = F.max_by("version_id", effective).alias("latest_version_id"), F.max_by("normalized_value", effective).alias("current_value")
    seen = F.max_by("event_id", _order()).alias("updated_at_event_id")
    rows = made.groupBy("object_id").agg(firsts, last, value, seen)
    # The subject, then the evidence's references by first occurrence: of each its first place alone is kept.
    each = made.where("action != 'TENTATIVE'").select("object_id", _order().alias("at"), F.posexplode("canonical_entities").alias("pos", "ref")).where("ref != ''")
    place = each.groupBy("object_id", "ref").agg(F.min(F.struct("at", "pos")).alias("at"))
    place = place.withColumn("n", F.row_number().over(Window.partitionBy("object_id").orderBy("at", "ref"))).where("n <= 8")
    refs = place.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda x: x["ref"]).alias("refs"))
    rows = rows.join(refs, "object_id", "left")
    canonical = F.slice(F.array_distinct(F.filter(F.concat(F.array("f.subject"), F.coalesce("refs", words_array([]))), lambda x: x != "")), 1, 8)
    return rows.select("object_id", "f.corpus_id", "f.subject", "f.slot", "f.policy", "f.memory_kind", F.lit("active").alias("status"), "latest_version_id", "current_value", canonical.alias("canonical_entities"), F.col("f.event_id").alias("created_at_event_id"), "updated_at_event_id", words_array([]).alias("aliases"))


def merge_objects(former: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of objects() over two runs of actions, one after the other, from those of each: what objects() gives over both."""
    first = ("corpus_id", "subject", "slot", "policy", "memory_kind", "status", "created_at_event_id", "aliases")
    newest = ("latest_version_id", "current_value", "updated_at_event_id")
    f, l = former.select("object_id", F.struct(*former.columns).alias("f")), later.select("object_id", F.struct(*later.columns).alias("l"))
    rows = f.join(l, "object_id", "full")
    picked = {c: F.coalesce(f"f.{c}", f"l.{c}") for c in first} | {c: F.coalesce(f"l.{c}", f"f.{c}") for c in newest}
    none = words_array([])
    picked["canonical_entities"] = F.slice(F.array_distinct(F.concat(F.coalesce("f.canonical_entities", none), F.coalesce("l.canonical_entities", none))), 1, 8)
    return rows.select(*(F.col("object_id") if c == "object_id" else picked[c].alias(c) for c in former.columns))


def closed_versions(held: DataFrame, later: DataFrame) -> DataFrame:
    """The held current versions of objects that later actions replace, with their windows closed where the first replacement begins."""
    effective = later.where(F.col("action").isin("ADD", "PATCH", "SUPERSEDE"))
    then = effective.groupBy("object_id").agg(F.min_by(F.struct("valid_from"), _order()).alias("_then"))
    rows = held.where("status = 'active'").join(then, "object_id")
    return rows.withColumns({"status": F.lit("superseded"), "valid_to": F.col("_then.valid_from")}).select(held.columns)


def evidence_links(actions: DataFrame) -> DataFrame:
    role = F.when(F.col("action") == "ADD", "origin").when(F.col("action") == "NONE", "support").when(F.col("action") == "TENTATIVE", "tentative").otherwise("update")
    rows = actions.withColumn("role", role)
    return rows.select(stable_id("link", "object_id", "event_id", "atom_id", "role").alias("link_id"), "corpus_id", "object_id", "version_id", "event_id", "session_id", "atom_id", "role", "confidence").dropDuplicates(["link_id"])


def action_histogram(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action", "reason").agg(F.count("*").alias("n"))


def cache_counters(actions: DataFrame) -> DataFrame:
    """A batch's first sight of an object is a miss, each later one a hit."""
    return actions.agg(F.countDistinct("object_id").alias("misses"), (F.count("*") - F.countDistinct("object_id")).alias("hits"))
