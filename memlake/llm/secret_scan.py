"""Secret scans over an incremental ledger of content-addressed blobs.

Each version of each path is addressed by the SHA-256 of its text. A blob is scanned once for each version of
a rule: pairs of (blob, rule version) that the ledger holds are not scanned again, in this run or a later one. New
findings are appended to the ledger and joined back to every path that ever held the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import broadcastable, byte_slices, new_folder, written

Match = Callable[[str], list[tuple[int, int]]]


@dataclass(frozen=True)
class Rule:
    """Spans of the pattern's matches, leftmost and non-overlapping, of which those whose `group` is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    #: Texts that hold none of these in any case aren't searched; empty: all are.
    hints: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str, folded: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in folded for h in self.hints):
            return []
        return [m.span() for m in re.finditer(self.pattern, text, self.flags) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base rules come first, in this order; {32,} finds just the maximal runs of 32 or more, and {12,} after AKIA those of 16.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("bearer", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
)
RULES = BASE + ADDED

_FINDING = "array<struct<kind:string,lo:int,hi:int>>"


def versions(df: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, body): every row is a version of its path; a null text is the empty one."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(path).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, found) of blobs(blob, todo, body): found lists the spans of each rule of todo, in code points."""
    by_id = {r.id: r for r in rules}

    def run(batches):
        for batch in batches:
            for a, z in byte_slices(batch.column(2)):
                blob, rule, found = [], [], []
                for b, todo, body in zip(*(c.to_pylist() for c in batch.slice(a, z - a).columns), strict=True):
                    folded = body.lower()
                    for i in todo:
                        blob.append(b), rule.append(i)
                        found.append([{"kind": by_id[i].kind, "lo": lo, "hi": hi} for lo, hi in by_id[i].spans(body, folded)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(rule, pa.string()), pa.array(found, kind)], names=["blob", "rule", "found"])

    return blobs.select("blob", "todo", "body").mapInArrow(run, f"blob string, rule string, found {_FINDING}")


def _one_body(held: DataFrame) -> DataFrame:
    return held.groupBy("blob").agg(F.first("body").alias("body"))


class Ledger:
    """Parquet folders of (blob, rule, found), one for each update; an absent folder is an empty ledger."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "ledger")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        schema = f"blob string, rule string, found {_FINDING}"
        return self.spark.read.schema(schema).parquet(f"{self.path}/run=*") if self._exists() else self.spark.createDataFrame([], schema)

    def update(self, held: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scan the pairs of held's blobs (of versions()) and rules that the ledger lacks, append them, and count them.

        Of a blob's rows, however many and of whatever paths, one body is kept, by an aggregation that drops copies before
        they are shuffled; so each pair is scanned once. What the ledger holds is told by digests alone: where the blobs
        with something to scan are few enough for Spark to broadcast them, bodies of all others never move.
        """
        ids = F.array(*(F.lit(r.id) for r in rules))
        if self._exists():
            seen = self.read().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = held.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
            todo = written(todo.where(F.size("todo") > 0), "todo")
            fresh = held.join(todo.select("blob"), "blob", "left_semi") if broadcastable(todo) else held
            bodies = _one_body(fresh).join(todo, "blob")
        else:
            bodies = _one_body(held).withColumn("todo", ids)
        part = f"{self.path}/run={uuid.uuid4().hex}"
        scan(bodies, rules).write.parquet(part)
        return self.spark.read.parquet(part).count()

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found): blobs with findings of these rule versions, spans by start and then rule order."""
        order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
        hits = self.read().where(F.col("rule").isin([r.id for r in rules]) & (F.size("found") > 0)).dropDuplicates(["blob", "rule"])
        key = lambda x: F.struct(x["lo"].alias("lo"), order[x["kind"]].alias("o"), x["hi"].alias("hi"), x["kind"].alias("kind"))
        return hits.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("f")).select("blob", F.array_sort(F.transform("f", key)).alias("found"))


def _joined(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    if kinds:
        found = F.filter(found, lambda x: x["kind"].isin(list(kinds)))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["lo"], x["hi"])), ",")


def spans_by_path(df: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, found) of every row after the ledger is brought up to date; found is empty without secrets.

    A null text counts as empty; null paths are kept; repeated rows each give a row; an empty table gives none;
    other columns, whatever their names, aren't read; texts of any length are scanned whole. Spans that begin at one place
    stand in the order of the rules. Copies of one blob, however many, are scanned once and joined by Spark's
    splittable equi-join to the blobs that have findings.
    """
    ledger = ledger or Ledger(df.sparkSession)
    held = versions(df, path, text)
    ledger.update(held, rules)
    empty = F.array().cast("array<struct<lo:int,o:int,hi:int,kind:string>>")
    out = held.select("path", "blob").join(ledger.findings(rules), "blob", "left")
    return out.select(F.col("path").alias(path), "blob", F.coalesce("found", empty).alias("found"))


def digests(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts and joined spans of spans_by_path's rows."""
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.col("found"), tuple(r.kind for r in BASE))
    return spans.select(key, *(n(r.kind) for r in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(text: str, found: str) -> Column:
    """text with each span of found replaced by its kind in brackets; spans that overlap count as one."""
    return F.expr(f"""aggregate({found}, named_struct('out', '', 'at', 0),
        (acc, x) -> named_struct('out', concat(acc.out, substring({text}, acc.at + 1, greatest(0, x.lo - acc.at)), if(x.lo >= acc.at, concat('[', x.kind, ']'), '')), 'at', greatest(acc.at, x.hi)),
        acc -> concat(acc.out, substring({text}, acc.at + 1)))""")
