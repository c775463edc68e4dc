"""The library's service: append conversations, search them, read state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from memlake.functions import sql
from memlake.operators import evaluate, lookups, search
from memlake.sources.store import Store
from memlake.sources.turns import read_conversations


class MemoryService:
    """embed: a Column function from text to array<double>, asked once for each event and snapshot; model: reconciles ambiguous conflicts; replies: a Column function from a turn to a model's reply that lists atoms. All are optional."""

    MODES = ("online", "migration")

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None, model: Callable | None = None, replies: Callable[[Column], Column] | None = None):
        self.spark, self.store, self.embed, self.model, self.replies = spark, Store(spark, path, embed=embed), embed, model, replies

    def append_json(self, corpus_id: str, path: str, mode: str = "online") -> bool:
        return self.append_turns(read_conversations(self.spark, path, corpus_id), mode)

    def append_turns(self, turns: DataFrame, mode: str = "online") -> bool:
        """Both modes run one code path; the name is only checked."""
        if mode not in self.MODES:
            raise ValueError(f"mode must be one of {self.MODES}")
        return self.store.append(turns, model=self.model, replies=self.replies)

    def prepare_turns(self, turns: DataFrame, path: str) -> None:
        """Everything of an append that needs no state, kept at path for append_prepared()."""
        self.store.save_prepared(self.store.prepare(turns, self.replies), path)

    def append_prepared(self, path: str) -> bool:
        return self.store.append_prepared(self.store.load_prepared(path), model=self.model)

    def report(self) -> tuple[DataFrame, DataFrame]:
        return self.store.report()

    def write_report(self, path: str) -> None:
        """The last append's counters and what it touched, as JSON files under path."""
        for name, df in zip(("counters", "touched"), self.report(), strict=True):
            evaluate.write_report(df, f"{path.rstrip('/')}/{name}")

    def approximate(self) -> DataFrame:
        """Estimates from the batches' sketches, without reading events."""
        return self.store.approximate()

    def compact(self) -> list[str]:
        return self.store.compact()

    def register_sql(self) -> list[str]:
        """Functions, views and table functions for spark.sql()."""
        return [*sql.register(self.spark), *sql.register_store(self.store)]

    def events(self, corpus_id: str, session_id: str, limit: int | None = None) -> DataFrame:
        """A session's events in order; of compacted parts one partition is opened."""
        rows = self.store.point("events", corpus_id=corpus_id, session_id=session_id).orderBy("turn_index")
        return rows if limit is None else rows.limit(limit)

    def _tables(self) -> dict[str, DataFrame]:
        return {"snapshots": self.store.snapshots(), "events": self.store.table("events"), "objects": self.store.objects(), "versions": self.store.versions(), "links": self.store.links()}

    def _asked(self, questions: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([("q", questions)], "qid string, question string") if isinstance(questions, str) else questions

    def search(self, questions: DataFrame | str, spans: int = 8) -> dict[str, DataFrame]:
        return search.search(self._asked(questions), self._tables(), self.embed, spans)

    def answer_views(self, questions: DataFrame | str, spans: int = 8) -> DataFrame:
        """(qid, question, view, text): what a model that answers is given."""
        return search.answer_views(self._asked(questions), self.search(questions, spans))

    def root(self, corpus_id: str, full_root: bool = True) -> DataFrame:
        """The corpus in one row: of all that is stored, or of what the last append touched."""
        return lookups.snapshot(self.store.root(full_root), corpus_id, "root", corpus_id)

    def session(self, corpus_id: str, session_id: str) -> DataFrame:
        return lookups.snapshot(self.store.snapshots(), corpus_id, "session", session_id)

    def entity(self, corpus_id: str, subject: str) -> DataFrame:
        return lookups.snapshot(self.store.snapshots(), corpus_id, "entity", subject)

    def state(self, corpus_id: str, session_id: str | None = None, subject: str | None = None) -> DataFrame:
        """The most specific snapshot that is asked for: entity, session, root."""
        return self.entity(corpus_id, subject) if subject else self.session(corpus_id, session_id) if session_id else self.root(corpus_id)

    def timeline(self, subject: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return lookups.timeline(self.store.objects(), self.store.versions(), self.store.links(), self.store.table("events"), subject)

    def sessions(self) -> DataFrame:
        return lookups.sessions(self.store.table("events"))

    def entities(self) -> DataFrame:
        return lookups.subjects(self.store.objects())

    def corpora(self) -> DataFrame:
        return lookups.corpora(self.store.snapshots(), self.store.table("events"))
