"""The memory store: an append-only log of batches as Parquet, and views that are folded forward from it.

A batch's events, atoms and reconciled candidates (actions) are written first and become visible with the next numbered
manifest (see manifest.py). A writer that finds the number taken looks at the newer version, reconciles again, and
retries; a batch id that is in already changes nothing.

Views (objects, versions, links, session and entity snapshots) hold the commits up to a number. Reading one folds in the
commits since then: their actions are merged by the objects they touch, the versions they replace are closed, and only
the sessions and subjects that they can change are summarised anew. What changed is a part of its own behind the
former ones, of which the newest row of a key counts. compact() puts a table's parts together, in partitions by a hash of
session or object, sorted, with Bloom filters on ids, so that point reads open few files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Generator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import evaluate, extract, lookups, reconcile, search, sketches, snapshots
from memlake.sources.manifest import Manifest, Manifests, Part
from memlake.sources.scratch import delete, written

TABLES = ("events", "atoms", "actions")
STATE = ("objects", "versions", "links")
#: Of each table what tells its rows apart, what its point reads ask for, and what its compacted files are sorted by.
KEYS = {"objects": ["object_id"], "versions": ["version_id", "atom_id"], "links": ["link_id"], "sessions": ["snapshot_id"], "entities": ["snapshot_id"]}
BUCKETED = {"sketches": ["corpus_id"], "events": ["corpus_id", "session_id"], "atoms": ["event_id"], "actions": ["object_id"], "objects": ["object_id"], "versions": ["object_id"], "links": ["object_id"], "sessions": ["snapshot_id"], "entities": ["snapshot_id"]}
SORTED = {"events": ["corpus_id", "session_id", "turn_index"], "atoms": ["event_id", "atom_id"], "links": ["object_id", "event_id"]}
BLOOM = {"events": "event_id", "atoms": "event_id", "actions": "event_id", "versions": "version_id", "links": "event_id"}


class StaleTurns(Exception):
    """Prepared turns continue sessions that another append has lengthened since; prepare them again."""


class Store:
    def __init__(self, spark: SparkSession, path: str, title: str = "", embed: Callable[[Column], Column] | None = None):
        # Constraint propagation multiplies these plans' nested expressions at planning time and could only add null checks.
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
        self.spark, self.path, self.title, self.embed = spark, path.rstrip("/"), title, embed
        self.manifests = Manifests(spark, self.path)

    # ------------------------------------------------------------ log

    def batches(self) -> list[int]:
        return [i for a, b in self.manifests.read().batches for i in range(a, b + 1)]

    def has(self, batch: int) -> bool:
        return self.manifests.read().has(batch)

    def _write(self, df: DataFrame, name: str, commit: int, last: int | None = None) -> tuple[Part, DataFrame]:
        path = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        return Part(path, commit, commit if last is None else last), written(df, name, path)

    def _read(self, parts: list[Part]) -> DataFrame | None:
        """Rows of parts; compacted ones have _bucket, the others null in its place."""
        plain, bucketed = [p.path for p in parts if not p.buckets], [p.path for p in parts if p.buckets]
        found = [self.spark.read.parquet(*plain)] if plain else []
        found += [self.spark.read.parquet(x) for x in bucketed]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    def table(self, name: str, since: int = 0, at: Manifest | None = None) -> DataFrame | None:
        """A table of the log: events, atoms or actions, of commits from `since` on."""
        m = at or self.manifests.read()
        df = self._read([p for p in m.tables.get(name, []) if p.last >= since])
        if df is None:
            return None
        df = df.drop("_bucket")
        return df.where(F.col("batch") >= since) if since else df

    def commit(self, batch: int | None, make: Callable[[Manifest], Generator]) -> bool:
        """Write the tables that make(manifest) yields as (name, rows) and make them visible; made again where another writer came first. False if the batch is in already.

        make is sent each table as it was written, so that the next one is derived from a scan and nothing is computed twice.
        """
        while True:
            m = self.manifests.read()
            if batch is not None and m.has(batch):
                return False
            new, number = m.copy(), m.next_commit
            new.version, new.next_commit = m.version + 1, number + 1
            new.add_batch(batch if batch is not None else (m.batches[-1][1] + 1 if m.batches else 0))
            parts, kept, steps, sent = [], {}, make(m), None
            while True:
                try:
                    name, df = steps.send(sent)
                except StopIteration:
                    break
                part, kept[name] = self._write(df.withColumn("batch", F.lit(number)), name, number)
                sent = kept[name].drop("batch")
                new.tables.setdefault(name, []).append(part)
                parts.append(part)
            part, _ = self._write(sketches.of_batch(kept["events"], kept["actions"]).withColumn("batch", F.lit(number)), "sketches", number)
            new.tables.setdefault("sketches", []).append(part)
            parts.append(part)
            if self.manifests.put(new):
                return True
            for p in parts:
                delete(self.spark, p.path)

    def current(self, at: Manifest | None = None) -> DataFrame | None:
        """(object_id, cur_nv, latest_version_id): what the next batch is reconciled against."""
        objects = self.view("objects", at)
        return None if objects is None else objects.select("object_id", F.col("current_value").alias("cur_nv"), "latest_version_id")

    def _events(self, turns: DataFrame, at: Manifest | None = None) -> DataFrame:
        """Events, with what searches read of them, of turns that follow what is stored."""
        held = self.table("events", at=at)
        return search.searchable_events(extract.events(turns, lookups.next_turn_index(held) if held is not None else None), self.embed)

    def _atoms(self, events: DataFrame, replies: Callable[[Column], Column] | None) -> DataFrame:
        atoms = extract.atoms(events)
        return extract.merge_atoms(atoms, extract.model_atoms(events, replies(F.col("surface")))) if replies else atoms

    def prepare(self, turns: DataFrame, replies: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
        """Events and atoms: all of an append that needs no state.

        replies: a Column function from a turn's surface text to a model's reply, whose atoms join the heuristic ones.
        """
        events = self._events(turns)
        return {"events": events, "atoms": self._atoms(events, replies)}

    def save_prepared(self, prepared: dict[str, DataFrame], path: str) -> None:
        """Keep prepared turns, so that an append which fails later doesn't ask the models again."""
        for name, df in prepared.items():
            df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")

    def load_prepared(self, path: str) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("events", "atoms")}

    def append(self, turns: DataFrame, batch: int | None = None, model=None, replies=None) -> bool:
        """Prepare, reconcile and commit a batch of turns; their order continues after earlier batches. False where the batch is in already."""

        def make(m: Manifest) -> Generator:
            events = yield "events", self._events(turns, m)
            atoms = yield "atoms", self._atoms(events, replies)
            yield "actions", self._actions(atoms, m, model)

        return self.commit(batch, make)

    def append_prepared(self, prepared: dict[str, DataFrame], batch: int | None = None, model=None) -> bool:
        def make(m: Manifest) -> Generator:
            held = self.table("events", at=m)
            if held is not None:
                first = prepared["events"].groupBy("corpus_id", "session_id").agg(F.min("turn_index").alias("first"))
                if not first.join(lookups.next_turn_index(held), ["corpus_id", "session_id"], "left").where("first != coalesce(next_index, 0)").isEmpty():
                    raise StaleTurns
            yield "events", prepared["events"]
            atoms = yield "atoms", prepared["atoms"]
            yield "actions", self._actions(atoms, m, model)

        return self.commit(batch, make)

    def _actions(self, atoms: DataFrame, m: Manifest, model) -> DataFrame:
        return reconcile.reconcile(extract.candidates(atoms), self.current(m), model)

    def report(self, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Counters (metric, value) of a commit, the last by default, and the sessions and subjects (kind, name) that it touched."""
        m = self.manifests.read()
        n = m.next_commit - 1 if batch is None else batch
        events, atoms, actions = (self.table(name, n, m).where(F.col("batch") == n) for name in TABLES)
        return evaluate.ingest_report(events, atoms, actions, reconcile.evidence_links(actions)), evaluate.touched(events, actions)

    def approximate(self) -> DataFrame:
        """(corpus_id, n, speakers, sessions, subjects, objects, lengths): numbers of events and estimates of distinct values, and three quantiles of the texts' lengths, from the batches' sketches alone."""
        return sketches.merged(self.table("sketches"), ["corpus_id"], ["speakers", "sessions", "subjects", "objects"], ["lengths"])

    # ------------------------------------------------------------ views

    def view(self, name: str, at: Manifest | None = None) -> DataFrame | None:
        """A current table: objects, versions, links, sessions, entities or root; None of an empty store."""
        m = at or self.manifests.read()
        if not m.next_commit:
            return None
        if name == "root":
            return self.root()
        if m.folded.get(name, 0) < m.next_commit:
            m = self._fold(m, name in STATE)
        return self._merged(name, m)

    def _merged(self, name: str, m: Manifest) -> DataFrame | None:
        """The newest row of each key over a view's parts."""
        parts = m.tables.get(name, [])
        if not parts:
            return None
        if len(parts) == 1 or name == "links":  # links are only ever added
            return self._read(parts).drop("_bucket", "_commit")
        former, later = self._read(parts[:1]).drop("_bucket"), self._read(parts[1:]).drop("_bucket")
        later = later.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*later.columns), F.col("_commit")).alias("_row")).select("_row.*")
        kept = former.join(later, KEYS[name], "left_anti").select(former.columns)
        return kept.unionByName(later, allowMissingColumns=True).drop("_commit")

    def _fold(self, m: Manifest, state_only: bool) -> Manifest:
        """The manifest with views that hold all commits; put as a new version unless another writer was first, who then folds again."""
        new, last = m.copy(), m.next_commit - 1
        new.version = m.version + 1

        def keep(name: str, df: DataFrame) -> DataFrame:
            part, kept = self._write(df.withColumn("_commit", F.lit(last)), name, m.folded.get(name, 0), last)
            new.tables.setdefault(name, []).append(part)
            new.folded[name] = m.next_commit
            return kept.drop("_commit")

        since = m.folded.get("objects", 0)
        if since < m.next_commit:
            actions = self._ordered(since, m)
            former = self._merged("objects", m)
            if former is None:
                keep("objects", reconcile.objects(actions)), keep("versions", reconcile.versions(actions)), keep("links", reconcile.evidence_links(self.table("actions", since, m)))
            else:
                later = reconcile.objects(actions)
                touched = written(actions.where("action != 'NONE'").select("object_id").distinct(), "touched")
                held = written(former.join(touched, "object_id", "left_semi"), "held")
                closing = self._merged("versions", m).join(held.select(F.col("latest_version_id").alias("version_id")), "version_id", "left_semi")
                keep("versions", reconcile.closed_versions(closing, actions).unionByName(reconcile.versions(actions)))
                keep("objects", reconcile.merge_objects(held, later))
                keep("links", reconcile.evidence_links(self.table("actions", since, m)))
        if not state_only and m.folded.get("sessions", 0) < m.next_commit:
            self._fold_snapshots(m, new, keep)
        if self.manifests.put(new):
            return new
        return new  # what was made holds for this reader; the next one folds from the newer version

    def _ordered(self, since: int, m: Manifest) -> DataFrame:
        """Actions ordered by commit first."""
        return self.table("actions", since, m).withColumn("seq", F.struct("batch", "seq"))

    def _fold_snapshots(self, m: Manifest, new: Manifest, keep) -> None:
        """Snapshots of the scopes that commits since the last fold can change; of all, where there are none yet."""
        since = m.folded.get("sessions", 0)
        events, (objects, versions, links) = self.table("events", at=m), (self._merged(n, new) for n in STATE)
        subjects, sessions = None, None
        if since:
            sessions, subjects = (written(x, "dirty") for x in self._dirty(since, m, objects, links))
        of = lambda df, keys, dirty: df if dirty is None else df.join(dirty, keys, "left_semi")
        by = ["corpus_id", "session_id"]
        made = snapshots.session_snapshots(of(events, by, sessions), objects, versions, of(links, by, sessions), self.title)
        keep("sessions", self._embedded(made))
        mine = of(objects, ["corpus_id", "subject"], subjects)
        ids = None if subjects is None else mine.select("object_id")
        keep("entities", self._embedded(snapshots.entity_snapshots(events, mine, of(versions, ["object_id"], ids), of(links, ["object_id"], ids), self.title)))

    def _dirty(self, since: int, m: Manifest, objects: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sessions and subjects whose snapshots the commits from `since` on can change.

        Sessions: of new events, and those with evidence for an object that has a new version. Subjects: of new actions, as each brings
        evidence, and those that new events name.
        """
        events, actions = self.table("events", since, m), self.table("actions", since, m)
        changed = actions.where("action != 'NONE'").select("object_id").distinct()
        sessions = events.select("corpus_id", "session_id").union(links.join(changed, "object_id", "left_semi").select("corpus_id", "session_id")).distinct()
        named = events.select("corpus_id", F.explode("canonical_entity_refs").alias("subject")).distinct().join(objects.select("corpus_id", "subject").distinct(), ["corpus_id", "subject"], "left_semi")
        return sessions, actions.select("corpus_id", "subject").union(named.select("corpus_id", "subject")).distinct()

    def _embedded(self, made: DataFrame) -> DataFrame:
        return search.searchable_snapshots(made, self.embed)

    def root(self, full_root: bool = True) -> DataFrame:
        """A row for each corpus: of all that is stored, or of what the last commit touched alone."""
        m = self.manifests.read()
        events, sessions, entities = self.table("events", at=m), self.view("sessions"), self.view("entities")
        if not full_root:
            n = m.next_commit - 1
            new, acts = self.table("events", n, m), self.table("actions", n, m)
            sessions = sessions.join(new.select("corpus_id", F.col("session_id").alias("scope_id")), ["corpus_id", "scope_id"], "left_semi")
            entities = entities.join(acts.select("corpus_id", F.col("subject").alias("scope_id")), ["corpus_id", "scope_id"], "left_semi")
            events = events.join(new.select("corpus_id"), "corpus_id", "left_semi")
        return self._embedded(snapshots.root_snapshot(events, sessions, entities, self.title))

    def objects(self) -> DataFrame:
        return self.view("objects")

    def versions(self) -> DataFrame:
        return self.view("versions")

    def links(self) -> DataFrame:
        return self.view("links")

    def snapshots(self) -> DataFrame:
        """Session, entity and root snapshots of all that is stored."""
        parts = [self.view(n) for n in ("sessions", "entities", "root")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)

    # ------------------------------------------------------------ layout and point reads

    def compact(self, least: int = 8, bucket_bytes: int = 128 << 20, most_buckets: int = 4096) -> list[str]:
        """Put together the parts of every table that has at least `least` of them; the names of those tables.

        Partitions are as many as files of bucket_bytes need. The former parts stay for readers of older versions until vacuum().
        """
        m = self.manifests.read()
        new = m.copy()
        new.version = m.version + 1
        done = []
        for name, parts in m.tables.items():
            if len(parts) < least:
                continue
            df = self._read(parts).drop("_bucket") if name in TABLES or name in ("links", "sketches") else self._merged(name, m)
            size = int(str(self._read(parts)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            buckets = max(1, min(most_buckets, -(-size // bucket_bytes)))
            if name not in TABLES and name != "sketches" and "_commit" not in df.columns:
                df = df.withColumn("_commit", F.lit(parts[-1].last))
            rows = df.withColumn("_bucket", self._bucket(name, buckets)).repartition(buckets, "_bucket").sortWithinPartitions("_bucket", *SORTED.get(name, BUCKETED[name]))
            path = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            writer = rows.write.partitionBy("_bucket")
            if name in BLOOM:
                writer = writer.option(f"parquet.bloom.filter.enabled#{BLOOM[name]}", "true")
            writer.parquet(path)
            new.tables[name] = [Part(path, parts[0].first, parts[-1].last, buckets)]
            done.append(name)
        if not done:
            return []
        if not self.manifests.put(new):
            return self.compact(least, bucket_bytes, most_buckets)
        self.manifests.forget()
        return done

    def _bucket(self, name: str, buckets: int, values: list[Column] | None = None) -> Column:
        of = values or [F.col(c) for c in BUCKETED[name]]
        return F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int")

    def point(self, name: str, **values: str) -> DataFrame | None:
        """Rows of a table of the log, or of links, by the columns that its buckets go by; of compacted parts one partition is opened."""
        parts = self.manifests.read().tables.get(name, [])
        same = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items()))
        found = []
        for p in parts:
            rows = self.spark.read.parquet(p.path)
            if p.buckets and set(BUCKETED[name]) <= set(values):
                rows = rows.where(F.col("_bucket") == self._bucket(name, p.buckets, [F.lit(values[c]) for c in BUCKETED[name]]))
            found.append(rows.where(same).drop("_bucket"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest doesn't name; how many. No writer or reader of an older version may be at work."""
        from memlake.sources.scratch import hadoop_path

        live = {p.path.rsplit("/", 1)[1] for parts in self.manifests.read().tables.values() for p in parts}
        gone = 0
        for name in self.manifests.read().tables:
            fs, p = hadoop_path(self.spark, f"{self.path}/data/{name}")
            for x in fs.listStatus(p):
                if x.getPath().getName() not in live:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
