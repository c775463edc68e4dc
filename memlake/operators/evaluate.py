"""Roll-ups of question answering and of ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import answers as A


def score(pairs: DataFrame, gold: str = "answer", predicted: str = "predicted") -> DataFrame:
    return pairs.withColumns({"em": A.exact_match(gold, predicted), "f1": A.f1(gold, predicted), "bleu1": A.bleu1(gold, predicted)})


def summary_columns():
    done = F.col("skipped") == F.lit(False)
    mean = lambda c, n: F.round(F.coalesce(F.avg(F.when(done, F.col(c))), F.lit(0.0)), n)
    return [
        F.count(F.when(done, 1)).alias("count"), F.count("*").alias("total"), F.count(F.when(~done, 1)).alias("skipped_count"), mean("em", 4).alias("em"), mean("f1", 4).alias("f1"), mean("bleu1", 4).alias("bleu1"),
        mean("elapsed_ms", 2).alias("elapsed_ms"), F.round(F.avg("judge"), 4).alias("judge"), F.count("judge").alias("judge_count"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    """Overall, by category and without adversarial questions, in one pass by grouping sets: (level, category, ...)."""
    rows = rows.withColumn("non_adversarial", F.col("category").isin(*A.NON_ADVERSARIAL))
    grouped = rows.groupingSets([[F.col("category")], [F.col("non_adversarial")], []], F.col("category"), F.col("non_adversarial")).agg(F.grouping("category").alias("gc"), F.grouping("non_adversarial").alias("gn"), *summary_columns())
    level = F.when(F.col("gc") == 0, "category").when(F.col("gn") == 0, "non_adversarial").otherwise("overall")
    return grouped.withColumn("level", level).where("level != 'non_adversarial' or non_adversarial").select("level", F.when(F.col("level") == "category", F.col("category")).alias("category"), "count", "total", "skipped_count", "em", "f1", "bleu1", "elapsed_ms", "judge", "judge_count")


def map_means(rows: DataFrame, column: str) -> DataFrame:
    """Mean and sum of each key of a map column over the rows that hold it."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


def judge_runs(rows: DataFrame, run: str = "run", value: str = "judge") -> DataFrame:
    """Mean of each run's mean, and the population's deviation of those means."""
    runs = rows.groupBy(run).agg(F.avg(value).alias("m"))
    return runs.agg(F.round(F.avg("m"), 6).alias("judge_mean"), F.round(F.stddev_pop("m"), 6).alias("judge_std"), F.count("*").alias("runs"))


def ingest_report(events: DataFrame, atoms: DataFrame, actions: DataFrame, links: DataFrame) -> DataFrame:
    """Counters of an append, a row for each metric."""
    n = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    written = actions.where("action != 'NONE'")
    out = n(events, "events_written").union(n(atoms, "atoms_written")).union(n(actions, "state_candidates")).union(n(written, "objects_written")).union(n(links, "evidence_links"))
    return out.union(actions.groupBy(F.concat(F.lit("action_"), "action").alias("metric")).agg(F.count("*").alias("value")))


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as one JSON-lines file under path; reports have a row for each metric."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def touched(events: DataFrame, actions: DataFrame) -> DataFrame:
    """(kind, name): the sessions and subjects that an append touched."""
    return events.select(F.lit("session").alias("kind"), F.col("session_id").alias("name")).union(actions.select(F.lit("subject"), "subject")).distinct()


def report_totals(reports: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """Samples' counters (sample, metric, value) summed and averaged over the samples that have them."""
    return reports.groupBy(by).agg(F.sum(value).alias("total"), F.round(F.avg(value), 2).alias("average"), F.count(value).alias("samples"))
