"""The functions and a store in SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memlake.functions import sql
from memlake.sources.store import Store
from memlake.sources.turns import event_turns

TEXTS = ['Alice Smith met Bob on 3 May 2021 in January, "red door" yesterday', "", None, "I live in City1; maybe.", "What road trips did we take last year?"]
VALUES = {
    "STRING": TEXTS, "ARRAY<STRING>": [["Alice Smith met Bob", "x"], [], None, ["a b", None, "kung fu and dancing"], ["The Harbor of Oslo"]], "ARRAY<DOUBLE>": [[1.0, 2.0], [0.5, -1.0], None, [], [0.0, 0.0]], "BIGINT": [3, 0, None, 7, 1],
}


@pytest.fixture(scope="module")
def named(spark):
    return sql.register(spark)


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_function_is_its_column(spark, named, name):
    arguments, body = sql.FUNCTIONS[name]
    rows = [tuple(VALUES[kind][(i + j) % 5] for j, (_, kind) in enumerate(arguments)) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{a} {kind}" for a, kind in arguments))
    df.createOrReplaceTempView("given")
    called = spark.sql(f"SELECT {sql.PREFIX}{name}({', '.join(a for a, _ in arguments)}) AS x FROM given")
    assert sorted(map(str, called.collect())) == sorted(map(str, df.select(body(*(a for a, _ in arguments)).alias("x")).collect()))
    assert "Python" not in called._jdf.queryExecution().executedPlan().toString()


def test_store_in_sql(spark, sf_dir, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.append(event_turns(spark, sf_dir).orderBy("seq").limit(60))
    names = sql.register_store(store)
    assert {"mem_events", "mem_state_of", "mem_root"} <= set(names)
    who = store.view("objects").first().subject
    state = spark.sql(f"SELECT * FROM mem_state_of('{who}')")
    assert state.count() == store.view("objects").where(F.col("subject") == who).count() > 0
    assert spark.sql(f"SELECT count(*) AS n FROM mem_history_of('{who}')").first().n >= state.count()
    session = store.table("events").first().session_id
    assert spark.sql(f"SELECT * FROM mem_events_of('{session}')").count() == store.table("events").where(F.col("session_id") == session).count()
