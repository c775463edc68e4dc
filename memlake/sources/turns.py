"""Turn sources: conversation JSON, dialogue samples, and tables that stand for turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import sanitize_id, strip

#: Columns of normalised turns; seq is the order of input over all sessions.
TURN_COLUMNS = ["corpus_id", "session_id", "speaker", "text", "timestamp", "metadata", "seq"]
#: 2024-01-01 in microseconds; the order number of event turns has room for a hundred days around it.
_START = 1_704_067_200_000_000
_KNOWN = ("session_id", "speaker", "role", "text", "content", "timestamp")


def _first_list(payload: Column, names) -> Column:
    """The first of the names that holds a list, as array<string> of JSON items."""
    items = [F.from_json(F.get_json_object(payload, f"$.{n}"), "array<string>") for n in names]
    return F.coalesce(*(F.when(F.startswith(strip(F.get_json_object(payload, f"$.{n}")), F.lit("[")), x) for n, x in zip(names, items, strict=True)))


def payload_turns(payload: Column | str) -> Column:
    """JSON turns of a payload: a list, or an object's first list of turns, conversation, messages; items that are no objects are dropped."""
    p = F.col(payload) if isinstance(payload, str) else payload
    listed = F.when(F.startswith(strip(p), F.lit("[")), F.from_json(p, "array<string>")).otherwise(_first_list(p, ("turns", "conversation", "messages")))
    return F.filter(listed, lambda x: F.startswith(strip(x), F.lit("{")))


def read_conversations(spark: SparkSession, path: str, corpus_id: str) -> DataFrame:
    """Normalised turns of JSON files, a payload each, in the order of file names and places; a payload without a list of turns fails the job."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))
    items = F.coalesce(payload_turns("payload"), F.raise_error(F.lit("payload has no list of turns")).cast("array<string>"))
    files = raw.select("file").distinct().withColumn("nth", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row for each file
    rows = raw.select("file", F.posexplode(items).alias("pos", "item")).join(files, "file")
    return normalize_json_turns(rows.select("item", (F.shiftleft("nth", 32) + F.col("pos")).alias("seq")), corpus_id)


def normalize_json_turns(items: DataFrame, corpus_id: str) -> DataFrame:
    """Turns from rows (item JSON, seq): aliases and defaults resolved, blank turns dropped, other keys kept as metadata."""
    get = lambda k: F.nullif(F.get_json_object("item", f"$.{k}"), F.lit(""))
    rest = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, v: ~k.isin(*_KNOWN))
    rows = items.select(
        F.lit(corpus_id).alias("corpus_id"), F.coalesce(get("session_id"), F.lit("session-1")).alias("session_id"), F.coalesce(get("speaker"), get("role"), F.lit("unknown")).alias("speaker"),
        strip(F.coalesce(get("text"), get("content"), F.lit(""))).alias("text"), get("timestamp").alias("timestamp"), F.to_json(rest).alias("metadata"), "seq",
    )
    return rows.where("text != ''").select(TURN_COLUMNS)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue samples (sample_id, conversation, qa) of JSON files that each hold a list; items that are no objects are dropped, and a file without a list fails the job."""
    raw = spark.read.text(path, wholetext=True).select("value")
    listed = F.coalesce(F.when(F.startswith(strip("value"), F.lit("[")), F.from_json("value", "array<string>")), F.raise_error(F.lit("file has no list of samples")).cast("array<string>"))
    items = raw.select(F.explode(listed).alias("item")).where(F.startswith(strip("item"), F.lit("{")))
    get = lambda k: F.get_json_object("item", f"$.{k}").alias(k)
    return items.select(get("sample_id"), get("conversation"), get("qa"))


def dialogue_turns(samples: DataFrame) -> DataFrame:
    """Turns of dialogue samples (sample_id, conversation JSON with lists session_N and strings session_N_date_time), sessions by number."""
    parts = F.from_json("conversation", "map<string,string>")
    rows = samples.select("sample_id", parts.alias("m")).select("sample_id", "m", F.explode("m").alias("name", "value")).where(F.col("name").rlike(r"^session_\d+$"))
    rows = rows.select("sample_id", F.regexp_extract("name", r"\d+", 0).cast("int").alias("n"), F.try_element_at("m", F.concat("name", F.lit("_date_time"))).alias("timestamp"), "name", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))
    get = lambda k: F.get_json_object("item", f"$.{k}")
    meta = F.to_json(F.struct(get("dia_id").alias("dia_id"), get("img_url").alias("img_url"), get("blip_caption").alias("blip_caption")))
    rows = rows.select(sanitize_id("sample_id").alias("corpus_id"), F.col("name").alias("session_id"), F.coalesce(get("speaker"), F.lit("unknown")).alias("speaker"), strip(F.coalesce(get("text"), F.lit(""))).alias("text"), "timestamp", meta.alias("metadata"), (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("seq"))
    return rows.where("text != ''").select(TURN_COLUMNS)


def dialogue_questions(samples: DataFrame) -> DataFrame:
    """Questions of dialogue samples (sample_id, qa JSON list)."""
    rows = samples.select("sample_id", F.posexplode(F.from_json("qa", "array<string>")).alias("i", "item"))
    get = lambda k: F.get_json_object("item", f"$.{k}")
    return rows.select("sample_id", F.coalesce(get("qa_id"), F.concat("sample_id", F.lit("-qa-"), F.col("i") + 1)).alias("qa_id"), get("question").alias("question"), F.coalesce(get("answer"), F.lit("")).alias("answer"), F.from_json(get("evidence"), "array<string>").alias("evidence"), get("category").alias("category"))


def conversation_turns(spark: SparkSession, sf_dir: str, corpus_id: str = "conv") -> DataFrame:
    """The conversations table as turns."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.lit(corpus_id).alias("corpus_id"), F.concat(F.lit("session-"), "conv_id").alias("session_id"), F.coalesce("role", F.lit("unknown")).alias("speaker"), strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(None).cast("string").alias("timestamp"), F.lit("{}").alias("metadata"), F.col("turn").cast("long").alias("seq")).where("text != ''")


def event_turns(spark: SparkSession, sf_dir: str, corpus_id: str = "ev") -> DataFrame:
    """The events table as turns whose texts exercise the state logic (see FIXTURES.md)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.floor("value").cast("long") % 7
    s = n.cast("string")
    text = (
        F.when(F.col("event_type") == "signup", F.when(n == 0, "I live in City1 downtown.").when(n == 5, "My flat is located in Town5.").otherwise(F.concat(F.lit("I live in City"), s, F.lit("."))))
        .when(F.col("event_type") == "purchase", F.when(n == 5, "Maybe my job is at Acme5.").otherwise(F.concat(F.lit("My job: I work at Acme"), s, F.lit("."))))
        .when(F.col("event_type") == "view", F.concat(F.lit("I prefer Brand"), s, F.lit(".")))
        .when(F.col("event_type") == "click", F.concat(F.lit("I want to visit City"), s, F.lit(" for stress relief today.")))
        .otherwise(F.concat(F.lit("The job failed with Code"), s, F.lit(".")))
    )
    return e.select(
        F.lit(corpus_id).alias("corpus_id"), F.concat(F.lit("session-"), F.dayofmonth("ts")).alias("session_id"), F.concat(F.lit("User"), "user_id").alias("speaker"), text.alias("text"),
        F.date_format("ts", "h:mm a 'on' d MMMM, yyyy").alias("timestamp"), F.lit("{}").alias("metadata"), ((F.unix_micros(F.col("ts").cast("timestamp")) - _START) * 1_000_000 + F.col("event_id")).alias("seq"),
    )
