"""What several operators of this subpackage share: work folders, written intermediates, components."""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_open: list[list[str]] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a folder of our own only where it is unset.

    Our own folder is the driver's alone, so a session whose tasks run elsewhere must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="memlake-")
    return _own_root[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    folder = f"{work_root(spark)}/memlake-{tag}-{uuid.uuid4().hex[:12]}"
    for made in _open:
        made.append(folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete the folders of written() tables that no later plan reads."""
    for df in tables:
        for f in {posixpath.dirname(x) for x in df.inputFiles()}:
            if "/memlake-" in f:
                _delete(df.sparkSession, f)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that the driver names within the block at its end, but for those of tables given to the yielded keep()."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(posixpath.dirname(x) for x in df.inputFiles())
        return df

    made: list[str] = []
    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        names = {posixpath.basename(k) for k in kept}
        for f in made:
            if posixpath.basename(f) not in names:
                _delete(spark, f)


def broadcastable(df: DataFrame) -> bool:
    """Whether the files of a written table are below the size up to which Spark broadcasts a side of a join."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for explicit round-robin deals of small tables of jobs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def byte_slices(column, most: int = 4 << 20, rows: int = 1000):
    """Bounds (a, b) of consecutive slices of an Arrow column of texts, of at most `most` bytes or one row, and at most `rows` rows."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for b, n in enumerate(sizes.tolist()):
        if b > a and (total + n > most or b - a == rows):
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


# ---------------------------------------------------------------- files that executors write and read


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, parts) -> None:
    """Write atomically under a name of the attempt's own, then rename: a repeated task leaves one whole file."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        with open(temp, "wb") as out:
            for x in parts:
                out.write(x)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(temp) as out:
        for x in parts:
            out.write(x)
    store.move(temp, path)


def get_file(uri: str) -> bytes:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


# ---------------------------------------------------------------- connected components

_MASKS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x7FEB352D846CA68B)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of edges reaches.

    Contraction: every node hooks to the least of its neighbours under an order that a round's XOR mask
    sets, two rounds of pointer doubling shorten the chains, and edges are mapped to the hooked nodes and
    made distinct; edges shrink by a constant factor a round, so rounds grow with the log of the nodes.
    Each round's tables are written to the shared folder. Minima are pre-aggregated and all joins are
    plain equi-joins, whose hot keys Spark splits. Nulls and loops are ignored; no edges: no rows.
    """
    e = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct()
    e = written(e, "edges")
    nodes = written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    label, r, done = nodes.withColumn("root", F.col("node")), 0, [e, nodes]
    while not e.isEmpty():
        mask = F.lit(_MASKS[r % len(_MASKS)])
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("p")).select("p.*")
        hook = written(both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m")).select(F.col("a").alias("x"), F.col("m").bitwiseXOR(mask).alias("h")), "hook")
        done.append(hook)
        for _ in range(2):
            via = hook.select(F.col("x").alias("h"), F.col("h").alias("hh"))
            hook = written(hook.join(via, "h").select("x", F.col("hh").alias("h")), "hook")
            done.append(hook)
        ha, hb = hook.toDF("a", "ha"), hook.toDF("b", "hb")
        moved = e.join(ha, "a").join(hb, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).where("a < b").distinct()
        e = written(moved, "edges")
        done.append(e)
        label = label.join(hook.toDF("root", "h"), "root", "left").select("node", F.coalesce("h", "root").alias("root"))
        r += 1
    label = written(label, "label")
    least = written(label.groupBy("root").agg(F.min("node").alias("component")), "least")
    out = written(label.join(least, "root").select("node", "component"), "component")
    drop_written(*done, label, least)
    return out


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def class_sample(df: DataFrame, label: str, key: str, per_class: int, most_rows: int | None = None) -> DataFrame:
    """About per_class rows of each label, or fewer where that would be more than most_rows in all, chosen by a hash of key; both bounds are the caller's documented parameters.

    Class counts come from label alone (a pruned scan); then one scan keeps rows whose hash falls below
    the class's fraction. Rows with a null label are left out. Labels with equal fractions share one comparison.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return df.where(F.lit(False))
    each = per_class if most_rows is None else max(1, min(per_class, most_rows // len(counts)))
    u = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    common = {v: n for v, n in counts.items() if n > each}
    keep = F.col(label).isNotNull() & ~F.col(label).isin(list(common)) if common else F.col(label).isNotNull()
    for value, n in sorted(common.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(label) == F.lit(value)) & (u < F.lit(each / n)))
    return df.where(keep)
