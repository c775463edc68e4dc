"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 majority bits of the XXH64 of word shingles. Index: each distinct fingerprint stands in two
tables, under its high and its low 32 bits. Two fingerprints that differ in at most 2 bits differ in at most 1
bit of the high segment, or not at all in the low one: so each probes the high table with the 33 values of
the radius-1 ball of its high segment, and the low table with its own value; whole distances are verified.

Buckets of more than `bucket` fingerprints are not joined by pairs. Whatever probes such a bucket goes an exact
other way: it is filed under all 65 values of its own radius-1 ball over 64 bits, since fingerprints are within
2 bits just when their balls meet, and what shares a value is linked to the value's smallest holder: a chain
through a shared value has the same components as its pairs, without the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, connected_components, drop_written, written

_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Of UTF-8 text; null or no words: 0. Fewer words than a shingle's: the whole sequence is the one shingle."""
    w = (text or b"").lower().split()  # on bytes: A-Z, and \x20 \x09-\x0D, only
    if not w:
        return 0
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(line, seed)
    ends = np.cumsum([len(x) + 1 for x in w])
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(w) - words + 1)
    lanes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = lanes @ _BITS  # (byte, bit), bytes little-endian
    return int.from_bytes(np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp long) of every row's whole text; fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                cut = batch.slice(a, b - a)
                fp = np.array([fingerprint(t, words) for t in cut.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(fp)], names=["k", "fp"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_pairs(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (a, b) among distinct fingerprints fps(fp): all pairs within 2 bits that small buckets hold, and links through shared ball values for the rest.

    Spark sizes an exploded table by the rows before the explode, so it would broadcast the balls of a table of a few MB, 33 or 65 times
    as many rows: they are joined by a merge, never broadcast.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.expr("transform(sequence(0, 31), i -> shiftleft(1L, i))")
    entry = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("t"), high.alias("v")), F.struct(F.lit(1).alias("t"), low.alias("v")))).alias("e")).select("fp", "e.*")
    balls = F.concat(F.array(F.struct(F.lit(0).alias("t"), high.alias("v")), F.struct(F.lit(1).alias("t"), low.alias("v"))), F.transform(flips, lambda m: F.struct(F.lit(0).alias("t"), high.bitwiseXOR(m).alias("v"))))
    probe = fps.select("fp", F.explode(balls).alias("e")).select(F.col("fp").alias("p"), "e.*")
    sizes = written(entry.groupBy("t", "v").agg(F.count("*").alias("n")), "sizes")
    small = written(entry.join(sizes.where(F.col("n") <= bucket), ["t", "v"], "left_semi"), "small")
    pairs = probe.hint("merge").join(small, ["t", "v"]).where((F.col("p") < F.col("fp")) & (_distance("p", "fp") <= 2)).select(F.col("p").alias("a"), F.col("fp").alias("b"))
    # p < fp alone would lose a probe that only the larger makes, but radius-1 balls and equal segments are symmetric.
    large = sizes.where(F.col("n") > bucket).select("t", "v")
    crowded = written(probe.join(large, ["t", "v"], "left_semi").select(F.col("p").alias("fp")).distinct(), "crowded")
    ball64 = F.concat(F.array(F.col("fp")), F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"))
    star = crowded.select("fp", F.explode(ball64).alias("v"))
    centre = written(star.groupBy("v").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("v", "a"), "centre")
    links = star.hint("merge").join(centre, "v").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    edges = written(pairs.union(links), "links")
    drop_written(sizes, small, crowded, centre)
    return edges


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bucket: int = 64) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of at most 2 differing bits.

    Equal fingerprints, so all texts without words too, are one class and link as any other. A null text
    counts as empty; rows with a null key join classes but name none (a class of null keys alone has a null
    component_id); repeated rows each give a row; an empty table gives none; other columns, whatever their names, aren't read.
    Texts of any length are hashed whole, one at a time, in slices of bounded size.
    """
    docs = written(fingerprints(df, key, text, words).withColumnRenamed(key, "k"), "fingerprints")
    classes = written(docs.groupBy("fp").agg(F.min("k").alias("least")), "classes")
    edges = near_pairs(classes.select("fp"), bucket)
    comp = connected_components(edges).withColumnRenamed("node", "fp")
    of = written(classes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "of")
    least = written(of.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    known = written(of.join(least, "component").select("fp", "component_id"), "known")
    drop_written(edges, classes, of, least)
    return docs.join(known, "fp").select(F.col("k").alias(key), "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
