"""URL filtering by association rules, in DataFrame and SQL functions alone.

A URL is a set of tokens: its scheme, every suffix of its host, its path's segments (numbers as one token), the file
ending, the names of its query's fields, and whether it has a fragment. FP-growth mines the combinations that labelled URLs
hold often enough together with a label; a rule stays if the label's share is surely enough, at the lower end of its
interval, above the label's share of all, and if no shorter rule is as sure of the same label. Matching goes by an inverted
index: URLs' tokens meet the rules filed under each rule's rarest token, and the rule's other tokens are then looked up
in the URL's set. Written rules come first; among mined rules of both verdicts the surest decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import drop_written, written

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Written:
    """A rule for a host, its subdomains, and the paths that begin as this one does."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Written(BLOCK, "com", "/en/"), Written(ALLOW, "example.com", "/en/7"), Written(ALLOW, "net", "/de/"), Written(BLOCK, "example.net", "/de/8"), Written(BLOCK, "org", "/es/"))


def _rest(url: str) -> Column:
    """What follows the first ://, or null."""
    return F.expr(f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) end")


def host(url: str = "url") -> Column:
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Written, host: str = "host", path: str = "path") -> Column:
    return ((F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)) & F.col(path).startswith(rule.path)


def written_rule(rules: tuple[Written, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        text, verdict = F.when(fits(r), r.text).otherwise(text), F.when(fits(r), r.verdict).otherwise(verdict)
    return text, verdict


def tokens(url: str = "url", host: str = "host", path: str = "path") -> Column:
    """Distinct tokens of a URL."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(x, r"\.\w+$", ""), r"\d+", "#")))
    ending = F.filter(F.array(F.regexp_extract(F.col(path), r"\.(\w+)$", 1)), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    scheme = F.filter(F.array(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(\w+)://", 1)), lambda x: x != "")
    fragment = F.when(F.coalesce(F.col(url), F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    named = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_distinct(F.concat(F.when(F.col(host) != "", suffixes).otherwise(F.array().cast("array<string>")), parts, named("ending", ending), named("field", names), named("scheme", scheme), fragment))


def _token_classes(rows: DataFrame, total: int, blocked: int, least: int) -> DataFrame:
    """(token, n, lean, class) of the tokens that at least `least` rows of one verdict hold, but not all rows.

    Tokens that the very same rows hold are one class, told by two hashes of the rows' numbers: any combination of them holds in
    the same rows, so mining them apart would double the combinations with each. What all rows hold tells nothing. lean is
    how far the share of blocked rows is from that of all rows.
    """
    each = rows.select("row", "verdict", F.explode("items").alias("token"))
    by_verdict = each.groupBy("token", "verdict").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit("again"))).alias("g"))
    block = F.sum(F.when(F.col("verdict") == BLOCK, F.col("n")).otherwise(0))
    stats = by_verdict.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.abs(block / F.sum("n") - blocked / total).alias("lean"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    return stats.where((F.col("most") >= least) & (F.col("n") < total)).select("token", "n", "lean", F.hex(F.xxhash64("n", "h", "g")).alias("class"))


def _counted(sets: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set, verdict, hits, n): in how many rows of held(items, verdict) each set of classes holds, and with which verdict. A set meets the rows that hold its rarest class."""
    filed = sets.select("set", F.explode("set").alias("class")).join(sizes, "class").groupBy("set").agg(F.min_by("class", F.struct("n", "class")).alias("class"))
    met = held.select("items", "verdict", F.explode("items").alias("class")).join(filed, "class").where(F.size(F.array_except("set", "items")) == 0)
    hits = met.groupBy("set", "verdict").agg(F.count("*").alias("hits"))
    return hits.join(hits.groupBy("set").agg(F.sum("hits").alias("n")), "set")


def _grown(held: DataFrame, tail: DataFrame, sizes: DataFrame, shares: dict[str, int], floor: int, confidence: float) -> DataFrame:
    """(set): all sets of classes that hold a class of tail(class) and may be rules of held(row, verdict, items), which are all of held's rows that hold one.

    Level by level, a set is extended by the classes that its rows hold and that follow its last one, tail's first and then the rarer.
    A set is given up for a verdict only where no set that holds it can be a rule that stays: where too few of its rows have the
    verdict; where it has as many other rows as it has without one of its classes, which is then no less sure with any class added; or
    where a part of it is already as sure as rows of that verdict alone would be. So no set that mine() keeps is lost, however wide rows are.
    """
    order = sizes.join(tail.withColumn("cut", F.lit(0)), "class", "left").select("class", F.struct(F.coalesce("cut", F.lit(1)).alias("cut"), "n", "class").alias("c"))
    rows = held.select("row", "verdict", F.explode("items").alias("class")).join(order, "class").groupBy("row", "verdict").agg(F.array_sort(F.collect_list("c")).alias("items"))
    bags = written(rows.groupBy("items", "verdict").agg(F.count("*").alias("times")).withColumn("bag", F.monotonically_increasing_id()), "bags")
    first = F.filter("items", lambda x: x["cut"] == 0)
    at = bags.select("bag", F.explode(F.transform(first, lambda x: F.array(x))).alias("set"))
    made, before, proposed = [bags], None, []
    base = F.create_map(*(F.lit(x) for v in (ALLOW, BLOCK) for x in (v, shares.get(v, 0) / sum(shares.values()))))
    while True:
        n = at.join(bags, "bag").groupBy("set").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("times")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)))
        each = n.select("set", F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("hits"), F.col(w).alias("other")) for v, w in ((ALLOW, BLOCK), (BLOCK, ALLOW))))).alias("x")).select("set", "x.*").where(F.col("hits") >= floor)
        each = each.withColumn("best", F.greatest(sureness(F.col("hits"), F.col("hits") + F.col("other")), base[F.col("verdict")]))
        if before is not None:
            # The set without each of its classes but the first, which keeps it among the sets of a class of tail.
            less = F.transform(F.sequence(F.lit(2), F.size("set")), lambda i: F.concat(F.slice("set", F.lit(1), i - 1), F.slice("set", i + 1, F.size("set"))))
            parts = each.select("verdict", F.col("set").alias("whole"), F.explode(less).alias("set")).join(before.select("set", "verdict", F.col("other").alias("had"), F.col("best").alias("s")), ["set", "verdict"])
            parts = parts.groupBy(F.col("whole").alias("set"), "verdict").agg(F.count("*").alias("parts"), F.min("had").alias("had"), F.max("s").alias("s"))
            each = each.join(parts, ["set", "verdict"]).where((F.col("parts") == F.size("set") - 1) & (F.col("other") < F.col("had")))
            each = each.select("set", "verdict", "hits", "other", F.greatest("best", "s").alias("best"))
        each = written(each, "level")
        made.append(each)
        proposed.append(each.select("set"))
        most = sureness(F.col("hits"), F.col("hits"))
        before = each.where((most > F.col("best")) & (most >= confidence))
        if before.isEmpty():
            break
        alive = at.join(before.select("set").distinct(), "set")
        more = alive.join(bags.select("bag", "items"), "bag").select("bag", "set", F.explode(F.filter("items", lambda x: x > F.element_at("set", -1))).alias("x"))
        at = written(more.select("bag", F.concat("set", F.array("x")).alias("set")), "grown")
        made.append(at)
    out = written(reduce(DataFrame.union, proposed).select(F.array_sort(F.transform("set", lambda x: x["class"])).alias("set")).distinct(), "proposed")
    drop_written(*made)
    return out


def sureness(hits: Column, n: Column, z: float = 2.58) -> Column:
    """Lower end of Wilson's interval of the share hits / n; z = 2.58: of 99 %."""
    return (hits / n + z * z / (2 * n) - z * F.sqrt(hits * (n - hits) / n + z * z / 4) / n) / (1 + z * z / n)


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = 20, widest: int = 10) -> DataFrame:
    """Rules (rule, verdict, need array, token, sure, confidence, hits) from labelled(items array, verdict).

    A rule is a set of tokens that hold with a label in at least the share `support` of labelled rows and in `least` rows, of
    which surely (see sureness()) a share of at least `confidence` has the label. Rules no surer than the label's share
    of all rows, and rules of which a proper subset is no less sure of the same label, are pruned: they could decide nothing.
    need holds all tokens of a class; token is the rarest of need. Sets may have any number of tokens. FP-growth lists all
    combinations that rows hold, which double with each class of a row, so it is given the classes that stand in no row behind
    the `widest` of the row that lean most to a verdict. All sets that hold one of the other classes are found by _grown(), so
    `widest` changes no result. All that is proposed is counted on all rows. Null or empty token sets hold no rule.
    """
    spark = labelled.sparkSession
    schema = "rule long, verdict string, need array<string>, token string, sure double, confidence double, hits long"
    rows = written(labelled.select(F.monotonically_increasing_id().alias("row"), "items", "verdict"), "labelled")
    shares = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}  # two verdicts
    total = sum(shares.values())
    floor = max(least, math.ceil(support * total))
    if total < floor:
        return spark.createDataFrame([], schema)
    classes = written(_token_classes(rows, total, shares.get(BLOCK, 0), floor), "classes")
    own = F.array_sort(F.collect_set(F.struct((-F.col("lean")).alias("lean"), (-F.col("n")).alias("n"), "class")))
    held = written(rows.select("row", "verdict", F.explode("items").alias("token")).join(classes, "token").groupBy("row", "verdict").agg(F.transform(own, lambda x: x["class"]).alias("items")), "held")
    label = F.concat(F.lit("label:"), "verdict")
    tail = written(held.where(F.size("items") > widest).select(F.explode(F.slice("items", widest + 1, F.size("items"))).alias("class")).distinct(), "tail")
    wide, core, grown = not tail.isEmpty(), held, None
    if wide:
        own = held.select("row", "verdict", F.explode("items").alias("class")).join(tail, "class", "left_anti")
        core = held.select("row", "verdict").join(own.groupBy("row").agg(F.collect_list("class").alias("items")), "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    baskets = core.select(F.concat("items", F.array(label)).alias("items")).union(rows.join(held.select("row"), "row", "left_anti").select(F.array(label)))
    baskets = written(baskets, "baskets")
    is_label = lambda x: x.startswith("label:")
    proposed = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / total, minConfidence=confidence).fit(baskets).associationRules
    proposed = proposed.where(is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label)).select(F.array_sort("antecedent").alias("set"))
    sizes = classes.select("class", "n").distinct()
    proposed = proposed.union(sizes.select(F.array("class")))
    if wide:
        holds = held.select("row", F.explode("items").alias("class")).join(tail, "class").select("row").distinct()
        grown = _grown(held.join(holds, "row"), tail, sizes, shares, floor, confidence)
        proposed = proposed.union(grown)
    counted = _counted(proposed.distinct(), held, sizes)
    found = counted.where(F.col("hits") >= floor).select("verdict", "set", (F.col("hits") / F.col("n")).alias("confidence"), "hits", sureness(F.col("hits"), F.col("n")).alias("sure"))
    base = F.create_map(*(F.lit(x) for v, n in sorted(shares.items()) for x in (v, n / total)))
    found = found.where((F.col("sure") >= confidence) & (F.col("sure") > base[F.col("verdict")]))
    found = written(found.withColumn("rule", F.xxhash64("verdict", "set")), "rules")
    # A rule's subsets are the rules filed under a class of its own all of whose classes it holds.
    parts = found.select("verdict", F.col("set").alias("part"), F.col("sure").alias("s"), F.element_at("set", 1).alias("class"))
    wider = found.where(F.size("set") > 1).select("rule", "verdict", "set", "sure", F.explode("set").alias("class"))
    covered = wider.join(parts, ["verdict", "class"]).where((F.size("part") < F.size("set")) & (F.col("s") >= F.col("sure")) & (F.size(F.array_except("part", "set")) == 0))
    kept = found.join(covered.select("rule").distinct(), "rule", "left_anti")
    named = kept.select("rule", F.explode("set").alias("class")).join(classes, "class").groupBy("rule").agg(F.array_sort(F.collect_list("token")).alias("need"), F.min_by("token", F.struct("n", "token")).alias("token"))
    out = written(kept.join(named, "rule").select("rule", "verdict", "need", "token", "sure", "confidence", "hits"), "mined")
    drop_written(rows, classes, held, baskets, found, tail, *([grown] if wide else []))
    return out


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, verdict, sure): the verdict of the surest rule that fits each distinct set of urls(items); sets that no rule fits are left out.

    Inverted index: a rule is filed under its rarest token; equality on tokens finds candidates, whose other
    tokens are looked up in the set. Among rules as sure as each other the one of more hits decides, then of more tokens, then block.
    """
    index = rules.select("token", "need", F.struct("sure", "hits", F.size("need").alias("n"), "verdict").alias("hit"))
    sets = urls.select("items").distinct()
    met = sets.select("items", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("need", "items")) == 0)
    return met.groupBy("items").agg(F.max("hit").alias("hit")).select("items", F.col("hit.verdict").alias("verdict"), F.col("hit.sure").alias("sure"))


def judge(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules: tuple[Written, ...] = RULES, default: str = ALLOW, **options) -> DataFrame:
    """(page, host, path, rule, verdict, mined_sure) of every row.

    labels(doc_id, quality, toxic) label the document whose number ends a URL's path: block where it is toxic or of low
    quality, else allow. Nulls in labels count as unlabelled, and of repeated labels any block wins. The longest written
    rule that fits decides, else the surest mined rule of either verdict, else `default`. Null URLs and URLs without :// have
    an empty host and path and no tokens; URLs may be of any length; null ids and repeated rows are kept; empty tables give no
    rows or no mined rules; other columns aren't read. options go to mine().
    """
    text, verdict = written_rule(rules)
    rows = pages.select(F.col(page).alias("id"), F.col(url).cast("string").alias("url")).withColumns({"host": host(), "path": path()})
    rows = rows.withColumns({"items": tokens(), "rule": text, "ruled": verdict})
    mined = mine(labelled_urls(rows, labels), **options)
    # Sets are known by two hashes, so that what is joined back is small and its size does not depend on the sets'.
    key = lambda: (F.xxhash64("items").alias("h"), F.xxhash64("items", F.lit("again")).alias("g"))
    hits = written(matched(rows, mined).select(*key(), F.col("verdict").alias("mined"), F.col("sure").alias("mined_sure")), "hits")
    out = rows.select("*", *key()).join(hits, ["h", "g"], "left")
    return out.select(F.col("id").alias(page), "host", "path", "rule", F.coalesce("ruled", "mined", F.lit(default)).alias("verdict"), "mined_sure")


def labelled_urls(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(items, verdict) of the rows(path, items) whose path ends in the number of a labelled document."""
    number = F.expr("try_cast(nullif(regexp_extract(path, '(\\\\d+)(?:\\\\.\\\\w+)?/?$', 1), '') as bigint)")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marks = labels.select("doc_id", bad.alias("bad")).where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    held = rows.select("items", number.alias("doc_id")).where("doc_id is not null").join(marks, "doc_id")
    return held.select("items", F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW).alias("verdict"))
