"""Registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from memlake.llm import decontaminate, embed_dedup, langid, lexical, merkle, piece_bpe, quality, secret_scan, simhash, token_ids, toxicity, url_rules, warc
from memlake.llm._shared import table


def op1_token_ids(spark, sf_dir):
    manifest = token_ids.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_ids.read_shards(manifest)


def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.components(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark, sf_dir):
    return piece_bpe.digests(piece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op4_warc(spark, sf_dir):
    got = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark, sf_dir):
    got = simhash.components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op6_decontaminate(spark, sf_dir):
    got = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"), F.round("cosine", 4).alias("cosine"))


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.train_on_documents(docs))
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_secrets(spark, sf_dir):
    return secret_scan.digests(secret_scan.spans_by_path(table(spark, sf_dir, "documents")))


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = quality.score(docs, quality.train_on_labels(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_rules(spark, sf_dir):
    got = url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op11_lexical(spark, sf_dir):
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.train_on_labels(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_ALL = (op1_token_ids, op2_embedding_dedup, op3_sentencepiece, op4_warc, op5_simhash, op6_decontaminate, op7_language, op8_secrets, op9_quality, op10_url_rules, op11_lexical, op12_toxicity, op13_merkle)
QUERIES = {f.__name__: f for f in _ALL}

_UNIT = "CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END"
_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# Eight steps of CRC-32 for each digit; its last bit is that of the result, inverted.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: i::BIGINT)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"
_CHANGED = "replace(text, chr(10), '')"


def _tree(name: str, grp: str, leaves: str) -> str:
    """Nodes (grp, lvl, k, h, n) of the ternary trees over leaves (grp, k, h, n)."""
    return f"{name} AS (SELECT {grp} AS grp, 0 AS lvl, k, h, n FROM {leaves} UNION ALL SELECT grp, lvl + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, lvl, k // 3, n)"


def _sides(tree: str, lvl: str) -> str:
    """Of each leaf (grp, p) and level the siblings on both sides."""
    return f"SELECT a.grp, a.k AS p, {lvl} AS lvl, coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (WHERE s.k < a.k // w), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.k) FILTER (WHERE s.k > a.k // w), '') AS r FROM (SELECT *, unnest(range(12)) AS v FROM {tree} WHERE lvl = 0) a, LATERAL (SELECT (3 ** a.v)::BIGINT AS w) JOIN {tree} s ON s.grp IS NOT DISTINCT FROM a.grp AND s.lvl = a.v AND s.n > 1 AND s.k // 3 = a.k // (3 * w) GROUP BY a.grp, a.k, a.v"


ORACLE_SQL: dict[str, str] = {
    "op11_lexical": f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS big_n, sum(len(t))::BIGINT AS big_l FROM d),
 p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, big_n),
 i AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
 s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), c GROUP BY item_id, doc_id)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_merkle": f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC} & 1 = 1 THEN {_leaf(_CHANGED)} ELSE {_leaf('text')} END AS held FROM documents),
 x AS (SELECT *, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM d),
 {_tree('t', 'grp', 'x')}, sub AS (SELECT grp AS source, h FROM t WHERE n = 1),
 y AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM sub), {_tree('u', "'all'", 'y')},
 low AS ({_sides('t', 'a.v')}), high AS ({_sides('u', '100 + a.v')}),
 steps AS (SELECT x.doc_id, x.source, x.k, lvl, l, r FROM x JOIN low ON low.grp IS NOT DISTINCT FROM x.source AND low.p = x.k
  UNION ALL SELECT x.doc_id, x.source, x.k, lvl, l, r FROM x JOIN y ON y.source IS NOT DISTINCT FROM x.source JOIN high ON high.p = y.k),
 path AS (SELECT source, k, string_agg(l || r, '' ORDER BY lvl) AS all_of, list(l || '|' || r ORDER BY lvl) AS steps FROM steps GROUP BY source, k),
 f AS (SELECT x.doc_id, x.leaf, y.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(all_of, '')) AS proof_sha256,
  list_reduce(list_concat([x.held], coalesce(steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM x JOIN y ON y.source IS NOT DISTINCT FROM x.source LEFT JOIN path ON path.source IS NOT DISTINCT FROM x.source AND path.k = x.k)
 SELECT *, folded_root = root AS verified FROM f""",
    "op2_embedding_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND {_COSINE} >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, vec_id = comp.c AS kept FROM e JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
 SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(d, CAST(1 + 10 * (i // 8) AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
}
