"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import shared_dir, table, write_table

Query = Callable[[SparkSession, str], DataFrame]


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    out = archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0, payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=100, digest=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_edits=0.2, recall=0.99)
    return found.select("doc_id", "contaminated", "n_items", "item_ids", "similarity")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import REPLY_SCHEMA, link, parse_messages, turns_as_messages

    parsed, folder = parse_messages(turns_as_messages(table(spark, sf_dir, "conversations"))), shared_dir(spark)
    calls, results = (write_table(x, folder, name) for x, name in zip(parsed, ("calls", "results")))  # parsed once
    out = link(calls, results, REPLY_SCHEMA)
    return out.select("conv_id", "turn", "call_id", "kind", "stage", F.array_join("errors", "; ").alias("errors"), "line")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import prefix_totals

    return prefix_totals(table(spark, sf_dir, "documents"), _public("piece_bpe_32k.model"), limit=4096)


def _remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``: the held-out rule."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(_remainder("doc_id", 4) != 2), rows_per_language=500)
    out = identify(docs, model, spans=False)
    return out.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels.where(_remainder("doc_id", 5) != 0), rows=3000)
    return score(docs, net, cutoff=0.3).select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"), capacity=4096, end_id=1, keep_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_quality, op3_jaccard_join, op4_best_fit_packing, op5_warc, op6_suffix_dedup, op7_decontaminate, op8_tool_calls, op9_token_counts, op10_exact_top_k, pipeline)}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
     n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM g GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
     l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
     c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
     k AS (SELECT same, min(doc_id) AS class_id FROM n GROUP BY same)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (same) LEFT JOIN c USING (doc_id)""",
    "op5_warc": """
WITH b AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages WHERE page_id IS NOT NULL),
     k AS (SELECT sha, max(page_id) AS keeper FROM b GROUP BY sha)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b JOIN k USING (sha)""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
     s AS (SELECT doc_id, CAST(unnest(range(octet_length(b) - 99)) AS BIGINT) AS i FROM d WHERE octet_length(b) >= 100),
     h AS (SELECT doc_id, i, md5(hex(b[i + 1:i + 100])) AS h FROM s JOIN d USING (doc_id)),
     t AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
     o AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS fresh FROM t),
     u AS (SELECT doc_id, i, sum(CASE WHEN fresh IS NULL OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
     x AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM u GROUP BY ALL),
     y AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM x),
     v AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1:a]) || CASE WHEN after IS NULL THEN hex(b[z + 1:]) ELSE '' END, '' ORDER BY a) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN v USING (doc_id)""",
    "op8_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
     c AS (SELECT conv_id, turn, n, text, 'c' || conv_id || '-' || turn AS call_id, CASE WHEN n % 13 = 0 THEN 'search' ELSE 'reply' END AS name,
                  CASE WHEN conv_id % 4 = 1 OR conv_id % 4 = 2 AND turn = 0 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS dep
           FROM t WHERE role IS DISTINCT FROM 'assistant'),
     k AS (SELECT c.*, d.turn IS NOT NULL AS known FROM c LEFT JOIN c d ON d.conv_id = c.conv_id AND d.turn = c.dep),
     late AS (SELECT DISTINCT conv_id FROM k WHERE known AND dep >= turn),
     s AS (SELECT conv_id, turn, CAST(1 AS BIGINT) AS depth FROM k WHERE NOT known
           UNION ALL SELECT k.conv_id, k.turn, s.depth + 1 FROM s JOIN k ON k.conv_id = s.conv_id AND k.known AND k.dep = s.turn),
     r AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
     p AS (SELECT k.*, late.conv_id IS NOT NULL AS late, CASE WHEN late.conv_id IS NULL THEN CAST(0 AS BIGINT) ELSE s.depth END AS stage
           FROM k LEFT JOIN late USING (conv_id) LEFT JOIN s ON s.conv_id = k.conv_id AND s.turn = k.turn)
SELECT p.conv_id, p.turn, p.call_id, 'call' AS kind, p.stage,
       concat_ws('; ', CASE WHEN name = 'search' THEN 'unknown tool' END, CASE WHEN name = 'reply' AND n % 7 = 0 THEN 'chars: not integer' END,
                 CASE WHEN name = 'reply' AND n % 5 = 0 THEN 'prompt: missing' END, CASE WHEN name = 'reply' AND n % 11 = 0 THEN 'extra: unexpected' END,
                 CASE WHEN dep IS NOT NULL AND NOT known THEN 'depends_on: unknown call' END, CASE WHEN p.stage IS NULL THEN 'depends_on: cycle' END,
                 CASE WHEN r.turn IS NULL THEN 'result: missing' END) AS errors,
       '{"arguments":{"chars":' || CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || CASE WHEN n % 11 = 0 THEN ',"extra":true' ELSE '' END
       || CASE WHEN n % 5 = 0 THEN '' ELSE ',"prompt":' || CAST(to_json(p.text) AS VARCHAR) END || '},"call_id":"' || p.call_id || '","kind":"call","name":"' || name || '"}' AS line
FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.call_id = p.call_id
UNION ALL
SELECT r.conv_id, r.turn, r.call_id, CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'result' END, p.stage, '',
       '{"call_id":"' || r.call_id || '","content":' || CAST(to_json(r.text) AS VARCHAR) || ',"kind":"' || CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'result' END || '"}'
FROM r LEFT JOIN p ON r.conv_id = p.conv_id AND r.call_id = p.call_id""",
    "op10_exact_top_k": """
WITH c AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
           FROM (SELECT * FROM c WHERE vec_id % 50 = 0) q JOIN c ON c.i = q.i AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
