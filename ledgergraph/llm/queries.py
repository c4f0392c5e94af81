"""The registered queries of this subpackage and the SQL that checks them, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgergraph.llm import binary, counts, languages, licenses, negatives, packing, quality, quotient, sharding, simhash, spelling, templates, trees
from ledgergraph.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn
    return add


@query("op2_jump_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 24)


@query("op8_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_duplicates(documents(spark, sf_dir))


@query("op9_packed_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(documents(spark, sf_dir))


@query("op3_simhash_anchors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


@query("op4_retrieval_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


@query("op6_length_histogram")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.histogram(documents(spark, sf_dir))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op1_template_leaks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaked_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op10_license_scan", licenses.check_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op5_context_trees")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.score(documents(spark, sf_dir))


@query("op11_hyperdimensional_languages")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(documents(spark, sf_dir))


@query("op12_hilbert_negatives", """
    WITH raw AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
                 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
         v AS (SELECT row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM raw WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
         s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same,
                      list_inner_product(a.q, b.q)::BIGINT AS score
               FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row),
         p AS (SELECT anchor, anchor_id, other AS positive, id AS positive_id, score AS positive_score FROM s WHERE same
               QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, other) <= 5)
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id, s.other)::INT AS rank
    FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id, s.other) <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_spelling_chunks", """
    WITH RECURSIVE steps AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256)),
         crc AS (SELECT list(c ORDER BY b) AS t FROM steps),
         runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
         kinds AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs GROUP BY ALL),
         bytes AS (SELECT doc_id, run, n, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM kinds),
         marks AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
         slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM marks),
         words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
         holes AS (SELECT word, n, unnest(list_transform(range(1, len(word) + 1), lambda i: substr(word, 1, i - 1) || '*' || substr(word, i + 1))) AS hole FROM words),
         short AS (SELECT word, n, replace(hole, '*', '') AS hole FROM holes),
         pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
                   UNION SELECT a.word, b.word, b.n FROM short a JOIN words b ON a.hole = b.word
                   UNION SELECT b.word, a.word, a.n FROM short a JOIN words b ON a.hole = b.word),
         near AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM pairs GROUP BY word),
         forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
                          CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
         chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.*, c.root FROM forms f JOIN chain c USING (word) WHERE c.root NOT IN (SELECT word FROM forms WHERE form IS NOT NULL)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))
