"""One query for each operator of this subpackage and its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import (
    jaccard_join,
    language,
    line_dedup,
    maxent,
    mixing,
    neighbours,
    packing,
    quality_model,
    quality_rules,
    sharding,
    spelling,
    suffix_dedup,
    whitening,
)
from spanledger.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: run(configure(spark), folder)
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.fold("doc_id", 3) == 1
    model = language.fit_languages(docs.filter(~held_out))
    found = language.identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "language")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """DuckDB has no CRC-32, so there is no reference SQL; tests compare with a plain version."""
    docs = _table(spark, folder, "documents")
    return sharding.assign_shards(docs, [1.0] * 8, grown_weight=1.0).withColumn("law", F.lit("key"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.fold("doc_id", 4) == 2
    # The labels learned from are at most SAMPLE_ROWS rows, so they are the side to broadcast.
    labels = quality_model.sample_labels(_table(spark, folder, "labels").filter(~held_out))
    model = quality_model.fit_quality(docs.join(F.broadcast(labels), "doc_id"))
    return quality_model.score_quality(docs, model).withColumn("held_out", held_out)


@query(
    "op4_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i, lines[i] AS line,
             translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
           LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
    ), repeated AS (
      SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) > 1
    )
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (doc_id > keeper) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id <= keeper), '')) AS kept_sha256
    FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    report = line_dedup.line_report(_table(spark, folder, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_neighbours")
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack_documents(docs, clusters=packing.near_clusters(docs))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, folder, "documents"))


@query(
    "op9_mixing",
    r"""
    WITH slim AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 15))::BIGINT AS key
      FROM documents
    ), totals AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source
    ), ranked AS (
      SELECT *, 2.0::DOUBLE * source_size AS most,
             CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
      FROM totals
    ), levels AS (
      SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM ranked
    ), targets AS (
      SELECT source, source_size,
             least(most, coalesce(weight * (SELECT arg_min(level, most / weight) FROM levels WHERE most >= weight * level), most)) AS target
      FROM levels
    ), budgets AS (
      SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
    ), sums AS (
      SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs,
             CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id) - s.size AS before
      FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
    FROM sums
    """,
)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix_records(_table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op10_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
      FROM words
    ), items AS MATERIALIZED (
      SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), links AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach AS (
      SELECT a AS doc_id, a AS other FROM links
      UNION
      SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
    ), least AS (
      SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM sets LEFT JOIN least USING (doc_id)
    """,
)
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(_table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.fold("doc_id", 5) == 1
    model = maxent.fit_maxent(docs.filter(~held_out))
    return maxent.score_texts(docs, model).withColumn("held_out", held_out)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    whitened = whitening.whiten_vectors(vectors, whitening.fit_whitening(vectors))
    return whitening.components_table(whitened).withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_spelling")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """DuckDB has no CRC-32, so there is no reference SQL; tests compare with a plain version."""
    return spelling.spelling_variants(_table(spark, folder, "documents"))
