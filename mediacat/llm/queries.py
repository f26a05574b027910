"""The numbered operators over the given tables: job logs are `documents`, their ids `doc_id`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import (
    archives, centroids, decontamination, exchanges, jaccard, licences, packing, passages, quality, sharding, suffixes, templates, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def as_logs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    return as_logs(spark.read.parquet(f"{folder}/documents.parquet"))


def _by_doc(result: DataFrame) -> DataFrame:
    return result.withColumnRenamed("job_id", "doc_id")


@query
def op1_passage_doubling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of 13-word passages that a document with a smaller id has, removed."""
    return _by_doc(passages.remove_repeats(_logs(spark, folder)).drop("kept"))


@query
def op2_cover_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of 400-byte strings that occur a second time anywhere, removed."""
    found = suffixes.remove_long_repeats(_logs(spark, folder))
    return _by_doc(found.drop("kept", "span_starts", "span_ends"))


# Words are lists; a window is thirteen of them joined.
ORACLES["op1_passage_doubling"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
), firsts AS (
  SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE f < doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS txt, count(g.p) AS n_removed
  FROM placed a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as token pieces in sequences of at most 4096 ids."""
    return _by_doc(packing.pack_pieces(packing.token_pieces(_logs(spark, folder), tokenizer_file())))


@query
def op4_line_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Line-first cleaning: line rules, then logs that lose too much text."""
    return _by_doc(quality.clean_logs(_logs(spark, folder)).drop("cleaned"))


def benchmark_items(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's texts as questions and answers: the last sentence of each is its answer."""
    rows = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    sentences = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\w"))
    most = F.slice(sentences, F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(0)))
    question = F.when(F.size(sentences) > 1, F.array_join(most, " ")).otherwise(F.col("text"))
    return rows.select("item_id", question.alias("question"), F.coalesce(F.try_element_at(sentences, F.lit(-1)), F.lit("")).alias("answer"))


@query
def op5_bm25_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items: one row for each document and item."""
    return _by_doc(decontamination.find_leaks(_logs(spark, folder), benchmark_items(spark, folder), split=True))


@query
def op6_incidence_product(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by a shingle similarity of 0.75 or more."""
    return _by_doc(jaccard.link_logs(_logs(spark, folder)))


# The sets pair by pair, then everything that links lead to.
ORACLES["op6_incidence_product"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""


@query
def incidence_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What op6 gives, and how many documents each document links to itself."""
    return _by_doc(jaccard.link_logs(_logs(spark, folder), counts=True))


# The SQL of op6 and a count of each document's links.
ORACLES["incidence_link_counts"] = ORACLES["op6_incidence_product"].replace(
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,",
    "SELECT d.doc_id, (SELECT count(*) FROM ways WHERE ways.a = d.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles,",
)


@query
def op7_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    got = archives.archive_lookups(pages, "page_id", "url", "html")
    return got.select(
        F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"),
    )


ORACLES["op7_warc_salvage"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages
), s AS (
  SELECT page_id, payload_digest, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
    min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM s
"""


@query
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in all documents, a row for each paragraph."""
    logs = _logs(spark, folder)
    classifier = licences.learn_licences(spark, licences.paragraphs_of(logs))
    return _by_doc(licences.scan_licences(logs, classifier))


@query
def op9_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of nearly equal bytes by sampled splitters."""
    return _by_doc(sharding.shard_logs(_logs(spark, folder)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity labels that may be learnt from: job_id and doc_id (the same), toxic."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out())
    return labels.select(F.col("doc_id").alias("job_id"), "doc_id", "toxic")


@query
def op10_factorization_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text; labels of held-out rows are not learnt from."""
    logs = _logs(spark, folder)
    machine = toxicity.learn_machine(logs, training_labels(spark, folder))
    scores = _by_doc(toxicity.score_logs(logs, machine))
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op11_checkpointed_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations after damage, repaired by the cheapest edits."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    lines = exchanges.damaged(rows, "conv_id", "turn", "role", "text")
    return exchanges.exchange_digests(exchanges.repair_exchanges(lines)).withColumnRenamed("job_id", "conv_id")


@query
def op12_incremental_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds, in whole numbers."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = centroids.cluster_speeds(vectors, "vec_id", "embedding").withColumnRenamed("node_id", "vec_id")
    print_of = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.withColumn("centroid_sha256", print_of).drop("centroid")


def _rounds_sql(rounds: int) -> str:
    """Each round as two tables: the nearest centroid of every vector, then the centroids' floors of means."""
    near = """
a{r} AS MATERIALIZED (
  SELECT vec_id, v, list_min(list_transform(cs, lambda s: {{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - s.c[i]) * (v[i] - s.c[i]))), 'j': s.j}})) AS m
  FROM v, (SELECT list({{'j': j, 'c': c}} ORDER BY j) AS cs FROM c{r})
)"""
    move = """, t{n} AS (
  SELECT m.j AS j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS u(i) GROUP BY m.j, i
), f{n} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM t{n} GROUP BY j
), c{n} AS MATERIALIZED (
  SELECT c{r}.j, coalesce(f{n}.c, c{r}.c) AS c FROM c{r} LEFT JOIN f{n} ON f{n}.j = c{r}.j
),"""
    return "".join(near.format(r=r) + (move.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))


# All distances anew in every round.
ORACLES["op12_incremental_distances"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS j, v AS c FROM v ORDER BY j LIMIT 8
),{_rounds_sql(10)}, e AS (
  SELECT m.j AS j, CAST(sum(m.d) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY m.j
)
SELECT vec_id, m.j AS cluster, CAST(m.d AS BIGINT) AS distance, cluster_inertia,
  CAST((SELECT sum(cluster_inertia) FROM e) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN e ON e.j = m.j JOIN c10 ON c10.j = m.j
"""


@query
def op13_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page by the template of its host."""
    return templates.extract_main_text(spark.read.parquet(f"{folder}/pages.parquet"))
