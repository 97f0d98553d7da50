"""The registered queries: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwave.llm import chat, clusters, decontam, langid, lm, media, packing, sharding, simhash, suffix, syncmers, toxicity, whitening
from quietwave.llm.common import crc_fold
from quietwave.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Only the clustering can be said in SQL; the others need learned models, hashes and tokenizers it lacks, or ordered state.
CHECKS: dict[str, str] = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold("doc_id", 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, distance=4)
    return groups.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op3_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.mark_texts(table(spark, sf_dir, "documents"), keep=["doc_id"], kept_text=False)


@query("op5_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    windows = chat.format_windows(turns.unionByName(extra), tokenizer_path("byte_bpe_50k.json"))
    return chat.read_back(windows)


@query("op6_external_shuffle_sharding")
def external_shuffle_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents go into the shards; sizes and checksums are taken from the texts read back from them."""
    docs = table(spark, sf_dir, "documents")
    placed = sharding.shuffle_into_shards(docs.withColumn("size", sharding.record_size("text")), "doc_id", "size", 24)
    path = fresh_path(spark, "sharded")
    sharding.write_shards(placed, path, placed=True)
    stored = sharding.read_shards(spark, path, placed.schema)
    return stored.select(
        "doc_id", sharding.record_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op7_media_columns")
def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.texts_to_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return media.media_features(stored).drop("tile")


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold("doc_id", 3)
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, fold != 1))
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold("doc_id", 5)
    held = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(12)) == 0
    scored = lm.score(docs, fold != 1, held)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_centroid_clustering")
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def _clustering_sql(rounds: int = 3) -> str:
    """Every vector against the 16 centroids, round by round."""
    parts = ["""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS centre FROM
  (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept ORDER BY h, x LIMIT 16))"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT vec_id, x, arg_min(cluster, distance * 16 + cluster) AS cluster, min(distance) AS distance FROM
  (SELECT r, vec_id, x, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - centre[i]) * (x[i] - centre[i]))) AS BIGINT) AS distance FROM (SELECT row_number() OVER () AS r, * FROM kept), c{i}) GROUP BY r, vec_id, x)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(floor_mean ORDER BY i) AS centre FROM
  (SELECT cluster, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS floor_mean FROM d{i}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centre, c.centre) AS centre FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(d.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY d.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM d{rounds} d JOIN c{rounds} c USING (cluster)"""


CHECKS["op12_centroid_clustering"] = _clustering_sql()
