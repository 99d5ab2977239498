"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranked_search
from .license_scan import duckdb_sql

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def remainder(n: int):
    """The fold of a document: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(docs: DataFrame, n: int, fold: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(remainder(n) == fold, F.lit(False)))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    docs = table(spark, sf_dir, "documents").withColumn("train", remainder(7) != 2)
    return held_out(lm_scores(docs), 7, 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def license_rows(docs: DataFrame) -> DataFrame:
    """Documents with a place in a tree: source, thousand, fifty, id."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return docs.select("doc_id", F.concat_ws("/", "source", part(1000), part(50), F.col("doc_id").cast("string")).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(license_rows(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(5) != 0).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return held_out(found, 5, 0).select("doc_id", "held_out", "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


#: Target shares of the domains that the labels tell apart.
MIXTURE = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """`doc_id, domain` of labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_rates

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mixing_rates(docs, domain_labels(labels), MIXTURE)
    return found.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(MIXTURE)], "rate")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_hits

    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).drop("key")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from .toxicity import fit, labelled_texts

    return fit(labelled_texts(docs, table(spark, sf_dir, "labels").where(remainder(4) != 2)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return held_out(found, 4, 2).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import chars_within, prefix_token_counts, total_tokens

    found = prefix_token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    tokens, limit = total_tokens(F.col("prefix_tokens")), 1024
    return found.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"), chars_within(F.col("prefix_tokens"), limit).alias("chars_in_limit"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, score_quality
    from .toxicity import labelled_texts

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = 12_000
    model = fit(labelled_texts(docs, labels.where(remainder(3) != 1), sample, "quality"), sample)
    found = score_quality(docs, model)
    return held_out(found, 3, 1).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import top_documents

    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_token_output": op6_token_output,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": duckdb_sql("SELECT doc_id, concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 50)::VARCHAR, doc_id::VARCHAR) AS path, text FROM documents"),
    "op13_ranked_search": ranked_search.duckdb_sql(),
}
