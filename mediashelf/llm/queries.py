"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.llm import (
    chat, exact_dedup, fill_in_middle, hard_negatives, language, mixing, near_dedup, pieces, quality, secrets,
    substring_dedup, url_filter, vector_dedup,
)
from mediashelf.llm.common import fold

URL_RULES = [  # fixed values: the rules every page is judged by
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MIX_WEIGHTS = {
    "domain": {"crawl": 3, "curated": 7},
    "language": {"en": 5, "de": 2, "fr": 2, None: 1},
    "source": {None: 1},
}
MIX_SHARE = (4, 5)  # the mixture holds four fifths of the corpus' tokens
MIX_CRAWL = ("src0", "src1", "src2", "src3", "src4")
MIX_SEED, MIX_EPOCHS = 17, 2
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture of ``docs`` with the parameters above."""
    domain = F.when(F.col("source").isin(*MIX_CRAWL), "crawl").otherwise("curated")
    return mixing.mix(
        docs, MIX_WEIGHTS, MIX_SHARE, F.regexp_count("text", F.lit(WORD)), domain,
        F.col("lang"), F.col("source"), seed=MIX_SEED, max_epochs=MIX_EPOCHS,
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each of its participants."""
    return chat.rotate(_table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "part", "n_turns", "n_own", "start", "rendered",
        F.array_join("mask_starts", ",").alias("mask_starts"),
        F.array_join("mask_ends", ",").alias("mask_ends"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates by four-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time a document is taken into the mixture."""
    docs = _table(spark, sf_dir, "documents")
    return mix_documents(docs).select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source",
        F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether decoding them gives the text back."""
    coded = pieces.with_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join("ids", ",")
    return coded.select(
        "doc_id", F.size("ids").alias("n_ids"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that also start anywhere else."""
    return substring_dedup.summary(_table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labelled documents outside the held-out third."""
    return quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return language.identify(docs, model).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"),
        "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies."""
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its positives."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *[number(k) for k in secrets.BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten, and restored from what it was rewritten to."""
    rewritten = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = fill_in_middle.with_restored(rewritten)
    return both.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_language": op5_language,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_near_dedup": op7_near_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}
