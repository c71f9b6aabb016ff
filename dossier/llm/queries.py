"""The training-data queries over the test tables; each runs its operator on its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import bpe, clusters, decontaminate, langid, lm, outliers, pieces, quality, ranked, simhash, substrings, toxicity, urls
from dossier.llm.common import remainder, table
from dossier.llm.oracle import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracle()

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows that also start in a document of a smaller id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document, the counts being the whole corpus's."""
    return lm.scores(table(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and their decoding, as digests per document."""
    vocabulary = bpe.Vocabulary.read(TOKENIZER, public_tokenizers.PATTERN)
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"], digests=True)


#: The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by output codes, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the components of those at 4 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages, learned from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    found = quality.score(docs, quality.train(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the weighted lexicon, learned from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


@query
def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts, the base rules and the robust outlier verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return outliers.judge(docs).select("doc_id", *outliers.FACTS, "base_failed", "kept", "distance")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of the benchmark items found in documents, with the tokens that match."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings after ten rounds, with inertia and the digest of each centroid."""
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["n"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per cluster
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    inertia = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(named))])
    digests = F.array(*[F.lit(d) for d in named]).cast("array<string>")
    return found.rows.select(
        "vec_id", "cluster", "distance", F.get(inertia.cast("array<long>"), "cluster").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digests, "cluster").alias("centroid_sha256"),
    )


@query
def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item by weighted impacts of its terms."""
    found = ranked.index(table(spark, sf_dir, "documents"))
    return ranked.search(found, table(spark, sf_dir, "benchmark"))


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and their decoding, as digests per document."""
    pieces_ = pieces.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_decode(table(spark, sf_dir, "documents"), pieces_, keep=["doc_id"], digests=True)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over the documents table."""
    return corpus_pipeline.run(spark, sf_dir)
