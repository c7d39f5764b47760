"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import (
    chunks, licenses, merkle, multi_index, nbest, packing, pii, quality, relations, resample, secrets, simhash, vantage,
)
from sparkwarden.llm.common import table
from sparkwarden.llm.sql import SQL as SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def _spans(column: str) -> Column:
    """An array of (start, end) as ``start:end`` joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_chunks(spark, sf_dir):
    found = chunks.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_kept", "n_dropped", "dropped_chars", _spans("drop_spans").alias("drop_spans"),
        _spans("kept_spans").alias("kept_spans"), "first_docs",
    )


@query
def op10_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def _digest(spans: Column) -> Column:
    return F.sha2(F.array_join(spans, ",").cast("binary"), 256)


@query
def op5_pii(spark, sf_dir):
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind_no"] <= len(pii.BASE_KINDS))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.BASE_KINDS], _digest(F.transform(base, text)).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


@query
def op1_multi_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op3_merkle(spark, sf_dir):
    return merkle.compared(table(spark, sf_dir, "documents"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query
def op4_secrets(spark, sf_dir):
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda s: F.array_position(F.array(*[F.lit(k) for k in secrets.KINDS]), s["kind"])
    both = F.array_sort(F.transform(F.concat("base", "weak"), lambda s: F.struct(s["start"], number(s), text(s).alias("told"))))
    return found.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        _digest(F.transform("base", text)).alias("base_sha256"), F.array_join(F.transform(both, lambda s: s["told"]), ",").alias("spans"),
    )


@query
def op6_nbest(spark, sf_dir):
    found = nbest.segmentations(table(spark, sf_dir, "documents"), nbest.default_settings())
    return found.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "scores",
        "swaps", "round_trip",
    )


@query
def op8_licenses(spark, sf_dir):
    found = licenses.licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op11_resample(spark, sf_dir):
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_set_relations(spark, sf_dir):
    return relations.similar_documents(table(spark, sf_dir, "documents"))


@query
def op13_vantage_clusters(spark, sf_dir):
    return vantage.clusters(table(spark, sf_dir, "embeddings"))
