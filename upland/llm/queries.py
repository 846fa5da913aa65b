"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from upland.llm import alignment, exact_dedup, html_text, licenses, mixing, near_vectors, ngram_join, quality, repeats, secret_scan, sentencepieces, spelling, token_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality")
def op1(spark, folder):
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_exact_dedup", exact_dedup.ORACLE)
def op2(spark, folder):
    return exact_dedup.classes(table(spark, folder, "documents")).drop("k")


@query("op3_license_scan")
def op3(spark, folder):
    return licenses.scan(table(spark, folder, "documents")).drop("detections")


@query("op4_near_vectors")
def op4(spark, folder):
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op5_html_text")
def op5(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query("op6_secret_scan")
def op6(spark, folder):
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


@query("op7_source_mix", mixing.ORACLE)
def op7(spark, folder):
    rows = mixing.repetitions(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op8_sentencepieces")
def op8(spark, folder):
    rows = sentencepieces.encode(table(spark, folder, "documents"))
    return rows.select("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "exact", F.xxhash64("pieces").alias("pieces_hash"))


@query("op9_repeats")
def op9(spark, folder):
    rows = repeats.without_repeats(table(spark, folder, "documents"))
    return rows.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


@query("op10_ngram_join")
def op10(spark, folder):
    return ngram_join.similar(table(spark, folder, "documents"))


@query("op11_token_files")
def op11(spark, folder):
    return token_files.written_and_read(table(spark, folder, "documents"))


@query("op12_token_alignment")
def op12(spark, folder):
    return alignment.align(table(spark, folder, "documents"))


@query("op13_spelling_variants", spelling.ORACLE)
def op13(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))
