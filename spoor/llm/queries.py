"""The registered queries of this package, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import (
    decontam, fim_frames, graph_ann, html_main, langid, lexical, mixing, quality, secret_scan, simhash,
    url_filter, warc, winnow,
)
from spoor.llm.common import held_out, stored, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3)
    return groups.select(
        F.col("id").alias("doc_id"),
        simhash.fingerprint_hex().alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_main.main_text(pages, html_main.fit(pages))
    return found.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, known))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, logs = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), langs, logs)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"),
    )


# fixed rules of the query: verdict, host, path
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "repeats", "block")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secret_scan.span_list(F.col("spans"), secret_scan.KINDS[:3])
    return found.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.payloads(warc.read(spark, path, data=False)).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


def op13_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(fim_frames.frames(table(spark, sf_dir, "documents")))
    return fim_frames.restore(fim_frames.transform(store)).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_graph_ann, op3_main_text, op4_quality, op5_line_dedup, op6_language,
        op7_decontamination, op8_url_filter, op9_mixing, op10_secrets, op11_lexical, op12_warc,
        op13_fim_frames,
    )
}
ORACLES: dict[str, str] = {"op8_url_filter": url_filter.ORACLE, "op9_mixing": mixing.ORACLE}
ORACLES |= {"op11_lexical": lexical.ORACLE, "op12_warc": warc.ORACLE, "op13_fim_frames": fim_frames.ORACLE}
