"""Registered queries of the training-data operators: ``QUERIES[name](spark, sf_dir)``.

Each applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.decontaminate import scan_for_items
from sensorlake.llm.exact_dedup import flag_exact
from sensorlake.llm.line_templates import flag_lines
from sensorlake.llm.language import UNKNOWN, held_out, identify, learn
from sensorlake.llm.merkle import manifest
from sensorlake.llm.near_dedup import near_duplicates
from sensorlake.llm.packing import pack
from sensorlake.llm.personal_data import find_personal
from sensorlake.llm.personal_data import learn as learn_personal
from sensorlake.llm.pieces import decode, encode
from sensorlake.llm.prefix_trie import branched, prefix_trie, turns
from sensorlake.llm.secret_links import find_secrets, report
from sensorlake.llm.url_filter import filter_urls, host_of
from sensorlake.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_for_items(docs, _table(spark, sf_dir, "benchmark"), out="found")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = flag_lines(docs, out="lines")
    clean = F.coalesce("lines.clean", "text")
    return found.select("doc_id", "lines.n_lines", "lines.n_recurring", "lines.n_dropped",
                        F.sha2(clean, 256).alias("clean_sha256"))


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]
# fixed values: host labels whose pages make up the list of unwanted URLs
UNWANTED_HOSTS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*map(F.lit, UNWANTED_HOSTS))))
    return filter_urls(pages, URL_RULES, listed, out="f").select("page_id", "f.host", "f.path", "f.rule", "f.verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).drop("complete")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_exact(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs), out="language")
    return found.select("doc_id", held_out("doc_id").alias("held_out"),
                        F.coalesce("language.lang", F.lit(UNKNOWN)).alias("lang_pred"), "language.score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_secrets(_table(spark, sf_dir, "documents")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, learn_personal(docs), out="p")
    return found.select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone",
                        F.sha2(F.array_join("p.base", ","), 256).alias("base_sha256"),
                        F.array_join("p.spans", ",").alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*branched(turns(_table(spark, sf_dir, "conversations"))))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(_table(spark, sf_dir, "documents"), claims={"text": F.translate("text", UPPER, LOWER)}, claimed=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, out="ids", packed=True), ids_col="ids", out="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_templates": op2_line_templates,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}
