"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chat, decontam, embeddings, minhash, pieces, pii, quality, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.HOST_RULES, urls.PATTERNS).select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(_read(spark, sf_dir, "documents"), piece_model())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, percent=80)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


# The same operators on tables with planted cases that the plain ones lack

_BENT = "1000000 * k + vec_id"


def embeddings_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 on each vector with three bent copies, at cosines around 0.99, 0.97 and 0.94."""
    own = _read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "embedding")
    bent = F.expr("transform(cast(embedding AS array<double>), (x, i) -> x + 0.011D * k * ((i * 7 + vec_id * 3 + k) % 5 - 2))")
    return embeddings.near_duplicates(own.select(F.expr(_BENT).alias("vec_id"), bent.alias("embedding")))


_EMBEDDINGS_PLANTED = f"""planted AS (SELECT {_BENT} AS vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 0.011::DOUBLE * k * (((i - 1) * 7 + vec_id * 3 + k) % 5 - 2)) AS embedding
  FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k))"""


def decontamination_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 on documents that end with whole benchmark items, cut items and two items."""
    docs, items = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    near = items.select(F.col("item_id").alias("a"), F.col("text").alias("one")), items.select(F.col("item_id").alias("b"), F.col("text").alias("two"))
    out = docs.withColumns({"a": F.col("doc_id") % 80, "b": F.col("doc_id") % 120}).join(near[0], "a", "left").join(near[1], "b", "left")
    return decontam.report(out.select("doc_id", F.concat_ws("\n", "text", F.upper("one"), "two").alias("text")), items)


_DECONTAMINATION_PLANTED = """planted AS (SELECT doc_id, concat_ws(chr(10), d.text, upper(a.text), b.text) AS text
  FROM documents d LEFT JOIN benchmark a ON a.item_id = doc_id % 80 LEFT JOIN benchmark b ON b.item_id = doc_id % 120)"""


def warc_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 on pages of which each second one comes again, and one as often as there are pages."""
    pages = _read(spark, sf_dir, "pages")
    one = pages.agg(F.min_by("html", "page_id").alias("html"))
    again = pages.where("page_id % 2 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    hot = pages.select((F.col("page_id") + 2_000_000).alias("page_id"), "url").join(F.broadcast(one), F.lit(True)).select("page_id", "url", "html")
    return warc.round_trip(pages.select("page_id", "url", "html").unionByName(again).unionByName(hot))


_WARC_PLANTED = """planted AS (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 1000000, html FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id + 2000000, (SELECT arg_min(html, page_id) FROM pages) FROM pages)"""


def _planted(sql: str, table: str, planted: str) -> str:
    """The SQL of a query over ``table``, over the planted table instead."""
    head = "WITH RECURSIVE " if "WITH RECURSIVE" in sql else "WITH "
    return sql.replace(f"FROM {table}", "FROM planted").replace(head, f"{head}{planted},\n", 1)


def piece_model() -> str:
    """The public tokenizer whose ids op7 and the pipeline give."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_warc": op10_warc,
    "embeddings_planted": embeddings_planted,
    "decontamination_planted": decontamination_planted,
    "warc_planted": warc_planted,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embeddings": embeddings.SQL,
    "op2_url_filter": urls.SQL,
    "op4_decontamination": decontam.SQL,
    "op8_pii": pii.SQL,
    "op10_warc": warc.SQL,
    "embeddings_planted": _planted(embeddings.SQL, "embeddings", _EMBEDDINGS_PLANTED),
    "decontamination_planted": _planted(decontam.SQL, "documents", _DECONTAMINATION_PLANTED),
    "warc_planted": _planted(warc.SQL, "pages", _WARC_PLANTED),
}
