"""Readers' work on the tables: decoding, side-cars, lexicon files, as they do it on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.publish import native
from vellum.sources import readers


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@native("SRC-01 SRC-02", "decoded_texts", sql="SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes in one of two encodings, with a mark of byte order, decoded again. Texts that ISO-8859-1 can't write are in UTF-8."""
    text = F.coalesce("text", F.lit(""))
    plain = ~text.rlike("[^\\x00-\\xff]") & text.rlike("[\\x80-\\xff]")
    content = F.when(plain, F.encode(F.when(plain, text).otherwise(F.lit("")), "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("﻿"), text), "UTF-8"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(readers.decoded(content)).alias("text_md5"))


@native("SRC-12 SNK-02", "side_car_round_trip", sql="SELECT doc_id, TRUE AS unchanged, lang AS languages FROM documents")
def side_car_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-cars written as JSON and read back: whether the checksum holds, and the languages."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    cars = docs.select(F.concat("name", F.lit(".json")).alias("name"), readers.side_car(F.struct(F.md5("text").alias("md5checksum"), F.col("lang").alias("languages"))).alias("text"))
    return readers.with_side_cars(docs, cars).select("doc_id", "unchanged", F.col("car.languages").alias("languages"))
