"""Readers and writers of what a text project keeps in files: texts in two encodings, pages, side-cars, lexicons, phrases, rules, scanner output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE_CAR = T.StructType([
    T.StructField("md5checksum", T.StringType()),
    T.StructField("pagedetails", T.MapType(T.StringType(), T.StructType([T.StructField(x, T.StringType()) for x in ("index", "style", "number", "label")]))),
    T.StructField("insertpos", T.StringType()), T.StructField("imagedir", T.StringType()), T.StructField("projectid", T.StringType()), T.StructField("languages", T.StringType()),
    T.StructField("charsuites", T.MapType(T.StringType(), T.BooleanType())), T.StructField("bookmarks", T.MapType(T.StringType(), T.StringType())), T.StructField("imagerotate", T.MapType(T.StringType(), T.IntegerType())),
])


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else ISO-8859-1; without a mark of byte order, with single line ends."""
    plain = content.cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, name and text of the files of a folder or pattern."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), decoded(F.col("content")).alias("text"))


def with_side_cars(docs: DataFrame, cars: DataFrame) -> DataFrame:
    """Documents with their side-cars (named as the document, with .json behind), and whether the checksum still holds."""
    parsed = cars.select(F.regexp_replace("name", "[.]json$", "").alias("name"), F.from_json("text", SIDE_CAR).alias("car"))
    return docs.join(parsed, "name", "left").withColumn("unchanged", F.md5(F.col("text")) == F.col("car.md5checksum"))


def side_car(car: Column) -> Column:
    return F.to_json(car)


def pages_as_document(pages: DataFrame) -> DataFrame:
    """One text of a folder's page files in the order of their names, a separator before each, blank ends cut. The group is one project's pages."""
    line = F.concat(F.lit("-----File: "), F.regexp_replace("name", "[.]txt$", ".png"), F.lit("-----\n"), F.regexp_replace("text", "\\s+$", ""), F.lit("\n"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    parts = pages.groupBy(folder.alias("project")).agg(F.array_sort(F.collect_list(F.struct("name", line.alias("part")))).alias("parts"))
    return parts.select("project", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))


def document_as_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """The pages of each document (name, page, text), cut at the separators."""
    parts = F.filter(F.split(F.col(text), "(?m)^-----File: ?"), lambda x: x != "")
    return docs.select("name", F.explode(parts).alias("part")).select("name", F.regexp_extract("part", "^([^.-]+)", 1).alias("page"), F.regexp_replace(F.regexp_replace("part", "^[^\\n]*\\n?", ""), "\\s+$", "").alias("text"))


def lexicon(spark: SparkSession, path: str, kind: str = "global") -> DataFrame:
    """word and kind of a file with a word per line."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")
    return words.distinct().withColumn("kind", F.lit(kind))


def project_words(spark: SparkSession, path: str) -> DataFrame:
    """word and kind (good, bad) of a project's word lists in JSON."""
    rows = spark.read.schema("good_words array<string>, bad_words array<string>").json(path, multiLine=True)
    return rows.select(F.explode("good_words").alias("word"), F.lit("good").alias("kind")).unionByName(rows.select(F.explode("bad_words").alias("word"), F.lit("bad").alias("kind")))


def save_project_words(words: DataFrame, path: str) -> None:
    lists = words.groupBy().agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "good", F.col("word")))).alias("good_words"), F.array_sort(F.collect_set(F.when(F.col("kind") == "bad", F.col("word")))).alias("bad_words"))
    lists.write.mode("overwrite").json(path)


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase and n of lines like a|b|c:12."""
    line = F.split("value", ":")
    return spark.read.text(path).filter(F.col("value").contains(":")).select(F.translate(F.get(line, 0), "|", " ").alias("phrase"), F.get(line, 1).cast("long").alias("n"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """ord, match, replacements, hint and whole of a rule file; a single replacement is a list of one."""
    entry = "array<struct<match:string,replacement:string,hint:string>>"
    raw = spark.read.schema(f"wholeword boolean, scannos {entry}, regexes {entry}").json(path, multiLine=True)
    listed = raw.select(F.coalesce("wholeword", F.lit(False)).alias("whole"), F.posexplode(F.coalesce("scannos", "regexes")).alias("ord", "r"))
    many = F.when(F.col("r.replacement").startswith("["), F.from_json("r.replacement", "array<string>")).otherwise(F.array(F.coalesce("r.replacement", F.lit(""))))
    return listed.select("ord", F.col("r.match").alias("match"), many.alias("replacements"), F.coalesce("r.hint", F.lit("")).alias("hint"), "whole")


#: The five entities of XML.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def scanner_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page, line_no and line of gzipped scanner XML: a page's lines are the characters of its line elements."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pages = files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit("(?s)<page[ >](.*?)</page>"), F.lit(1))).alias("page", "body"))
    lines = pages.select("path", "page", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<line[ >](.*?)</line>"), F.lit(1))).alias("line_no", "raw"))
    text = F.array_join(F.regexp_extract_all("raw", F.lit("<charParams[^>]*>([^<]*)</charParams>"), F.lit(1)), "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return lines.select("path", "page", "line_no", F.regexp_replace(text, "[ \\t]+", " ").alias("line"))


def save_texts(docs: DataFrame, path: str, text: str = "text", by: str = "name") -> None:
    """Texts as files, a folder for each name."""
    docs.select(F.col(by).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
