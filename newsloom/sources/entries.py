"""Landed feed files and API responses to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text, url

ENTRY = (
    "title string, link string, summary string, content array<struct<value:string>>, media_thumbnail array<struct<url:string>>, "
    "enclosures array<struct<type:string,href:string>>, published string, tags array<struct<term:string>>, slash_comments string"
)
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries landed as JSON lines, with a declared schema so that nothing is inferred."""
    return spark.read.schema(ENTRY).json(path)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file (publications, feeds, relations)."""
    return spark.read.option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def parse_date(raw, fallback: Column) -> Column:
    bare = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")  # weekday names are not parsed
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries, fallback)


def project(df: DataFrame, id_col: str, entry: str, as_of: Column) -> DataFrame:
    """Article columns of an entry struct: field fallbacks for description, content, image and date, lengths cut."""
    e = F.col(entry)
    content = F.coalesce(F.get(F.filter(e["content"], lambda c: F.coalesce(c["value"], F.lit("")) != ""), F.lit(0))["value"], F.lit(""))
    picture = F.get(F.filter(e["enclosures"], lambda x: F.contains(x["type"], F.lit("image"))), F.lit(0))["href"]
    image = F.coalesce(F.get(e["media_thumbnail"], F.lit(0))["url"], picture)
    rows = df.select(id_col, e["title"].alias("title"), e["summary"].alias("summary"), content.alias("content"), image.alias("image"),
                     e["published"].alias("published"))
    words = text.word_count(text.full_text("title", "summary", "content"))
    return rows.select(
        id_col, "title", text.description_or_lead("summary", "content").alias("description"), "content",
        F.when(F.col("image").isNotNull(), url.upgrade_image("image")).alias("image_url"),
        parse_date("published", as_of).alias("published_at"), words.alias("word_count"), text.read_minutes(words).alias("read_minutes"))
