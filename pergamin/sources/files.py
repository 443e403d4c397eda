"""Files in, results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamin.functions import formats


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below ``path``: path (the key), identifier (its name), content and format by content.

    Two files of one name stay two rows. Unreadable content is no error here; ``unwrapped`` gives the reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("identifier"), F.col("length").alias("n_bytes"), "content", formats.detect(F.col("content")).alias("file_format"))


def unwrapped(files: DataFrame) -> DataFrame:
    """Text or inner bytes of every file. Only envelopes reach Python; plain files pass by."""
    envelope = F.col("file_format").isin("rtf", "bry", "pkcs7")
    opened = files.where(envelope).withColumn("_u", formats.unwrap("content")).select("path", "identifier", "file_format", "_u.text", F.col("_u.content").alias("content"), "_u.reason")
    nothing = F.lit(None).cast("string")
    other = files.where(~envelope | F.col("file_format").isNull()).select("path", "identifier", "file_format", nothing.alias("text"), "content", nothing.alias("reason"))
    return opened.unionByName(other)


def as_json(results: DataFrame) -> DataFrame:
    """Each result as one JSON object in the column ``value``."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object for each row; a document that failed is a row with its reason and never ends the job."""
    results.write.mode("errorifexists").json(path)


ITEMS = "struct<texts:array<struct<text:string,label:string,prov:array<struct<page_no:string,bbox:struct<l:string,t:string,r:string,b:string>>>>>>"


def converted_text(json: Column) -> Column:
    """Text of a converter's JSON in reading order: by page, sideways boxes, headers and footers last, from top to bottom and left
    to right; items without a place come at the end. Null for what is no such JSON, empty if it has no text."""
    items = F.coalesce(F.from_json(json, ITEMS)["texts"], F.from_json(F.lit('{"texts": []}'), ITEMS)["texts"])
    number = lambda c: c.try_cast("double")

    def key(item: Column, i: Column) -> Column:
        place = F.try_element_at(item["prov"], F.lit(1))
        box = place["bbox"]
        w, h = F.abs(number(box["r"]) - number(box["l"])), F.abs(number(box["t"]) - number(box["b"]))
        last = item["label"].isin("page_header", "page_footer") | F.coalesce((w > 0) & (w < 40) & (h > 3 * w), F.lit(False))
        known = place.isNotNull()
        return F.struct(
            F.when(known, F.coalesce(place["page_no"].try_cast("int"), F.lit(0))).otherwise(F.lit(1_000_000)).alias("page"), F.when(known, F.coalesce(last, F.lit(False)).cast("int")).otherwise(F.lit(2)).alias("last"),
            F.coalesce(-number(box["t"]), F.lit(0.0)).alias("top"), F.coalesce(number(box["l"]), F.lit(0.0)).alias("left"), i.alias("i"), F.coalesce(item["text"], F.lit("")).alias("text"),
        )

    ordered = F.array_sort(F.transform(items, key))
    return F.when(json.isNotNull(), F.array_join(F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: F.trim(t) != ""), "\n"))
