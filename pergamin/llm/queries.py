"""The queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamin.llm import encoding, lookalike, pack, personal, quality, repeat, scanned, tokenize
from pergamin.session import spread, write_through
from pergamin.sources.tables import load


#: The id column of each table of texts.
ROW_ID = {"readings": "reading_id", "unwrapped": "unwrap_id", "screenings": "screening_id", "classified_lines": "line_id", "page_lines": "line_id"}


def texts(spark: SparkSession, folder: str, *tables: str) -> DataFrame:
    """Rows (rec struct<record, row_id>, text) of whole tables, one below the other."""
    parts = [load(spark, folder, t).select(F.struct(F.lit(t).alias("record"), F.col(ROW_ID[t]).alias("row_id")).alias("rec"), "text") for t in tables]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return spread(whole, "rec")


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and form of every reading and of every classified line by itself."""
    profiles = quality.train(load(spark, folder, "quality_samples"), load(spark, folder, "common_words"))
    measured = quality.text_quality(texts(spark, folder, "readings", "classified_lines"), profiles, "rec")
    return measured.select("rec.record", "rec.row_id", *(c for c in measured.columns if c != "rec"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    samples, common = load(spark, folder, "quality_samples"), load(spark, folder, "common_words")
    readings = quality.text_quality(texts(spark, folder, "readings"), quality.train(samples, common), "rec")
    lines = load(spark, folder, "classified_lines").select("line_id", "doc_id", "step", "page_no", "i", "text")
    forms = quality.line_forms(lines, quality.train(samples, common, lines=True))
    found = readings.select("rec.record", "rec.row_id", "form").unionByName(forms.select(F.lit("classified_lines").alias("record"), F.col("line_id").alias("row_id"), "form"))
    return found.where(F.col("form").isin("list", "table", "junk")).distinct()


def _personal(spark: SparkSession, folder: str) -> DataFrame:
    source = texts(spark, folder, "readings", "screenings")
    return personal.personal_information(source, load(spark, folder, "name_hints"), "rec")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading and screening with its personal information replaced by placeholders."""
    return _personal(spark, folder).select("rec.record", "rec.row_id", "masked", F.size("found").alias("occurrences"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _personal(spark, folder).select("rec.record", "rec.row_id", F.inline("found")).distinct()


def _scanned(spark: SparkSession, folder: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """What is found of the lines of OCR steps, and the counts of all texts."""
    lines, readings = load(spark, folder, "page_lines"), load(spark, folder, "readings")
    ocr = F.coalesce(F.col("kind") == "ocr", F.lit(False))
    texts = scanned.reading_texts(readings.where(ocr))
    return scanned.read_lines(scanned.page_lines(lines), texts, readings.where(~ocr).select("text"), lines.count() + 24 * readings.count(), whole)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record", F.element_at(F.array(*map(F.lit, scanned.RECORDS)), F.col("record") + 1))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(scanned.noises(*_scanned(spark, folder, False)).select("record", "row_id", "noise").distinct())


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every page read by an OCR step as continuous paragraphs."""
    return _named(scanned.paragraphs(*_scanned(spark, folder, True)))


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every line and reading with the form that all texts looking like it share."""
    forms = lookalike.canonical_forms(texts(spark, folder, "page_lines", "readings"), "rec")
    return forms.select("rec.record", "rec.row_id", "canonical", "look")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    place = ["record", "doc_id", "page_no"]
    lines = load(spark, folder, "page_lines").select(F.lit("page_lines").alias("record"), "doc_id", "page_no", F.col("line_id").alias("row_id"), "text")
    readings = load(spark, folder, "readings").select(F.lit("readings").alias("record"), "doc_id", F.lit(-1).alias("page_no"), F.col("reading_id").alias("row_id"), "text")
    return lookalike.same_look_pairs(spread(lines.unionByName(readings), "doc_id"), place, "row_id", keep="record")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of readings and unwrapped, with what it is restored to."""
    source = texts(spark, folder, "readings", "unwrapped")
    return encoding.repair_encoding(source, encoding.letter_statistics(source), "rec").select("rec.record", "rec.row_id", "garbled", "states", "spans", "restored")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_restored(spark, folder).where("garbled").select("record", "row_id").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.token_ids(spread(load(spark, folder, "documents").select("doc_id", "text"), "doc_id"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    documents = load(spark, folder, "documents").select("doc_id", "text")
    targets = pack.read_targets(load(spark, folder, "packing_targets"))
    return pack.pack(tokenize.token_counts(spread(documents, "doc_id")), targets, rows=documents.count()), targets


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0]


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return pack.fill(*_packed(spark, folder))


def p8_repeated_content(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return repeat.repeated_content(documents, repeat.train(load(spark, folder, "quality_samples")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeat.found(p8_repeated_content(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_masked, p3_found, p3_paragraphs, p4_found, p4_canonical, p5_found, p5_restored, p6_ids, p7_containers, p7_fill, p8_found, p8_repeated_content)}
