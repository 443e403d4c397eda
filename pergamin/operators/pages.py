"""Pages before and after they are read: which ones to read, batches of them, and pages rolled up to readings and witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import text as X

DEFAULT = C.Thresholds()


def to_read(pages: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """The pages (doc_id, page_no, rank) an OCR step reads: those without text where a document has both sorts, else all, and of
    these the first ``max_pages``. A filter ahead of the reader, so no other page is rendered. Pages given again count once."""
    bare = (F.length(X.strip(F.coalesce("text", F.lit("")))) < t.min_text_page_chars).alias("bare")
    once = pages.select("doc_id", "page_no", bare).groupBy("doc_id", "page_no").agg(F.bool_and("bare").alias("bare"))
    mixed = once.groupBy("doc_id").agg(F.bool_or("bare").alias("_some"), F.bool_and("bare").alias("_all"))
    wanted = once.join(mixed, "doc_id").where(F.col("bare") | ~F.col("_some") | F.col("_all"))
    ranked = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    return ranked.where(F.col("rank") <= t.max_pages).select("doc_id", "page_no", "rank")


def subdocument(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The given pages (doc_id, page_no) of a document, in order of ``page_no``; a document of which none is given has none."""
    return pages.join(wanted.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")


def page_texts(lines: DataFrame) -> DataFrame:
    """Pages (doc_id, step, page_no, text, confidence) of lines: the lines that are not blank, and their mean score of 100."""
    shown = lines.where(X.strip(F.coalesce("text", F.lit(""))) != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"]), "\n")
    return shown.groupBy("doc_id", "step", "page_no").agg(text.alias("text"), F.coalesce(F.round(F.round(100 * F.avg("score"), 6), 1), F.lit(0.0)).alias("confidence"))


def transcriptions(pages: DataFrame) -> DataFrame:
    """Readings of pages (doc_id, step, page_no, text, confidence, error): text in order of pages, pages sent and answered, the mean
    confidence of pages with text, and the different failures.

    A page that was read as blank is answered, one with an error is not; if none was answered, the text is empty. Partial
    aggregates meet per document and step: what is gathered is a document's pages."""
    blank = X.strip(F.coalesce("text", F.lit(""))) == ""
    shown = F.when(~blank, F.struct("page_no", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "\n\n")
    failures = F.array_sort(F.collect_set("error"))
    return pages.groupBy("doc_id", "step").agg(
        F.count("*").alias("pages_sent"), F.count_if(F.col("error").isNull()).alias("pages_answered"), F.coalesce(F.round(F.round(F.avg(F.when(~blank, F.col("confidence"))), 6), 1), F.lit(0.0)).alias("confidence"), text.alias("text"), failures.alias("failures"),
    )


def batches(pages: DataFrame, size: int = 2) -> DataFrame:
    """Rows (doc_id, batch_no, page_nos) of ``size`` pages, in order."""
    ranked = pages.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1)
    return ranked.groupBy("doc_id", F.floor(F.col("_rank") / size).cast("int").alias("batch_no")).agg(F.array_sort(F.collect_list("page_no")).alias("page_nos"))


def batch_coverage(batches: DataFrame) -> DataFrame:
    """What came of the batches (doc_id, batch_no, page_nos, responses) of a document: pages sent and answered, batches that failed.

    A batch fails as a whole: if it has no answer, or not one for each of its pages."""
    n, answered = F.size("page_nos"), F.col("responses").isNotNull() & (F.size("responses") == F.size("page_nos"))
    return batches.groupBy("doc_id").agg(F.sum(n).alias("pages_sent"), F.sum(F.when(answered, n).otherwise(0)).alias("pages_answered"), F.count_if(~answered).alias("failed_batches"))


def reassembled(pages: DataFrame, converted: DataFrame) -> DataFrame:
    """Native pages with converted ones in place of those without text: the n-th converted text (doc_id, ordinal from 1, text) stands for
    the n-th page of ``to_read``. One row for each document: pages, converted_pages, text."""
    placed = to_read(pages).join(converted.select("doc_id", F.col("ordinal").alias("rank"), F.col("text").alias("_new")), ["doc_id", "rank"])
    native = pages.groupBy("doc_id", "page_no").agg(F.max("text").alias("text")).join(placed.select("doc_id", "page_no", "_new"), ["doc_id", "page_no"], "left")
    filled = lambda c: X.strip(F.coalesce(c, F.lit(""))) != ""
    chosen = F.when(filled("_new"), F.col("_new")).when(filled("text"), F.col("text"))
    gathered = F.array_sort(F.collect_list(F.when(chosen.isNotNull(), F.struct("page_no", chosen.alias("t")))))
    return native.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(filled("_new")).alias("converted_pages"), F.array_join(F.transform(gathered, lambda x: x["t"]), "\n\n").alias("text"))


def witnesses(lines: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """Cheap local readings (doc_id, reliable, confidence, text) of the first ``max_witness_pages`` pages: words of lines of a score of
    at least the least confidence are reliable. A document of which no page was read has no row: unknown is not empty."""
    near = lines.where(F.col("page_no") < t.max_witness_pages).withColumn("_words", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(C.WORD), F.lit(0))))
    sure = F.coalesce(F.col("score"), F.lit(0.0)) * 100 >= t.min_confidence
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    return near.groupBy("doc_id").agg(F.sum(F.when(sure, F.col("_words")).otherwise(0)).alias("reliable"), F.coalesce(F.round(F.round(100 * F.avg("score"), 6), 1), F.lit(0.0)).alias("confidence"), text.alias("text"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, block, paragraph, line, text, score, box) of recognised words (the same keys, word_no, text, confidence
    of 100, x1 to y2), in order of ``word_no``. Words that are blank or of no confidence are left out."""
    kept = words.where((F.col("confidence") >= 0) & (X.strip(F.coalesce("text", F.lit(""))) != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    box = F.struct(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return kept.groupBy("doc_id", "page_no", "block", "paragraph", "line").agg(text.alias("text"), F.round(F.avg("confidence") / 100, 4).alias("score"), box.alias("box"))


def reread(lines: DataFrame, again: DataFrame, gain: float = DEFAULT.min_reread_gain) -> DataFrame:
    """``lines`` (line_id, text, score) with the best of their second readings (line_id, ordinal, text, score) where it is better by more
    than ``gain``; ``replaced`` says so. Ties go to the first reading."""
    best = again.groupBy("line_id").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("ordinal"))).alias("_b"))
    better: Column = F.coalesce(F.col("_b.score") > F.coalesce(F.col("score"), F.lit(0.0)) + gain, F.lit(False))
    joined = lines.join(best, "line_id", "left").withColumn("replaced", better)
    return joined.withColumns({"text": F.when(F.col("replaced"), F.col("_b.text")).otherwise(F.col("text")), "score": F.when(F.col("replaced"), F.col("_b.score")).otherwise(F.col("score"))}).drop("_b")
