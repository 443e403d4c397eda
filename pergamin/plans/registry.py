"""The queries of the engine's own operators, each over its whole tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import checks, formats, prose
from pergamin.functions import text as X
from pergamin.operators import engines, gates, lines, pages, segment
from pergamin.plans import cascade
from pergamin.plans.oracles import ORACLES
from pergamin.session import spread
from pergamin.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, given a partition for every core where it has fewer: patterns are heavy per row, and one small file is one task."""
    return spread(tables.load(spark, folder, name))


def text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return X.with_metrics(load(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *X.METRICS)


def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    return X.with_score(X.with_metrics(load(spark, folder, "documents").select("doc_id", "text"))).select("doc_id", "score", "label")


def native_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "doc_pages").select("doc_id", "page_no", F.md5(X.normalize(F.col("text"))).alias("text_digest"), F.length(X.normalize(F.col("text"))).alias("n_chars"))


def stamp_words(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return load(spark, folder, "documents").select("doc_id", F.length(X.strip_stamp(t)).alias("bare_chars"), X.useful_words(t).alias("useful_words"), F.size(X.vocabulary(t)).alias("different_words"))


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    found = load(spark, folder, "documents").select("doc_id", X.anchors(F.col("text")).alias("_a"))
    return found.select("doc_id", F.size("_a").alias("n_anchors"), F.array_join("_a", " ").alias("anchors"))


def identifiers_lost(spark: SparkSession, folder: str) -> DataFrame:
    """For the two OCR steps of a document: identifiers of the first that the second does not contain."""
    rows = cascade.latest(load(spark, folder, "readings").where("step in ('paddle', 'vision')").where(F.col("text").isNotNull()))
    found = rows.select("doc_id", "step", X.anchors(F.col("text")).alias("a"))
    pair = found.where("step = 'paddle'").select("doc_id", F.col("a").alias("p")).join(found.where("step = 'vision'").select("doc_id", F.col("a").alias("v")), "doc_id")
    return pair.select("doc_id", F.array_join(X.lost_anchors(F.col("p"), F.col("v")), " ").alias("lost"))


def unread_marks(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    rows = load(spark, folder, "readings").select("reading_id", "text").where(t.isNotNull())
    return rows.select("reading_id", F.length(X.real_content(t)).alias("real_chars"), F.round(X.marker_fraction(t), 4).alias("marker_fraction"))


def structure_scores(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.page_statistics(load(spark, folder, "doc_pages"))


def pages_without_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "doc_pages").select("doc_id", "page_no", (F.length(X.strip(F.coalesce("text", F.lit("")))) < C.Thresholds().min_text_page_chars).alias("bare"))
    once = pages.groupBy("doc_id", "page_no").agg(F.bool_and("bare").alias("bare"))
    found = once.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("bare").alias("without_text"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("bare"), F.col("page_no")))), ",").alias("page_list"))
    return found.withColumn("mixed", (F.col("without_text") > 0) & (F.col("without_text") < F.col("pages")))


def image_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.uncovered_images(load(spark, folder, "doc_pages")).groupBy("doc_id", "page_no").agg(F.bool_or("uncovered").alias("uncovered"))


def attachment_screening(spark: SparkSession, folder: str) -> DataFrame:
    rows = gates.screening(load(spark, folder, "screenings").select("screening_id", "text", "label"))
    return rows.select("screening_id", "marks_found", F.round("mark_density", 3).alias("mark_density"), "drop")


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return lines.lexicon(load(spark, folder, "documents"))


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    source = load(spark, folder, "page_lines").dropDuplicates(["line_id"])
    covered = lines.with_coverage(source, lines.lexicon(load(spark, folder, "documents")))
    return lines.mark_signatures(lines.classify(covered))


def line_coverage(spark: SparkSession, folder: str) -> DataFrame:
    source = load(spark, folder, "page_lines").select("line_id", F.coalesce("text", F.lit("")).alias("text"))
    return lines.with_coverage(source, lines.lexicon(load(spark, folder, "documents"))).select("line_id", F.round("coverage", 4).alias("coverage"))


def resegmented_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents").select("doc_id", "text")
    parted = segment.resegment(documents, lines.lexicon(documents))
    return parted.select("doc_id", F.col("resegmented").isNotNull().alias("changed"), F.length("resegmented").alias("n_chars"))


def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("line_id", "kind", "junk", F.length("clean_text").alias("n_chars"))


def page_containment(spark: SparkSession, folder: str) -> DataFrame:
    return lines.contain(_classified(spark, folder)).withColumn("text_digest", F.md5("text")).drop("text")


def recovered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose words had run together, parted, and what kind they are then."""
    words = lines.lexicon(load(spark, folder, "documents"))
    source = load(spark, folder, "page_lines").dropDuplicates(["line_id"])
    kinds = lines.classify(lines.recover(lines.with_coverage(source, words), words))
    return kinds.select("line_id", "kind", "recovered", F.length("clean_text").alias("n_chars"))


def document_layers(spark: SparkSession, folder: str) -> DataFrame:
    return lines.layer_report(lines.contain(_classified(spark, folder)))


def reread_targets(spark: SparkSession, folder: str) -> DataFrame:
    return lines.reread_targets(_classified(spark, folder)).select("line_id", "kind", "rank")


def page_routes(spark: SparkSession, folder: str) -> DataFrame:
    source = load(spark, folder, "page_lines").dropDuplicates(["line_id"])
    return lines.route(lines.with_coverage(source, lines.lexicon(load(spark, folder, "documents"))))


def page_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "page_lines").dropDuplicates(["line_id"]).where(X.strip(F.coalesce("text", F.lit(""))) != "")
    pages = rows.groupBy("doc_id", "step", "page_no").agg(F.count("*").alias("n_lines"), F.coalesce(F.round(F.round(100 * F.avg("score"), 6), 1), F.lit(0.0)).alias("confidence"))
    return pages


def page_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Native pages in order, each replaced by the lines OCR read where the page had next to no text."""
    pages = load(spark, folder, "doc_pages").groupBy("doc_id", "page_no").agg(F.max("text").alias("native"))
    read = load(spark, folder, "page_lines").where("step = 'paddle'").dropDuplicates(["line_id"]).where(X.strip(F.coalesce("text", F.lit(""))) != "")
    ocr = read.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"]), "\n").alias("ocr"))
    bare = F.length(X.strip(F.coalesce("native", F.lit("")))) < C.Thresholds().min_text_page_chars
    merged = pages.join(ocr, ["doc_id", "page_no"], "left").withColumn("_t", F.when(bare & F.col("ocr").isNotNull(), F.col("ocr")).when(X.strip(F.coalesce("native", F.lit(""))) != "", F.col("native")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("page_no", "_t")))), lambda x: x["_t"]), "\n\n")
    return merged.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(bare & F.col("ocr").isNotNull()).alias("merged_pages"), F.md5(joined).alias("text_digest"))


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.measured(load(spark, folder, "documents"), load(spark, folder, "doc_pages"), load(spark, folder, "readings"))


def reading_gates(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select("doc_id", "step", "useful_words", "score", "structure_score", "accepted", "reason")


def reading_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Shared vocabulary of every two readings of a document."""
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))
    words = rows.select("doc_id", "step", "ordinal", X.vocabulary(F.col("text")).alias("v"))
    left, right = words.select("doc_id", F.col("step").alias("first"), F.col("ordinal").alias("_o"), F.col("v").alias("_v")), words.select("doc_id", F.col("step").alias("second"), "ordinal", "v")
    pairs = left.join(right, "doc_id").where((F.col("_o") < F.col("ordinal")) | (F.col("_o") == F.col("ordinal")) & (F.col("first") < F.col("second")))
    return pairs.select("doc_id", "first", "second", F.round(gates.jaccard(F.array("_v", "v")), 4).alias("similarity"))


def best_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.with_score(X.with_metrics(cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))))
    return cascade.contest(rows)


def longest_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))
    return rows.groupBy("doc_id").agg(F.max_by("step", F.struct(F.length("text"), -F.col("ordinal"))).alias("step"), F.max(F.length("text")).alias("n_chars"))


def step_comparison(spark: SparkSession, folder: str) -> DataFrame:
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))
    counted = rows.select("step", F.size(X.latin_words(F.col("text"))).alias("w"), F.size(X.anchors(F.col("text"))).alias("a"), "confidence")
    return counted.groupBy("step").agg(F.count("*").alias("readings"), F.median("w").alias("median_words"), F.median("a").alias("median_anchors"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def replacements(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the text of the expensive step may replace the longest cheaper one."""
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))
    cheap = rows.where("kind <> 'expensive'").groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ordinal"))).alias("previous"))
    new = rows.where("kind = 'expensive'").select("doc_id", F.col("text").alias("new"), F.coalesce("pages_sent", F.lit(0)).alias("sent"), F.coalesce("pages_answered", F.lit(0)).alias("answered"), F.coalesce("failed_batches", F.lit(0)).alias("failed_batches"), F.lit(True).alias("trustworthy"))
    documents = load(spark, folder, "documents").select("doc_id", F.coalesce("pages", F.lit(1)).alias("doc_pages")).dropDuplicates(["doc_id"])
    return gates.replacement(cheap.join(new, "doc_id").join(documents, "doc_id")).select("doc_id", "rejection", F.size("lost").alias("n_lost"))


def final_text(spark: SparkSession, folder: str) -> DataFrame:
    final = prose.normalize(F.col("text"))
    return load(spark, folder, "documents").select("doc_id", "text").withColumn("final", final).select("doc_id", F.length("final").alias("n_chars"), F.md5("final").alias("digest"))


def amounts_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", F.md5(prose.fix_thousands(F.col("text"))).alias("digest"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "readings").where("kind = 'expensive'").select("reading_id", F.md5(prose.clean_response(F.col("text"))).alias("digest"))


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.encode(F.col("text"), "utf-8")
    return load(spark, folder, "unwrapped").select("unwrap_id", "file_format", formats.detect(raw).alias("seen_format"))


def private_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in the form of a tax id or a case number, and how many of them have right check digits."""
    return checks.counts(load(spark, folder, "documents").select("doc_id", "text"))


def cascade_results(spark: SparkSession, folder: str) -> DataFrame:
    settled = cascade.results(_measured(spark, folder))
    return settled.select("doc_id", "step", F.round("score", 4).alias("score"), "closed_by", "similarity", F.length("text").alias("n_chars"), "provenance")


def cascade_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """The cascade with the gates of expensive steps and the winner as running text."""
    settled = cascade.guarded(_measured(spark, folder))
    return settled.select("doc_id", "step", F.round("score", 4).alias("score"), "closed_by", "similarity", F.length("text").alias("n_chars"), F.md5("text").alias("text_digest"), "provenance")


def score_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why every document scores as it does."""
    rows = X.with_metrics(load(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join(X.score_reasons(F.col("text")), "; ").alias("reasons"))


def pages_to_read(spark: SparkSession, folder: str) -> DataFrame:
    return pages.to_read(load(spark, folder, "doc_pages"))


def _page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_texts(load(spark, folder, "page_lines").dropDuplicates(["line_id"]))


def transcriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines rolled up to pages, and pages to readings."""
    rolled = pages.transcriptions(_page_texts(spark, folder).withColumn("error", F.lit(None).cast("string")))
    return rolled.select("doc_id", "step", "pages_sent", "pages_answered", "confidence", F.md5("text").alias("text_digest"))


def engine_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every native page read by the engine of text layers, rolled up to readings; a page without text is a failure."""
    native = load(spark, folder, "doc_pages").groupBy("doc_id", "page_no").agg(F.max("text").alias("content"))
    rolled = pages.transcriptions(engines.read_pages(native, engines.TextLayer, "text_layer"))
    return rolled.select("doc_id", "pages_sent", "pages_answered", "confidence", F.array_join("failures", "; ").alias("failures"), F.md5("text").alias("text_digest"))


def batch_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Native pages sent two by two to a client that answers with their texts and fails on a page without any."""
    native = load(spark, folder, "doc_pages").groupBy("doc_id", "page_no").agg(F.max("text").alias("text"))
    grouped = pages.batches(native)
    each = grouped.select("doc_id", "batch_no", F.explode("page_nos").alias("page_no")).join(native, ["doc_id", "page_no"])
    content = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    sent = grouped.join(each.groupBy("doc_id", "batch_no").agg(content.alias("contents")), ["doc_id", "batch_no"])
    return pages.batch_coverage(engines.read_batches(sent, lambda: lambda texts: [t.strip() for t in texts]))


def converted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Native pages with those of the first OCR step in place of pages without text, in order."""
    ocr = cascade.latest(load(spark, folder, "readings").where("step = 'paddle'")).select("doc_id", F.posexplode("page_texts").alias("_k", "text"))
    done = pages.reassembled(load(spark, folder, "doc_pages"), ocr.select("doc_id", (F.col("_k") + 1).alias("ordinal"), "text"))
    return done.select("doc_id", "pages", "converted_pages", F.md5("text").alias("text_digest"))


def witnesses(spark: SparkSession, folder: str) -> DataFrame:
    seen = pages.witnesses(load(spark, folder, "page_lines").where("step = 'vision'").dropDuplicates(["line_id"]))
    return seen.select("doc_id", "reliable", "confidence", F.md5("text").alias("text_digest"))


def veto_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What a witness of the vision step says to an expensive step, by the longest text so far."""
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull() & (F.col("kind") != "expensive") & (F.col("step") != "vision")))
    best = rows.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ordinal"))).alias("current"))
    seen = pages.witnesses(load(spark, folder, "page_lines").where("step = 'vision'").dropDuplicates(["line_id"])).select("doc_id", "reliable", "text")
    both = best.join(seen, "doc_id", "left").withColumn("_v", X.vocabulary(F.col("current"))).withColumn("_w", X.vocabulary(F.coalesce("text", F.lit(""))))
    no = F.lit(False)
    veto = gates.veto(X.useful_words(F.col("current")), no, no, F.col("reliable"), X.useful_words(F.coalesce("text", F.lit(""))), gates.jaccard(F.array("_v", "_w")))
    return both.select("doc_id", F.col("reliable").isNotNull().alias("witnessed"), F.coalesce(veto, F.lit("proceed")).alias("veto"))


def screened_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The longest text of every document before the screening of cards; what is dropped is replaced by a notice."""
    rows = cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))
    best = rows.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ordinal"))).alias("text"))
    labels = load(spark, folder, "documents").select("doc_id", "label").dropDuplicates(["doc_id"])
    judged = gates.screening(best.join(labels, "doc_id", "left"))
    return judged.select("doc_id", F.col("drop").alias("dropped"), F.length(F.when(F.col("drop"), gates.NOTICE).otherwise(F.col("text"))).alias("n_chars"))


def losing_readings(spark: SparkSession, folder: str) -> DataFrame:
    """All readings with text but the winner of the contest."""
    rows = X.with_score(X.with_metrics(cascade.latest(load(spark, folder, "readings").where(F.col("text").isNotNull()))))
    won = cascade.contest(rows).select("doc_id", F.col("step").alias("won"))
    return rows.join(won, "doc_id", "left").where(F.coalesce(F.col("step") != F.col("won"), F.lit(True))).select("doc_id", "step", "score")


def converted_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "readings").where("kind = 'expensive'")
    return rows.select("reading_id", F.length(prose.without_images(F.col("text"))).alias("n_chars"), prose.converted_is_empty(F.col("text")).alias("is_empty"))


def response_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of every model's answer, here each reading between the marks that the model is asked for."""
    rows = load(spark, folder, "readings").where("step = 'paddle' and page_texts is not null")
    answer = F.concat(F.lit("<think>a</think>\n"), F.array_join(F.transform("page_texts", lambda p: F.concat(F.lit("=== INICIO DA TRANSCRICAO ===\n"), F.coalesce(p, F.lit("")), F.lit("\n=== FIM DA TRANSCRICAO ==="))), "\n"))
    blocks = rows.select("reading_id", prose.response_blocks(answer).alias("_b"))
    return blocks.select("reading_id", F.size("_b").alias("n_pages"), F.md5(F.array_join("_b", "|")).alias("digest"))


def engine_report(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(engines.REGISTRY.report(), "engine string, priority int, available boolean, why string")


def route_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The route of every page with what it was decided by."""
    source = load(spark, folder, "page_lines").dropDuplicates(["line_id"])
    routed = lines.route(lines.with_coverage(source, lines.lexicon(load(spark, folder, "documents"))))
    return routed.select("doc_id", "step", "page_no", lines.evidence().alias("evidence"))


def privacy_scan(spark: SparkSession, folder: str) -> DataFrame:
    return checks.privacy(load(spark, folder, "documents").select("doc_id", "text"))


def unwrapped_files(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of envelopes written as rich text and unwrapped again."""
    rows = load(spark, folder, "unwrapped").where("file_format = 'rtf' and text is not null").select("unwrap_id", "text").distinct()
    sign = lambda c: F.when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).when(c == "\n", F.lit("\\par ")).when(F.ascii(c) < 128, c)
    high, low = (lambda c: F.floor((F.ascii(c) - 0x10000) / 1024) + 0xD800), (lambda c: F.pmod(F.ascii(c) - 0x10000, F.lit(1024)) + 0xDC00)
    number = lambda n: F.concat(F.lit("\\u"), n.cast("string"), F.lit("?"))
    coded = lambda c: F.coalesce(sign(c), F.when(F.ascii(c) < 0x10000, number(F.ascii(c))).otherwise(F.concat(number(high(c)), number(low(c)))))
    content = F.concat(F.lit("{\\rtf1 "), F.array_join(F.transform(F.split(F.regexp_replace("text", "[\r\x00]", ""), ""), coded), ""), F.lit("}"))
    opened = rows.select("unwrap_id", formats.unwrap(F.encode(content, "utf-8")).alias("u"))
    return opened.select("unwrap_id", F.col("u.file_format").alias("seen_format"), F.md5(X.strip(F.col("u.text"))).alias("text_digest"))


def queries() -> dict[str, Query]:
    found = (
        text_metrics, text_scores, native_text, stamp_words, identifiers, identifiers_lost, unread_marks, structure_scores, pages_without_text, image_coverage,
        attachment_screening, lexicon, line_coverage, resegmented_texts, line_kinds, page_containment, document_layers, reread_targets, recovered_lines, page_routes, page_confidence, page_merge,
        reading_gates, reading_agreement, best_readings, longest_texts, step_comparison, replacements, final_text, amounts_repaired, responses, file_formats,
        private_numbers, cascade_results, cascade_guarded, score_reasons, pages_to_read, transcriptions, engine_readings, batch_coverage, converted_pages, witnesses, veto_decisions,
        screened_texts, losing_readings, converted_texts, response_pages, engine_report, route_evidence, privacy_scan, unwrapped_files,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
