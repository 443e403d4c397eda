"""The cascade over a whole archive: every document's readings in order of cost, stopped at the first one that is good enough.

What one document's loop would decide step by step is one grouped plan here: all readings are measured in parallel, the few rows
of a document (one for each step) are gathered into an ordered array, and the first closing position, the agreement of all readings
so far, the consensus on emptiness and the contest are expressions over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import prose
from pergamin.functions import text as X
from pergamin.operators import gates

DEFAULT = C.Thresholds()


def latest(readings: DataFrame) -> DataFrame:
    """One row for each document and step: of rows delivered again the one loaded last, ties by the digest of the text.

    The texts are not sorted: the choice is a partial aggregation over (loaded_at, digest).
    """
    order = F.struct(F.col("loaded_at"), F.coalesce(F.md5("text"), F.lit("")), F.col("reading_id"))
    return readings.groupBy("doc_id", "step").agg(F.max_by(F.struct(*(c for c in readings.columns if c not in ("doc_id", "step"))), order).alias("_r")).select("doc_id", "step", "_r.*")


def page_statistics(pages: DataFrame) -> DataFrame:
    """Structure of a document's native pages: chars_per_page, empty_pages, fragmentation. Pages given again count once."""
    once = pages.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("chars", "blocks", "words"), F.struct("chars", "blocks", "words")).alias("_p")).select("doc_id", "_p.*")
    fragmentation = F.when(F.sum("words") > 0, F.round(F.sum("blocks") / F.sum("words"), 4)).otherwise(F.lit(1.0))
    empty = F.round(F.avg((F.col("chars") < 50).cast("double")), 4)
    return once.groupBy("doc_id").agg(F.count("*").alias("native_pages"), F.round(F.sum("chars") / F.count("*"), 2).alias("chars_per_page"), empty.alias("empty_pages"), fragmentation.alias("fragmentation"))


def uncovered_images(pages: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """Pages (doc_id, page_no, uncovered): whether an image takes a share of the page and no text block's centre lies in it."""
    images, texts = F.filter("boxes", lambda b: b["kind"] == 1), F.filter("boxes", lambda b: b["kind"] == 0)
    area = F.col("page_w") * F.col("page_h")

    def bare(i: Column) -> Column:
        inside = lambda x: (((x["x1"] + x["x2"]) / 2).between(i["x1"], i["x2"])) & (((x["y1"] + x["y2"]) / 2).between(i["y1"], i["y2"]))
        return ((i["x2"] - i["x1"]) * (i["y2"] - i["y1"]) / area >= t.uncovered_image_share) & ~F.exists(texts, inside)

    return pages.select("doc_id", "page_no", F.coalesce((area > 0) & F.exists(images, bare), F.lit(False)).alias("uncovered"))


def measured(documents: DataFrame, pages: DataFrame, readings: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """Every reading with what the gates look at and its verdict: ``accepted`` and ``reason``; refused readings keep their text."""
    rows = X.with_score(X.with_metrics(latest(readings).withColumn("text", F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("_bare", X.strip_stamp(F.col("text"))).withColumn("bare_chars", F.length("_bare"))
    rows = rows.withColumn("useful_words", F.size(F.regexp_extract_all("_bare", F.lit(C.LATIN_WORD), F.lit(0)))).withColumn("vocabulary", F.array_distinct(X.latin_words(F.col("_bare")))).drop("_bare")
    profile = documents.select("doc_id", F.col("pages").alias("doc_pages"), "has_image", "has_vector").dropDuplicates(["doc_id"])
    coverage = uncovered_images(pages, t).groupBy("doc_id").agg(F.bool_or("uncovered").alias("uncovered"))
    rows = rows.join(profile, "doc_id", "left").join(page_statistics(pages), "doc_id", "left").join(coverage, "doc_id", "left")
    rows = rows.withColumns(
        {
            "chars_per_page": F.coalesce("chars_per_page", F.length("text") / F.greatest(F.coalesce("doc_pages", F.lit(1)), F.lit(1))),
            "empty_pages": F.coalesce("empty_pages", (F.length("text") < 50).cast("double")),
            "fragmentation": F.coalesce("fragmentation", F.lit(0.0)),
        }
    )
    rows = X.with_structure_score(rows)
    c = F.col
    native = c("kind") == "native"
    gate = gates.acceptance(c("useful_words"), c("glyph_index"), c("bare_chars"), c("doc_pages"), c("has_image"), c("has_vector"), F.when(~native, c("score")), t)
    reason = (
        F.when(~F.coalesce("available", F.lit(True)), F.concat(F.lit("unavailable: "), F.coalesce("why", F.lit("no reason given"))))
        .when(X.strip(c("text")) == "", F.when(native, "no text layer").otherwise("no text"))
        .when(native & (c("structure_score") < t.native_accept_score), "structure below the minimum")
        .when(native & F.coalesce("uncovered", F.lit(False)), "image without text")
        .when(~native & (F.coalesce("confidence", F.lit(0.0)) < t.min_confidence) & (c("kind") == "ocr"), "confidence below the minimum")
        .when(~native & ((F.coalesce("pages_sent", F.lit(0)) == 0) | (c("pages_sent") != c("pages_answered"))), "pages without an answer")
        .otherwise(gate)
    )
    rows = rows.withColumn("reason", reason).withColumn("accepted", c("reason").isin(*gates.ACCEPTED))
    return rows.withColumn("read_something", F.coalesce("available", F.lit(True)) & (X.strip(c("text")) != ""))


#: What the contest and the gates over all readings look at.
ENTRY = ("ordinal", "step", "text", "score", "accepted", "reason", "useful_words", "vocabulary", "read_something")


def results(rows: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """One row for each document: text, step, score, how it closed (``closed_by``), similarity and provenance.

    Refused is not discarded: a reading that no gate accepts still takes part in the contest. Ties go to the cheaper step.
    """
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("r"))
    return _settled(docs.withColumn("r", F.transform("r", lambda x: x.withField("refused", F.lit(False)))), t)


def guarded(rows: DataFrame, witnesses: DataFrame | None = None, t: C.Thresholds = DEFAULT) -> DataFrame:
    """As ``results``, with the gates of expensive steps and the winner as running text.

    An expensive reading is held against the longest text so far. If that is not to be replaced by it, the reading is no candidate:
    it still counts as a vote on agreement and emptiness, but neither closes nor wins. ``witnesses`` (doc_id, is_photo, is_blank,
    reliable, text) are local readings that may veto the step: what it read is left out then. A document without a witness has
    that in its provenance; without the table there are no vetoes.
    """
    known = witnesses is not None
    extra = F.struct(gates.replacement_measures(F.col("text")).alias("m"), X.anchors(F.col("text")).alias("anchors"), F.coalesce("doc_pages", F.lit(1)).alias("pages"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_sent", "pages_answered", "failed_batches")))
    entry = F.struct(*ENTRY, F.lit(False).alias("refused"), F.col("kind"), extra.alias("x"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    if known:
        seen = F.struct("is_photo", "is_blank", F.when(F.col("text").isNotNull(), F.coalesce("reliable", F.lit(0))).alias("reliable"), X.useful_words(F.col("text")).alias("useful"), X.vocabulary(F.col("text")).alias("vocabulary"))
        docs = docs.join(witnesses.groupBy("doc_id").agg(F.max_by(seen, F.struct(F.coalesce("reliable", F.lit(-1)), F.coalesce(F.md5("text"), F.lit("")))).alias("_w")), "doc_id", "left")

    def judged(x: Column, p: Column) -> Column:
        """The expensive reading x behind the longest text p, which is null if there is none."""
        lost = X.lost_anchors(p["x"]["anchors"], x["x"]["anchors"])
        why = F.when(x["read_something"] & p.isNotNull(), gates.rejection(p["x"]["m"], x["x"]["m"], x["x"]["pages"], x["x"]["pages_sent"], x["x"]["pages_answered"], x["x"]["failed_batches"], F.lit(True), lost, t))
        plain = x.withField("refused", why.isNotNull()).withField("accepted", x["accepted"] & why.isNull()).withField("reason", F.coalesce(why, x["reason"]))
        if not known:
            return plain
        w = F.col("_w")
        alike = gates.jaccard(F.array(F.coalesce(p["vocabulary"], F.array().cast("array<string>")), w["vocabulary"]), t.min_useful_words)
        veto = gates.veto(F.coalesce(p["x"]["m"]["useful"], F.lit(0)), F.coalesce(w["is_photo"], F.lit(False)), F.coalesce(w["is_blank"], F.lit(False)), w["reliable"], w["useful"], alike, t)
        skipped = x.withField("read_something", F.lit(False)).withField("accepted", F.lit(False)).withField("reason", F.concat(F.lit("veto: "), veto))
        unseen = plain.withField("reason", F.concat(F.when(plain["accepted"], "ok").otherwise(plain["reason"]), F.lit("; no witness")))
        return F.when(veto.isNotNull(), skipped).when(w["reliable"].isNull(), unseen).otherwise(plain)

    def step(done: Column, x: Column) -> Column:
        texts = F.transform(F.filter(done, lambda d: d["read_something"] & ~d["refused"]), lambda d: F.struct((-d["x"]["m"]["chars"]).alias("o"), d["ordinal"].alias("ordinal"), d.alias("d")))
        longest = F.array(F.try_element_at(F.array_sort(texts), F.lit(1))["d"])
        return F.concat(done, F.when(x["kind"] == "expensive", F.transform(longest, lambda p: judged(x, p))).otherwise(F.array(x)))

    docs = docs.withColumn("r", F.aggregate("r", F.slice("r", 1, 0), step))
    return _settled(docs, t).withColumn("text", prose.normalize(F.col("text")))


def _settled(docs: DataFrame, t: C.Thresholds) -> DataFrame:
    """``results`` of documents with ``r``, their readings in order."""
    so_far = lambda i: F.filter(F.slice("r", 1, i), lambda x: x["read_something"])
    alike = lambda i: gates.jaccard(F.transform(so_far(i), lambda x: x["vocabulary"]), t.min_useful_words)
    docs = docs.withColumn("_similarity", F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.round(alike(i), 4)))
    docs = docs.withColumn("_accepted", F.coalesce(F.array_position(F.transform("r", lambda x: x["accepted"]), True), F.lit(0)))
    docs = docs.withColumn("_agreed", F.coalesce(F.array_position(F.transform("_similarity", lambda s: s >= t.min_agreement), True), F.lit(0)))
    first = F.least(F.when(F.col("_accepted") > 0, F.col("_accepted")), F.when(F.col("_agreed") > 0, F.col("_agreed")))
    docs = docs.withColumn("_close", first.cast("int"))
    read = F.filter("r", lambda x: x["read_something"])
    empty = F.col("_close").isNull() & gates.empty_by_consensus(F.transform(read, lambda x: x["useful_words"]), t)
    closed = F.when(F.col("_close") == F.col("_accepted"), "acceptance").when(F.col("_close").isNotNull(), "agreement").when(empty, "consensus").otherwise("contest")
    docs = docs.withColumn("closed_by", closed)
    field = F.when(F.col("closed_by") == "acceptance", F.slice("r", F.col("_close"), F.lit(1))).when(F.col("closed_by") == "agreement", F.filter(so_far(F.col("_close")), lambda x: ~x["refused"])).when(F.col("closed_by") == "contest", F.filter(read, lambda x: ~x["refused"])).otherwise(F.slice("r", 1, 0))
    ranked = F.transform(field, lambda x: F.struct(-gates.usefulness(x["score"], x["text"]), x["ordinal"], x["step"], x["text"], x["score"]))
    docs = docs.withColumn("_winner", F.try_element_at(F.array_sort(ranked), F.lit(1)))
    seen = F.slice("r", 1, F.coalesce("_close", F.size("r")))
    path = F.array_join(F.transform(seen, lambda x: F.concat(x["step"], F.lit("("), F.when(x["accepted"] & ~x["reason"].endswith("; no witness"), "ok").otherwise(x["reason"]), F.lit(")"))), " -> ")
    step = F.coalesce(F.col("_winner.step"), F.when(F.col("closed_by") == "consensus", F.lit("empty_by_consensus")), F.lit("none"))
    return docs.select(
        "doc_id", step.alias("step"), F.coalesce("_winner.text", F.lit("")).alias("text"), F.col("_winner.score").alias("score"), "closed_by",
        F.element_at("_similarity", F.coalesce("_close", F.size("r"))).alias("similarity"), F.concat(step, F.lit(": "), path).alias("provenance"),
    )


def contest(rows: DataFrame) -> DataFrame:
    """The most useful reading of each document, ties by order of cost; documents without text have none."""
    ranked = rows.withColumn("usefulness", F.round(gates.usefulness(F.col("score"), F.col("text")), 4)).where(X.strip(F.col("text")) != "")
    first = Window.partitionBy("doc_id").orderBy(F.desc("usefulness"), "ordinal")
    return ranked.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("doc_id", "step", "usefulness")
