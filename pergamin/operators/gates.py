"""The gates of the cascade as one expression each: acceptance, steps, screening, vetoes, replacement, agreement, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import text as X

DEFAULT = C.Thresholds()


def acceptance(useful: Column, glyph: Column, chars: Column, pages: Column, has_image: Column, has_vector: Column, score: Column | None = None, t: C.Thresholds = DEFAULT) -> Column:
    """Reason of the acceptance gate, tested in order of cost. ``chars``: length without the stamp. The text is good enough if
    the reason is one of the two in ``ACCEPTED``."""
    reason = F.when(~(F.coalesce(has_image, F.lit(True)) | F.coalesce(has_vector, F.lit(False))), F.lit("page with no visual content"))
    reason = reason.when(useful < t.min_useful_words, F.concat(F.lit("only "), useful.cast("string"), F.lit(" useful words outside the stamp")))
    reason = reason.when(glyph > t.max_glyph_index, F.lit("glyph indices instead of text"))
    if score is not None:
        reason = reason.when(score < t.min_score, F.lit("text quality below the minimum"))
    reason = reason.when(chars / F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) < t.min_chars_per_page, F.lit("too few characters a page"))
    return reason.otherwise(F.lit("adequate extraction"))


ACCEPTED = ("page with no visual content", "adequate extraction")


# What stands for the text of an attachment that is dropped.
NOTICE = "[identity card or vehicle paper: no text of the case]"


def screening(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``marks_found``, ``mark_density`` and ``drop``: attachments that are cards or vehicle papers carry no text of a case.

    A blank or null text is kept.
    """
    t = F.col(text)
    n = F.length(t)
    rows = df.withColumn("_card", X.card_text(t)).withColumn("marks_found", F.coalesce(X.card_marks(F.col("_card")), F.lit(0)))
    rows = rows.withColumn("mark_density", F.when(n > 0, 1000 * F.col("marks_found") / n).otherwise(F.lit(0.0)))
    vehicle = F.lit(False)
    for mark in C.VEHICLE_MARKS:
        vehicle = vehicle | F.contains(F.col("_card"), F.lit(mark))
    labelled = (F.lower(X.strip(F.col(label))) == C.PERSONAL_LABEL) & (n <= 1000)
    drop = F.when(X.strip(t) == "", False).when(vehicle, True).when(labelled, True).when(F.col("marks_found") < 2, False).when(F.col("mark_density") < 2.5, False).otherwise(True)
    return rows.withColumn("drop", F.when(t.isNull(), False).otherwise(drop)).drop("_card")


def jaccard(vocabularies: Column, floor: int = DEFAULT.min_useful_words) -> Column:
    """Shared part of all vocabularies of an array; 0 if there are fewer than two or one is below the floor."""
    enough = (F.size(vocabularies) >= 2) & F.forall(vocabularies, lambda v: F.size(v) >= floor)
    both = F.aggregate(F.slice(vocabularies, 2, F.size(vocabularies)), F.element_at(vocabularies, 1), lambda a, v: F.array_intersect(a, v))
    either = F.array_distinct(F.flatten(vocabularies))
    return F.when(enough, F.size(both) / F.size(either)).otherwise(F.lit(0.0))


def empty_by_consensus(counts: Column, t: C.Thresholds = DEFAULT) -> Column:
    """At least two readings that read something, all of them next to nothing."""
    return (F.size(counts) >= 2) & F.forall(counts, lambda n: n < t.min_useful_words)


def veto(useful: Column, is_photo: Column, is_blank: Column, reliable: Column, witness_useful: Column, similarity: Column, t: C.Thresholds = DEFAULT) -> Column:
    """Name of the veto against an expensive step, or null to proceed. ``reliable`` is null if there is no witness."""
    few = useful < t.min_useful_words
    return (
        F.when(few & is_photo, F.lit("photograph"))
        .when(few & is_blank, F.lit("no_ink"))
        .when(reliable.isNull(), F.lit(None).cast("string"))
        .when(reliable < t.min_reliable_words, F.lit("no_legible_word"))
        .when(witness_useful < t.min_useful_words, F.lit("sparse_page"))
        .when(similarity >= t.min_agreement, F.lit("reading_confirmed"))
    )


def rejection(previous: Column, new: Column, doc_pages: Column, sent: Column, answered: Column, failed: Column, trustworthy: Column, lost: Column, t: C.Thresholds = DEFAULT) -> Column:
    """Why a new text may not replace the previous one, or null. Of both: what ``replacement_measures`` gives; a null previous is none."""
    before = previous["real"] / F.greatest(doc_pages, F.lit(1))
    read = F.when(answered > 0, answered).when(sent > 0, sent).otherwise(doc_pages)
    after = new["real"] / F.greatest(read, F.lit(1))
    degenerate = previous["useful"] < t.min_useful_words
    exempt = degenerate | ~trustworthy
    richer = after >= t.much_richer * F.greatest(before, F.lit(1.0))
    truncated = (sent > 0) & (doc_pages > sent)
    return (
        F.when(F.coalesce(previous["chars"], F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(new["markers"] >= t.max_marker_fraction, F.lit("loop of unread marks"))
        .when(truncated & ~degenerate & ~richer, F.lit("pages were left out"))
        .when((failed > 0) & ~degenerate, F.lit("batches failed"))
        .when(~(exempt | truncated | richer) & (F.size(lost) > 0), F.concat(F.lit("identifiers lost: "), F.array_join(F.slice(lost, 1, 5), ", ")))
        .when((new["chars"] <= previous["chars"]) & ~exempt, F.lit("not longer than the text it would replace"))
    )


def replacement_measures(text: Column) -> Column:
    """What ``rejection`` looks at in a text."""
    return F.struct(F.length(text).alias("chars"), F.length(X.real_content(text)).alias("real"), X.marker_fraction(text).alias("markers"), X.useful_words(text).alias("useful"))


def replacement(df: DataFrame, t: C.Thresholds = DEFAULT) -> DataFrame:
    """Adds ``rejection`` (null: the new text may replace the old one) and ``lost`` to rows with previous, new, doc_pages, sent,
    answered, failed_batches and trustworthy."""
    c = F.col
    rows = df.withColumn("_old", replacement_measures(c("previous"))).withColumn("_new", replacement_measures(c("new")))
    rows = rows.withColumn("lost", X.lost_anchors(X.anchors(c("previous")), X.anchors(c("new"))))
    reason = rejection(c("_old"), c("_new"), c("doc_pages"), c("sent"), c("answered"), c("failed_batches"), c("trustworthy"), c("lost"), t)
    return rows.withColumn("rejection", reason).drop("_old", "_new")


def usefulness(score: Column, text: Column) -> Column:
    volume = F.length(X.strip(text))
    return F.when(volume == 0, F.lit(0.0)).otherwise(F.greatest(score, F.lit(0.0)) * F.log1p(volume))
