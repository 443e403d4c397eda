"""Lines with geometry: kinds, containment of damaged ones, the page's report and the route a page should take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C
from pergamin.functions import text as X
from pergamin.operators import segment, skew
from pergamin.session import write_through

#: Words of a lexicon that is sent to every task: a few megabytes.
BROADCAST_WORDS = 200_000
# Coverage below which words of a line may have run together, and from which on parting them has helped.
PARTED = 0.55
PAGE = ["doc_id", "step", "page_no"]


def lexicon(texts: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Words that occur ``least`` times in the corpus: a partial and a final aggregation. The short ones that always count are added
    where coverage is measured."""
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(C.LEXICON_TOKEN), F.lit(0))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def with_coverage(lines: DataFrame, words: DataFrame, key: str = "line_id", text: str = "text") -> DataFrame:
    """Adds ``coverage``: share of a line's tokens that the lexicon has, 1 if it has no token.

    The lexicon is written and its size read: one of at most BROADCAST_WORDS words is broadcast, so tokens stay in their task and
    meet again per line in a partial aggregation before anything is shuffled; a larger one is joined by word, frequent words
    apart. Lines of the same key and text share one value, as copies change no share. Short words are always known.
    """
    tokens = lines.select(key, F.md5(text).alias("_text"), F.regexp_extract_all(F.lower(text), F.lit(C.LEXICON_TOKEN), F.lit(0)).alias("_tokens")).where(F.size("_tokens") > 0)
    single = tokens.select(key, "_text", F.explode("_tokens").alias("word"))
    lexicon = write_through(words.select("word", F.lit(1).alias("_known")), "lexicon")
    known = single.join(F.broadcast(lexicon), "word", "left") if lexicon.count() <= BROADCAST_WORDS else skew.join(single, lexicon, ["word"], "left")
    found = F.count_if(F.col("_known").isNotNull() | F.col("word").isin(*C.SHORT_WORDS))
    covered = known.groupBy(key, "_text").agg((found / F.count("*")).alias("coverage"))
    return lines.withColumn("_text", F.md5(text)).join(covered, [key, "_text"], "left").drop("_text").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))


def recover(lines: DataFrame, words: DataFrame, key: str = "line_id", text: str = "text") -> DataFrame:
    """Lines with ``coverage`` whose words had run together with them parted: text and coverage anew and ``recovered``.

    Only lines of prose that the lexicon hardly covers and that hold a long run are looked at, and a parting is taken only if
    the lexicon then covers the line."""
    tokens = F.size(F.regexp_extract_all(F.lower(text), F.lit(C.LEXICON_TOKEN), F.lit(0)))
    few = lines.where((F.col("coverage") < PARTED) & (tokens >= 2) & ~F.col(text).rlike(C.REFERENCE_LINE) & ~F.col(text).rlike(C.DATE_LINE)).select(key, F.col(text).alias("_old")).distinct()
    parted = segment.resegment(few, words, "_old", "_new").where(F.col("_new").isNotNull())
    better = with_coverage(parted, words, key, "_new").where(F.col("coverage") >= PARTED).select(key, F.col("_old").alias(text), "_new", F.col("coverage").alias("_better"))
    joined = lines.join(better, [key, text], "left")
    return joined.withColumns({text: F.coalesce("_new", text), "coverage": F.coalesce("_better", "coverage"), "recovered": F.col("_new").isNotNull()}).drop("_new", "_better")


def box(poly: Column) -> dict[str, Column]:
    """Edges of the box around a polygon; null without one."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def classify(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``clean_text``, ``junk`` and ``kind`` (clean, suspect, illegible, vertical, fragment or, of those that ``recover`` parted,
    recovered) to lines with ``coverage``."""
    c = F.col
    rows = lines.withColumn("_t", X.strip(F.coalesce(c(text), F.lit("")))).withColumn("clean_text", X.strip(X.removed(c("_t"), C.FOREIGN_SCRIPT)))
    n = F.length("clean_text")
    foreign = 1 - n / F.greatest(F.length("_t"), F.lit(1))
    junk = (n - F.length(X.removed(c("clean_text"), C.JUNK_CHARACTER))) / F.greatest(n, F.lit(1))
    alnum = n - F.length(X.removed(c("clean_text"), r"[\p{L}\p{N}]"))
    rows = rows.withColumns({"_foreign": foreign, "_junk": junk, "_alnum": alnum, **{f"_{k}": v for k, v in box(c("poly")).items()}})
    tokens = F.size(F.regexp_extract_all(F.lower("clean_text"), F.lit(C.LEXICON_TOKEN), F.lit(0)))
    w, h = c("_x2") - c("_x1"), c("_y2") - c("_y1")
    middle = (c("_x1") + c("_x2")) / 2 / c("page_w")
    sized = c("_x1").isNotNull() & (c("page_w") > 1) & (c("page_h") > 1)
    vertical = sized & (h > 1.5 * F.greatest(w, F.lit(1.0))) & (h > 0.06 * c("page_h")) & ((middle < 0.13) | (middle > 0.87))
    structural = c("clean_text").rlike(C.REFERENCE_LINE) | c("clean_text").rlike(C.DATE_LINE) | ((n <= 24) & c("clean_text").rlike(C.CAPS_TITLE)) | c("clean_text").rlike(C.ANCHOR_LINE)
    score = F.coalesce(c("score"), F.lit(0.0))
    illegible = (c("_foreign") > 0.5) | (c("_junk") > 0.55) | ((score < 0.55) & (c("coverage") < 0.12) & (n >= 14))
    suspect = ((tokens >= 2) & (c("coverage") < 0.35) & (score < 0.85)) | (c("_foreign") > 0.2)
    parted = c("recovered") if "recovered" in lines.columns else F.lit(False)
    kind = F.when((c("_alnum") == 0) & (n <= 3), "fragment").when(vertical, "vertical").when(parted, "recovered").when(structural, "clean").when(illegible, "illegible").when(suspect, "suspect").otherwise("clean")
    return rows.withColumn("kind", kind).withColumn("junk", F.round("_junk", 3)).drop("_t", "_foreign", "_junk", "_alnum", "_x1", "_y1", "_x2", "_y2")


def mark_signatures(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Turns a clean scribble into ``signature`` where a name in capitals follows within two lines and an office within three."""
    c = F.col
    ahead = Window.partitionBy(*PAGE).orderBy(order, "line_id")
    body = lines.where("kind <> 'fragment'")
    name = F.max(c("clean_text").rlike(C.CAPS_NAME).cast("int")).over(ahead.rowsBetween(1, 2))
    office = F.max(c("clean_text").rlike(C.JOB_TITLE).cast("int")).over(ahead.rowsBetween(1, 3))
    tokens = F.size(F.regexp_extract_all(F.lower("clean_text"), F.lit(C.LEXICON_TOKEN), F.lit(0)))
    scribble = F.length("clean_text").between(2, 28) & (tokens <= 3) & (c("coverage") < 0.25) & (F.coalesce(c("score"), F.lit(0.0)) < 0.97) & ~c("clean_text").rlike("[0-9]")
    marked = body.withColumn("_sign", (c("kind") == "clean") & scribble & (name == 1) & (office == 1))
    marked = marked.withColumn("kind", F.when(F.col("_sign"), "signature").otherwise(c("kind"))).drop("_sign")
    return marked.unionByName(lines.where("kind = 'fragment'"))


def contain(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Page report: counts per kind, trusted share of characters, and the text with one mark for each run of damaged lines."""
    c = F.col
    ordered = Window.partitionBy(*PAGE).orderBy(order, "line_id")
    damaged = c("kind").isin("illegible", "vertical", "signature")
    rows = lines.withColumn("_body", c("kind") != "fragment")
    body = rows.where("_body").withColumn("_damaged", damaged).withColumn("_again", F.lag("_damaged", 1, False).over(ordered))
    shown = F.when(~c("_damaged"), c("clean_text")).when(c("_again"), F.lit(None)).when(c("kind") == "signature", F.lit(C.SIGNATURE_MARKER)).otherwise(F.lit(C.ILLEGIBLE_MARKER))
    rows = body.withColumn("_shown", shown).unionByName(rows.where("not _body"), allowMissingColumns=True)
    size = F.length("clean_text")
    count = lambda kind: F.count_if(c("kind") == kind).alias(f"n_{kind}")
    pages = rows.groupBy(*PAGE).agg(
        F.count("*").alias("n_total"), *(count(k) for k in ("illegible", "vertical", "fragment", "suspect", "signature", "recovered")),
        F.round(F.sum(F.when(c("kind").isin("clean", "recovered"), size).otherwise(0)) / F.greatest(F.sum(F.greatest(size, F.lit(1))), F.lit(1)), 3).alias("trusted_fraction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("_shown").isNotNull(), F.struct(order, "line_id", "_shown")))), lambda x: x["_shown"]), "\n").alias("text"),
    )
    return pages.withColumn("needs_escalation", (c("trusted_fraction") < 0.72) | (c("n_illegible") >= 3) | (c("n_illegible") + c("n_suspect") >= 6)).withColumn(
        "suggested_action", F.when(c("needs_escalation"), "escalate").when(c("n_illegible") == 0, "ok").otherwise("accept_with_holes")
    )


def layer_report(pages: DataFrame) -> DataFrame:
    """The reports of a document's pages summed up; the trusted fraction is their plain mean."""
    sums = [F.sum(k).alias(k) for k in ("n_total", "n_illegible", "n_suspect", "n_signature", "n_vertical")]
    return pages.groupBy("doc_id", "step").agg(*sums, F.round(F.avg("trusted_fraction"), 3).alias("trusted_fraction"), F.bool_or("needs_escalation").alias("needs_escalation"))


def reread_targets(lines: DataFrame, most: int = C.Thresholds().max_targets, order: str = "line_no") -> DataFrame:
    """Lines to read again: vertical ones first, at most ``most`` of a page."""
    first = Window.partitionBy(*PAGE).orderBy((F.col("kind") == "vertical").desc(), order, "line_id")
    return lines.where("kind in ('vertical', 'illegible')").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


#: What a route is decided by, by name.
HALF = 0.500000001  # half up, whatever the last bit of a mean
EVIDENCE = ("amounts", "columns", "coverage", "median_score", "numeric", "prose", "rules", "short")


def evidence() -> Column:
    """The route with its measures, of two decimals, as text; a missing measure is 0."""
    values = [F.format_string(f"{name}=%.2f", F.floor(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * 100 + HALF) / 100) for name in EVIDENCE]
    return F.concat(F.col("route"), F.lit(" ("), F.concat_ws(", ", *values), F.lit(")"))


def route(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """One row for every page: its votes and the ``route`` (table, stamped_digital, degraded or normal).

    Columns are gaps and islands over the starts of lines: a gap above 0.02 of the width opens a new one, and the share of
    lines in groups of at least three counts, if the page has six starts.
    """
    c = F.col
    rows = lines.withColumn("_t", X.strip(F.coalesce(c("text"), F.lit("")))).where("_t <> ''")
    rows = rows.withColumn("_x", F.when(c("page_w") > 0, box(c("poly"))["x1"] / c("page_w")))
    by_start = Window.partitionBy(*PAGE).orderBy(F.col("_x").asc_nulls_last(), "line_id")
    placed = rows.withColumn("_gap", ((c("_x") - F.lag("_x").over(by_start)) > 0.02).cast("int"))
    placed = placed.withColumn("_group", F.when(c("_x").isNotNull(), F.sum(F.coalesce("_gap", F.lit(0))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))))
    sized = placed.withColumn("_members", F.count("_x").over(Window.partitionBy(*PAGE, "_group")))
    n = F.length("_t")
    digits = n - F.length(X.removed(c("_t"), "[0-9]"))
    mean = lambda test: F.avg(test.cast("double"))
    pages = sized.groupBy(*PAGE).agg(
        mean(n <= 22).alias("short"), mean((digits >= 2) & (n <= 40)).alias("numeric"), F.sum(F.regexp_count("_t", F.lit(C.AMOUNT_MARK))).alias("amounts"),
        F.count_if(c("_t").rlike(C.RULE_MARK)).alias("rules"), F.when(F.count("_x") < 6, F.lit(0.0)).otherwise(F.count_if(c("_x").isNotNull() & (c("_members") >= 3)) / F.count("_x")).alias("columns"),
        mean((n > 45) & c("_t").rlike(r"[.;:]\z")).alias("prose"), F.max(c("_t").rlike(C.SEAL)).alias("seal"), F.avg("coverage").alias("coverage"), F.median("score").alias("median_score"),
    )
    votes = (c("short") > 0.55).cast("int") + (c("numeric") > 0.30).cast("int") + (c("amounts") >= 6).cast("int") + (c("rules") >= 3).cast("int") + (c("columns") > 0.35).cast("int") + (c("prose") < 0.12).cast("int")
    kind = F.when((c("votes") >= 4) & (c("numeric") > 0.20), "table").when(c("seal") & (c("coverage") >= 0.45), "stamped_digital").when((c("coverage") < 0.40) & (c("median_score") < 0.90) & (c("prose") < 0.15), "degraded").otherwise("normal")
    return pages.withColumn("votes", votes).withColumn("route", kind)
