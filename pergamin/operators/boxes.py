"""Boxes on pages: overlap with lines, suppression of doubles, signatures; and the ink of a page's pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.functions import catalogue as C
from pergamin.operators.lines import PAGE, box

# Overlap from which a line lies in a box, and two boxes are one; most of a reading that can be a scribble.
LINE_SHARE, SAME_BOX = 0.15, 0.45
SCRIBBLE_COVERAGE, SCRIBBLE_SCORE, SCRIBBLE_CHARS = 0.30, 0.92, 40


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_of_line(line: Column, other: Column) -> Column:
    """Share of a line's box that lies in another; 0 if either is missing."""
    return F.coalesce(intersection(line, other) / F.greatest(area(line), F.lit(1.0)), F.lit(0.0))


def suppressed(boxes: Column, limit: float = SAME_BOX) -> Column:
    """Boxes by falling confidence without those that overlap a kept one by ``limit`` of their union; null stays null."""
    ranked = F.array_sort(boxes, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))

    def iou(a: Column, b: Column) -> Column:
        both = intersection(a, b)
        return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))

    return F.aggregate(ranked, F.slice(boxes, F.lit(1), F.lit(0)), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= limit), kept).otherwise(F.array_append(kept, b)))


def signatures(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (doc_id, step, page_no, line_id) that a detector's box makes a signature: of a box without words of stamps the line
    least covered by the lexicon, if it may be a scribble. ``lines`` are classified; ``boxes`` have doc_id, page_no, x1 to y2.

    Lines meet the boxes of their page only; a box is reduced to one line by a partial aggregation.
    """
    c = F.col
    edges = box(c("poly"))
    placed = lines.where(c("poly").isNotNull()).select(*PAGE, "line_id", "kind", "clean_text", "coverage", "score", F.struct(*(v.alias(k) for k, v in edges.items())).alias("_line"))
    found = boxes.select("doc_id", "page_no", F.struct("x1", "y1", "x2", "y2").alias("_box")).distinct()
    inside = placed.join(found, ["doc_id", "page_no"]).where(overlap_of_line(c("_line"), c("_box")) >= LINE_SHARE)
    candidate = F.struct("coverage", "line_id", "kind", "clean_text", "score")
    best = inside.groupBy("doc_id", "step", "page_no", "_box").agg(F.bool_or(c("clean_text").rlike(C.STAMP_KEYWORDS)).alias("_stamp"), F.min_by(candidate, F.struct("coverage", "line_id")).alias("_l")).where(~c("_stamp"))
    scribble = c("_l.kind").isin("clean", "suspect") & ~c("_l.clean_text").rlike(C.REFERENCE_LINE) & (c("_l.coverage") < SCRIBBLE_COVERAGE) & (F.coalesce("_l.score", F.lit(0.0)) < SCRIBBLE_SCORE) & (F.length("_l.clean_text") <= SCRIBBLE_CHARS)
    return best.where(scribble).select(*PAGE, c("_l.line_id").alias("line_id")).distinct()


# Greys of a photograph and their share, darkest paper, the band at the top without content, share of ink of a blank page.
GREY, PHOTO_SHARE, PAPER, TOP_BAND, BLANK_SHARE = (60, 230), 0.45, 200, 0.12, 0.01
INK = T.StructType([T.StructField("is_photo", T.BooleanType()), T.StructField("ink", T.DoubleType()), T.StructField("is_blank", T.BooleanType())])


def ink_of(pixels: bytes | None, width: int | None, height: int | None) -> tuple:
    """Ink signals of an 8-bit grey image; null for one that is missing or of another size."""
    if pixels is None or not width or not height or len(pixels) != width * height:
        return None, None, None
    grey = np.frombuffer(pixels, np.uint8).reshape(int(height), int(width))
    body = grey[int(height * TOP_BAND) :]
    ink = float((body < PAPER).mean()) if body.size else 0.0
    return bool(((grey > GREY[0]) & (grey < GREY[1])).mean() > PHOTO_SHARE), ink, ink < BLANK_SHARE


@F.pandas_udf(INK)
def ink(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    found = [ink_of(p if p is None else bytes(p), None if pd.isna(w) else int(w), None if pd.isna(h) else int(h)) for p, w, h in zip(pixels, width, height)]
    return pd.DataFrame(found, columns=["is_photo", "ink", "is_blank"])
