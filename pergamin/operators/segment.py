"""Words that a recogniser ran together, parted again by the lexicon."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergamin.functions import catalogue as C

# Runs that are looked at, and the lengths of their parts.
RUN, LONGEST, SHORTEST = re.compile("[A-Za-zÀ-ÿ]{14,}"), 18, 2


def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def parts_of(run: str, words: frozenset[str]) -> list[str] | None:
    """The run as words, the longest first part that leaves a rest of words; null if there is none of two parts or more.

    Read from the end, so every rest is solved once and the work is in proportion to the length of the run.
    """
    low = folded(run)
    if len(low) != len(run):
        return None
    best: list[list[int] | None] = [None] * len(run) + [[]]
    for start in range(len(run) - 1, -1, -1):
        for size in range(min(LONGEST, len(run) - start), SHORTEST - 1, -1):
            rest = best[start + size]
            if rest is not None and low[start : start + size] in words:
                best[start] = [size, *rest]
                break
    if best[0] is None or len(best[0]) < 2:
        return None
    out, at = [], 0
    for size in best[0]:
        out.append(run[at : at + size])
        at += size
    return out


def candidates(run: str) -> set[str]:
    """What may be a part of the run, folded: 17 for each letter at most."""
    low = folded(run)
    if len(low) != len(run):
        return set()
    return {low[k : k + size] for k in range(len(low)) for size in range(SHORTEST, min(LONGEST, len(low) - k) + 1)}


def resegment(df: DataFrame, lexicon: DataFrame, text: str = "text", output: str = "resegmented") -> DataFrame:
    """Adds ``output``: the text with words parted that were run together, null where nothing changes or for a null text.

    ``lexicon`` has word and n; all of its words are parts. The different runs are joined to it by their substrings, parted with
    what was found and joined back to the texts by digest. Texts without a long run do not reach Python.
    """
    long = F.col(text).rlike(RUN.pattern)
    rows = df.where(long).withColumn("_digest", F.sha2(text, 256))
    occurring = rows.select("_digest", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(RUN.pattern), F.lit(0)))).alias("_run")).distinct()
    runs = occurring.select("_run").distinct()

    def substrings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for run in frame["_run"]:
                yield pd.DataFrame({"_run": run, "_part": sorted(candidates(run))}, dtype=str)

    @F.pandas_udf("string")
    def fold(words: pd.Series) -> pd.Series:
        return words.map(folded, na_action="ignore")

    @F.pandas_udf("string")
    def split(runs: pd.Series, words: pd.Series) -> pd.Series:
        found = (parts_of(r, frozenset(w if w is not None else ()) | frozenset(C.SHORT_WORDS)) for r, w in zip(runs, words))
        return pd.Series([" ".join(f) if f else None for f in found], dtype=object)

    words = lexicon.select(fold("word").alias("_part")).distinct()
    known = runs.mapInPandas(substrings, "_run string, _part string").join(words, "_part", "left_semi").groupBy("_run").agg(F.collect_set("_part").alias("_parts"))
    splits = runs.join(known, "_run", "left").select("_run", split("_run", "_parts").alias("_split")).where(F.col("_split").isNotNull())
    changes = occurring.join(splits, "_run").groupBy("_digest").agg(F.collect_list("_run").alias("_runs"), F.collect_list("_split").alias("_splits"))

    @F.pandas_udf("string")
    def parted(texts: pd.Series, runs: pd.Series, splits: pd.Series) -> pd.Series:
        def one(t: str, r: list | None, s: list | None) -> str | None:
            if r is None:
                return None
            new = dict(zip(r, s))
            return RUN.sub(lambda m: new.get(m.group(), m.group()), t)

        return pd.Series([one(*x) for x in zip(texts, runs, splits)], dtype=object)

    done = rows.join(changes, "_digest", "left").withColumn(output, parted(text, "_runs", "_splits")).drop("_digest", "_runs", "_splits")
    return done.unionByName(df.where(F.coalesce(~long, F.lit(True))).withColumn(output, F.lit(None).cast("string")))
