"""Leak check: no replaced original may survive in the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as X


def matcher(needle: Column) -> Column:
    """Pattern of a whitespace-normalized original; NULL if it is exempt (one character, small number).

    Letters and digits at its edges must not continue outside; an underscore is a boundary.
    """
    compact = F.replace(needle, F.lit(" "), F.lit(""))
    exempt = (F.length(compact) < 2) | compact.rlike(r"^\p{Nd}{1,2}$")
    lead = F.when(needle.rlike(r"(?U)^[^\W_]"), F.lit(r"(?<![^\W_])")).otherwise(F.lit(""))
    tail = F.when(needle.rlike(r"(?U)[^\W_]$"), F.lit(r"(?![^\W_])")).otherwise(F.lit(""))
    return F.when(~exempt, F.concat(F.lit("(?U)"), lead, X.quoted(needle), tail))


def alternation(originals: Column) -> Column:
    """One pattern for any of the originals, longest first; NULL if none is left after the exemptions."""
    patterns = F.filter(F.transform(F.array_distinct(F.transform(originals, X.normalize_ws)), matcher), lambda p: p.isNotNull())
    ranked = F.array_sort(F.transform(patterns, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    joined = F.array_join(F.transform(ranked, lambda x: F.concat(F.lit("(?:"), x["p"], F.lit(")"))), "|")
    return F.when(F.size(patterns) > 0, joined)


def surviving(output: Column, originals: Column) -> Column:
    """Array of (original, occurrences) for the originals that output still holds, in input order."""
    ranked = F.array_sort(F.transform(originals, lambda o, i: F.struct(X.normalize_ws(o).alias("needle"), i.alias("i"), o.alias("original"))))
    firsts = X.once(ranked, lambda r: F.filter(r, lambda n, i: (i == 0) | (F.get(r, i - 1)["needle"] != n["needle"])))

    def counted(haystack: Column) -> Column:
        rows = F.transform(firsts, lambda n: F.struct(n["i"], n["original"].alias("original"), F.coalesce(F.regexp_count(haystack, matcher(n["needle"])), F.lit(0)).alias("occurrences")))
        return F.transform(F.array_sort(F.filter(rows, lambda c: c["occurrences"] > 0)), lambda c: F.struct(c["original"].alias("original"), c["occurrences"].alias("occurrences")))

    return F.when(F.size(originals) > 0, X.once(X.normalize_ws(output), counted)).otherwise(F.array().cast("array<struct<original:string,occurrences:int>>"))


def surviving_rows(outputs: DataFrame, originals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, original, occurrences) for outputs (doc, text) and originals (doc, original), joined on doc."""
    needles = originals.select(doc, "original", X.normalize_ws("original").alias("_n")).groupBy(doc, "_n").agg(F.min("original").alias("original"))
    text = outputs.select(doc, X.normalize_ws("text").alias("_h"))
    counted = text.join(needles, doc).select(doc, "original", F.regexp_count("_h", matcher(F.col("_n"))).alias("occurrences"))
    return counted.where("occurrences > 0")


def verify(outputs: DataFrame, originals: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(outputs without a leak, quarantine of the others): the quarantine carries counts, never values."""
    leaks = surviving_rows(outputs, originals, doc).groupBy(doc).agg(F.count(F.lit(1)).alias("leaked_values"), F.sum("occurrences").alias("leaked_occurrences"))
    return outputs.join(leaks, doc, "left_anti"), outputs.select(doc).join(leaks, doc)
