"""Detection: recognizers to disjoint spans with scores and context."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as X
from cloakframe.functions.patterns import ALL, Recognizer
from cloakframe.operators.overlap import normalize_overlaps

DEFAULT_THRESHOLD = 0.35
CONTEXT = 40
_TEXT_SPAN = "array<struct<start:int,end:int,entity_type:string,score:double,text_span:string,context:string,recognizer_name:string>>"
_SPAN = "array<struct<start:int,end:int,entity_type:string,score:double,recognizer_name:string>>"


def _found(text: str, r: Recognizer, matches: Column) -> Column:
    """Spans of a recognizer's matches that its validator keeps, with scores boosted by context words."""
    spans = X.spans_of(text, matches, r.pattern)
    if r.validate:
        spans = F.filter(spans, lambda s: r.validate(s["text"]))
    words = r"\b(?:" + "|".join(r.context) + r")\b"

    def scored(score_of) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(r.entity_type).alias("entity_type"), score_of(s).alias("score"), F.lit(r.name).alias("recognizer_name")))

    plain = F.lit(r.score)
    if not r.context:
        return F.when(F.size(matches) > 0, scored(lambda s: plain)).otherwise(F.array().cast(_SPAN))
    boosted = lambda cut: scored(lambda s: F.when(F.lower(cut(*X.around(s["start"], s["end"], CONTEXT))).rlike(words), F.least(F.lit(1.0), plain + r.boost)).otherwise(plain))
    return F.when(F.size(matches) > 0, X.cutting(text, boosted)).otherwise(F.array().cast(_SPAN))


def matches_of(text: str, r: Recognizer) -> Column:
    """All matches of a recognizer's pattern; texts without its hint are not searched."""
    found = X.matches(text, r.pattern)
    if not r.hint:
        return found
    return F.when(F.col(text).rlike(r.hint) if r.hint_is_pattern else F.col(text).contains(r.hint), found).otherwise(F.array().cast("array<string>"))


def raw_spans(df: DataFrame, text: str = "text", recognizers: Iterable[Recognizer] = ALL, threshold: float | None = None, entities: list[str] | None = None, out: str = "spans") -> DataFrame:
    """df with all spans at or above the threshold; recognizers of unwanted types never run."""
    limit = threshold or DEFAULT_THRESHOLD  # 0.0 means the default
    own = [r for r in recognizers if entities is None or r.entity_type in entities]
    if not own:
        return df.withColumn(out, F.array().cast(_SPAN))
    found = df.select("*", *[matches_of(text, r).alias(f"_m{i}") for i, r in enumerate(own)])
    spans = F.concat(*[_found(text, r, F.col(f"_m{i}")).cast(_SPAN) for i, r in enumerate(own)])
    spans = F.coalesce(F.filter(spans, lambda s: s["score"] >= limit), F.array().cast(_SPAN))
    return found.withColumn(out, spans).drop(*[f"_m{i}" for i in range(len(own))])


def with_text(text: str, spans: Column) -> Column:
    """Spans with text_span and context."""
    def described(cut) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"),
                cut(s["start"], s["end"]).alias("text_span"), cut(*X.around(s["start"], s["end"], CONTEXT)).alias("context"), s["recognizer_name"].alias("recognizer_name"),
            ),
        )

    return F.when(F.size(spans) > 0, X.cutting(text, described)).otherwise(F.array().cast(_TEXT_SPAN))


def analyze(df: DataFrame, text: str = "text", recognizers: Iterable[Recognizer] = ALL, threshold: float | None = None, entities: list[str] | None = None, out: str = "spans") -> DataFrame:
    """df with disjoint spans: start, end, entity_type, score, text_span, context, recognizer_name."""
    found = raw_spans(df, text, recognizers, threshold, entities, "_raw")
    clean = found.withColumn("_clean", normalize_overlaps(F.col("_raw")))
    return clean.withColumn(out, with_text(text, F.col("_clean"))).drop("_raw", "_clean")


def detections(analyzed: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row per span."""
    return analyzed.select(*keys, F.explode(spans).alias("_s")).select(*keys, "_s.*")
