"""Text in, text out: detection with role filter and propagation, policies, splicing, leak counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions import text as X
from cloakframe.functions.patterns import ALL
from cloakframe.operators.detect import analyze
from cloakframe.operators.leak import surviving
from cloakframe.operators.propagate import propagate
from cloakframe.operators.roles import ROLE_TYPES, drop_role_terms, terms_in


def analyze_rows(df: DataFrame, text: str = "text", recognizers=ALL, threshold: float | None = None, entities: list[str] | None = None) -> DataFrame:
    """df with spans: detected, without role terms, propagated, without role terms again."""
    found = analyze(df, text, recognizers, threshold, entities)
    named = {r.entity_type for r in recognizers} & set(ROLE_TYPES if entities is None else entities)
    if not named & set(ROLE_TYPES):  # nobody to be a role or to be looked for again
        return found
    found = found.withColumn("_defined", terms_in(F.col(text)))
    found = found.withColumn("spans", drop_role_terms(F.col("spans"), F.col("_defined")))
    return propagate(found, text).withColumn("spans", drop_role_terms(F.col("spans"), F.col("_defined"))).drop("_defined")


def anonymize_rows(analyzed: DataFrame, policies: dict[str, A.Policy] | None = None, text: str = "text", salt=None, out: str = "anonymized", default: A.Policy = A.HIPS) -> DataFrame:
    """analyzed with the rewritten text, edits (start, end, replacement) and operators_applied by type.

    salt: a column or string, the same for a document; it must not change between evaluations.
    """
    salt = F.lit(salt or "") if salt is None or isinstance(salt, str) else salt
    avoid = F.array_distinct(F.transform("spans", lambda s: s["text_span"]))
    made = analyzed.withColumn("_avoid", A.avoid_pattern(avoid))
    edit = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), A.render(s["entity_type"], s["text_span"], policies, salt, F.col("_avoid"), default).alias("replacement"))
    made = made.withColumn("edits", F.transform("spans", edit))
    applied = F.map_from_entries(F.array_distinct(F.transform("spans", lambda s: F.struct(s["entity_type"], A.operator_of(s["entity_type"], policies, default)))))
    return made.withColumn(out, X.splice(text, F.col("edits"))).withColumn("operators_applied", applied).drop("_avoid")


def process_text(df: DataFrame, policies: dict[str, A.Policy] | None = None, text: str = "text", recognizers=ALL, threshold: float | None = None, entities: list[str] | None = None, salt=None) -> DataFrame:
    """df with spans, edits, anonymized, operators_applied and leaks (originals that survive, with counts)."""
    made = anonymize_rows(analyze_rows(df, text, recognizers, threshold, entities), policies, text, salt)
    replaced = F.transform(F.filter("spans", lambda s: A.operator_of(s["entity_type"], policies, A.HIPS) != "keep"), lambda s: s["text_span"])
    return made.withColumn("leaks", surviving(F.col("anonymized"), replaced))
