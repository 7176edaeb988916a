"""Role terms: words that name a role, title or defined term, not a person or firm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as X

ROLE_TYPES = ("PERSON", "ORGANIZATION")

# Role nouns, job titles, pronouns and the shapes of defined terms.
ROLE_NOUNS = [
    "party", "parties", "disclosing party", "receiving party", "discloser", "recipient", "authorized representative", "authorised representative",
    "representative", "employee", "employer", "supplier", "customer", "client", "contractor", "subcontractor", "consultant", "buyer", "seller",
    "purchaser", "vendor", "lessor", "lessee", "landlord", "tenant", "licensor", "licensee", "borrower", "lender", "guarantor", "company", "board",
    "board of directors", "directors", "shareholders", "founders", "investor", "investors", "claimant", "defendant", "respondent", "appellant",
    "applicant", "expert", "agreement", "confidential information", "effective date", "order", "services", "deliverables", "affiliate", "affiliates",
    "subsidiary", "provider", "service provider", "processor", "controller", "data controller", "data processor", "data subject", "hr",
    "human resources", "engineering", "operations", "finance", "legal", "sales", "marketing", "procurement", "compliance", "it",
    "product development", "logistics",
]
JOB_TITLES = [
    "chief", "officer", "chief executive officer", "chief financial officer", "chief operating officer", "chief technology officer",
    "chief information officer", "ceo", "cfo", "coo", "cto", "cio", "director", "managing director", "executive director", "non-executive director",
    "manager", "assistant", "reviewer", "chair", "chairman", "chairwoman", "chairperson", "secretary", "company secretary", "president",
    "vice president", "vp", "partner", "senior partner", "associate", "counsel", "general counsel", "head", "lead",
]
PRONOUNS = [
    "i", "me", "we", "us", "you", "he", "she", "him", "her", "they", "them", "it",
]
PERIOD = r"^(?:q[1-4]|h[12]|fy\s?'?[0-9]{2,4})$"
EDGE = "\"'.,;:()“”‘’"
# regexp_extract_all returns one group, so the two shapes in parentheses are two patterns.
DEFINED_IN_PARENS = r"""(?iuU)\((?:[^()"“”]{0,40}?\b)?(?:the|each\s+a|each\s+an|a|an)\s+["“]([^"”]{2,60})["”]"""
DEFINED_HEREINAFTER = r"""(?iuU)\(\s*hereinafter\s+(?:referred\s+to\s+as\s+)?["“](?:the\s+)([^"”]{2,60})["”]"""
DEFINED_MEANS = r"""(?iuU)["“]([^"”]{2,60})["”]\s+(?:means|shall\s+mean|has\s+the\s+meaning)"""


TERMS = ROLE_NOUNS + JOB_TITLES
# What is taken off a term, in this order.
POSSESSIVE = r"['’]s$"
DETERMINER = r"^(?:the|a|an|each|any|my|our|your|his|her|its|their|such)\s+"
ORDINAL = r"^(?:first|second|third|fourth|1st|2nd|3rd|4th)\s+"
UNIT = r"\s+(?:team|department|dept|division|unit|function)$"


def normalize_term(text: Column) -> Column:
    """Lower case, one space between words; no quotes around, possessive, determiner, ordinal or unit noun."""
    t = X.strip(text)
    t = F.regexp_replace(t, rf"^[{X._escaped(EDGE)}]+|[{X._escaped(EDGE)}]+$", "")
    t = X.normalize_ws(F.lower(t))
    for part in (POSSESSIVE, DETERMINER, ORDINAL, UNIT):
        t = F.regexp_replace(t, part, "")
    return t


def terms_in(text: Column) -> Column:
    """Array of the normalized terms that a text defines for itself."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (DEFINED_IN_PARENS, DEFINED_HEREINAFTER, DEFINED_MEANS)])
    return F.coalesce(F.array_distinct(F.filter(F.transform(found, normalize_term), lambda t: t != "")), F.array().cast("array<string>"))


def defined_terms(blocks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, defined): the terms of all blocks of a document that aren't blank."""
    own = blocks.where(X.strip(F.col(text)) != "").select(doc, F.explode(terms_in(F.col(text))).alias("t"))
    return own.groupBy(doc).agg(F.array_sort(F.collect_set("t")).alias("defined"))


def is_role_term(entity_type: Column, text: Column, defined: Column | None = None) -> Column:
    t = normalize_term(text)
    defined = F.coalesce(defined, F.array().cast("array<string>")) if defined is not None else F.array().cast("array<string>")
    known = lambda x: x.isin(TERMS) | F.array_contains(defined, x)
    role = t.isin(PRONOUNS) | (F.length(t) == 1) | t.rlike(PERIOD) | known(t) | (t.endswith("s") & known(F.left(t, F.length(t) - 1)))
    return entity_type.isin(*ROLE_TYPES) & (t != "") & role


def drop_role_terms(spans: Column, defined: Column | None = None) -> Column:
    """Spans (entity_type, text_span) without role terms."""
    return F.filter(spans, lambda s: ~is_role_term(s["entity_type"], s["text_span"], defined))
