"""Review sessions as tables: proposals, decisions, and what committing them does.

proposals: session_id, ord, detection_id, entity_type, score, original, segment_anchor, start, end,
           group_id, group_index, group_original
decisions: session_id, ord, kind (proposal | user_added), proposal_id, status (accept | reject), id,
           segment_anchor, entity_type, original, start, end, operator, operator_params, custom_replacement
sessions:  session_id, status (open | committed | abandoned), default_operator, default_operator_params,
           created_at, committed_at, salt
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions import text as X
from cloakframe.operators import mapping as M
from cloakframe.operators.blocks import fragment_words

PARAMS = "map<string,string>"
# Fixed value: what stands for a pseudonym while the store is locked.
LOCKED_PREVIEW = "<pseudonymize preview unavailable — unlock the mapping store>"


class SessionNotOpen(RuntimeError):
    """The session is committed or abandoned."""


class InvalidDecision(ValueError):
    """A decision names no proposal of its session."""


def detection_id(entity_type: Column, original: Column, position: Column) -> Column:
    """A content-addressed id of twelve hex digits."""
    return F.substring(F.sha1(F.concat(entity_type, F.lit("\0"), original, F.lit("\0"), position).cast("binary")), 1, 12)


def propose_spans(spans: DataFrame) -> DataFrame:
    """Proposals from one row per span: session_id, ord, segment_id, start, end, entity_type, score, text_span."""
    place = F.concat_ws(":", "segment_id", F.col("start").cast("string"))
    return spans.select(
        "session_id", "ord", detection_id(F.col("entity_type"), F.col("text_span"), place).alias("detection_id"), "entity_type", "score", F.col("text_span").alias("original"), F.col("segment_id").alias("segment_anchor"),
        "start", "end", F.lit(None).cast("string").alias("group_id"), F.lit(0).alias("group_index"), F.lit(None).cast("string").alias("group_original"),
    )


def propose_findings(findings: DataFrame) -> DataFrame:
    """Proposals from findings (session_id, block_ord, start, entity_type, score, original, pieces): one per piece.

    Pieces of a finding over several segments share a group id; the first is its head.
    """
    head = F.get("pieces", F.lit(0))
    group = detection_id(F.col("entity_type"), F.col("original"), F.concat(F.lit("group:"), head["segment_id"], F.lit(":"), head["start"].cast("string")))
    grouped = findings.withColumn("group_id", F.when(F.size("pieces") > 1, group))
    each = grouped.select("session_id", "block_ord", F.col("start").alias("_at"), "entity_type", "score", F.col("original").alias("_whole"), "group_id", F.posexplode("pieces").alias("group_index", "p"))
    place = F.concat_ws(":", "p.segment_id", F.col("p.start").cast("string"), "group_id")
    text = F.when(F.col("group_id").isNull(), F.col("_whole")).otherwise(F.col("p.text"))
    order = W.partitionBy("session_id").orderBy("block_ord", "_at", "group_index")
    return each.select(
        "session_id", (F.row_number().over(order) - 1).alias("ord"), detection_id(F.col("entity_type"), F.col("p.text"), place).alias("detection_id"), "entity_type", "score", text.alias("original"),
        F.col("p.segment_id").alias("segment_anchor"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "group_id", "group_index", F.when(F.col("group_id").isNotNull(), F.col("_whole")).alias("group_original"),
    )


def unknown_proposals(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposal decisions that name no proposal of their session."""
    return decisions.where("kind = 'proposal'").join(proposals.select("session_id", F.col("detection_id").alias("proposal_id")), ["session_id", "proposal_id"], "left_anti")


def effective_decisions(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """One decision per decided proposal: a decision on a piece holds for its group, and the last one wins."""
    own = decisions.where("kind = 'proposal'").select("session_id", F.col("ord").alias("_ord"), "proposal_id", "status", "operator", "operator_params", "custom_replacement")
    key = F.coalesce("group_id", "detection_id")
    target = proposals.select("session_id", F.col("detection_id").alias("proposal_id"), key.alias("_unit"))
    units = own.join(target, ["session_id", "proposal_id"]).drop("proposal_id")
    last = units.withColumn("_n", F.row_number().over(W.partitionBy("session_id", "_unit").orderBy(F.desc("_ord")))).where("_n = 1").drop("_n", "_ord")
    members = proposals.select("session_id", "detection_id", key.alias("_unit"))
    return members.join(last, ["session_id", "_unit"]).select("session_id", F.col("detection_id").alias("proposal_id"), "status", "operator", "operator_params", "custom_replacement")


def purge_overlaps(proposals: DataFrame, user_added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving proposals, removed (session_id, detection_id)) once reviewers' spans are added.

    A span removes proposals that it overlaps on its segment; touching ones stay.  Of a group that was
    hit, blank pieces go too, and the rest are trimmed and renumbered.
    """
    ua = user_added.select("session_id", "segment_anchor", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = proposals.join(ua, ["session_id", "segment_anchor"]).where("start < _e and end > _s").select("session_id", "detection_id", "group_id").distinct()
    groups = hit.where("group_id is not null").select("session_id", F.col("group_id").alias("_g")).distinct()
    marked = proposals.join(hit.select("session_id", "detection_id", F.lit(True).alias("_hit")), ["session_id", "detection_id"], "left")
    marked = marked.join(groups.withColumnRenamed("session_id", "_sid"), (F.col("session_id") == F.col("_sid")) & (F.col("group_id") == F.col("_g")), "left")
    marked = marked.withColumn("_gone", F.coalesce("_hit", F.lit(False)) | (F.col("_g").isNotNull() & (X.strip("original") == "")))
    removed = marked.where("_gone").select("session_id", "detection_id")
    stay = marked.where("not _gone")
    lead = F.length("original") - F.length(F.regexp_replace("original", r"(?U)^\s+", ""))
    text, start = X.strip("original"), F.col("start") + lead
    number = (F.row_number().over(W.partitionBy("session_id", "group_id").orderBy("ord")) - 1).cast("int")
    changed = F.col("_g").isNotNull()
    stay = stay.withColumn("group_index", F.when(changed, number).otherwise(F.col("group_index")))
    stay = stay.withColumns({"start": F.when(changed, start).otherwise(F.col("start")), "end": F.when(changed, start + F.length(text)).otherwise(F.col("end")), "original": F.when(changed, text).otherwise(F.col("original"))})
    return stay.select(*proposals.columns), removed


def drop_decisions(decisions: DataFrame, removed: DataFrame) -> DataFrame:
    """Decisions without those on removed proposals."""
    return decisions.join(removed.withColumnRenamed("detection_id", "proposal_id"), ["session_id", "proposal_id"], "left_anti").select(*decisions.columns)


def validate_user_added(user_added: DataFrame, segments: DataFrame) -> DataFrame:
    """user_added with reject_reason: NULL, or what is wrong with the marked span."""
    text = segments.select("session_id", F.col("segment_id").alias("segment_anchor"), F.col("text").alias("_t"))
    joined = user_added.join(text, ["session_id", "segment_anchor"], "left")
    reason = (
        F.when(F.col("_t").isNull(), F.lit("unknown segment"))
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("_t")), F.lit("offsets outside the segment"))
        .when(F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("original"), F.lit("text differs"))
    )
    return joined.withColumn("reject_reason", reason).drop("_t")


def transition(sessions: DataFrame, session_ids: list[str], to: str) -> DataFrame:
    """sessions with those ids committed or abandoned; a closed one raises."""
    closed = sessions.where(F.col("session_id").isin(session_ids) & (F.col("status") != "open")).count()
    if closed:
        raise SessionNotOpen(f"{closed} of the sessions cannot change")
    own = F.col("session_id").isin(session_ids)
    out = sessions.withColumn("status", F.when(own, F.lit(to)).otherwise(F.col("status")))
    return out.withColumn("committed_at", F.when(own & F.lit(to == "committed"), F.current_timestamp()).otherwise(F.col("committed_at")))


def set_default_operator(sessions: DataFrame, session_id: str, operator: str, params: dict | None = None) -> DataFrame:
    own = F.col("session_id") == session_id
    new = F.create_map(*[F.lit(str(x)) for kv in (params or {}).items() for x in kv]).cast(PARAMS) if params else F.lit(None).cast(PARAMS)
    return sessions.withColumn("default_operator", F.when(own, F.lit(operator)).otherwise(F.col("default_operator"))).withColumn("default_operator_params", F.when(own, new).otherwise(F.col("default_operator_params")))


def replacement(entity_type: Column, original: Column, operator: Column, params: Column, custom: Column, salt: Column, avoid: Column | None = None, pseudonym: Column | None = None) -> Column:
    """What an accepted span becomes: its custom text, or its operator's result; the same in preview and commit."""
    n = F.coalesce(params["chars_to_mask"].try_cast("int"), F.lit(1 << 20))
    char, end = F.coalesce(params["masking_char"], F.lit("*")), F.coalesce(params["from_end"], F.lit("false")) == "true"
    size = F.least(n, F.length(original))
    kept = F.length(original) - size
    masked = F.when(end, F.concat(F.substring(original, F.lit(1), kept), F.repeat(char, size))).otherwise(F.concat(F.repeat(char, size), F.substring(original, size + 1, kept)))
    plain = A.replace(entity_type)
    return F.coalesce(
        custom,
        F.when(operator == "redact", F.lit(""))
        .when(operator == "replace", F.coalesce(params["new_value"], plain))
        .when(operator == "mask", masked)
        .when(operator == "hash", F.sha2(F.concat(F.coalesce(params["salt"], F.lit("")), original), 256))
        .when(operator == "keep", original)
        .when(operator == "pseudonymize", pseudonym if pseudonym is not None else F.raise_error(F.lit("pseudonymize needs an unlocked mapping store")).cast("string"))
        .when(operator == "hips", A.apply(A.HIPS, entity_type, original, salt, avoid))
        .otherwise(plain),
    )


def replacement_context(proposals: DataFrame, user_added: DataFrame) -> DataFrame:
    """(session_id, avoid): every proposal's original and fragment words, and reviewers' originals, decided or not."""
    own = proposals.select("session_id", F.coalesce("group_original", "original").alias("o"))
    parts = proposals.where("group_original is not null").select("session_id", F.explode(fragment_words(F.col("original"), F.col("group_original"))).alias("o"))
    every = own.unionByName(parts).unionByName(user_added.select("session_id", F.col("original").alias("o")))
    return every.groupBy("session_id").agg(F.array_sort(F.collect_set("o")).alias("avoid"))


def _with_pseudonyms(rows: DataFrame, mappings: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """(rows, the pseudonym of each original whose operator asks for one): stored, or as it would be minted.

    mappings: an unlocked store's rows; NULL for the column where there is none.
    """
    if mappings is None:
        return rows, None
    whole = F.coalesce("group_original", "original")
    asked = rows.where((F.coalesce("operator", "default_operator") == "pseudonymize") & F.col("custom_replacement").isNull())
    order = F.xxhash64("session_id", "segment_anchor", "start")
    named = M.preview(asked.select("entity_type", whole.alias("original"), order.alias("ord")).groupBy("entity_type", "original").agg(F.min("ord").alias("ord")), mappings)
    named = named.select(F.col("entity_type").alias("_type"), F.col("original").alias("_whole"), F.col("pseudonym").alias("_pseudonym"))
    return rows.join(named, (F.col("entity_type") == F.col("_type")) & (whole == F.col("_whole")), "left").drop("_type", "_whole"), F.col("_pseudonym")


def pseudonym_requests(proposals: DataFrame, decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(entity_type, original, ord) that a commit will ask the mapping store for."""
    own = _rendered(proposals, decisions, sessions).where("status = 'accept'")
    asked = own.where((F.coalesce("operator", "default_operator") == "pseudonymize") & F.col("custom_replacement").isNull())
    return asked.select("entity_type", F.coalesce("group_original", "original").alias("original"), F.xxhash64("session_id", "segment_anchor", "start").alias("ord"))


def _rendered(proposals: DataFrame, decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Proposals and reviewers' spans with status, operator and the session's defaults."""
    added = decisions.where("kind = 'user_added'")
    found = proposals.join(effective_decisions(decisions, proposals).withColumnRenamed("proposal_id", "detection_id"), ["session_id", "detection_id"], "left")
    shown = ["session_id", "detection_id", "segment_anchor", "start", "entity_type", "original", "group_id", "group_index", "group_original", "status", "operator", "operator_params", "custom_replacement"]
    null = lambda c: F.lit(None).cast("string").alias(c)
    own = added.select(
        "session_id", F.col("id").alias("detection_id"), "segment_anchor", "start", "entity_type", "original", null("group_id"), F.lit(0).alias("group_index"), null("group_original"), F.lit("accept").alias("status"),
        "operator", "operator_params", "custom_replacement",
    )
    return found.select(*shown).unionByName(own).join(sessions.select("session_id", "default_operator", "default_operator_params", "salt"), "session_id")


def plan_edits(segments: DataFrame, proposals: DataFrame, decisions: DataFrame, sessions: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Edits (session_id, segment_id, start, end, replacement, leak_original, leak_extra) of accepted and added spans.

    Recorded offsets must still match the segment's text; a span that moved is placed at its first
    occurrence, one that is gone is left out.  mappings: what the unlocked store holds after
    pseudonym_requests were minted; without it, an edit that needs a pseudonym raises.
    """
    added = decisions.where("kind = 'user_added'")
    context = replacement_context(proposals, added)
    accepted = effective_decisions(decisions, proposals).where("status = 'accept'")
    own = proposals.join(accepted.withColumnRenamed("proposal_id", "detection_id"), ["session_id", "detection_id"]).select(
        "session_id", "segment_anchor", "start", "end", "entity_type", "original", "group_id", "group_index", "group_original", "operator", "operator_params", "custom_replacement"
    )
    extra = added.select(
        "session_id", "segment_anchor", "start", "end", "entity_type", "original", F.lit(None).cast("string").alias("group_id"), F.lit(0).alias("group_index"), F.lit(None).cast("string").alias("group_original"), "operator", "operator_params", "custom_replacement"
    )
    both = own.unionByName(extra).withColumnRenamed("segment_anchor", "segment_id")
    both = both.join(segments.select("session_id", "segment_id", F.col("text").alias("_t")), ["session_id", "segment_id"]).join(sessions.select("session_id", "default_operator", "default_operator_params", "salt"), "session_id").join(context, "session_id", "left")
    here = F.substring(F.col("_t"), F.col("start") + 1, F.length("original")) == F.col("original")
    both = both.withColumn("_at", F.when(here, F.col("start")).otherwise(F.expr("instr(_t, original) - 1"))).where("_at >= 0")
    whole = F.coalesce("group_original", "original")
    tail = F.col("group_id").isNotNull() & (F.col("group_index") > 0)
    both, pseudonym = _with_pseudonyms(both.withColumn("segment_anchor", F.col("segment_id")), mappings)
    made = replacement(F.col("entity_type"), whole, F.coalesce("operator", "default_operator"), F.coalesce("operator_params", "default_operator_params"), F.col("custom_replacement"), F.coalesce("salt", "session_id"), A.avoid_pattern(F.col("avoid")), pseudonym)
    return both.select(
        "session_id", "segment_id", F.col("_at").alias("start"), (F.col("_at") + F.length("original")).alias("end"), F.when(tail, F.lit("")).otherwise(made).alias("replacement"), F.when(~tail, whole).alias("leak_original"),
        F.when(F.col("group_original").isNotNull(), fragment_words(F.col("original"), F.col("group_original"))).otherwise(F.array().cast("array<string>")).alias("leak_extra"),
    )


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """segments with their edits spliced in."""
    by_segment = edits.groupBy("session_id", "segment_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("_edits"))
    joined = segments.join(by_segment, ["session_id", "segment_id"], "left")
    return joined.withColumn("text", F.when(F.col("_edits").isNull(), F.col("text")).otherwise(X.splice("text", F.col("_edits")))).drop("_edits")


def originals_to_verify(edits: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(session_id, original) that must not survive: what was replaced, less what was rejected elsewhere."""
    values = F.concat(F.when(F.col("leak_original").isNotNull(), F.array("leak_original")).otherwise(F.array().cast("array<string>")), F.col("leak_extra"))
    every = edits.select("session_id", F.explode(values).alias("original")).distinct()
    rejected = effective_decisions(decisions, proposals).where("status = 'reject'").select("session_id", F.col("proposal_id").alias("detection_id"))
    no = proposals.join(rejected, ["session_id", "detection_id"], "left_semi")
    kept = no.select("session_id", F.coalesce("group_original", "original").alias("original"))
    parts = no.where("group_original is not null").select("session_id", F.explode(fragment_words(F.col("original"), F.col("group_original"))).alias("original"))
    return every.join(kept.unionByName(parts).distinct(), ["session_id", "original"], "left_anti")


def previews(proposals: DataFrame, decisions: DataFrame, sessions: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """(session_id, detection_id, status, preview): undecided by the default operator, rejected as it is, reviewers' own spans by theirs.

    mappings: the unlocked store's rows; without them, a pseudonym's place is held by a note.  Nothing is minted for good.
    """
    context = replacement_context(proposals, decisions.where("kind = 'user_added'"))
    own = _rendered(proposals, decisions, sessions).join(context, "session_id", "left")
    own, pseudonym = _with_pseudonyms(own, mappings)
    whole = F.coalesce("group_original", "original")
    made = replacement(
        F.col("entity_type"), whole, F.coalesce("operator", "default_operator"), F.coalesce("operator_params", "default_operator_params"), F.col("custom_replacement"), F.coalesce("salt", "session_id"), A.avoid_pattern(F.col("avoid")),
        F.lit(LOCKED_PREVIEW) if pseudonym is None else pseudonym,
    )
    tail = F.col("group_id").isNotNull() & (F.col("group_index") > 0)
    shown = F.when(F.col("status") == "reject", F.col("original")).when(tail, F.lit("")).otherwise(made)
    return own.select("session_id", "detection_id", F.coalesce("status", F.lit("pending")).alias("status"), shown.alias("preview"))


def session_index(sessions: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions with accepted (reviewers' spans included), rejected and pending counts, newest first."""
    decided = effective_decisions(decisions, proposals).groupBy("session_id").agg(F.count_if(F.col("status") == "accept").alias("_a"), F.count_if(F.col("status") == "reject").alias("rejected"))
    added = decisions.where("kind = 'user_added'").groupBy("session_id").agg(F.count(F.lit(1)).alias("_u"))
    total = proposals.groupBy("session_id").agg(F.count(F.lit(1)).alias("_t"))
    z = lambda c: F.coalesce(c, F.lit(0))
    joined = sessions.join(decided, "session_id", "left").join(added, "session_id", "left").join(total, "session_id", "left")
    return joined.select("session_id", "status", "created_at", (z("_a") + z("_u")).alias("accepted"), z("rejected").alias("rejected"), (z("_t") - z("_a") - z("rejected")).alias("pending")).orderBy(F.desc("created_at"), "session_id")
