"""Review tables: ids, groups, decisions, purges, commits and the session store."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import sql
from cloakframe.operators import review as R
from cloakframe.sources.sessions import InputShed, SessionNotFound, SessionStore

_D = "session_id string, ord int, kind string, proposal_id string, status string, id string, segment_anchor string, entity_type string, original string, start int, end int, operator string, operator_params map<string,string>, custom_replacement string"
_S = "session_id string, status string, default_operator string, default_operator_params map<string,string>, created_at timestamp, committed_at timestamp, salt string"


def _findings(spark):
    pieces = [dict(segment_id="a", start=5, end=8, text="Jen"), dict(segment_id="b", start=0, end=1, text=" "), dict(segment_id="c", start=0, end=7, text=" Martin")]
    rows = [("s", 0, 5, "PERSON", 0.9, "Jen  Martin", pieces), ("s", 1, 0, "PERSON", 0.9, "Ann", [dict(segment_id="d", start=0, end=3, text="Ann")])]
    return spark.createDataFrame(rows, "session_id string, block_ord int, start int, entity_type string, score double, original string, pieces array<struct<segment_id:string,start:int,end:int,text:string>>")


def _decide(spark, rows):
    full = [(s, o, "proposal", p, st, None, None, None, None, None, None, op, None, cu) for s, o, p, st, op, cu in rows]
    return spark.createDataFrame(full, _D)


def _sha(*parts):
    return hashlib.sha1("\0".join(parts).encode()).hexdigest()[:12]


def test_proposals_of_findings(spark):
    got = R.propose_findings(_findings(spark)).orderBy("ord").collect()
    group = _sha("PERSON", "Jen  Martin", "group:a:5")
    assert [(r.detection_id, r.group_id, r.group_index, r.original) for r in got] == [
        (_sha("PERSON", "Jen", f"a:5:{group}"), group, 0, "Jen"), (_sha("PERSON", " ", f"b:0:{group}"), group, 1, " "), (_sha("PERSON", " Martin", f"c:0:{group}"), group, 2, " Martin"), (_sha("PERSON", "Ann", "d:0"), None, 0, "Ann"),
    ]


def test_group_decisions_and_commit(spark):
    p = R.propose_findings(_findings(spark)).cache()
    ids = {r.original: r.detection_id for r in p.collect()}
    decisions = _decide(spark, [("s", 0, ids["Jen"], "reject", None, None), ("s", 1, ids[" Martin"], "accept", "replace", None), ("s", 2, ids["Ann"], "reject", None, None), ("s", 3, "none", "accept", None, None)])
    got = {r.proposal_id: r.status for r in R.effective_decisions(decisions, p).collect()}
    assert got == {ids["Jen"]: "accept", ids[" "]: "accept", ids[" Martin"]: "accept", ids["Ann"]: "reject"}
    assert R.unknown_proposals(decisions, p).count() == 1
    sessions = spark.createDataFrame([("s", "open", "redact", None, None, None, "x")], _S)
    segments = spark.createDataFrame([("s", "a", "Dear Jen"), ("s", "b", " "), ("s", "c", " Martin spoke"), ("s", "d", "Ann left")], "session_id string, segment_id string, text string")
    edits = R.plan_edits(segments, p, decisions, sessions)
    assert {r.segment_id: r.text for r in R.apply_edits(segments, edits).collect()} == {"a": "Dear <PERSON>", "b": "", "c": " spoke", "d": "Ann left"}
    assert {r.original for r in R.originals_to_verify(edits, p, decisions).collect()} == {"Jen  Martin", "Jen", "Martin"}
    shown = {r.detection_id: (r.status, r.preview) for r in R.previews(p, decisions, sessions).collect()}
    assert shown[ids["Jen"]] == ("accept", "<PERSON>") and shown[ids["Ann"]] == ("reject", "Ann") and shown[ids[" "]][1] == ""
    index = R.session_index(sessions, p, decisions).first()
    assert (index.accepted, index.rejected, index.pending) == (3, 1, 0)


def test_purge_trims_and_renumbers(spark):
    p = R.propose_findings(_findings(spark))
    marks = spark.createDataFrame([("s", "a", 7, 9), ("s", "d", 3, 5)], "session_id string, segment_anchor string, start int, end int")
    stay, removed = R.purge_overlaps(p, marks)
    assert sorted((r.original, r.segment_anchor, r.start, r.end, r.group_index) for r in stay.collect()) == [("Ann", "d", 0, 3, 0), ("Martin", "c", 1, 7, 0)]
    assert removed.count() == 2


def test_transitions_and_marks(spark):
    sessions = spark.createDataFrame([("s", "open", "redact", None, None, None, "x"), ("t", "committed", "redact", None, None, None, "x")], _S)
    assert {r.session_id: r.status for r in R.transition(sessions, ["s"], "abandoned").collect()} == {"s": "abandoned", "t": "committed"}
    with pytest.raises(R.SessionNotOpen):
        R.transition(sessions, ["t"], "committed")
    segments = spark.createDataFrame([("s", "a", "Dear Jen")], "session_id string, segment_id string, text string")
    marks = spark.createDataFrame([("s", "a", 5, 8, "Jen"), ("s", "a", 5, 8, "Jan"), ("s", "a", 5, 80, "Jen"), ("s", "z", 0, 1, "J")], "session_id string, segment_anchor string, start int, end int, original string")
    assert [r.reject_reason for r in R.validate_user_added(marks, segments).orderBy("segment_anchor", "end", F.desc("original")).collect()] == [None, "text differs", "offsets outside the segment", "unknown segment"]


def test_store(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "sessions"))
    manifest = {"session": {"session_id": "s1", "status": "open", "created_at": "2026-01-01T00:00:00Z"}, "segments": [{"segment_id": "a", "text": "Ann"}], "proposals": [], "decisions": [{"ord": 1, "kind": "proposal", "proposal_id": "x", "status": "accept"}]}
    store.save(manifest, b"one")
    store.save(manifest, b"two")
    assert store.load_input("s1") == b"one" and store.ids() == ["s1"]
    (tmp_path / "sessions" / "bad").mkdir()
    (tmp_path / "sessions" / "bad" / "manifest.json").write_text("{")
    sessions, segments, proposals, decisions = store.tables()
    assert (sessions.count(), segments.first().text, proposals.count(), decisions.first().status) == (1, "Ann", 0, "accept")
    store.shed_input("s1")
    with pytest.raises(InputShed):
        store.load_input("s1")
    store.delete("s1")
    with pytest.raises(SessionNotFound):
        store.load("../s1")


def test_sql_functions(spark):
    sql.register(spark)
    assert tuple(spark.sql("select deid_mask('abcdef', '*', 2, true), deid_replace('USER_ADDED'), deid_luhn('4111 1111 1111 1111'), deid_normalize_ws(' a  b ')").first()) == ("abcd**", "[REDACTED]", True, "a b")
