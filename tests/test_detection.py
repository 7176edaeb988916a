"""E-mail detection, role terms, seeds, mentions and blocks."""

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.patterns import CARD, EMAIL, IPV4, NAME_RULES
from cloakframe.operators import ner
from cloakframe.operators.blocks import detect_blocks, fragment_words, join_blocks, run_block
from cloakframe.operators.detect import analyze
from cloakframe.operators.propagate import candidates, mentions_in, seeds_from
from cloakframe.operators.roles import defined_terms, is_role_term


def test_email_domains_and_rejects(spark):
    texts = ["a.b@firm.local", "x@y", "mail to j+k@sub.host.example.com.", "éa@b.co", "a@b.c", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [s.text_span for s in r.spans] for r in analyze(df, recognizers=[EMAIL]).collect()}
    assert got == {0: ["a.b@firm.local"], 1: [], 2: ["j+k@sub.host.example.com"], 3: [], 4: [], 5: [], 6: []}


def test_threshold_zero_is_default_and_types_filter(spark):
    df = spark.createDataFrame([("a@b.com",)], "text string")
    assert len(analyze(df, recognizers=[EMAIL], threshold=0.0).first().spans) == 1
    assert analyze(df, recognizers=[EMAIL], threshold=0.95).first().spans == []
    assert analyze(df, entities=["PERSON"]).first().spans == []


def test_defined_terms_need_an_article(spark):
    df = spark.createDataFrame([(1, 'Acme Ltd ("Acme") and Bolt (the "Supplier"). "Order" shall mean this.'), (1, " "), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.defined) for r in defined_terms(df).collect()] == [(1, ["order", "supplier"])]


@pytest.mark.parametrize(("kind", "text", "role"), [("PERSON", "the Supplier's", True), ("PERSON", "I", True), ("PERSON", "FY24", True), ("PERSON", "Jane Poe", False), ("LOCATION", "party", False), ("ORGANIZATION", "Second Lender", True), ("PERSON", '""', False)])
def test_role_terms(spark, kind, text, role):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    assert df.select(is_role_term(F.col("k"), F.col("t"))).first()[0] is role


def _seeds(spark, found):
    spans = [dict(entity_type=t, text_span=x, score=s) for t, x, s in found]
    df = spark.createDataFrame([(spans,)], "spans array<struct<entity_type:string,text_span:string,score:double>>")
    return [s.asDict() for s in df.select(seeds_from(candidates(F.col("spans"))).alias("s")).first().s]


def test_seeds(spark):
    got = {s["key"]: (s["entity_type"], s["score"], sorted(s["forms"])) for s in _seeds(spark, [("PERSON", "Dr Mark de Price", 0.5), ("ORGANIZATION", "First Bank", 0.9), ("ORGANIZATION", "PRICE", 0.5), ("LOCATION", "Rome", 1.0)])}
    assert got == {"dr mark de price": ("PERSON", 0.5, ["Dr Mark de Price"]), "mark": ("PERSON", 0.5, ["Mark"]), "price": ("PERSON", 0.5, ["PRICE", "Price"]), "first bank": ("ORGANIZATION", 0.9, ["First Bank"])}


def test_mentions(spark):
    seeds = _seeds(spark, [("PERSON", "Mark Price", 0.8)])
    found = lambda text, covered=(): [(m["start"], m["end"]) for m in mentions_in(text, seeds, [dict(start=a, end=b) for a, b in covered])]
    assert found("Mark Price and Price") == [(0, 10), (15, 20)]
    assert found("The market price rose for Acme.") == []  # lower case among capitals
    assert found("ask mark about it") == [(4, 8)]  # an all lower case text
    assert found("Markus Prices") == []
    assert found("Mark Price", [(0, 4)]) == [(5, 10)]


_SEGMENTS = "doc_id int, seg_ord int, segment_id string, text string, block string, join_before string"


def test_blocks_join_by_key(spark):
    rows = [(1, 0, "a", "Jen", "p", " "), (1, 1, "b", "alone", None, ""), (1, 2, "c", "nifer", "p", ""), (1, 3, "d", "x", "p", " ")]
    got = sorted((r.block_ord, r.text, [s.offset for s in r.segs]) for r in join_blocks(spark.createDataFrame(rows, _SEGMENTS)).collect())
    assert got == [(0, "Jennifer x", [0, 3, 9]), (1, "alone", [0])]


def test_document_pass(spark):
    rows = [(1, 0, "a", "Price came. (the \"Supplier\")", None, ""), (1, 1, "b", "Dear Mr Mark Pr", "q", ""), (1, 2, "c", "ice", "q", ""), (1, 3, "d", "  ", None, ""), (2, 0, "a", "Price", None, "")]
    got = sorted((r.doc_id, r.block_ord, r.original, [(p.segment_id, p.start, p.end) for p in r.pieces]) for r in detect_blocks(spark.createDataFrame(rows, _SEGMENTS), NAME_RULES).collect())
    assert got == [(1, 0, "Price", [("a", 0, 5)]), (1, 1, "Mark Price", [("b", 8, 15), ("c", 0, 3)])]


def test_findings_of_blocks_are_disjoint(spark):
    rows = [(1, 0, "a", "38.211.12.42 4366089147969128", None, ""), (2, 0, "a", "4495589438270767 42.73.240.87", None, "")]
    got = sorted((r.doc_id, r.start, r.end, r.entity_type, r.original) for r in detect_blocks(spark.createDataFrame(rows, _SEGMENTS), [IPV4, CARD]).collect())
    assert got == [  # the longer one stays whole, the other keeps what lies outside
        (1, 0, 10, "IP_ADDRESS", "38.211.12."), (1, 10, 29, "CREDIT_CARD", "42 4366089147969128"),
        (2, 0, 19, "CREDIT_CARD", "4495589438270767 42"), (2, 19, 29, "IP_ADDRESS", ".73.240.87"),
    ]


def test_fragment_words_and_run_block(spark):
    df = spark.createDataFrame([("Jen", "Jennifer Martin", "body/p0/r3"), ("nifer Martin", "Jennifer Martin", "sheet=A/B1")], "p string, o string, id string")
    assert [tuple(r) for r in df.select(fragment_words(F.col("p"), F.col("o")), run_block(F.col("id"))).collect()] == [([], "body/p0"), (["Martin"], None)]


def test_model_port(spark):
    def build():
        return lambda text, labels, threshold: [(text.index(w), text.index(w) + len(w), label, 0.6) for w, label in (("(Monday,", "date"), ("$9,433.00", "bank account"), ("Barclays Bank", "bank account"), ("May 3", "date")) if w in text]

    df = spark.createDataFrame([("On (Monday, pay $9,433.00 to Barclays Bank by May 3",), (None,)], "text string")
    rows = ner.model_spans(df, build).select("text", "spans").collect()
    assert [(s.entity_type, rows[0].text[s.start : s.end], round(s.score, 3)) for s in rows[0].spans] == [("ORGANIZATION", "Barclays Bank", 0.675), ("DATE_TIME", "May 3", 0.675)]
    assert rows[1].spans == []
    assert ner.model_spans(df, build, wanted=["EMAIL_ADDRESS"]).first().spans == []
    assert ner.chunk("ab. " * 3 + "\ncd", 6) == [(0, "ab. "), (4, "ab. "), (8, "ab. "), (13, "cd")]
