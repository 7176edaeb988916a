"""Lines, paragraphs and span plans of pages."""

import random

import numpy as np

from cloakframe.operators import page_layout as L
from cloakframe.operators.blocks import join_blocks

SCHEMA = "doc_id string, page int, x0 double, top double, x1 double, bottom double, chars array<struct<text:string,x0:double,top:double,x1:double,bottom:double,size:double>>"


def _word(text, x, y, size=10.0, width=5.0, doc="d", page=0):
    x, y = float(x), float(y)
    chars = [dict(text=c, x0=x + width * i, top=y, x1=x + width * (i + 1), bottom=y + size, size=size) for i, c in enumerate(text)]
    return dict(doc_id=doc, page=page, x0=x, top=y, x1=x + width * len(text), bottom=y + size, chars=chars)


def test_rows_need_half_of_the_smaller_height():
    tops = np.array([0.0, 4.9, 5.1, 30.0])
    assert L.row_numbers(tops, tops + 10).tolist() == [0, 0, 0, 1]  # the row reaches to 14.9 after its second word
    assert L.row_numbers(np.array([0.0, 5.1]), np.array([10.0, 15.1])).tolist() == [0, 1]
    assert L.row_numbers(np.array([0.0, 8.0]), np.array([20.0, 11.0])).tolist() == [0, 0]  # a small word inside
    assert L.row_numbers(np.zeros(0), np.zeros(0)).tolist() == []


def test_lines_are_cut_at_gutters_and_read_left_to_right():
    words = [_word("right", 200, 1), _word("two", 30, 0), _word("one", 10, 0.5), _word("below", 10, 14), _word("wide", 42 + 10.5, 14)]
    got = [x["text"] for x in L.page_lines(words)]
    assert got == ["one two", "right", "below", "wide"]
    assert [x["text"] for x in L.page_lines([_word("a", 0, 0), _word("b", 5 + 10, 0)])] == ["a b"]  # a gap of one size is no cut
    assert list(L.page_lines([_word("  ", 0, 0)])) == [] and list(L.page_lines([])) == []


def test_ligatures_share_their_box():
    text, boxes = L.line_text([_word("oﬃce", 0, 0), _word("x", 25, 0)])
    assert text == "office x" and len(boxes) == 8
    assert [round(b[0], 3) for b in boxes] == [0, 5, 6.667, 8.333, 10, 15, 20, 25]
    assert boxes[6] == (20.0, 0, 25, 10.0)


def test_paragraphs_by_column_gap_and_size():
    box = lambda x, y, h=10.0: (x, y, x + 100, y + h)
    boxes = np.array([box(0, 0), box(200, 0), box(0, 12), box(200, 18.1), box(0, 24), box(0, 36, 14.0)])
    assert L.paragraph_numbers(boxes, np.array([10.0] * 5 + [14.0])) == [0, 1, 0, 2, 0, 3]


def test_words_to_segments(spark):
    rows = [_word("Jen", 10, 0), _word("ny", 10, 12), _word("other", 10, 60), _word("page", 0, 0, page=1), _word("second", 0, 0, doc="e"), dict(_word("x", 0, 90), chars=None)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ("doc_id", "page", "x0", "top", "x1", "bottom", "chars")) for r in rows], SCHEMA)
    got = L.read_lines(df)
    seg = {(r.doc_id, r.segment_id): (r.text, r.block, r.join_before, len(r.char_boxes)) for r in got.collect()}
    assert seg == {
        ("d", "page0/line0"): ("Jen", "page0/para0", "", 3), ("d", "page0/line1"): ("ny", "page0/para0", " ", 2), ("d", "page0/line2"): ("other", "page0/para1", "", 5),
        ("d", "page1/line0"): ("page", "page1/para0", "", 4), ("e", "page0/line0"): ("second", "page0/para0", "", 6),
    }
    assert sorted(r.text for r in join_blocks(got).where("doc_id = 'd'").collect()) == ["Jen ny", "other", "page"]
    assert L.read_lines(df.limit(0)).count() == 0


def test_span_plans():
    assert L.plan_spans("same", "same") == []
    assert L.plan_spans("see Ann now", "see <P> now", [dict(start=4, end=7, text="<P>", original="Ann")]) == [(4, 7, "<P>")]
    assert L.plan_spans("see Ann now", "see <P> now", [dict(start=4, end=7, text="<P>", original="Bob")]) == [(4, 7, "<P>")]  # by what differs
    assert L.plan_spans("see Ann now", "see <P> now", [dict(start=0, end=99, text="<P>")]) == [(4, 7, "<P>")]
    assert L.plan_spans("see Ann now", "see <P> now", [dict(start=0, end=3, text="<P>")]) == [(0, 11, "see <P> now")]  # what is recorded gives another text
    assert L.plan_spans("abXcdYef", "abUcdVef") == [(2, 6, "UcdV")]  # two equal characters between
    assert L.plan_spans("abXcdeYf", "abUcdeVf") == [(2, 3, "U"), (6, 7, "V")]
    rng = random.Random(4)
    for _ in range(300):
        old, new = ("".join(rng.choice("abc ") for _ in range(rng.randrange(15))) for _ in range(2))
        spans = L.plan_spans(old, new)
        assert L._spliced(old, spans) == new
        assert all(b[0] - a[1] >= 3 for a, b in zip(spans, spans[1:], strict=False))
