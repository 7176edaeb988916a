"""Column helpers for text, spans and splicing.  Offsets are code points, half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_ws(text) -> Column:
    """Runs of Unicode whitespace to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\s+", " "), r"^ | $", "")


def strip(text, extra: str = "") -> Column:
    """Text without Unicode whitespace, or characters of extra, at its ends."""
    own = rf"[\s{_escaped(extra)}]+" if extra else r"\s+"
    return F.regexp_replace(_c(text), rf"(?U)^{own}|{own}$", "")


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c in "[]\\^-&" else c for c in chars)


def words(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)\w+"), F.lit(0))


def matches(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated a single time per row, also where use names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative join, by doublings: n log n, nothing grows element by element."""

    def doubled(v: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < F.size(v))
        return F.aggregate(steps, v, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, join(F.get(acc, i - k), x)).otherwise(x)))

    return once(values, doubled)


def running_sums(values: Column) -> Column:
    """Of each element the sum of all up to it."""
    return _scan(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _scan(values, F.greatest)


def spans_of(text, found: Column, pattern: str) -> Column:
    """Offsets of ``found`` (all matches of pattern in text): matches paired with the text between them."""

    def placed(m: Column) -> Column:
        pairs = F.arrays_zip(m.alias("m"), F.slice(F.split(_c(text), pattern, -1), 1, F.size(m)).alias("b"))
        ends = running_sums(F.transform(pairs, lambda x: F.length(x["b"]) + F.length(x["m"])))
        return F.transform(F.arrays_zip(m.alias("m"), ends.alias("e")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("text")))

    return F.when(F.size(found) > 0, once(found, placed)).otherwise(F.array().cast(SPANS))


#: Code points in a block; a substring of a long text is cut from the blocks that it touches.
_BLOCK = 1024


def cutting(text, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, end) is text[start:end] at a cost that doesn't grow with start; end may lie beyond.

    (Spark's substring counts code points from the front each time.)
    """

    def within(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
            lead = F.substring(F.get(blocks, first), start - first * _BLOCK + 1, F.when(first == last, end - start).otherwise(F.lit(_BLOCK)))
            rest = F.concat(F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end - last * _BLOCK))
            return F.when(end <= start, F.lit("")).when(first == last, lead).otherwise(F.concat(lead, rest))

        return use(cut)

    return once(F.regexp_extract_all(_c(text), F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)), within)


def around(start: Column, end: Column, width: int = 40) -> tuple[Column, Column]:
    """Bounds of the span with up to width characters on either side."""
    return F.greatest(start - width, F.lit(0)), end + width


def splice(text, edits: Column) -> Column:
    """text with non-overlapping edits (start, end, replacement) applied."""
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))))

    def rewritten(cut: Callable[[Column, Column], Column]) -> Column:
        def parts(e: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["end"]))
            head = F.transform(F.arrays_zip(e.alias("e"), F.slice(before, 1, F.size(e)).alias("p")), lambda x: F.concat(cut(x["p"], x["e"]["start"]), x["e"]["replacement"]))
            return F.concat(F.array_join(head, ""), cut(F.element_at(before, -1), F.length(_c(text))))

        return once(ordered, parts)

    return F.when(F.size(edits) > 0, cutting(text, rewritten)).otherwise(_c(text))


def hash_int(key: Column, bound) -> Column:
    """A stable integer in [0, bound) from a string key."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long"), _c(bound) if isinstance(bound, Column) else F.lit(bound)).cast("int")


def quoted(text: Column) -> Column:
    r"""text as a literal regular expression (\Q..\E, safe for texts that hold \E)."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
