"""Disjoint spans from overlapping ones, as bounded folds over clusters of the sorted array.

Spans are ordered by (start, end, higher score first).  Of the first two that overlap, a container
stays alone; otherwise the longer one wins (then the higher score, then the earlier) and the other
keeps what lies outside.  A sweep takes at most two steps per span of its cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.text import once, running_max

#: What the fold works on; ``ord`` keeps equal spans in input order.
WORK = "struct<start:int,end:int,neg:double,ord:int,entity_type:string,score:double,recognizer_name:string>"


def _work(spans: Column) -> Column:
    return F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), (-s["score"]).alias("neg"), i.alias("ord"),
                s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["recognizer_name"].alias("recognizer_name"),
            ),
        )
    )


def _cut(s: Column, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), s["neg"].alias("neg"), s["ord"].alias("ord"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["recognizer_name"].alias("recognizer_name"))


def _resolve(a: Column, b: Column) -> Column:
    """One or two disjoint spans instead of a and b, which overlap with a first in order."""
    size_a, size_b = a["end"] - a["start"], b["end"] - b["start"]
    a_wins = F.when(size_a != size_b, size_a > size_b).when(a["score"] != b["score"], a["score"] > b["score"]).otherwise(a["start"] <= b["start"])
    return (
        F.when((a["start"] <= b["start"]) & (b["end"] <= a["end"]), F.array(a))
        .when((b["start"] <= a["start"]) & (a["end"] <= b["end"]), F.array(b))
        .when(a_wins, F.array(a, _cut(b, a["end"], b["end"])))
        .otherwise(F.array(_cut(a, a["start"], b["start"]), b))
    )


def _settle(work: Column) -> Column:
    """Disjoint spans of one cluster: a sorted array of the work type."""
    kind = f"array<{WORK}>"

    def step(acc: Column, _: Column) -> Column:
        todo, done = acc["todo"], acc["done"]
        a, b = F.get(todo, F.lit(0)), F.get(todo, F.lit(1))
        apart = b.isNull() | (a["end"] <= b["start"])
        return F.when(F.size(todo) == 0, acc).otherwise(
            F.struct(
                F.when(apart, F.concat(done, F.array(a))).otherwise(done).alias("done"),
                F.when(apart, F.slice(todo, 2, F.greatest(F.size(todo), F.lit(1)))).otherwise(F.array_sort(F.concat(_resolve(a, b), F.slice(todo, 3, F.greatest(F.size(todo), F.lit(1)))))).alias("todo"),
            )
        )

    begin = F.struct(F.array().cast(kind).alias("done"), work.cast(kind).alias("todo"))
    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(work)), begin, step, lambda acc: F.concat(acc["done"], acc["todo"]))


def _clusters(work: Column) -> Column:
    """The sorted spans cut where a span starts at or after the end of all before it."""
    reach = running_max(F.transform(work, lambda s: s["end"]))
    tagged = F.transform(F.arrays_zip(work.alias("s"), F.concat(F.array(F.lit(-1)), reach).alias("r")), lambda x, i: F.when(x["s"]["start"] >= x["r"], i))
    heads = F.filter(tagged, lambda i: i.isNotNull())
    return once(heads, lambda h: F.transform(h, lambda at, i: F.slice(work, at + 1, F.coalesce(F.get(h, i + 1), F.size(work)) - at)))


def normalize_overlaps(spans: Column) -> Column:
    """Disjoint spans (start, end, entity_type, score, recognizer_name) in document order.

    Spans that don't touch a common cluster never meet, so each cluster is settled by itself; the cost
    grows with the clusters' sizes, not with the spans of the text.
    """

    def settled(work: Column) -> Column:
        return F.flatten(F.transform(_clusters(work), lambda c: F.when(F.size(c) > 1, _settle(c)).otherwise(c)))

    out = F.when(F.size(spans) < 2, _work(spans)).otherwise(once(_work(spans), settled))
    return F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["recognizer_name"].alias("recognizer_name")))
