"""Line deduplication by overlapping three-line windows.

The lines of a text are its newline-separated parts; windows run over the lines that hold a word.
Each window of three consecutive lines is hashed (128 bits), repeated windows are found globally,
the first occurrence by (doc_id, position) stays, and the lines that any later occurrence covers
are removed.  Windows are judged on the input, so covered positions of overlapping occurrences
merge; lines without a word stay where they are.

Windows are counted with partial aggregation; occurrences meet the repeated windows in a join that
adaptive execution splits where a window is hot; removed positions are gathered per document only
and return to it by its id and a hash of its text.

Defined results: NULL texts stay NULL; a text of fewer than three lines with words has no window;
rows without an id come first in the order; identical repeated rows count as one occurrence and are
treated alike; ids may be of any type that has an order; an empty table gives no rows; input columns
named n_lines or n_removed are replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import Own, table

LINES = 3
_ADDED = ("n_lines", "n_removed")


def _windows(text: bytes, k: int) -> list[bytes]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [blake2b(b"\n".join(lines[i : i + k]), digest_size=16).digest() for i in range(len(lines) - k + 1)]


def window_rows(keyed: DataFrame, k: int) -> DataFrame:
    """(_h1, _h2, _id, _key, _pos) for each window of each text of (_id, _key, text)."""

    def run(batches):
        for batch in batches:
            at, pos, digests = [], [], []
            for i, x in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                own = _windows(x or b"", k)
                at.extend([i] * len(own))
                pos.extend(range(len(own)))
                digests.extend(own)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32())],
                names=["_h1", "_h2", "_id", "_key", "_pos"],
            )

    long = lambda name: T.StructField(name, T.LongType())
    return keyed.mapInArrow(run, T.StructType([long("_h1"), long("_h2"), T.StructField("_id", keyed.schema[0].dataType), long("_key"), T.StructField("_pos", T.IntegerType())]))


def _rebuild(text: bytes, starts: list[int], k: int) -> tuple[bytes, int]:
    drop = {j for s in starts for j in range(s, s + k)}
    kept, i = [], -1
    for line in text.split(b"\n"):
        if line.strip():
            i += 1
            if i in drop:
                continue
        kept.append(line)
    return b"\n".join(kept), len(drop)


def dedup_lines(docs: DataFrame, lines: int = LINES, text: str = "text") -> DataFrame:
    """docs with text less its later repetitions, and n_lines and n_removed (lines that hold a word)."""
    own = Own(docs)
    doc, body = own["doc_id"], own[text]
    kept = [*dict.fromkeys([*own.kept(_ADDED), doc, body])]
    keyed = own.df.select(*kept, F.xxhash64(doc, body).alias("_key"))
    found = window_rows(keyed.select(F.col(doc).alias("_id"), "_key", body), lines)
    occurrence = F.struct("_id", "_key", "_pos")
    repeated = found.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(occurrence).alias("_first")).where("_n > 1").drop("_n")
    later = found.join(repeated, ["_h1", "_h2"]).where(~occurrence.eqNullSafe(F.col("_first")))
    removed = later.groupBy("_id", F.col("_key").alias("_k")).agg(F.collect_set("_pos").alias("_starts"))
    # the id parts what a 64-bit hash of a whole corpus can't
    both = keyed.join(removed, (F.col("_key") == F.col("_k")) & F.col(doc).eqNullSafe(F.col("_id")), "left").select(*kept, "_starts")
    at, schema = kept.index(body), own.df.select(*kept).schema.add("_lines", T.LongType()).add("_gone", T.LongType())

    def run(batches):
        for batch in batches:
            texts, n, gone = [], [], []
            kind = batch.column(at).type
            for x, starts in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                n.append(sum(1 for y in (x or b"").split(b"\n") if y.strip()))
                x, less = _rebuild(x, starts, lines) if starts else (x, 0)
                texts.append(x)
                gone.append(less)
            same = [pa.array(texts, pa.binary()).cast(kind) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, "_lines", "_gone"])

    return own.back(both.mapInArrow(run, schema), {"n_lines": "_lines", "n_removed": "_gone"})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = r"""
with l as (select doc_id, j, x from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) j from documents)),
w as (select doc_id, j, x, row_number() over (partition by doc_id order by j) - 1 p from l where regexp_matches(x, '[^\x20\x09-\x0D]')),
g as (select doc_id, p, x || chr(10) || lead(x) over o || chr(10) || lead(x, 2) over o g from w window o as (partition by doc_id order by p)),
r as (select doc_id, p, row_number() over (partition by g order by doc_id, p) n from g where g is not null),
d as (select distinct doc_id, p + k p from r, (select unnest([0, 1, 2]) k) where n > 1),
k as (select l.doc_id, l.j, l.x from l left join w using (doc_id, j) left join d on d.doc_id = w.doc_id and d.p = w.p where d.p is null),
t as (select doc_id, string_agg(x, chr(10) order by j) text from k group by doc_id),
c as (select doc_id, count(*) n from w group by doc_id), e as (select doc_id, count(*) n from d group by doc_id)
select doc_id, coalesce(c.n, 0)::bigint n_lines, coalesce(e.n, 0)::bigint n_removed,
       case when documents.text is null then null else coalesce(t.text, '') end as text
from documents left join t using (doc_id) left join c using (doc_id) left join e using (doc_id)
"""
