"""Secret scanning over an incremental blob ledger, in DataFrame expressions only.

Every version of a path is content-addressed by SHA-256.  The ledger holds one row per scanned
(blob, rule, rule version) with the spans found; a run scans only distinct blobs, and of each only
the rules whose pair is not in the ledger yet, and joins the findings back to all paths.  Distinct
blobs are picked by partial aggregation (copies collapse before the shuffle).  New ledger rows are stored in
a folder of their run (class ``Ledger``), those without spans included, so that a later run can skip their
pairs; the findings of paths are joined back from the stored ledger; they are written first, so that the
join is split by adaptive execution where one blob has very many paths.

Offsets are code points.  They come from pairing all matches with the text between them; ends are running
sums (n log n in the matches of a text).

Defined results: NULL texts are empty and have no spans; repeated rows and copies get the same
spans; overlapping spans of different kinds all stay, sorted by start, then kind; ids are not used, so
they may be missing, repeated or of any type; an empty table gives no rows and no new ledger rows; an input
column named spans is replaced, all others (whatever their names) are returned.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import once, running_sums
from cloakframe.llm.common import Own, table, written
from cloakframe.sources.scratch import folder


@dataclass(frozen=True)
class Rule:
    """kind and version name the pattern; value is the group whose length must be least or more;
    hint is a literal that every match holds (texts without it are not searched)."""

    kind: str
    pattern: str
    version: int = 1
    value: int = 0
    least: int = 1
    hint: str | None = None


#: The contract's base kinds, in its order.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
#: Well-known public token formats.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
]
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<s:int,e:int>>"
_LEDGER = f"blob string, kind string, version int, spans {_SPANS}"


def _matches(text: Column, rule: Rule) -> Column:
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(text.contains(rule.hint), found).otherwise(F.array().cast("array<string>")) if rule.hint else found


def _spans(text: Column, matches: Column, rule: Rule) -> Column:
    """Spans of the matches, those with too short a value left out; ends are running sums of lengths."""
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)) if rule.value else matches

    def placed(m: Column) -> Column:
        between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(m))
        sizes = F.transform(F.arrays_zip(m.alias("m"), between.alias("b")), lambda x: F.length(x["b"]) + F.length(x["m"]))
        rows = F.arrays_zip(m.alias("m"), running_sums(sizes).alias("e"), (values if rule.value else m).alias("v"))
        return F.transform(F.filter(rows, lambda x: F.length(x["v"]) >= rule.least), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e")))

    return F.when(F.size(matches) > 0, once(matches, placed)).otherwise(F.array().cast(_SPANS))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """New ledger rows by blob: (_blob, found: array of (kind, version, spans)) for the unseen pairs.

    ledger: (blob, kind, version, spans) as ``ledger_rows`` gives it.
    """
    rules = rules or RULES
    own = Own(versions)
    body = F.col(own[text])
    blobs = own.df.select(blob_of(body).alias("_blob"), F.coalesce(body, F.lit("")).alias("_text")).groupBy("_blob").agg(F.first("_text").alias("_text"))
    if ledger is None:
        todo = blobs.withColumn("_seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy(F.col("blob").alias("_b")).agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("_seen"))
        todo = blobs.join(seen, F.col("_blob") == F.col("_b"), "left").select("_blob", "_text", F.coalesce("_seen", F.array().cast("array<string>")).alias("_seen"))
        todo = todo.where(~F.forall(F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules]), lambda r: F.array_contains("_seen", r)))
    unseen = {r.kind: ~F.array_contains("_seen", f"{r.kind}:{r.version}") for r in rules}
    todo = todo.select("_blob", "_text", "_seen", *[F.when(unseen[r.kind], _matches(F.col("_text"), r)).otherwise(F.array().cast("array<string>")).alias(f"m_{r.kind}") for r in rules])
    found = [F.when(unseen[r.kind], F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("_text"), F.col(f"m_{r.kind}"), r).alias("spans"))) for r in rules]
    return todo.select("_blob", F.array_compact(F.array(*found)).alias("found"))


def ledger_rows(found: DataFrame) -> DataFrame:
    """(blob, kind, version, spans), to be appended to the ledger."""
    # outer, as the filter that is inferred for an inner explode would search all texts twice
    return found.select(F.col("_blob").alias("blob"), F.explode_outer("found").alias("f")).where("f is not null").select("blob", "f.kind", "f.version", "f.spans")


class Ledger:
    """A ledger stored in a folder that all executors share: one table of new rows per run, none rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """(blob, kind, version, spans) of all runs so far."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        runs = [f"{self.path}/{s.getPath().getName()}" for s in files.listStatus(folder)] if files.exists(folder) else []
        done = [r for r in runs if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS"))]
        if done:
            return self.spark.read.schema(_LEDGER).parquet(*done)
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (("blob", "string"), ("kind", "string"), ("version", "int"), ("spans", _SPANS))])

    def grow(self, versions: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
        """Scan the pairs of versions' blobs and rules that the ledger lacks, store them; all rows."""
        new = ledger_rows(scan_unseen(versions, self.rows(), rules, text))
        new.write.option("compression", "zstd").parquet(f"{self.path}/run-{uuid.uuid4().hex}")
        return self.rows()


def grow_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """ledger with a written row for each pair of versions' blobs and rules that it lacks."""
    new = written(ledger_rows(scan_unseen(versions, ledger, rules, text)), "ledger")
    return new if ledger is None else ledger.select(*new.columns).unionByName(new)


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """versions with spans: all findings of its blob under the rules, from the ledger or scanned now."""
    return paths_of(versions, grow_ledger(versions, ledger, rules, text), rules, text)


def paths_of(versions: DataFrame, ledger: DataFrame, rules: list[Rule] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """versions (or its columns in keep) with spans: all findings of its blob under the rules in a ledger that has them."""
    rules, own = rules or RULES, Own(versions)
    pairs = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    hits = ledger.where((F.size("spans") > 0) & F.array_contains(pairs, F.concat_ws(":", "kind", F.col("version").cast("string"))))
    found = hits.groupBy(F.col("blob").alias("_of")).agg(F.collect_list(F.struct("kind", "version", "spans")).alias("_found"))
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    flat = F.flatten(F.transform("_found", lambda f: F.transform(f["spans"], lambda s: F.struct(s["s"].alias("start"), order[f["kind"]].alias("rank"), s["e"].alias("end"), f["kind"].alias("kind")))))
    spans = written(found.select("_of", F.array_sort(flat).alias("_spans")), "findings")
    rows = own.df.select(*own.kept(("spans",), keep), blob_of(F.col(own[text])).alias("_blob"))
    joined = rows.join(spans, F.col("_blob") == F.col("_of"), "left")
    return own.back(joined, {"spans": F.coalesce("_spans", F.array().cast(spans.schema["_spans"].dataType))}, keep)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over all documents: its ledger is stored, consulted for pairs seen before (none yet) and joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, folder(spark, "secret-ledger"))
    found = paths_of(docs, ledger.grow(docs), keep=["doc_id"])
    text_of = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?i)password|passwd|secret|token|api_?key").replace("((?i)", "((?i:").replace("_?key)", "_?key))", 1) if r.value else r.pattern
        p = p.replace("'", "''")
        parts.append(f"select doc_id, '{r.kind}' kind, {i} o, {r.least} least, regexp_extract_all(text, '{p}') m, regexp_extract_all(text, '{p}', {r.value}) v, regexp_split_to_array(text, '{p}') b from t")
    return (
        "with t as (select doc_id, coalesce(text, '') as text from documents), r as (" + " union all ".join(parts) + """),
x as (select doc_id, kind, o, least, m, v, b, unnest(range(1, len(m) + 1)) i from r where len(m) > 0),
s as (select doc_id, kind, o, (list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::bigint s,
  length(m[i]) n from x where length(v[i]) >= least),
g as (select doc_id, count(*) filter (o = 0) a, count(*) filter (o = 1) c, count(*) filter (o = 2) h,
  string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) filter (o < 3) base,
  string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) every from s group by doc_id)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(c, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(every, '') spans from t left join g using (doc_id)"""
    )


OP7_SQL = _sql()
