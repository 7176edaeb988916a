"""Temperature mixing of sources to target weights, in DataFrame expressions only.

The token share p of each source becomes a weight proportional to p**a.  The exponent a is bisected
on a grid of 2**-20: the largest that still reaches the target entropy (a fraction of the log of the
number of sources), raised where needed to the smallest that keeps every source within the repetition
limit.  Weights are whole numbers (the tokens themselves at exponent 1, else p**a in steps of 2**-40) and
all their sums are exact, so exponent and quotas don't depend on how rows are spread over partitions.
Quotas are rounded down; what is left of the budget goes, a token each, to the largest remainders.

Each source's quota is then realised as whole passes over its documents and one last pass in part:
documents fall into hashed blocks, the blocks of a pass are permuted by hash, whole blocks are taken
while they fit, and in the one block that does not fit, documents in hash order.

Words are counted once, into a written table; quotas and places are worked out on its narrow columns,
and the texts meet their number of copies in one join at the end.  A source has at most ``MOST_BLOCKS``
blocks, so the running sum over blocks is bounded however large the source, and a block holds a bounded
share of it; a hot source is spread over its blocks.

Defined results: NULL texts have no tokens and documents without tokens cost nothing; a NULL source is
a source of its own; sources without tokens have weight zero and give no rows; repeated rows are drawn
as separate documents, in the order of their texts' hashes; rows without an id are hashed as an empty
one; with no tokens at all, or an empty table, no rows; input columns named like an output are replaced,
all others (whatever their names) are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, table, written

WORD = r"[^\x20\x09-\x0D]+"
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
BLOCK_TOKENS = 20_000
MOST_BLOCKS = 65_536
GRID_BITS = 20
#: Steps of a weight between 0 and 1.
UNIT = 1 << 40
SEED = "mix-1"
_ADDED = ("n_tokens", "epoch", "block", "block_order", "doc_order")


def _hash(*parts) -> Column:
    """md5 of the parts joined by '|'; NULL parts are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _weight(a: Column | float) -> Column:
    """p**a in whole steps, so that sums of weights are exact."""
    return F.floor(F.pow("_p", a if isinstance(a, Column) else F.lit(a)) * float(UNIT))


def _at(sources: DataFrame, exponents: list[int]) -> dict[int, tuple[float, float]]:
    """Entropy and largest repetition (for a budget of all tokens) of each exponent, in one aggregation."""
    a = F.col("_k") / float(1 << GRID_BITS)
    each = sources.select("_p", F.explode(F.array(*[F.lit(k) for k in exponents])).alias("_k"))
    w = _weight(a)
    whole = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = each.groupBy("_k").agg(whole(w).alias("_z"), whole(F.floor(F.pow("_p", a) * F.log("_p") * float(UNIT))).alias("_l"), F.max(w / F.col("_p")).alias("_r"))
    rows = sums.select("_k", (F.log(F.col("_z") / float(UNIT)) - a * F.col("_l") / F.col("_z")).alias("h"), (F.col("_r") / F.col("_z")).alias("r")).collect()
    return {r._k: (r.h, r.r) for r in rows}


def _bisect(sources: DataFrame, low_enough) -> int:
    """The largest exponent in [0, 2**GRID_BITS] with low_enough(entropy, repetition); 0 if none.

    low_enough holds up to some exponent.  Five halvings share one aggregation: it evaluates all
    points that they could visit.
    """
    lo, hi = 0, (1 << GRID_BITS) + 1
    while hi - lo > 1:
        step = max(1, (hi - lo) // 32)
        points = list(range(lo + step, hi, step))
        got = _at(sources, points)
        good = [k for k in points if low_enough(*got[k])]
        lo, hi = max(good, default=lo), min((k for k in points if k not in good), default=hi)
    return lo


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, scale: float = 1.0) -> float:
    """The mixing exponent for sources (_p: positive shares); scale: the budget over all tokens."""
    n = sources.count()
    if n < 2:
        return 1.0
    import math

    by_entropy = _bisect(sources, lambda h, r: h >= target_entropy * math.log(n))
    by_repeats = _bisect(sources, lambda h, r: r * scale > max_repeats)
    whole = 1 << GRID_BITS
    if by_repeats and by_repeats >= by_entropy:
        by_entropy = min(whole, by_repeats + 1)
    elif not by_repeats and not by_entropy and _at(sources, [0])[0][1] * scale > max_repeats:
        by_entropy = 1
    return by_entropy / whole


def quotas(sums: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """(_source, _tokens, _quota) for sources (_source, _tokens: positive); the quotas sum to the budget."""
    total = int(sums.agg(F.sum("_tokens")).first()[0] or 0)
    if not total:
        return sums.select("_source", "_tokens", F.lit(0).cast("long").alias("_quota")).limit(0)
    budget = total if budget is None else budget
    shares = sums.withColumn("_p", F.col("_tokens") / F.lit(float(total)))
    a = exponent(shares, target_entropy, max_repeats, budget / total)
    weighed = shares.select("_source", "_tokens", (F.col("_tokens") if a == 1.0 else _weight(a)).cast("decimal(20,0)").alias("_w"))
    z = int(weighed.agg(F.sum("_w")).first()[0])
    claim = F.lit(budget).cast("decimal(18,0)") * F.col("_w")
    dealt = weighed.select("_source", "_tokens", F.expr(f"cast({budget} as decimal(18,0)) * _w div cast({z} as decimal(38,0))").alias("_quota"), (claim % F.lit(z).cast("decimal(38,0)")).alias("_rest"))
    dealt = written(dealt, "quotas")
    left = budget - int(dealt.agg(F.sum("_quota")).first()[0])
    if not left:
        return dealt.drop("_rest")
    more = dealt.orderBy(F.desc("_rest"), _hash(F.col("_source")), F.col("_source").isNull()).limit(left).select(F.col("_source").alias("_s"), F.lit(1).alias("_more"))
    return dealt.join(more, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "_tokens", (F.col("_quota") + F.coalesce("_more", F.lit(0))).alias("_quota"))


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Drawn documents, one row per draw: columns of docs (or keep), n_tokens, epoch, block, block_order, doc_order.

    Reading the draws of a source by (epoch, block_order, doc_order) is its block permutation.
    """
    own = Own(docs)
    carried = own.kept(_ADDED, keep)
    words = F.coalesce(F.regexp_count(own[text], F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.md5(F.coalesce(F.col(own[text]), F.lit("")).cast("binary"))
    counted = own.df.select(*carried, F.col(own[source]).alias("_source"), F.col(own["doc_id"]).cast("string").alias("_id"), words.alias("_n"), tie.alias("_tie"))
    base = written(counted.withColumn("_row", F.monotonically_increasing_id()), "counted")
    narrow = base.select("_row", "_source", "_id", "_n", "_tie")
    sums = written(narrow.groupBy("_source").agg(F.sum("_n").alias("_tokens")).where("_tokens > 0"), "sources")
    blocks_of = F.least(F.ceil(F.col("_tokens") / F.lit(float(block_tokens))), F.lit(MOST_BLOCKS)).cast("long")
    plan = quotas(sums, target_entropy, max_repeats, budget).select(F.col("_source").alias("_of"), blocks_of.alias("_blocks"), F.expr("cast(_quota div _tokens as int)").alias("_full"), (F.col("_quota") % F.col("_tokens")).alias("_part"))

    block = (F.conv(F.substring(_hash(seed, F.col("_id")), 1, 15), 16, 10).cast("long") % F.col("_blocks")).cast("int")
    dealt = narrow.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_block", block)
    by_block = dealt.groupBy(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_full").agg(F.sum("_n").alias("_sum"))
    order = _hash(seed, F.col("_full"), F.col("_s"), F.col("_b"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_s").orderBy(order, "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_block = by_block.select("_s", "_b", before.alias("_before"))
    placed = dealt.join(by_block, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    within = W.partitionBy("_source", "_block").orderBy(_hash(seed, F.col("_full"), F.col("_id")), "_n", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    copies = F.col("_full") + ((F.col("_before") + F.sum("_n").over(within)) <= F.col("_part")).cast("int")
    taken = placed.select(F.col("_row").alias("_at"), F.col("_block"), copies.alias("_copies")).where("_copies > 0")
    drawn = base.join(taken, F.col("_row") == F.col("_at")).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return own.back(drawn, {"n_tokens": "_n", "epoch": "_epoch", "block": "_block", "block_order": _hash(seed, F.col("_epoch"), F.col("_source"), F.col("_block")), "doc_order": _hash(seed, F.col("_epoch"), F.col("_id"))}, keep)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id", "source"])


def mix_sql(docs: str = "documents", columns: str = "doc_id, source") -> str:
    """DuckDB SQL of mix() with its defaults over the relation docs."""
    grid, unit = f"{1 << GRID_BITS}.0::double", f"{UNIT}.0::double"
    entropy_at, repeats_at = f"(((elo + ehi) // 2) / {grid})", f"(((rlo + rhi) // 2) / {grid})"
    weight = lambda a: f"floor(p ** {a} * {unit})::bigint"
    entropy = f"(select ln(sum({weight('x')})::double / {unit}) - max(x) * sum(floor(p ** x * ln(p) * {unit})::bigint)::double / sum({weight('x')})::double from (select p, {entropy_at} x from p))"
    repeats = f"(select max({weight('x')}::double / p) / sum({weight('x')})::double from (select p, {repeats_at} x from p))"
    return rf"""
with recursive base as (select *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint n_tokens, md5(coalesce(text, '')) tie from {docs}),
sums as (select source, sum(n_tokens)::bigint t from base group by source having sum(n_tokens) > 0),
tot as (select sum(t)::bigint total, count(*) n from sums),
p as (select source, t, t / total::double p from sums, tot),
steps as (
  select 0 i, 0::bigint elo, {(1 << GRID_BITS) + 1}::bigint ehi, 0::bigint rlo, {(1 << GRID_BITS) + 1}::bigint rhi
  union all
  select i + 1, if(eh >= {TARGET_ENTROPY} * ln(n), em, elo), if(eh >= {TARGET_ENTROPY} * ln(n), ehi, em), if(rr > {MAX_REPEATS}, rm, rlo), if(rr > {MAX_REPEATS}, rhi, rm)
  from (select s.*, (elo + ehi) // 2 em, (rlo + rhi) // 2 rm, {entropy} eh, {repeats} rr from steps s where i < {GRID_BITS + 2}), tot),
ends as (select elo, rlo from steps where i = {GRID_BITS + 2}),
alpha as (select if(n < 2, 1.0, if(rlo > 0 and rlo >= elo, least({1 << GRID_BITS}, rlo + 1), elo) / {grid}) a from ends, tot),
w as (select source, t, if(a = 1, t, {weight('a')})::hugeint w from p, alpha),
claim as (select source, t, total::hugeint * w // z quota, total::hugeint * w % z rest, total from w, tot, (select sum(w)::hugeint z from w)),
dealt as (select source, t, quota + (row_number() over (order by rest desc, md5(coalesce(source, '')), source is null) <= total - sum(quota) over ())::int quota from claim),
plan as (select source, t, quota::bigint quota, least(ceil(t / {float(BLOCK_TOKENS)}), {MOST_BLOCKS})::bigint blocks from dealt),
d as (select base.*, quota // t full_, quota % t part, (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint % blocks)::int block
  from base join plan on base.source is not distinct from plan.source),
b as (select source, block, full_, sum(n_tokens) n from d group by all),
bb as (select source, block, coalesce(sum(n) over (partition by source order by md5('{SEED}|' || full_ || '|' || coalesce(source, '') || '|' || block), block rows between unbounded preceding and 1 preceding), 0) bef from b),
c as (select d.*, full_ + (bef + sum(n_tokens) over (partition by d.source, d.block order by md5('{SEED}|' || full_ || '|' || coalesce(doc_id::varchar, '')), n_tokens, tie rows unbounded preceding) <= part)::int copies
  from d join bb on d.source is not distinct from bb.source and d.block = bb.block)
select {columns}, n_tokens, epoch::int epoch, block, md5('{SEED}|' || epoch || '|' || coalesce(source, '') || '|' || block) block_order, md5('{SEED}|' || epoch || '|' || coalesce(doc_id::varchar, '')) doc_order
from (select *, unnest(range(0, copies)) epoch from c where copies > 0)
"""


OP10_SQL = mix_sql()
