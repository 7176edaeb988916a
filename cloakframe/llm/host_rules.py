"""Quality rules judged by host: failures are aggregated by domain, shrunk, and joined back.

Each document is measured once (words, symbols, repeated lines and windows) into a written table, which
holds the texts only where the caller wants them back (``keep``).  Rule failures are
summed by host; the beta prior of the failure rate comes from the hosts' own rates (moments,
weighted by documents), and a host whose shrunk rate exceeds ``HOST_LIMIT`` is rejected with all
its documents.  Hosts are partially aggregated before the shuffle, and the verdicts return by a
join that adaptive execution splits where a host is hot.

Defined results: NULL and empty texts have no words (and fail the rule on few words); documents
with a NULL host form one host; with one host, or hosts of equal rates, the prior has the mean
rate and the strength ``MAX_STRENGTH``; ids may be of any type, missing or repeated (each row is judged
by itself); an empty table gives no rows; input columns named like an output are replaced, all others
(whatever their names) are returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import Own, Words, grams, read_texts, table, written

REPEAT_WINDOW = 5
HOST_LIMIT = 0.5
MAX_STRENGTH = 1_000_000.0

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_VERDICTS = ("base_failed", "rule_failed", "host_rate", "host_rejected", "kept")
_BYTE = np.arange(256)
_LEADS = (_BYTE & 0xC0) != 0x80
_LEADS[[9, 10, 11, 12, 13, 32]] = False
_SYMBOL = np.isin(_BYTE, list(b"#*$%&|<>"))


def repeated_words(words: Words, window: int) -> np.ndarray:
    """Per text, the words inside windows found twice or more in that text."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(len(words.count), np.int64)
    whole = words.text[:n] == words.text[window - 1 :]
    at = np.flatnonzero(whole)
    keys = grams(words.hash, window)[at] + words.text[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.hash) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + window] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def measures(texts: list[bytes]) -> dict:
    words = Words(texts)
    b = np.frombuffer(words.data, np.uint8)
    ends = words.text_end
    starts = np.append(0, ends[:-1])

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags[b]))
        return sums[ends] - sums[starts]

    dups = []
    for x in texts:
        lines = [y for y in x.split(b"\n") if y.strip()]
        dups.append(len(lines) - len(set(lines)))
    return {"n_words": words.count, "word_chars": within(_LEADS), "n_symbols": within(_SYMBOL), "n_dup_lines": dups, "n_repeat_words": repeated_words(words, REPEAT_WINDOW)}


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with the measures, base_failed, rule_failed, host_rate (shrunk), host_rejected and kept."""
    own = Own(docs)
    mine = own.kept((*_MEASURES, *_VERDICTS), keep)
    m = read_texts(own, [*mine, own[host]], ", ".join(f"_{c} bigint" for c in _MEASURES), lambda x: {f"_{k}": v for k, v in measures(x).items()}, text)
    base = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    judged = m.select(*mine, F.col(own[host]).alias("_host"), *[f"_{c}" for c in _MEASURES], base.alias("_base"), (base | (100 * F.col("_n_symbols") > 10 * F.col("_word_chars"))).alias("_rule"))
    judged = written(judged, "measured")  # read twice, measured once
    verdicts = host_verdicts(judged, limit).withColumnRenamed("_host", "_of")
    joined = judged.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left")
    kept = ~F.col("_base") & ~F.col("_rejected")
    return own.back(joined, {c: f"_{c}" for c in _MEASURES} | {"base_failed": "_base", "rule_failed": "_rule", "host_rate": "_rate", "host_rejected": "_rejected", "kept": kept}, keep)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(_host, _rate: posterior mean of its failure rate, _rejected) of each host of (_host, _rule)."""
    by_host = measured.groupBy("_host").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col("_rule").cast("double")).alias("_f"))
    # decimals, so that the sum doesn't depend on the order of hosts
    squares = F.sum((F.col("_f") * F.col("_f") / F.col("_n")).cast("decimal(28,9)")).cast("double")
    moments = by_host.agg(F.sum("_n").alias("_N"), F.sum("_f").alias("_F"), squares.alias("_S"))
    mean = F.col("_F") / F.col("_N")
    moments = moments.select(mean.alias("_m"), (F.col("_S") / F.col("_N") - mean * mean).alias("_v"))
    strength = F.when(F.col("_v") > 1e-12, F.least(F.greatest(F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1, F.lit(1.0)), F.lit(MAX_STRENGTH))).otherwise(MAX_STRENGTH)
    prior = moments.select("_m", strength.alias("_k"))  # one row
    shrunk = (F.col("_f") + F.col("_m") * F.col("_k")) / (F.col("_n") + F.col("_k"))
    return by_host.join(F.broadcast(prior)).select("_host", shrunk.alias("_rate"), (shrunk > limit).alias("_rejected"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
with t as (select doc_id, source, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from t where len(w) >= 5)),
rep as (select doc_id, count(distinct j) n from (
  select doc_id, unnest(range(i, i + 5)) j from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(text, chr(10))) l from t)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (select t.doc_id, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
  from t left join dup using (doc_id) left join rep using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m),
h as (select source, count(*)::double n, sum((base_failed or 100 * n_symbols > 10 * word_chars)::int)::double f from f group by source),
p as (select sum(f) / sum(n) m, sum((f * f / n)::decimal(28,9))::double / sum(n) - (sum(f) / sum(n)) ** 2 v from h),
k as (select m, case when v > 1e-12 then least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) else 1e6 end k from p),
v as (select source, (f + m * k) / (n + k) > 0.5 bad from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad kept
from f join v on f.source is not distinct from v.source
"""
