"""Queries of the de-identification operators and their DuckDB equivalents.

Every query runs over its whole tables.  The SQL side has no lookaround, so its patterns state the same
matches by their maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions import patterns as P
from cloakframe.functions import surrogates as S
from cloakframe.functions import text as X
from cloakframe.functions import validators as V
from cloakframe.operators import blocks as B
from cloakframe.operators import evaluate as E
from cloakframe.operators import leak as L
from cloakframe.operators import mapping as M
from cloakframe.operators import ner
from cloakframe.operators import review as R
from cloakframe.operators.detect import detections, raw_spans
from cloakframe.operators.engine import process_text
from cloakframe.operators.overlap import normalize_overlaps
from cloakframe.operators import roles as ROLES
from cloakframe.operators.propagate import GENERIC_TOKENS, STOP_TOKENS, candidates, seeds_from
from cloakframe.operators.roles import defined_terms, is_role_term
from cloakframe.sources.scratch import written
from cloakframe.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SQL_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
SQL_IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SQL_PHONE = r"\+?[0-9]{1,3} ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
SQL_HEX = r"\b[0-9a-f]{40}\b"
SQL_CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"

#: Simple forms of the recognizers, for queries that compare spans one to one.
EMAIL, IPV4, PHONE, CARD, HEX = P.EMAIL, P.IPV4, P.PHONE, P.CARD, P.HEX_TOKEN


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def spans_sql(pattern: str, table: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """Rows (keys, start, end, value) of all matches."""
    p = pattern.replace("'", "''")
    return f"""select {keys}, (list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::int "start",
    (list_sum(list_transform(b[1:i], lambda z: length(z))) + list_sum(list_transform(m[1:i], lambda z: length(z))))::int "end", m[i] "value"
  from (select {keys}, m, b, unnest(range(1, len(m) + 1)) i from (
    select {keys}, regexp_extract_all({text}, '{p}') m, regexp_split_to_array({text}, '{p}') b from {table}) where len(m) > 0)"""


IPV4_OK = "list_bool_and(list_transform(string_split(value, '.'), lambda x: x::int <= 255))"
LUHN_OK = """(list_sum(list_transform(range(1, length(regexp_replace(value, '[^0-9]', '', 'g')) + 1),
  lambda i: case when i % 2 = 1 then substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), i, 1)::int
            else (2 * substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), i, 1)::int) % 10 + substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), i, 1)::int // 5 end)) % 10 = 0)"""
ALL_SPANS = f"""(
  select *, 'EMAIL_ADDRESS' entity_type from ({spans_sql(SQL_EMAIL)}) union all select *, 'IP_ADDRESS' from ({spans_sql(SQL_IPV4)}) where {IPV4_OK}
  union all select *, 'PHONE_NUMBER' from ({spans_sql(SQL_PHONE)}) union all select *, 'CREDIT_CARD' from ({spans_sql(SQL_CARD)}) where {LUHN_OK}
  union all select *, 'ID_NUMBER' from ({spans_sql(SQL_HEX)}))"""


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def _spans(df: DataFrame, recognizer: P.Recognizer, *keys: str, text: str = "text") -> DataFrame:
    found = df.select(*keys, F.col(text).alias("_t"), X.matches(text, recognizer.pattern).alias("_m")).where(F.size("_m") > 0)
    rows = found.select(*keys, F.explode(X.spans_of("_t", F.col("_m"), recognizer.pattern)).alias("s"))
    rows = rows.select(*keys, "s.start", "s.end", F.col("s.text").alias("value"))
    return rows.where(recognizer.validate(F.col("value"))) if recognizer.validate else rows


# Detection ------------------------------------------------------------------------------------


@query(f"select d.doc_id, d.text not null and len(m) > 0 found, coalesce(len(m), 0)::int n_emails, sha256(coalesce(regexp_replace(text, '{SQL_EMAIL}', '<EMAIL_ADDRESS>', 'g'), '')) text_sha, 0 leaks from (select doc_id, text, regexp_extract_all(text, '{SQL_EMAIL}') m from documents) d")
def email_replace(spark, sf_dir):
    """E-mail spans, replacement, splice and leak counts, natively."""
    out = process_text(_docs(spark, sf_dir), {"DEFAULT": A.REPLACE}, recognizers=[EMAIL], entities=["EMAIL_ADDRESS"])
    return out.select("doc_id", (F.size("spans") > 0).alias("found"), F.size("spans").alias("n_emails"), F.sha2(F.coalesce("anonymized", F.lit("")), 256).alias("text_sha"), F.size("leaks").alias("leaks"))


@query(spans_sql(SQL_EMAIL))
def email_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), EMAIL, "doc_id")


@query(f"select * from ({spans_sql(SQL_IPV4)}) where {IPV4_OK}")
def ipv4_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), IPV4, "doc_id")


@query(spans_sql(SQL_PHONE))
def phone_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), PHONE, "doc_id")


@query(f"select *, {LUHN_OK} luhn_valid from ({spans_sql(SQL_CARD)})")
def card_spans(spark, sf_dir):
    plain = P.Recognizer("Card", "CREDIT_CARD", CARD.pattern, 0.5)
    return _spans(_docs(spark, sf_dir), plain, "doc_id").withColumn("luhn_valid", V.luhn(F.col("value")))


@query(spans_sql(SQL_HEX))
def token_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), HEX, "doc_id")


@query(f"""select s.doc_id, "start", "end", case when regexp_matches(lower(substr(text, greatest("start" - 40, 0) + 1, ("end" + 40 - greatest("start" - 40, 0))::int)), '\\b(?:phone|call|tel)\\b') then 0.85 else 0.5 end::double score
from ({spans_sql(SQL_PHONE)}) s join documents using (doc_id)""")
def phone_scores(spark, sf_dir):
    """Telephone numbers, surer of those near a word such as call."""
    found = raw_spans(_docs(spark, sf_dir), recognizers=[PHONE])
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.score")


def _planted(rows: DataFrame, recognizer: P.Recognizer) -> DataFrame:
    """Spans of one recognizer, its validator included, in (key, text)."""
    found = raw_spans(rows, recognizers=[recognizer])
    return found.select("key", "text", F.explode("spans").alias("s")).select("key", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"))


@query("""with t as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') a, strftime(o_orderdate, '%B %-d, %Y') b, strftime(o_orderdate, '%-d.%-m.%Y') c from orders)
select o_orderkey as key, 5 "start", 15 "end", a as value from t union all select o_orderkey, 19, (19 + length(b))::int, b from t union all select o_orderkey, (21 + length(b))::int, (21 + length(b) + length(c))::int, c from t""")
def date_mentions(spark, sf_dir):
    """Every order's date in three layouts, and as a part of longer numbers, which isn't one."""
    day = lambda layout: F.date_format("o_orderdate", layout)
    text = F.concat(F.lit("paid "), day("yyyy-MM-dd"), F.lit(" or "), day("MMMM d, yyyy"), F.lit("; "), day("d.M.yyyy"), F.lit(" not 1"), day("yyyy-MM-dd"))
    return _planted(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), text.alias("text")), P.DATE)


_SSN_SQL = "(select c_custkey k, lpad((c_custkey * 7919 % 1000)::varchar, 3, '0') a, lpad((c_custkey % 100)::varchar, 2, '0') g, lpad((c_custkey * 37 % 10000)::varchar, 4, '0') n from customer)"


@query(f"""select k as key, 3 "start", 14 "end", a || '-' || g || '-' || n as value from {_SSN_SQL} where a not in ('000', '666') and a < '900' and g <> '00' and n <> '0000'""")
def ssn_mentions(spark, sf_dir):
    """A number of the form for every customer; those that are never issued are left out."""
    part = lambda value, n: F.lpad(value.cast("string"), n, "0")
    k = F.col("c_custkey")
    text = F.concat(F.lit("no "), part(k * 7919 % 1000, 3), F.lit("-"), part(k % 100, 2), F.lit("-"), part(k * 37 % 10000, 4), F.lit(" 123-45-67890"))
    return _planted(read_table(spark, sf_dir, "customer").select(k.alias("key"), text.alias("text")), P.SSN)


@query("""select c_custkey as key, 4 "start", 26 "end", 'DE' || lpad((98 - (lpad(c_custkey::varchar, 18, '0') || '131400')::hugeint % 97)::varchar, 2, '0') || lpad(c_custkey::varchar, 18, '0') as value
from customer where c_custkey % 2 = 0""")
def iban_mentions(spark, sf_dir):
    """An account number for every customer, with a wrong check number for odd ones."""
    k = F.col("c_custkey")
    account = F.lpad(k.cast("string"), 18, "0")
    check = 98 - (F.concat(account, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int") + (k % 2).cast("int")
    text = F.concat(F.lit("pay DE"), F.lpad(check.cast("string"), 2, "0"), account)
    return _planted(read_table(spark, sf_dir, "customer").select(k.alias("key"), text.alias("text")), P.IBAN)


_LINK = r"""https?://[^\s<>"']+[^\s<>"'.,;:!?)]"""


@query(f"""select page_id as key, 4 "start", (4 + length(v))::int "end", v as value from (select page_id, regexp_extract(url, '{_LINK.replace("'", "''")}') v from pages) where v <> ''""")
def page_links(spark, sf_dir):
    """Every page's address at the end of a sentence."""
    return _planted(read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("see "), "url", F.lit(".")).alias("text")), P.URL)


_EDGES = ",;:()[]\"''"


@query(rf"""with w as (select distinct unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) v from documents),
t as (select kind, v, ltrim(rtrim(v, '{_EDGES}.'), '{_EDGES}') t from w, (select unnest(['ID_NUMBER', 'DATE_TIME', 'PERSON']) kind)),
c as (select kind, v, t, regexp_matches(t, '\p{{Nd}}') d, regexp_matches(t, '\p{{Lu}}') u from t)
select v as value, kind as claimed, t as trimmed, least(1.0, 0.35 + 0.65 * greatest(0.0, (length(v) % 10 / 10.0::double - 0.2) / 0.8)) score,
  case when kind = 'ID_NUMBER' then case when d and not regexp_matches(t, '{ner.CURRENCY}') then 'ID_NUMBER' when not d and u then 'ORGANIZATION' end
       when kind = 'DATE_TIME' then case when d or (u and lower(t) not in ({", ".join(f"'{x}'" for x in ner.WEEKDAYS)})) then 'DATE_TIME' end else kind end as entity_type from c""")
def claims_rechecked(spark, sf_dir):
    """Every word of the documents as if a model had claimed it: trimmed, checked again and its score rescaled."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("value")).distinct()
    claims = words.select("value", F.explode(F.array(*[F.lit(x) for x in ("ID_NUMBER", "DATE_TIME", "PERSON")])).alias("claimed"))
    trimmed = claims.withColumn("trimmed", ner.trim_edges(F.lit(0), F.col("value"))["text"])
    return trimmed.select("value", "claimed", "trimmed", ner.rescale(F.length("value") % 10 / F.lit(10.0)).alias("score"), ner.recheck(F.col("claimed"), F.col("trimmed")).alias("entity_type"))


def _profile(spark, sf_dir) -> DataFrame:
    found = raw_spans(_docs(spark, sf_dir, "doc_id", "lang", "source", "text"), recognizers=[EMAIL, IPV4, PHONE, CARD, HEX])
    return found.select("doc_id", "lang", "source", F.explode("spans").alias("s")).select("doc_id", "lang", "source", F.col("s.entity_type").alias("entity_type"))


_PROFILE_SQL = f"(select d.lang, d.source, a.doc_id, a.entity_type from {ALL_SPANS} a join documents d using (doc_id))"


@query(f"select lang, entity_type, count(*) n, count(distinct doc_id) docs from {_PROFILE_SQL} group by lang, entity_type")
def entity_counts_by_lang(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"select lang, entity_type, count(*) n from {_PROFILE_SQL} group by rollup (lang, entity_type)")
def entity_rollup(spark, sf_dir):
    return _profile(spark, sf_dir).rollup("lang", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"select lang, entity_type, source, count(*) n from {_PROFILE_SQL} group by cube (lang, entity_type, source)")
def entity_cube(spark, sf_dir):
    return _profile(spark, sf_dir).cube("lang", "entity_type", "source").agg(F.count(F.lit(1)).alias("n"))


#: Two spans in every 40 characters of a document: apart, touching, nested, equal or overlapping, with scores that tie or don't.
_PAIRS_SQL = """(select doc_id, k, 40 * k s1, 40 * k + 4 + k % 9 e1, 4 + k % 3 sc1, 40 * k + k % 11 s2, 40 * k + k % 11 + 3 + k % 13 e2, 4 + k % 4 sc2
  from (select doc_id, unnest(range(0, length(text) // 40)) k from documents))"""


@query(f"""with p as (select doc_id, s1 < s2 or (s1 = s2 and (e1 < e2 or (e1 = e2 and sc1 >= sc2))) first1, * exclude (doc_id) from {_PAIRS_SQL}),
o as (select doc_id, if(first1, s1, s2) a0, if(first1, e1, e2) a1, if(first1, sc1, sc2) ac, if(first1, 'A', 'B') ta, if(first1, s2, s1) b0, if(first1, e2, e1) b1, if(first1, sc2, sc1) bc, if(first1, 'B', 'A') tb from p),
w as (select *, case when a1 <= b0 then 'both' when b1 <= a1 then 'a' when a0 = b0 then 'b'
  when a1 - a0 > b1 - b0 or (a1 - a0 = b1 - b0 and ac >= bc) then 'cut b' else 'cut a' end r from o)
select doc_id, a0::int "start", (case when r = 'cut a' then b0 else a1 end)::int "end", ta entity_type from w where r <> 'b'
union all select doc_id, (case when r = 'cut b' then a1 else b0 end)::int, b1::int, tb from w where r <> 'a'""")
def overlap_resolution(spark, sf_dir):
    """Containment, trimming of the shorter span and the higher score, for pairs of spans all over the documents."""
    docs = _docs(spark, sf_dir).where(F.length("text") >= 40)
    span = lambda s, e, t, x: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(t).alias("entity_type"), (x / 10.0).alias("score"), F.lit("r").alias("recognizer_name"))
    two = lambda k: F.array(span(40 * k, 40 * k + 4 + k % 9, "A", 4 + k % 3), span(40 * k + k % 11, 40 * k + k % 11 + 3 + k % 13, "B", 4 + k % 4))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int") - 1), two))
    return docs.select("doc_id", F.explode(normalize_overlaps(spans)).alias("s")).select("doc_id", "s.start", "s.end", "s.entity_type")


@query(f"""select conv_id, turn, role, len(regexp_extract_all(text, '{SQL_EMAIL}'))::int emails, len(regexp_extract_all(text, '{SQL_PHONE}'))::int phones from conversations""")
def conversation_pii(spark, sf_dir):
    df = read_table(spark, sf_dir, "conversations")
    n = lambda r: F.size(X.matches("text", r.pattern))
    return df.select("conv_id", "turn", "role", n(EMAIL).alias("emails"), n(PHONE).alias("phones"))


@query(r"select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, count(*) n, count(distinct url) urls from pages group by 1")
def page_url_hosts(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    return read_table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


# Anonymization --------------------------------------------------------------------------------


def _rewritten(spark, sf_dir, policy: A.Policy) -> DataFrame:
    out = process_text(_docs(spark, sf_dir), {"DEFAULT": policy}, recognizers=[EMAIL], entities=["EMAIL_ADDRESS"])
    return out.select("doc_id", F.col("anonymized").alias("text"))


@query(f"select doc_id, regexp_replace(text, '{SQL_EMAIL}', '', 'g') as text from documents")
def redact_text(spark, sf_dir):
    return _rewritten(spark, sf_dir, A.Policy("redact"))


@query(f"select doc_id, regexp_replace(text, '{SQL_EMAIL}', '[mail]', 'g') as text from documents")
def replace_text(spark, sf_dir):
    return _rewritten(spark, sf_dir, A.Policy("replace", {"new_value": "[mail]"}))


@query(f"""select doc_id, value as original, '####' || substr(value, 5) as masked from ({spans_sql(SQL_EMAIL)})""")
def mask_values(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), EMAIL, "doc_id").select("doc_id", F.col("value").alias("original"), A.mask(F.col("value"), "#", 4).alias("masked"))


@query(f"select doc_id, sha256('pepper' || value) as hashed from ({spans_sql(SQL_EMAIL)})")
def hash_values(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), EMAIL, "doc_id").select("doc_id", A.hash_value(F.col("value"), "pepper").alias("hashed"))


@query("select doc_id, text from documents")
def keep_text(spark, sf_dir):
    return _rewritten(spark, sf_dir, A.Policy("keep"))


@query(f"select doc_id, value as original from ({spans_sql(SQL_EMAIL)})")
def encrypt_round_trip(spark, sf_dir):
    key = "0123456789abcdef"
    return _spans(_docs(spark, sf_dir), EMAIL, "doc_id").select("doc_id", A.decrypt(A.encrypt(F.col("value"), key), key).alias("original"))


@query(f"""select doc_id, regexp_replace(regexp_replace(text, '{SQL_EMAIL}', '<EMAIL_ADDRESS>', 'g'), '{SQL_HEX}', '<ID_NUMBER>', 'g') as text from documents""")
def multi_type_replace(spark, sf_dir):
    out = process_text(_docs(spark, sf_dir), {"DEFAULT": A.REPLACE}, recognizers=[EMAIL, HEX], entities=["EMAIL_ADDRESS", "ID_NUMBER"])
    return out.select("doc_id", F.col("anonymized").alias("text"))


@query(f"""select doc_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(upper(m[i]), '')), '') as text
from (select doc_id, regexp_split_to_array(text, '{SQL_EMAIL}') b, regexp_extract_all(text, '{SQL_EMAIL}') m from documents)""")
def custom_text(spark, sf_dir):
    """E-mail addresses through an operator of the caller's: upper case."""
    return _rewritten(spark, sf_dir, A.Policy("custom", {"lambda": F.upper}))


_DRAWN = "('0x' || substr(sha256('corpus' || chr(0) || 'VEHICLE' || chr(0) || c_name || chr(0) || '0' || chr(0) || '{}'), 1, 15))::bigint"


@query("select c_custkey, " + " || ".join(f"chr(({_DRAWN.format(f'l{i}')} % 26 + 97)::int)" for i in range(4)) + f" || '-' || lpad(({_DRAWN.format('n')} % 10000)::varchar, 4, '0') as surrogate from customer")
def fallback_surrogates(spark, sf_dir):
    """Surrogates of a type that has no generator: four letters and four digits."""
    return read_table(spark, sf_dir, "customer").select("c_custkey", S.draw(F.lit("VEHICLE"), F.col("c_name"), F.lit("corpus"), F.lit(0)).alias("surrogate"))


_DATE_MOVE = """(select case when ('0x' || substr(h, 1, 1))::int >= 8 then d else -d end m from (select h, 730 + ('0x' || substr(h, 2, 15))::bigint % 1096 d from (select sha256('date' || chr(0) || 'corpus') h)))"""


@query(f"select o_orderkey, strftime(o_orderdate::date + m::int, '%Y-%m-%d') as shifted from orders, {_DATE_MOVE}")
def date_shift(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", S.shift_date(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("corpus"), F.lit(0)).alias("shifted"))


@query("""select c_custkey, list_aggregate(list_transform(range(1, length(v) + 1), lambda i: case
    when regexp_matches(substr(v, i, 1), '[0-9]') then (('0x' || substr(sha256('salt' || c_name || chr(0) || (i - 1)), 1, 15))::bigint % 10)::varchar
    when regexp_matches(substr(v, i, 1), '[a-z]') then chr((('0x' || substr(sha256('salt' || c_name || chr(0) || (i - 1)), 1, 15))::bigint % 26 + 97)::int)
    when regexp_matches(substr(v, i, 1), '[A-Z]') then chr((('0x' || substr(sha256('salt' || c_name || chr(0) || (i - 1)), 1, 15))::bigint % 26 + 65)::int)
    else substr(v, i, 1) end), 'string_agg', '') as shaped from (select c_custkey, c_name, c_name v from customer)""")
def hips_reshape(spark, sf_dir):
    """Customer names with other digits and letters in the same places."""
    return read_table(spark, sf_dir, "customer").select("c_custkey", S.reshape(F.col("c_name"), F.concat(F.lit("salt"), F.col("c_name"))).alias("shaped"))


@query(None)
def hips_text(spark, sf_dir):
    """All pattern types rewritten with surrogates that avoid the document's originals; leaks must be none."""
    out = process_text(_docs(spark, sf_dir), recognizers=P.PATTERNS, salt=F.concat(F.lit("corpus-"), F.col("doc_id").cast("string")))
    return out.select("doc_id", F.size("spans").alias("n_spans"), F.sha2(F.coalesce("anonymized", F.lit("")), 256).alias("text_sha"), F.size("leaks").alias("leaks"))


# Mapping store --------------------------------------------------------------------------------


def _short(entity_type, original, attempt):
    return F.substring(F.sha2(F.concat_ws("|", entity_type, original, attempt.cast("string")).cast("binary"), 256), 1, 16)


@query("select c_name as original, substr(sha256('PERSON|' || c_name || '|0'), 1, 16) as pseudonym, c_name as reversed from customer")
def pseudonym_map(spark, sf_dir):
    """Minting for every customer, then back again."""
    people = read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), F.col("c_custkey").alias("ord"))
    named, grown = M.get_or_create(people, M.empty(spark), _short)
    back = M.reverse(named.select("entity_type", "pseudonym", F.col("original").alias("_o")), grown)
    return back.select(F.col("_o").alias("original"), "pseudonym", F.col("original").alias("reversed"))


def _named_sql(lang: str = "['en', 'it', 'fr', 'de', 'es', 'pt', 'nl'][c_custkey % 7 + 1]", columns: str = "original, {} as pseudonym, original as reversed") -> str:
    """The first person's name drawn for (original, lang), which holds where no two customers draw the same (at 60 times sf0.1, some do)."""
    draw = lambda what, n: f"('0x' || substr(sha256('pseudonym' || chr(0) || 'PERSON' || chr(0) || original || chr(0) || '0' || chr(0) || '{what}'), 1, 15))::bigint % {n}"
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    spoken = lambda values, what: "case lang " + " ".join(f"when '{k}' then {listed(v)}[{draw(what, len(v))} + 1]" for k, v in values.items()) + " end"
    syllable = lambda i: f"{listed(S.ONSETS)}[d // {100**i} % 100 // 5 + 1] || {listed(S.VOWELS)}[d // {100**i} % 100 % 5 + 1]"
    word = " || ".join(syllable(i) for i in range(3)) + f" || {spoken(S.SURNAME, 'end')}"
    name = f"{spoken(S.GIVEN, 'given')} || ' ' || chr(({draw('initial', 26)} + 65)::int) || '. ' || upper(word[1]) || word[2:]"
    return f"""select {columns.format(name)}
from (select *, {word} word from (select c_name original, c_custkey, {lang} lang, {draw('name', 10**6).replace('original', 'c_name')} d from customer))"""


@query(_named_sql())
def pseudonym_names(spark, sf_dir):
    """Names in seven languages for every customer by the shipped factory, then back again."""
    languages = F.array(*[F.lit(x) for x in ("en_GB", "it", "fr_FR", "de", "es", "pt", "nl")])
    people = read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), F.col("c_custkey").alias("ord"), F.get(languages, (F.col("c_custkey") % 7).cast("int")).alias("language"))
    named, grown = M.get_or_create(people, M.empty(spark))
    back = M.reverse(named.select("entity_type", "pseudonym", F.col("original").alias("_o")), grown)
    return back.select(F.col("_o").alias("original"), "pseudonym", F.col("original").alias("reversed"))


@query("select c_name as original, if(c_custkey % 3 = 0, 'known ' || c_custkey, null) as pseudonym from customer")
def pseudonym_peek(spark, sf_dir):
    """Customers with the pseudonym that a store has for a third of them; nothing is minted."""
    people = read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), "c_custkey")
    known = people.where("c_custkey % 3 = 0").select("entity_type", "original", F.concat(F.lit("known "), F.col("c_custkey").cast("string")).alias("pseudonym"))
    return M.peek(people.select("entity_type", "original"), known).select("original", "pseudonym")


@query(_named_sql("'en'", "original, if(c_custkey % 3 = 0, 'known ' || c_custkey, {}) as pseudonym"))
def pseudonym_preview(spark, sf_dir):
    """What a commit would give every customer: known pseudonyms, and names that would be minted."""
    people = read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), F.col("c_custkey").alias("ord"))
    known = people.where("ord % 3 = 0").select("entity_type", "original", F.concat(F.lit("known "), F.col("ord").cast("string")).alias("pseudonym"))
    return M.preview(people, known).select("original", "pseudonym")


@query("select c_name as original, 'shared' || case when n = 0 then '' else '-' || n end as pseudonym from (select c_name, row_number() over (order by c_custkey) - 1 n from customer)")
def pseudonym_collisions(spark, sf_dir):
    """All customers draw the same candidate: the first keeps it, the others get suffixes in order."""
    people = read_table(spark, sf_dir, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original"), F.col("c_custkey").alias("ord"))
    return M.mint(people, M.empty(spark), lambda t, o, k: F.lit("shared")).select("original", "pseudonym")


# Blocks ---------------------------------------------------------------------------------------


def _segments(spark, sf_dir) -> DataFrame:
    """The lines of documents as segments; two lines make a block, joined by a space."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_ord", "text"))
    return lines.select("doc_id", "seg_ord", F.concat(F.lit("line"), F.col("seg_ord").cast("string")).alias("segment_id"), "text", F.floor(F.col("seg_ord") / 2).cast("string").alias("block"), F.lit(" ").alias("join_before"))


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 seg_ord from documents)"


_RUN_IDS = "'body/p' || l_orderkey || case l_linenumber % 3 when 0 then '/r' || l_linenumber when 1 then '/h/n' || l_linenumber else '/x' || l_linenumber end"


@query(f"select id as segment_id, if(regexp_matches(id, '/[rn][0-9]+$'), regexp_replace(id, '/[rn][0-9]+$', ''), null) as block from (select {_RUN_IDS} id from lineitem)")
def run_blocks(spark, sf_dir):
    """The block of a run by its id, for ids of several kinds."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "/r").when(F.col("l_linenumber") % 3 == 1, "/h/n").otherwise("/x")
    ids = read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("body/p"), F.col("l_orderkey").cast("string"), kind, F.col("l_linenumber").cast("string")).alias("segment_id"))
    return ids.withColumn("block", B.run_block(F.col("segment_id")))


@query(f"select doc_id, min(seg_ord)::int block_ord, string_agg(text, ' ' order by seg_ord) as text, count(*)::int segments from {_LINES} group by doc_id, seg_ord // 2")
def block_join(spark, sf_dir):
    return B.join_blocks(_segments(spark, sf_dir)).select("doc_id", "block_ord", "text", F.size("segs").alias("segments"))


@query(f"""with b as (select doc_id, seg_ord // 2 k, string_agg(text, ' ' order by seg_ord) as text, first(length(text) order by seg_ord) n0 from {_LINES} group by all),
s as ({spans_sql("[a-z]+ [A-Z][a-z]+", "b", "doc_id, k, n0")})
select doc_id, (2 * k)::int block_ord, "start" || '-' || "end" as at, 'line' || (2 * k) segment_id, "start" piece_start, least("end", n0)::int piece_end from s where "start" < n0
union all select doc_id, (2 * k)::int, "start" || '-' || "end", 'line' || (2 * k + 1), greatest("start" - n0 - 1, 0)::int, ("end" - n0 - 1)::int from s where "end" > n0 + 1""")
def block_projection(spark, sf_dir):
    """Spans of joined blocks as pieces of their lines."""
    blocks = B.join_blocks(_segments(spark, sf_dir))
    pattern = "[a-z]+ [A-Z][a-z]+"
    found = blocks.withColumn("_m", X.matches("text", pattern)).where(F.size("_m") > 0).select("doc_id", "block_ord", "segs", F.explode(X.spans_of("text", F.col("_m"), pattern)).alias("s"))
    each = found.select("doc_id", "block_ord", F.concat_ws("-", "s.start", "s.end").alias("at"), F.explode(B.pieces_of(F.col("segs"), F.col("s.start"), F.col("s.end"))).alias("p"))
    return each.select("doc_id", "block_ord", "at", "p.segment_id", F.col("p.start").alias("piece_start"), F.col("p.end").alias("piece_end"))


@query(r"select doc_id, regexp_replace(text, '[A-Z]{2,}', '_', 'g') as text from documents")
def splice_edits(spark, sf_dir):
    pattern = "[A-Z]{2,}"
    df = _docs(spark, sf_dir).withColumn("_m", X.matches("text", pattern))
    edits = F.transform(X.spans_of("text", F.col("_m"), pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("_").alias("replacement")))
    return df.select("doc_id", X.splice("text", edits).alias("text"))


_NEAR = """regexp_matches(lower(substr(text, greatest("start" - 40, 0) + 1, ("end" + 40 - greatest("start" - 40, 0))::int)), '\\b(?:{})\\b')"""
_CALLED, _IN_CARD, _KEYED = (_NEAR.format("|".join(r.context)) for r in (PHONE, CARD, HEX))


def _kind_sql(pattern: str, kind: str, score: str, valid: str = "true") -> str:
    return f"""select doc_id, k, n0, text, "start", "end", value, '{kind}' t, {score} sc from ({spans_sql(pattern, "b", "doc_id, k, n0, text")}) where {valid}"""


@query(f"""with b as (select doc_id, seg_ord // 2 k, string_agg(text, ' ' order by seg_ord) as text, first(length(text) order by seg_ord) n0 from {_LINES} group by all),
s as (select *, row_number() over (order by doc_id, k, "start", "end", sc desc, t) id from (
  {_kind_sql(SQL_EMAIL, "EMAIL_ADDRESS", "0.9")} union all {_kind_sql(SQL_IPV4, "IP_ADDRESS", "0.6", IPV4_OK)} union all {_kind_sql(SQL_PHONE, "PHONE_NUMBER", f"if({_CALLED}, 0.85, 0.5)")}
  union all {_kind_sql(SQL_CARD, "CREDIT_CARD", f"if({_IN_CARD}, 1.0, 0.7)", LUHN_OK)} union all {_kind_sql(SQL_HEX, "ID_NUMBER", f"if({_KEYED}, 0.85, 0.5)")}))
select doc_id, (2 * k)::int block_ord, "start", "end", t entity_type, value as original, (("start" < n0)::int + ("end" > n0 + 1)::int)::int pieces from s
where not exists (select 1 from s o where o.doc_id = s.doc_id and o.k = s.k and o."start" <= s."start" and s."end" <= o."end" and (o."end" - o."start" > s."end" - s."start" or o.id < s.id))
  and "start" < "end" and ("start" < n0 or "end" > n0 + 1)""")
def detect_pattern_blocks(spark, sf_dir):
    """Findings of five recognizers in joined lines, the longer of nested ones, on their lines."""
    found = B.detect_blocks(_segments(spark, sf_dir), [EMAIL, IPV4, PHONE, CARD, HEX])
    return found.select("doc_id", "block_ord", "start", "end", "entity_type", "original", F.size("pieces").alias("pieces"))


@query(None)
def detect_document_blocks(spark, sf_dir):
    """Findings of all documents with roles and propagation across blocks, on their lines."""
    found = B.detect_blocks(_segments(spark, sf_dir))
    return found.select("doc_id", "block_ord", "start", "end", "entity_type", "original", F.size("pieces").alias("pieces"))


# Roles and propagation ------------------------------------------------------------------------


def _term_sql(value: str) -> str:
    """A term as its role is looked up, in SQL."""
    out = f"trim(regexp_replace(lower(trim(regexp_replace({value}, '^[\"''.,;:()“”‘’]+|[\"''.,;:()“”‘’]+$', '', 'g'))), '\\s+', ' ', 'g'))"
    for part in (ROLES.POSSESSIVE, ROLES.DETERMINER, ROLES.ORDINAL, ROLES.UNIT):
        out = "regexp_replace(" + out + ", '" + part.replace("'", "''") + "', '')"
    return out


_LISTED = "[" + ", ".join(f"'{t}'" for t in ROLES.TERMS) + "]"
_LATIN = "regexp_extract_all(text, '[A-Za-z]+')"


@query(f"""with d as (select doc_id, w from (select doc_id, {_LATIN} w from documents) where len(w) >= 6),
t as (select doc_id, unnest([w[1] || ' ' || w[2], w[3], w[4] || ' ' || w[5], w[6]]) raw from d)
select distinct doc_id, {_term_sql('raw')} term from t where length(raw) between 2 and 60 and {_term_sql('raw')} <> ''""")
def defined_terms_found(spark, sf_dir):
    """Terms that documents define: words of theirs in each defining phrase, and in quotes that define nothing."""
    w = lambda i: F.get("w", F.lit(i - 1))
    words = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 6)
    phrases = [
        F.concat(F.lit('Acme Ltd (the "'), w(1), F.lit(" "), w(2), F.lit('") and Bolt ("Undefined one").')), F.concat(F.lit('"'), w(3), F.lit('" shall mean all data.')),
        F.concat(F.lit("(each a “"), w(4), F.lit(" "), w(5), F.lit("”)")), F.concat(F.lit('(hereinafter referred to as "the '), w(6), F.lit('")')),
    ]
    blocks = words.select("doc_id", F.explode(F.array(*phrases)).alias("text"))
    return defined_terms(blocks).select("doc_id", F.explode("defined").alias("term"))


_ROLE_VALUES = f"(select distinct unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) \"value\" from (select {_LATIN} w from documents))"


@query(f"""with v as (select "value", {_term_sql('"value"')} t from {_ROLE_VALUES}),
r as (select "value", t <> '' and (list_contains([{", ".join(f"'{x}'" for x in ROLES.PRONOUNS)}], t) or length(t) = 1 or regexp_matches(t, '{ROLES.PERIOD.replace("'", "''")}') or list_contains({_LISTED}, t)
  or (t like '%s' and list_contains({_LISTED}, t[:-2]))) role from v)
select entity_type, "value", role and entity_type <> 'LOCATION' role from r, (select unnest(['PERSON', 'ORGANIZATION', 'LOCATION']) entity_type)""")
def role_terms(spark, sf_dir):
    """Every word and pair of words of the documents: is it a role rather than a name?"""
    words = _docs(spark, sf_dir).select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b")), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    values = words.select(F.explode(F.concat("w", F.filter(pairs, lambda x: x.isNotNull()))).alias("value")).distinct()
    each = values.select(F.explode(F.array(*[F.lit(t) for t in ("PERSON", "ORGANIZATION", "LOCATION")])).alias("entity_type"), "value")
    return each.withColumn("role", is_role_term(F.col("entity_type"), F.col("value")))


_PERSON_LIKE, _FIRM_LIKE = "[A-Z][a-z]+ [a-z]+", "[a-z]+ [A-Z][a-z]+"
_STOPS, _GENERIC = (", ".join(f"'{t}'" for t in x if t.isascii()) for x in (STOP_TOKENS, GENERIC_TOKENS))


@query(f"""with f as (select doc_id, 'PERSON' t, "start" s, 0 o, 0.5 + length("value") % 4 / 10.0 sc, "value" v from ({spans_sql(_PERSON_LIKE)})
  union all select doc_id, 'ORGANIZATION', "start", 1, 0.5 + length("value") % 5 / 10.0, "value" from ({spans_sql(_FIRM_LIKE)})),
c as (select doc_id, t, s, o, sc, unnest(case when t = 'PERSON' then [v] || list_filter(string_split(v, ' '), lambda x: length(x) >= 3 and lower(x) not in ({_STOPS}))
    else [v] || case when length(string_split(v, ' ')[1]) >= 4 and lower(string_split(v, ' ')[1]) not in ({_GENERIC}) then [string_split(v, ' ')[1]] else [] end end) form from f),
r as (select *, row_number() over (partition by doc_id, lower(form) order by sc desc, s, o) n from c)
select doc_id, lower(form) as key, max(t) filter (n = 1) entity_type, max(sc)::double score, string_agg(distinct form, '|' order by form) forms from r group by doc_id, lower(form)""")
def seeds_of_findings(spark, sf_dir):
    """Seeds of name-like word pairs of all documents."""
    docs = _docs(spark, sf_dir)

    def like(pattern: str, kind: str, rank: int, steps: int):
        found = X.spans_of("text", X.matches("text", pattern), pattern)
        return F.transform(found, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("entity_type"), s["text"].alias("text_span"), (0.5 + F.length(s["text"]) % steps / 10.0).alias("score")))

    spans = F.array_sort(F.concat(like(_PERSON_LIKE, "PERSON", 0, 4), like(_FIRM_LIKE, "ORGANIZATION", 1, 5)))
    offered = docs.select("doc_id", candidates(spans).alias("c"))
    found = offered.select("doc_id", F.explode(seeds_from(F.col("c"))).alias("s"))
    return found.select("doc_id", "s.key", "s.entity_type", "s.score", F.array_join(F.array_sort("s.forms"), "|").alias("forms"))


_LETTERS = "translate(doc_id::varchar, '0123456789', 'abcdefghij')"


@query(f"""with n as (select doc_id, 'Ad' || {_LETTERS} a, 'Be' || {_LETTERS} b from documents)
select doc_id, 0 block_ord, 8::int "start", (9 + length(a) + length(b))::int "end", 'PERSON' entity_type, a || ' ' || b original, 1::int pieces from n
union all select doc_id, 1, 4, (4 + length(b))::int, 'PERSON', b, 2 from n
union all select doc_id, 3, 0, length(a)::int, 'PERSON', a, 1 from n
union all select doc_id, 3, (6 + length(a))::int, (7 + 2 * length(a) + length(b))::int, 'PERSON', lower(a) || ' ' || upper(b), 1 from n""")
def propagated_names(spark, sf_dir):
    """A titled name in the first block of each document, found again in other blocks and across segments; roles are not."""
    letters = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    a, b = F.concat(F.lit("Ad"), letters), F.concat(F.lit("Be"), letters)
    seg = lambda i, text, block=None: F.struct(F.lit(i).alias("seg_ord"), F.lit(f"s{i}").alias("segment_id"), text.alias("text"), F.lit(block).cast("string").alias("block"), F.lit("").alias("join_before"))
    rows = F.array(
        seg(0, F.concat(F.lit("Dear Mr "), a, F.lit(" "), b, F.lit(' (the "Supplier"),'))), seg(1, F.lit("may B"), "p"), seg(2, F.concat(F.substring(b, 2, 99), F.lit(" and the Supplier")), "p"),
        seg(3, F.concat(a, F.lit(" with "), F.lower(a), F.lit(" "), F.upper(b), F.lit(", Supplier"))),
    )
    segments = _docs(spark, sf_dir).select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")
    found = B.detect_blocks(segments, P.NAME_RULES)
    return found.select("doc_id", "block_ord", "start", "end", "entity_type", "original", F.size("pieces").alias("pieces"))


# Leak check -----------------------------------------------------------------------------------


@query(f"select doc_id, value as original, count(*) as occurrences from ({spans_sql(SQL_EMAIL)}) group by all")
def leak_counts(spark, sf_dir):
    """How often each e-mail address of a document stands in it, by the leak check's rules."""
    docs = _docs(spark, sf_dir)
    originals = _spans(docs, EMAIL, "doc_id").select("doc_id", F.col("value").alias("original"))
    return L.surviving_rows(docs, originals).select("doc_id", "original", F.col("occurrences").cast("long").alias("occurrences"))


@query(f"""select doc_id, count(*)::int occurrences from ({spans_sql(SQL_EMAIL)}) group by doc_id""")
def alternation_counts(spark, sf_dir):
    """How often any of a document's e-mail addresses stands in it, by one pattern for all of them."""
    docs = _docs(spark, sf_dir)
    originals = _spans(docs, EMAIL, "doc_id").groupBy("doc_id").agg(F.collect_list("value").alias("_o"))
    return docs.join(originals, "doc_id").select("doc_id", F.regexp_count(X.normalize_ws("text"), L.alternation(F.col("_o"))).alias("occurrences"))


@query(f"""select doc_id, count(*) leaked_values, sum(n)::bigint leaked_occurrences from (select doc_id, value, count(*) n from ({spans_sql(SQL_EMAIL)}) group by all) group by doc_id""")
def leak_quarantine(spark, sf_dir):
    """Documents kept back because an address that was to go is still there; counts, no values."""
    docs = _docs(spark, sf_dir)
    originals = _spans(docs, EMAIL, "doc_id").select("doc_id", F.col("value").alias("original"))
    held = L.verify(docs, originals)[1]
    return held.select("doc_id", F.col("leaked_values").cast("long").alias("leaked_values"), F.col("leaked_occurrences").cast("long").alias("leaked_occurrences"))


# Review ---------------------------------------------------------------------------------------


def _proposals(spark, sf_dir) -> DataFrame:
    found = raw_spans(_docs(spark, sf_dir), recognizers=[EMAIL, IPV4])
    rows = detections(found, "doc_id", "text").withColumn("text_span", F.expr("substring(text, start + 1, end - start)"))
    order = W.partitionBy("doc_id").orderBy("start", "end")
    made = R.propose_spans(rows.select(F.col("doc_id").cast("string").alias("session_id"), (F.row_number().over(order) - 1).alias("ord"), F.lit("t").alias("segment_id"), "start", "end", "entity_type", "score", "text_span"))
    return written(made, "proposals")  # read by several branches, detected once


_PROPOSALS = f"""(select doc_id::varchar session_id, "start", "end", value, entity_type, (row_number() over (partition by doc_id order by "start", "end") - 1)::int ord,
  substr(sha1(entity_type || chr(0) || value || chr(0) || 't:' || "start"), 1, 12) detection_id
  from {ALL_SPANS} where entity_type in ('EMAIL_ADDRESS', 'IP_ADDRESS'))"""


@query(f'select session_id, ord, detection_id, entity_type, value as original, "start", "end" from {_PROPOSALS}')
def detection_ids(spark, sf_dir):
    return _proposals(spark, sf_dir).select("session_id", "ord", "detection_id", "entity_type", "original", "start", "end")


def _decisions(proposals: DataFrame) -> DataFrame:
    """Every proposal is rejected first; those at even places are accepted afterwards."""
    rows = proposals.select("session_id", "ord", "detection_id", F.explode(F.when(F.col("ord") % 2 == 0, F.array(F.lit("reject"), F.lit("accept"))).otherwise(F.array(F.lit("reject")))).alias("status"))
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        "session_id", (F.col("ord") * 2 + (F.col("status") == "accept").cast("int")).alias("ord"), F.lit("proposal").alias("kind"), F.col("detection_id").alias("proposal_id"), "status", null("string").alias("id"), null("string").alias("segment_anchor"),
        null("string").alias("entity_type"), null("string").alias("original"), null("int").alias("start"), null("int").alias("end"), null("string").alias("operator"), null("map<string,string>").alias("operator_params"), null("string").alias("custom_replacement"),
    )


def _sessions(spark, sf_dir) -> DataFrame:
    created = F.timestamp_seconds(F.col("doc_id") + 1_700_000_000)
    return _docs(spark, sf_dir, "doc_id").select(F.col("doc_id").cast("string").alias("session_id"), F.lit("open").alias("status"), F.lit("replace").alias("default_operator"), F.lit(None).cast("map<string,string>").alias("default_operator_params"), created.alias("created_at"), F.lit(None).cast("timestamp").alias("committed_at"), F.lit("s").alias("salt"))


@query(f"select session_id, detection_id as proposal_id, case when ord % 2 = 0 then 'accept' else 'reject' end as status from {_PROPOSALS}")
def decisions_latest(spark, sf_dir):
    proposals = _proposals(spark, sf_dir)
    return R.effective_decisions(_decisions(proposals), proposals).select("session_id", "proposal_id", "status")


@query(f"""select session_id, detection_id, "start", "end" from {_PROPOSALS} where not ("start" < 900 and "end" > 300)""")
def overlap_purge(spark, sf_dir):
    """A reviewer marks characters 300 to 900 of every document: what overlaps goes."""
    proposals = _proposals(spark, sf_dir)
    marks = proposals.select("session_id").distinct().select("session_id", F.lit("t").alias("segment_anchor"), F.lit(300).alias("start"), F.lit(900).alias("end"))
    return R.purge_overlaps(proposals, marks)[0].select("session_id", "detection_id", "start", "end")


@query(f"""select d.doc_id::varchar session_id, coalesce(count_if(ord % 2 = 0), 0)::bigint accepted, coalesce(count_if(ord % 2 = 1), 0)::bigint rejected, 0::bigint pending from documents d left join {_PROPOSALS} p on p.session_id = d.doc_id::varchar group by 1""")
def session_index(spark, sf_dir):
    proposals = _proposals(spark, sf_dir)
    out = R.session_index(_sessions(spark, sf_dir), proposals, _decisions(proposals))
    return out.select("session_id", *[F.col(c).cast("long").alias(c) for c in ("accepted", "rejected", "pending")])


@query(f"""with a as (select *, lag("end", 1, 0) over (partition by session_id order by ord) prev from {_PROPOSALS} where ord % 2 = 0),
t as (select d.doc_id::varchar session_id, text, string_agg(substr(text, prev + 1, a."start" - prev) || '<' || entity_type || '>', '' order by ord) head, max("end") last from documents d left join a on a.session_id = d.doc_id::varchar group by all)
select session_id, sha256(coalesce(coalesce(head, '') || substr(text, coalesce(last, 0) + 1), '')) as text_sha from t""")
def review_commit(spark, sf_dir):
    """Accepted proposals replaced in their documents, the rest as it was."""
    proposals, docs = _proposals(spark, sf_dir), _docs(spark, sf_dir)
    segments = docs.select(F.col("doc_id").cast("string").alias("session_id"), F.lit("t").alias("segment_id"), "text")
    edits = R.plan_edits(segments, proposals, _decisions(proposals), _sessions(spark, sf_dir))
    return R.apply_edits(segments, edits).select("session_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"))


_BLOCK_PIECES = f"""(with b as (select doc_id, seg_ord // 2 k, string_agg(text, ' ' order by seg_ord) as text, first(length(text) order by seg_ord) n0, count(*) segs from {_LINES} group by all),
s as ({spans_sql("[a-z]+ [A-Z][a-z]+", "b", "doc_id, k, n0")})
select doc_id, k, "start", value, 0 g, 'line' || (2 * k) seg, "start" p0, least("end", n0) p1, substr(value, 1, (least("end", n0) - "start")::int) piece, "start" < n0 and "end" > n0 + 1 several from s where "start" < n0
union all select doc_id, k, "start", value, if("start" < n0, 1, 0), 'line' || (2 * k + 1), greatest("start" - n0 - 1, 0), "end" - n0 - 1, substr(value, greatest(n0 + 2 - "start", 1)::int), "start" < n0 and "end" > n0 + 1 from s where "end" > n0 + 1)"""
_GROUP_ID = """substr(sha1('NAME' || chr(0) || value || chr(0) || 'group:line' || (2 * k) || ':' || "start"), 1, 12)"""


@query(f"""with p as (select *, if(several, {_GROUP_ID}, null) gid from {_BLOCK_PIECES})
select doc_id::varchar session_id, (row_number() over (partition by doc_id order by k, "start", g) - 1)::int ord, substr(sha1('NAME' || chr(0) || piece || chr(0) || seg || ':' || p0 || coalesce(':' || gid, '')), 1, 12) detection_id,
  piece original, seg segment_anchor, p0::int "start", p1::int "end", gid group_id, g::int group_index, if(several, value, null) group_original from p""")
def grouped_proposals(spark, sf_dir):
    """Proposals from findings in joined lines: those over two lines are groups of pieces."""
    return R.propose_findings(_block_findings(spark, sf_dir)).select("session_id", "ord", "detection_id", "original", "segment_anchor", "start", "end", "group_id", "group_index", "group_original")


def _block_findings(spark, sf_dir) -> DataFrame:
    pattern = "[a-z]+ [A-Z][a-z]+"
    found = B.join_blocks(_segments(spark, sf_dir)).withColumn("_m", X.matches("text", pattern)).where(F.size("_m") > 0).select("doc_id", "block_ord", "segs", F.explode(X.spans_of("text", F.col("_m"), pattern)).alias("s"))
    return found.select(
        F.col("doc_id").cast("string").alias("session_id"), "block_ord", F.col("s.start").alias("start"), F.lit("NAME").alias("entity_type"), F.lit(0.5).alias("score"), F.col("s.text").alias("original"),
        B.pieces_of(F.col("segs"), F.col("s.start"), F.col("s.end")).alias("pieces"),
    ).where(F.size("pieces") > 0)


_WORDS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"


@query(f"""select doc_id, coalesce((select string_agg(x, ' ' order by i) from (select x, min(i) i from (select unnest(p) x, generate_subscripts(p, 1) i) where length(x) >= 3 and list_contains(o, x) group by x)), '') as words
from (select doc_id, regexp_extract_all(substr(text, 11, 60), '{_WORDS}') p, regexp_extract_all(substr(text, 1, 90), '{_WORDS}') o from documents where length(text) > 10)""")
def fragment_words_of_pieces(spark, sf_dir):
    """What each document's characters 10 to 70 share, as whole words, with its first 90."""
    docs = _docs(spark, sf_dir).where(F.length("text") > 10)
    return docs.select("doc_id", F.array_join(B.fragment_words(F.substring("text", 11, 60), F.substring("text", 1, 90)), " ").alias("words"))


@query(f"select session_id, string_agg(distinct value, '|' order by value) avoid from {_PROPOSALS} group by session_id")
def avoided_originals(spark, sf_dir):
    """What surrogates of a session must not contain: every proposal's original, decided or not."""
    proposals = _proposals(spark, sf_dir)
    return R.replacement_context(proposals, _decisions(proposals).where("kind = 'user_added'")).select("session_id", F.array_join("avoid", "|").alias("avoid"))


@query("select doc_id::varchar session_id, if(doc_id in (1, 3, 5), 'committed', 'open') status, doc_id in (1, 3, 5) closed, if(doc_id = 2, 'mask', 'replace') default_operator from documents")
def session_states(spark, sf_dir):
    """All sessions after three of them were committed and one got another default operator."""
    sessions = R.set_default_operator(R.transition(_sessions(spark, sf_dir), ["1", "3", "5"], "committed"), "2", "mask")
    return sessions.select("session_id", "status", F.col("committed_at").isNotNull().alias("closed"), "default_operator")


@query(f"""with p as {_PROPOSALS} select distinct session_id, value as original from p a where ord % 2 = 0 and not exists (select 1 from p r where r.session_id = a.session_id and r.ord % 2 = 1 and r.value = a.value)""")
def verified_originals(spark, sf_dir):
    """What must not survive a commit: accepted values that nobody rejected elsewhere in the document."""
    proposals = _proposals(spark, sf_dir)
    segments = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("session_id"), F.lit("t").alias("segment_id"), "text")
    decisions = _decisions(proposals)
    return R.originals_to_verify(R.plan_edits(segments, proposals, decisions, _sessions(spark, sf_dir)), proposals, decisions)


@query("""select doc_id::varchar session_id, case when doc_id % 4 = 1 then 'unknown segment' when text is null then 'unknown segment' when doc_id % 4 = 2 or length(text) < 5 then 'offsets outside the segment'
  when doc_id % 4 = 3 and substr(text, 1, 5) <> 'wrong' then 'text differs' end reject_reason from documents""")
def checked_marks(spark, sf_dir):
    """A reviewer's mark on the first five characters of every document: right, on no segment, out of bounds or misquoted."""
    docs = _docs(spark, sf_dir)
    kind = F.col("doc_id") % 4
    marks = docs.select(
        F.col("doc_id").cast("string").alias("session_id"), F.when(kind == 1, "elsewhere").otherwise("t").alias("segment_anchor"), F.lit(0).alias("start"),
        F.when(kind == 2, F.length("text") + 1).otherwise(F.lit(5)).alias("end"), F.when(kind == 3, F.lit("wrong")).otherwise(F.substring("text", 1, 5)).alias("original"),
    )
    segments = docs.select(F.col("doc_id").cast("string").alias("session_id"), F.lit("t").alias("segment_id"), "text")
    return R.validate_user_added(marks, segments).select("session_id", "reject_reason")


@query(f"""select session_id, detection_id, case when ord % 3 = 0 then 'accept' when ord % 3 = 1 then 'reject' else 'pending' end status, case when ord % 3 = 1 then value else '<' || entity_type || '>' end preview from {_PROPOSALS}""")
def review_previews(spark, sf_dir):
    """What a reviewer sees: accepted and undecided proposals by the default operator, rejected ones as they are."""
    proposals = _proposals(spark, sf_dir)
    decisions = _decisions(proposals).join(proposals.select("session_id", F.col("detection_id").alias("proposal_id"), F.col("ord").alias("_o")), ["session_id", "proposal_id"]).where("_o % 3 < 2")
    decisions = decisions.withColumn("status", F.when(F.col("_o") % 3 == 0, "accept").otherwise("reject")).drop("_o")
    return R.previews(proposals, decisions, _sessions(spark, sf_dir))


# Evaluation -----------------------------------------------------------------------------------


def _truth_and_predictions(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    numbers = P.Recognizer("n", "NUM", r"\b[0-9]{2,}\b", 0.5)
    longer = P.Recognizer("n", "NUM", r"\b[0-9]{3,}\b|\b[0-9]\b", 0.5)
    rows = lambda r: _spans(docs, r, "doc_id").select("doc_id", F.when(F.length("value") % 2 == 0, "EVEN").otherwise("ODD").alias("entity_type"), "start", "end", F.lit(0.5).alias("score"))
    return rows(numbers), rows(longer)


_NUMBERS = r"""(select doc_id, "start", "end", case when length(value) % 2 = 0 then 'EVEN' else 'ODD' end entity_type from ({}))"""


@query(f"""with t as (select * from {_NUMBERS.format(spans_sql(r"\b[0-9]{2,}\b"))}), p as (select * from {_NUMBERS.format(spans_sql(r"\b[0-9]{3,}\b|\b[0-9]\b"))}),
c as (select coalesce(t.entity_type, p.entity_type) entity_type, count_if(t.doc_id is not null and p.doc_id is not null)::bigint tp, count_if(t.doc_id is null)::bigint fp, count_if(p.doc_id is null)::bigint fn
  from t full join p on t.doc_id = p.doc_id and t."start" = p."start" and t."end" = p."end" and t.entity_type = p.entity_type group by 1),
r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end as "precision", case when tp + fn = 0 then 0.0 else tp / (tp + fn)::double end recall from c)
select *, case when "precision" + recall = 0 then 0.0 else 2 * "precision" * recall / ("precision" + recall) end f1 from r""")
def scorer_exact(spark, sf_dir):
    return E.metrics(E.counts(*_truth_and_predictions(spark, sf_dir)), "entity_type")


_RATIOS = """r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end as "precision", case when tp + fn = 0 then 0.0 else tp / (tp + fn)::double end recall from c),
  m as (select *, case when "precision" + recall = 0 then 0.0 else 2 * "precision" * recall / ("precision" + recall) end f1 from r)"""


@query(f"""with n as (select doc_id, "start", "end", case when length(value) % 2 = 0 then 'EVEN' else 'ODD' end entity_type, length(value) k from ({spans_sql(r"[0-9]+")})),
c as (select entity_type, count_if(k >= 3)::bigint tp, count_if(k = 1)::bigint fp, count_if(k = 2)::bigint fn from n group by 1), {_RATIOS}
select * from m""")
def scorer_overlap(spark, sf_dir):
    """Numbers of two digits or more are true; found are those of one digit, and those of three or more less their first."""
    docs = _docs(spark, sf_dir)
    numbers = _spans(docs, P.Recognizer("n", "NUM", "[0-9]+", 0.5), "doc_id")
    kind = F.when(F.length("value") % 2 == 0, "EVEN").otherwise("ODD").alias("entity_type")
    truth = numbers.where(F.length("value") >= 2).select("doc_id", kind, "start", "end")
    less = F.when(F.length("value") == 1, F.col("start")).otherwise(F.col("start") + 1)
    found = numbers.where(F.length("value") != 2).select("doc_id", kind, less.alias("start"), "end", (F.length("value") % 7 / 10.0).alias("score"))
    return E.metrics(E.counts(truth, found, mode="overlap"), "entity_type")


@query(f"""with t as (select * from {_NUMBERS.format(spans_sql(r"\b[0-9]{2,}\b"))}), p as (select * from {_NUMBERS.format(spans_sql(r"\b[0-9]{3,}\b|\b[0-9]\b"))}),
c as (select coalesce(t.entity_type, p.entity_type) entity_type, count_if(t.doc_id is not null and p.doc_id is not null)::bigint tp, count_if(t.doc_id is null)::bigint fp, count_if(p.doc_id is null)::bigint fn
  from t full join p on t.doc_id = p.doc_id and t."start" = p."start" and t."end" = p."end" and t.entity_type = p.entity_type group by 1), {_RATIOS}
select avg("precision") "precision", avg(recall) recall, avg(f1) f1, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from m""")
def scorer_macro(spark, sf_dir):
    """The unweighted means over the types."""
    return E.macro(E.metrics(E.counts(*_truth_and_predictions(spark, sf_dir)), "entity_type"))


@query("""select conv_id as doc_id, (e - length(text))::int "start", e::int "end", 'USER' entity_type, sha256(text) as text_sha from (
  select conv_id, role, coalesce(text, '') as text, sum(length(coalesce(text, ''))) over (partition by conv_id order by turn) e from conversations) where role = 'user'""")
def annotated_turns(spark, sf_dir):
    """Conversations as one text each, the users' turns annotated."""
    turns = read_table(spark, sf_dir, "conversations")
    parts = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text", F.when(F.col("role") == "user", "USER").alias("entity_type"))
    found = E.annotated_texts(parts).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", "e.start", "e.end", "e.entity_type", F.sha2("e.text", 256).alias("text_sha"))
