"""Operators, policies, surrogates, leak check and mapping store."""

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import anonymize as A
from cloakframe.functions import surrogates as S
from cloakframe.functions.patterns import EMAIL
from cloakframe.operators import leak, mapping
from cloakframe.operators.engine import process_text


def _one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(expr).first()[0]


def test_operators(spark):
    t, v = F.col("t"), F.col("v")
    run = lambda p: _one(spark, A.apply(p, t, v, F.lit("s")), t="PERSON", v="Jane Poe")
    assert run(A.Policy("redact")) == ""
    assert run(A.Policy("replace")) == "<PERSON>"
    assert run(A.Policy("replace", {"new_value": "X"})) == "X"
    assert run(A.Policy("mask", {"chars_to_mask": 3, "from_end": True})) == "Jane ***"
    assert run(A.Policy("mask", {"chars_to_mask": 99, "masking_char": "#"})) == "########"
    assert run(A.Policy("keep")) == "Jane Poe"
    assert run(A.Policy("custom", {"lambda": F.upper})) == "JANE POE"
    assert _one(spark, A.decrypt(A.encrypt(v, "k" * 16), "k" * 16), v="Jane") == "Jane"
    with pytest.raises(A.InvalidOperatorParams):
        A.encrypt(v, "short")
    with pytest.raises(A.InvalidOperatorParams):
        A.Policy("unknown")


def test_policy_precedence(spark):
    df = spark.createDataFrame([("a@b.com",)], "text string")
    out = lambda p: process_text(df, p, recognizers=[EMAIL]).first()
    assert out({"EMAIL_ADDRESS": A.Policy("redact"), "DEFAULT": A.Policy("keep")}).anonymized == ""
    assert out({"PERSON": A.Policy("redact")}).anonymized == "<EMAIL_ADDRESS>"
    assert out(None).operators_applied == {"EMAIL_ADDRESS": "hips"}


@pytest.mark.parametrize(("text", "like"), [("May 3, 2026", r"[A-Z][a-z]+ [1-9][0-9]?, 20\d\d"), ("2/12/2025", r"\d\d/\d\d/20\d\d"), ("2020-01-31", r"\d{4}-\d\d-\d\d"), ("3 March 2021", r"[1-9][0-9]? [A-Z][a-z]+ 20\d\d"), ("March 2021", r"[A-Z][a-z]+ 20\d\d")])
def test_dates_keep_their_layout(spark, text, like):
    import re

    got = _one(spark, S.shift_date(F.col("v"), F.lit("s"), F.lit(0)), v=text)
    assert re.fullmatch(like, got) and got != text


def test_dates_keep_their_distance(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2020-03-01",)], "v string").select(F.to_date(S.shift_date(F.col("v"), F.lit("s"), F.lit(0))).alias("d"))
    a, b = [r.d for r in df.collect()]
    assert (b - a).days == 60


def test_surrogates(spark):
    kind = lambda t, v, salt="s": _one(spark, S.surrogate(F.col("t"), F.col("v"), F.lit(salt)), t=t, v=v)
    assert kind("PERSON", "Jane Poe") == kind("PERSON", "Jane Poe") != kind("PERSON", "Jane Poe", "other")
    shaped = kind("US_SSN", "A1b-22")
    assert shaped[0].isupper() and shaped[1].isdigit() and shaped[2].islower() and shaped[3] == "-" and shaped != "A1b-22"
    names = spark.createDataFrame([("PERSON", f"Zed {n}", n) for n in S.LAST], "t string, v string, n string")
    made = names.select("n", S.surrogate(F.col("t"), F.col("v"), F.lit("s"), A.avoid_pattern(F.array("n"))).alias("made"))
    assert not [r for r in made.collect() if r.n in r.made]  # no surrogate holds the name that it must avoid


def test_leak_rules(spark):
    rows = [("Ann Annual Ann. é Ann_", ["Ann"]), ("a 14 b", ["14", "x"]), ("Jane\n Poe", ["Jane Poe", "Jane  Poe"]), ("C++ (x)", ["C++"]), ("jane", ["Jane"])]
    df = spark.createDataFrame(rows, "t string, o array<string>")
    got = [[(x.original, x.occurrences) for x in r.s] for r in df.select(leak.surviving(F.col("t"), F.col("o")).alias("s")).collect()]
    assert got == [[("Ann", 3)], [], [("Jane Poe", 1)], [("C++", 1)], []]
    outputs = spark.createDataFrame([(1, "Ann is"), (2, "fine")], "doc_id int, text string")
    good, bad = leak.verify(outputs, spark.createDataFrame([(1, "Ann"), (2, "Ann")], "doc_id int, original string"))
    assert [r.doc_id for r in good.collect()] == [2] and [tuple(r) for r in bad.collect()] == [(1, 1, 1)]


_ASK = "entity_type string, original string, ord int"


def test_minting(spark):
    same = lambda t, o, k: F.lit("x")
    ask = spark.createDataFrame([("P", "b", 2), ("P", "a", 1), ("O", "a", 3), ("P", "c", 4), ("P", "a", 9)], _ASK)
    had = spark.createDataFrame([("P", "old", "x-1")], mapping.SCHEMA)
    named, grown = mapping.get_or_create(ask, had, same)
    got = {(r.entity_type, r.original): r.pseudonym for r in grown.collect()}
    assert got == {("P", "old"): "x-1", ("P", "a"): "x", ("P", "b"): "x-2", ("P", "c"): "x-3", ("O", "a"): "x"}
    assert {(r.entity_type, r.original): r.pseudonym for r in mapping.preview(ask, had, same).collect()} == {k: v for k, v in got.items() if k[1] != "old"}
    back = mapping.reverse(spark.createDataFrame([("P", "x-2"), ("P", "none")], "entity_type string, pseudonym string"), grown)
    assert {r.pseudonym: r.original for r in back.collect()} == {"x-2": "b", "none": None}


def _mint_by_hand(ask, had, candidate, attempts=5):
    least = {}
    for t, o, k in ask:
        if (t, o) not in had:
            least[t, o] = min(k, least.get((t, o), k))
    left, out = sorted(least, key=lambda x: (x[0], least[x], x[1])), {}
    taken = {(t, p) for (t, _), p in had.items()}
    for k in range(attempts):
        again = []
        won = set()
        for t, o in left:
            p = candidate(t, o, k)
            if (t, p) in taken or (t, p) in won:
                again.append((t, o))
            else:
                out[t, o] = p
                won.add((t, p))
        taken |= won
        left = again
    for t, o in left:
        base, i = candidate(t, o, 0), 1
        while (t, f"{base}-{i}") in taken:
            i += 1
        taken.add((t, f"{base}-{i}"))
        out[t, o] = f"{base}-{i}"
    return out


def test_minting_of_hot_candidates_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mapping, "_SLOTS", 7)
    ask = [("PQ"[i % 7 == 0], f"n{i * 37 % 400}", i * 13 % 300) for i in range(600)]
    had = {("P", f"old{s}"): f"x-{s}" for s in (1, 2, 5, 30, 31, 9000)} | {("P", "n3"): "y", ("Q", "old"): "x-4"}
    start = lambda o: F.when(F.col("original") < "n2", F.lit("x")).otherwise(F.lit("y"))
    named = lambda t, o, k: F.concat(start(o), F.when(k == 0, "").otherwise(F.concat(F.lit("."), k.cast("string"))))
    by_hand = lambda t, o, k: ("x" if o < "n2" else "y") + (f".{k}" if k else "")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranks must cross range partitions
    try:
        made = mapping.mint(spark.createDataFrame(ask, _ASK), spark.createDataFrame([(*k, v) for k, v in had.items()], mapping.SCHEMA), named)
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r.entity_type, r.original): r.pseudonym for r in got} == _mint_by_hand(ask, had, by_hand)
    assert len(got) == len({(r.entity_type, r.pseudonym) for r in got})


def test_collisions_query_runs_over_all_customers(spark):
    from cloakframe.plans.catalog import pseudonym_collisions

    path = "/root/testdata/sf0.01"
    people = spark.read.parquet(f"{path}/customer.parquet").select("c_custkey", "c_name").collect()
    want = {o: p for (_, o), p in _mint_by_hand([("P", r.c_name, r.c_custkey) for r in people], {}, lambda t, o, k: "shared").items()}
    got = pseudonym_collisions(spark, path).collect()
    assert len(got) == len(people) > 51 and {r.original: r.pseudonym for r in got} == want


def test_encrypted_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store = mapping.EncryptedStore(spark, path)
    with pytest.raises(mapping.MappingLocked):
        store.save(mapping.empty(spark))
    store.unlock("one")
    store.save(spark.createDataFrame([("P", "Jane", "Ada")], mapping.SCHEMA))
    with pytest.raises(mapping.WrongPassphrase):
        mapping.EncryptedStore(spark, path).unlock("bad")
    store.rotate("one", "two")
    again = mapping.EncryptedStore(spark, path)
    again.unlock("two")
    assert [tuple(r) for r in again.load().collect()] == [("P", "Jane", "Ada")]
    with pytest.raises(mapping.WrongPassphrase):
        mapping.EncryptedStore(spark, path).unlock("one")
