import os
import time

from cloakframe.sources import scratch


def test_written_tables_are_read_again_and_cleared(spark):
    df = scratch.written(spark.range(5).toDF("n"), "numbers")
    assert sorted(r.n for r in df.collect()) == list(range(5))
    assert scratch.clear(spark) >= 1 and scratch.clear(spark) == 0


def test_scopes_and_old_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    outer = scratch.written(spark.range(3), "outer")
    with scratch.scope() as made:
        scratch.written(spark.range(4), "inner")
        kept = scratch.written(spark.range(5), "kept")
    assert len(made) == 2 and scratch.drop(spark, made[:-1]) == 1
    assert (outer.count(), kept.count()) == (3, 5) and not os.path.exists(made[0])
    (tmp_path / "mine").mkdir()
    for path in (made[1], tmp_path / "mine"):
        os.utime(path, (time.time() - 7200,) * 2)
    assert scratch.clear_old(spark, 1) == 1
    assert not os.path.exists(made[1]) and outer.count() == 3 and (tmp_path / "mine").exists()
    scratch.clear(spark)
