"""Logs, stores and artifacts on small folders; distributions against known values."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import distributions, media, scalar, texts
from spanloom.operators import serving
from spanloom.sources import logs, sinks


def test_log_replay_and_checkpoint(spark, tmp_path):
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, v string, operation string")
    assert logs.replay(spark, log) is None and logs.checkpoint(spark, log, snap, "id") is None
    logs.append(rows((1, "a", "put"), (2, "b", "put")), log)
    logs.append(rows((1, "c", "put"), (3, "d", "put")), log)
    held = lambda: {r.id: r.v for r in logs.state(spark, log, snap, "id").collect()}
    assert held() == {1: "c", 2: "b", 3: "d"}
    assert logs.checkpoint(spark, log, snap, "id", every=100) is None
    assert logs.checkpoint(spark, log, snap, "id", every=4) == 1 and logs.replay(spark, log) is None
    logs.append(rows((2, None, "delete"), (4, "e", "put")), log)
    assert held() == {1: "c", 3: "d", 4: "e"}
    assert {r.id: r.v for r in logs.applied(logs.replay(spark, log), "id", first=True).collect()} == {4: "e"}


def test_store(spark, tmp_path):
    store = logs.Store(spark, str(tmp_path / "s"), "id")
    store.put(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    store.put(spark.createDataFrame([(1, "z")], "id int, v string"))
    store.delete(spark.createDataFrame([(2,)], "id int"))
    assert [tuple(r) for r in store.rows().collect()] == [(1, "z")] and store.get(1).first().v == "z" and store.get(2).isEmpty()
    with pytest.raises(ValueError):
        logs.Store(spark, "x", "id", "tape")


def test_artifacts_and_datasets(spark, tmp_path):
    path = str(tmp_path / "a")
    for i in range(11):
        added = logs.log_artifacts(spark.createDataFrame([("m", f"x{i}")], "name string, body string"), path, "name", "body").first()
        assert added.number == i + 1
    assert logs.resolve(spark, path, "name", "m").first().number == 11 and logs.resolve(spark, path, "name", "m", "v3").first().size == 2
    logs.dataset(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, kind string"), str(tmp_path / "d"), "kind")
    assert {r.kind: r.n for r in spark.read.json(str(tmp_path / "d" / "stats")).collect()} == {"a": 1, "b": 2}
    assert spark.read.json(str(tmp_path / "d" / "by_category" / "kind=b")).count() == 2
    assert logs.formatted([{"a": 1, "b": 2}]) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert "1 & 2" in logs.formatted([{"a": 1, "b": 2}], "latex") and "<td>2</td>" in logs.formatted([{"a": 1, "b": 2}], "html")
    assert sinks.newest(spark, str(tmp_path / "none")) is None


def test_distributions(spark):
    assert distributions.t_tail(2.228138851986274, 10) == pytest.approx(0.05) and distributions.t_quantile(0.975, 10) == pytest.approx(2.2281388519)
    assert distributions.f_quantile(0.95, 2, 9) == pytest.approx(4.2564947291) and distributions.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    df = spark.createDataFrame([(2.228138851986274, 10), (None, 3), (1.0, 0)], "t double, df int")
    p = [r[0] for r in df.select(distributions.t_p(F.col("t"), F.col("df"))).collect()]
    assert p[0] == pytest.approx(0.05) and p[1:] == [None, None]
    assert spark.range(1).select(distributions.normal_p(F.lit(1.959963984540054))).first()[0] == pytest.approx(0.05)


def test_limiter_against_a_plain_loop(spark):
    rows = [(k, (i * 7919) % 9000, i) for i, k in enumerate([1, 1, 2, 1, 3] * 80)]
    got = sorted(map(tuple, serving.limited(spark.createDataFrame(rows, "k long, s long, e long"), "k", F.col("s"), "e", 3, 20).collect()))
    want = []
    for key in (1, 2, 3):
        past = []
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if sum(s - t < 3600 for t in past) < 20 and sum(s - t < 60 for t in past) < 3:
                past.append(s)
                want.append((key, e))
    assert got == sorted(want)


def test_texts_and_masks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(texts.word_error(F.lit("a b c"), F.lit("a x c d"))) == 0.5 and one(texts.word_error(F.lit(""), F.lit(""))) == 0.0
    assert one(texts.fuzzy_reward(F.lit("Cat"), F.lit("cat"))) == 0.5 and one(texts.fuzzy_reward(F.lit("x"), F.lit("x"))) == 1.0
    assert one(texts.answer(F.lit("a <answer> 7 </answer> b"))) == "7" and one(texts.answer(F.lit("a\nlast"))) == "last"
    assert [s.operation for s in one(texts.steps(F.lit("THINK first\nnothing\nZOOM_IN(3)")))] == ["THINK", "ZOOM_IN"]
    assert one(scalar.parse_time(F.lit("1:02:03"))) == 3723.0 and one(scalar.parse_time(F.lit("x"))) is None
    assert one(scalar.effect_label(F.lit(-0.6))) == "medium"
    array = lambda *v: F.array(*map(F.lit, v))
    full, none = array(1, 1, 1, 1), array(0, 0, 0, 0)
    assert one(media.mask_iou(media.mask_counts(none, none))) == 1.0 and one(media.dice(media.mask_counts(none, none))) is None
    assert one(media.mask_box(array(0, 1, 0, 0), F.lit(2))) == [1, 0, 1, 0] and one(media.mask_box(none, F.lit(2))) is None
    assert one(media.boundary_f1(full, full, F.lit(2))) == 1.0 and one(media.boundary_f1(full, none, F.lit(2))) == 0.0
