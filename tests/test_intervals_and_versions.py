"""Interval joins against all pairs; versioned tables: plans, crashes, two writers."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from recordspine.operators import intervals
from recordspine.sources import versioned

DAY = date(2000, 1, 1)


def spans(rnd, n, start):
    out = []
    for i in range(n):
        s = rnd.randrange(-400, 4000)
        e = s + rnd.choice([0, 1, 2, 5, 40, 900, 20_000, -3])
        out.append((start + i, rnd.randrange(3), None if rnd.random() < 0.1 else DAY + timedelta(s), None if rnd.random() < 0.15 else DAY + timedelta(e)))
    return out


def bounds(s, e):
    return s or date.min, e or date.max


def test_interval_joins_against_all_pairs(spark):
    rnd = random.Random(11)
    a, b = spans(rnd, 150, 0), spans(rnd, 150, 1000)
    left = spark.createDataFrame(a, "l int, k int, s date, e date")
    right = spark.createDataFrame(b, "r int, k int, s2 date, e2 date")
    got = sorted((x.l, x.r) for x in intervals.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2")).collect())
    want = []
    for l, k, s, e in a:
        for r, k2, s2, e2 in b:
            (s1, e1), (s3, e3) = bounds(s, e), bounds(s2, e2)
            if k == k2 and s1 < e1 and s3 < e3 and s1 < e3 and s3 < e1:
                want.append((l, r))
    assert got == sorted(want) and len(want) > 1000
    got = sorted((x.l, x.r) for x in intervals.stab_join(left, right, ["k"], "s", ("s2", "e2")).collect())
    assert got == sorted((l, r) for l, k, s, _ in a for r, k2, s2, e2 in b if s and k == k2 and bounds(s2, e2)[0] <= s < bounds(s2, e2)[1])
    assert intervals.overlap_join(left.limit(0), right, ["k"], ("s", "e"), ("s2", "e2")).count() == 0


def test_keys_of_few_and_many_intervals_are_joined_alike(spark):
    rnd = random.Random(12)
    a, b = spans(rnd, 120, 0), spans(rnd, 120, 1000) + [(5000, 7, None, None), (5001, None, None, None)]
    left = spark.createDataFrame(a + [(6000, 7, DAY, None), (6001, None, DAY, None)], "l int, k int, s date, e date")
    right = spark.createDataFrame(b, "r int, k int, s2 date, e2 date")
    some = sorted(right.groupBy("k").count().toPandas()["count"])[-2]  # one key has more
    for join in (lambda most: intervals.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), most), lambda most: intervals.stab_join(left, right, ["k"], "s", ("s2", "e2"), most)):
        plain, mixed, bins = (join(most) for most in (1000, int(some), 0))
        want = sorted(map(str, plain.collect()))
        assert want == sorted(map(str, mixed.collect())) == sorted(map(str, bins.collect())) and len(want) > 500
        plan = plain._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Broadcast" not in plan  # each row shuffled once
        assert "Broadcast" not in bins._jdf.queryExecution().optimizedPlan().toString() and "strategy=merge" in bins._jdf.queryExecution().optimizedPlan().toString()


def test_cover_is_short_and_exact(spark):
    rows = spark.createDataFrame([(s, e) for s in range(0, 40) for e in range(s + 1, 41)] + [(1, 65_535)], "s long, e long").select("s", "e", intervals.cover(F.col("s"), F.col("e"), 16).alias("c")).collect()
    for r in rows:
        days = sorted(d for x in r.c for d in range(x.bin << x.level, (x.bin + 1) << x.level))
        assert days == list(range(r.s, r.e)) and len(r.c) <= 32


def test_upsert_of_versions(spark, tmp_path):
    path = f"file://{tmp_path}/people"
    base = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(1000)], "id long, name string, state int")
    versioned.create(base, path, ["id"], 8)
    delta = spark.createDataFrame([(5, "new", None), (5, "newer", 9), (2000, "x", 1)], "id long, name string, state int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = versioned.merged(versioned.read(spark, path), delta, ["id"], 8)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    base_side = plan[plan.index("FileScan") - 400 :].split("FileScan")[0]
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and "Exchange" not in base_side and "Bucketed: true" in plan, plan
    assert versioned.upsert(delta, path, keep=["name"]) == 2
    now = {r.id: (r.name, r.state) for r in versioned.read(spark, path).collect()}
    assert len(now) == 1001 and now[5] == ("n5", 9) and now[2000] == ("x", 1) and now[7] == ("n7", 1)
    assert versioned.read(spark, path, 1).count() == 1000


def test_failed_and_second_writers_change_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versioned.create(spark.createDataFrame([(1, "a")], "id long, v string"), path, ["id"], 2)
    row = spark.createDataFrame([(1, "b")], "id long, v string")
    real = versioned.publish
    monkeypatch.setattr(versioned, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        versioned.upsert(row, path)
    monkeypatch.setattr(versioned, "publish", real)
    assert [tuple(r) for r in versioned.read(spark, path).collect()] == [(1, "a")]
    assert versioned.upsert(row, path) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        versioned.publish(spark, path, 2, {})
    with pytest.raises(Exception, match="null key"):
        versioned.upsert(spark.createDataFrame([(None, "c")], "id long, v string"), path)
    assert [tuple(r) for r in versioned.read(spark, path).collect()] == [(1, "b")]
    other = spark.newSession()
    assert [tuple(r) for r in versioned.read(other, path).collect()] == [(1, "b")]
