"""Sums up ragged trees and comparison of versions, against plain Python."""

from __future__ import annotations

import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from recordspine.operators import graph
from recordspine.sources import digests
from recordspine.sources.tables import shared_folder


def sums(parents, own):
    total = dict(own)
    for n, v in own.items():
        up = parents[n]
        while up in parents:
            total[up] += v
            up = parents[up]
    return total


def test_subtrees_of_twelve_levels_chains_and_stars(spark):
    rnd = random.Random(3)
    parents = {0: None}
    for i in range(1, 12):  # a spine with leaves at all depths
        parents[i] = i - 1
    parents |= {100 + i: rnd.randrange(12) for i in range(200)} | {1000 + i: 999 + i if i else None for i in range(70)} | {5000 + i: 1 for i in range(300)} | {9000: 123456}
    own = {n: rnd.randrange(1, 50) for n in parents}
    rows = spark.createDataFrame([(n, p, own[n]) for n, p in parents.items()] + [(None, 1, 5)], "id int, up int, v int")
    got = {r.id: (r.own_v, r.total_v) for r in graph.subtree_sums(rows, "id", "up", ["v"]).collect()}
    want = sums(parents, own)
    assert got == {n: (own[n], want[n]) for n in parents}


def test_facts_of_unknown_places_stay_apart(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, up string")
    facts = spark.createDataFrame([("c", 2), ("c", None), ("a", 1), ("x", 7), (None, 4)], "id string, n int")
    out = graph.rollup_tree(nodes, "id", "up", facts, {"rows": F.count(F.lit(1)), "n": F.sum("n")})
    assert {r.id: (r.own_rows, r.total_rows, r.own_n, r.total_n) for r in out.collect()} == {"a": (1, 3, 1, 3), "b": (0, 2, 0, 2), "c": (2, 2, 2, 2), "d": (0, 0, 0, 0), None: (2, 2, 11, 11)}
    assert graph.rollup_tree(nodes.limit(0), "id", "up", facts.limit(0), {"n": F.sum("n")}).count() == 0


def test_cycles_and_repeated_nodes_raise(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, up int, v int")
    with pytest.raises(ValueError):
        graph.subtree_sums(make([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, None, 1)]), "id", "up", ["v"]).collect()
    with pytest.raises(ValueError):
        graph.subtree_sums(make([(1, 1, 1)]), "id", "up", ["v"]).collect()
    with pytest.raises(Exception, match="repeated node 1"):
        graph.subtree_sums(make([(1, None, 1), (1, None, 1)]), "id", "up", ["v"]).collect()


def stored(spark, rows, schema, digits=2):
    path = shared_folder(spark, "t")
    digests.store(spark.createDataFrame(rows, schema), path, ["k", "s"], digits)
    return path


def test_changes_and_only_their_ranges(spark):
    schema = "k int, s string, v string, d double"
    old = {(i, f"s{i % 7}"): (f"v{i % 5}" if i % 3 else None, i / 3) for i in range(2000)}
    new = dict(old)
    del new[(5, "s5")]
    new[(7, "s0")] = (None, 7 / 3)
    new[(8, "s1")] = (None, None)
    new[(9999, "s")] = ("", 0.0)
    flat = lambda d: [(*k, *v) for k, v in d.items()]
    a, b, c = (stored(spark, flat(d), schema) for d in (old, new, dict(reversed(old.items()))))
    assert digests.differing_ranges(spark, a, c) == [] and digests.changed_keys(spark, a, c, spark.createDataFrame([], schema).schema, ["k", "s"]).count() == 0
    ranges = digests.differing_ranges(spark, a, b)
    assert 1 <= len(ranges) <= 4
    out = digests.changed_keys(spark, a, b, spark.createDataFrame([], schema).schema, ["k", "s"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_range") == 2 and all(r in plan for r in ranges)
    for path in (a, b):  # equal ranges are never read: their rows may be gone
        for folder in pathlib.Path(path.removeprefix("file://"), "rows").glob("_range=*"):
            if folder.name[7:] not in ranges:
                for file in folder.iterdir():
                    file.unlink()
    again = digests.changed_keys(spark, a, b, spark.createDataFrame([], schema).schema, ["k", "s"])
    assert sorted(map(tuple, again.collect())) == [(5, "s5", "removed"), (7, "s0", "changed"), (8, "s1", "changed"), (9999, "s", "added")]


def test_empty_versions_null_keys_and_repeated_rows(spark):
    schema = "k int, s string, v string"
    none, some = stored(spark, [], schema), stored(spark, [(1, None, "a"), (2, "x", None), (2, "x", None)], schema)
    once = stored(spark, [(1, None, "a"), (2, "x", None)], schema)
    cols = spark.createDataFrame([], schema).schema
    pairs = lambda x, y: sorted(map(tuple, digests.changed_keys(spark, x, y, cols, ["k", "s"]).collect()))
    assert pairs(none, some) == [(1, None, "added"), (2, "x", "added")]
    assert pairs(some, none) == [(1, None, "removed"), (2, "x", "removed")]
    assert pairs(some, once) == [(2, "x", "changed")]
    assert pairs(none, none) == []
    with pytest.raises(ValueError):
        digests.store(spark.createDataFrame([(1,)], "_range int"), f"/tmp/none-{uuid.uuid4().hex}", ["_range"])
