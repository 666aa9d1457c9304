"""Matching against all pairs in plain Python."""

from __future__ import annotations

import itertools
import re

from recordspine.operators import matching

FIELDS = ["place", "office", "name"]


def test_against_all_pairs(spark):
    values = [None, "", "a", "A-b", "!"]
    queries = [(i, *v) for i, v in enumerate(itertools.product(values, repeat=3))]
    records = [(i, *v) for i, v in enumerate(itertools.product([None, "a", "a b", "!"], [None, "a", "A  B."], ["a", "", None]))] + [(3, "a", "a", "a")]
    key = lambda v: None if v is None else re.sub("[^a-z0-9]+", "_", v.lower()).strip("_")
    want = {}
    for i, *q in queries:
        fits = [r[0] for r in records if all(not w or ((key(w) == key(h) if f == "office" else w == h) and h is not None) for f, w, h in zip(FIELDS, q, r[1:]))] if q[0] or q[1] else []
        want[i] = ("matched" if len(fits) == 1 else "ambiguous" if fits else "unmatched", len(fits), fits[0] if len(fits) == 1 else None)
    schema = "place string, office string, name string"
    r, q = spark.createDataFrame(records, f"rid int, {schema}"), spark.createDataFrame(queries, f"qid int, {schema}")
    run = lambda r, q: matching.match(r, "rid", q, "qid", FIELDS, ["place", "office"], {"office": matching.office_key})
    assert {x.qid: (x.status, x.candidates, x.rid) for x in run(r, q).collect()} == want
    assert {s for s, *_ in want.values()} == {"matched", "ambiguous", "unmatched"}
    assert run(r, q.limit(0)).count() == 0
    assert {x.status for x in run(r.limit(0), q).collect()} == {"unmatched"}


def test_repeated_queries_stay(spark):
    r = spark.createDataFrame([(1, "a")], "rid int, place string")
    q = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "qid int, place string")
    assert sorted((x.qid or 0, x.status) for x in matching.match(r, "rid", q, "qid", ["place"]).collect()) == [(0, "unmatched"), (1, "matched"), (1, "matched")]
