"""Folded names against unicodedata over whole ranges of letters."""

from __future__ import annotations

import re
import unicodedata

from recordspine.functions import folding


def test_names_fold_as_decomposition_does(spark):
    letters = [chr(c) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF10, 0xFF5B), range(0x2160, 0x2180)) for c in r]
    names = [f"A{x}b “{x}” O'Neil-{x}" for x in letters] + ["Jane  Doe", "José Peña", "ﬁne Ｊｏｅ", "", None, "éa", "'\"", "José Peña"]
    rows = spark.createDataFrame([(i, n, "own") for i, n in enumerate(names)], "id int, name string, _folded_before string")

    def want(name, marks):
        t = "".join(c for c in unicodedata.normalize("NFKD", name) if marks or not unicodedata.combining(c))
        return " ".join(re.findall("[a-zA-Z0-9]+", re.sub("[\"“”']", "", t))).lower()

    for strict in (False, True):
        got = {r.id: r.n for r in folding.with_folded_names(rows, "name", "n", strict).collect()}
        assert got == {i: None if n is None else want(n, strict) for i, n in enumerate(names)}
    assert folding.folded("José Peña", False) == "jose pena" and folding.folded("José Peña", True) == "jose pen a"
    assert folding.with_folded_names(rows.limit(0), "name", "n").columns == ["id", "name", "_folded_before", "n"]
