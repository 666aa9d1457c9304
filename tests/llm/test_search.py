"""Hard negatives, URL filters and ranked lexical search against brute force and held-out labels, with the odd rows of each."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from parity import assert_same
from pyspark.sql import functions as F

from recordspine.llm import lexical, negatives, queries, urls


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_lexical_search"])
def test_same_as_duckdb(spark, name):
    assert assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


# 11 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shape", [(7, 5, 9), (16, 16, 16), (33, 64, 70), (1, 64, 100), (40, 0, 3)])
def test_strassen_is_exact(shape):
    rnd, (m, k, n) = np.random.default_rng(4), shape
    a, b = rnd.integers(-(2**36), 2**36, (m, k)), rnd.integers(-(2**20), 2**20, (k, n))
    assert (negatives.strassen(a, b, 4) == a.astype(object) @ b.astype(object) if k else negatives.strassen(a, b, 4) == 0).all()


def negatives_brute(rows, s):
    rows = {(i, label, tuple(math.floor(s.scale * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, label, v in rows:
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
        for top, positive, _ in sorted(x for x in scored if x[2] == label)[: s.positives]:
            fits = sorted((n, j) for n, j, other in scored if other != label and s.floor_percent * -top <= 100 * -n <= 100 * -top)
            out.update((i, positive, rank, j, -top, -n) for rank, (n, j) in enumerate(fits[: s.negatives], 1))
    return out


def test_hard_negatives_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(6, 10))
    rows = [(i, (centres[rnd.integers(6)] + 0.4 * rnd.normal(size=10)).tolist(), int(rnd.integers(3))) for i in range(900)]
    hot = rows[5][1]
    rows += [(2000 + i, hot, 1) for i in range(450)] + [(1500, hot, 1), (1500, hot, 1), (1500, hot, 2)]  # ties, repeated rows, one id with two labels
    rows += [(3000, None, 1), (3001, [1.0, None], 1), (3002, [float("nan")] * 10, 1), (3003, [float("inf")] * 10, 1), (None, hot, 1), (3100, hot, None), (3200, [], 1), (3201, [], 2), (3300, [1.0, 2.0], 1), (3301, [1.0, 2.0], 1), (3302, [0.9, 2.0], 2)]
    frame = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "vec_id long, embedding array<double>, label int, a int, q int, score int")
    for s in (negatives.Settings(block=256, strip=3), negatives.Settings(positives=2, negatives=3, floor_percent=50)):
        got = Counter(tuple(r) for r in negatives.hard_negatives(frame, F.pmod("vec_id", F.lit(100)) == 0, s).collect())
        assert got == negatives_brute(rows, s) and len(got) > 50


def test_hard_negatives_of_huge_values_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, 1.0], 1), (2, [-1e300, 5.0], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(frame, F.col("vec_id") == 0).count() >= 0
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0


# 12 ------------------------------------------------------------------------------------------------------------------
def parts_brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_brute(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


ODD = [None, "", "no address", "://", "http://", "HTTP://WWW.Example.NET/en/x", "https://example.net", "https://a.example.net/EN/", "x://net/", "y://planet/", "ftp://ÄB.org/fr/?q=://b/", "https://h.com?x/y", "https://h.com#f", "https://example.com/de/a?b#c", "https://u@example.com:8/de/", "http://org/fr/" + "z" * 50_000, "https://a\nb.net/\n/x?y"]


def test_url_parts_and_rules(spark):
    rows = [(i, u, "own", 5, 6) for i, u in enumerate(ODD + ODD)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host int, f_suffix int"), urls.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts_brute(r.url)
        rule, verdict = rule_brute(host, path)
        assert (r.host, r.path, r.rule, r.f_suffix) == (host, path, rule, 6)
        assert r.verdict == (verdict or "allow") and r.chance == 0  # none of them has a seed word: one label only


def test_url_query_on_the_whole_table(spark):
    got = queries.queries()["op12_url_filter"](spark, SF.replace("0.001", "0.01")).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url").collect()}
    assert {r.page_id for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        host, path = parts_brute(pages[r.page_id])
        rule, verdict = rule_brute(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.chance >= 0.5 else "allow"))


def made_urls(rnd, n):
    """(url, bad): bad ones have hyphens, digits and many parameters; some labels are turned round."""
    word = lambda k: "".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(k))
    out = []
    for _ in range(n):
        bad = rnd.random() < 0.4
        host = f"{word(4)}-{rnd.randrange(10**6)}-{word(5)}.{rnd.choice(['biz', 'top', 'com'])}" if bad else f"{word(8)}.{rnd.choice(['com', 'org'])}"
        query = "?" + "&".join(f"{word(1)}={rnd.randrange(99)}" for _ in range(rnd.randrange(1, 6))) if bad or rnd.random() < 0.2 else ""
        out.append((f"https://{host}/{word(6)}/{word(4)}{query}", int(bad)))
    return out


def test_url_model_on_held_out_labels(spark):
    rnd = random.Random(8)
    rows = [(i, u, y, y if i % 5 else None) for i, (u, y) in enumerate(made_urls(rnd, 1500))]
    rows += [(5000 + i, rows[3][1], rows[3][2], rows[3][3]) for i in range(700)]  # copies of one url
    frame = spark.createDataFrame(rows, "page_id long, url string, truth int, label int")
    s = urls.Settings(sample_rows=300)
    got = [r for r in urls.judge(frame, [], s, label="label").collect() if r.label is None]
    assert len(got) == 300 and sum((r.chance >= 0.5) == (r.truth == 1) for r in got) >= 0.97 * len(got)
    assert urls.judge(frame.limit(0), urls.RULES).count() == 0


def test_url_model_finds_hosts_whose_words_it_never_saw(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url")
    words = ["ads", "adult", "casino", "pills", "bets", "spam"]
    host = F.regexp_extract("url", "://([^/]+)", 1)
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))
    unseen = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words[:2])))
    got = urls.judge(pages.select("page_id", "url", bad.alias("bad"), F.when(unseen, None).otherwise(bad.cast("int")).alias("label")), [], label="label")
    n, found, wrong = got.agg(*(F.count_if(F.expr(x)) for x in ("bad AND label IS NULL", "bad AND label IS NULL AND chance >= 0.5", "NOT bad AND chance >= 0.5"))).first()
    assert n and found == n and wrong == 0


def test_entropy_and_counts(spark):
    text = "aabbccdd/häß"
    got = spark.range(1).select(urls.entropy(F.lit(text)).alias("e"), urls.entropy(F.lit("")).alias("none")).first()
    assert got.none == 0 and abs(got.e + sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())) < 1e-9


# 13 ------------------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def search_brute(docs, items, k):
    read = [(i, Counter(split(t))) for i, t in docs]
    read = [(i, c) for i, c in read if c]
    n_docs, n_terms = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, c in read:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            scored.append((-sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c), i))
        out.update((item, rank, i, -score) for rank, (score, i) in enumerate(sorted(x for x in scored if x[0] and x[1] is not None)[:k], 1))
    return out


def corpus(rnd):
    text = lambda n, v: " ".join(f"w{int(rnd.paretovariate(0.7)) % v}" for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 90), 500)) for i in range(700)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(7, docs[7][1]), (7, "Other text w3")]  # copies tie, ids repeat
    docs += [(2000, None), (2001, ""), (2002, " .,!\x7f\t"), (None, docs[7][1]), (2003, "Élan ÉLAN élan naïve_Ünï W3x"), (2004, text(30_000, 900)), (2005, "one" * 20_000)]
    items = [(i, text(rnd.randrange(1, 25), 500)) for i in range(60)] + [(3, text(9, 500)), (80, None), (81, ""), (82, "?!"), (83, "nowhere known"), (84, "ÉLAN W3X one élan élan"), (85, docs[7][1]), (85, docs[7][1]), (None, "w1 w2")]
    return docs, items


def test_search_against_brute_force(spark):
    docs, items = corpus(random.Random(5))
    d = spark.createDataFrame([(*x, "s", 1, 1, 1) for x in docs], "doc_id long, text string, term string, n int, m int, score int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, item int")
    for s in (lexical.Settings(), lexical.Settings(k=3, round_bytes=900, seed_docs=100, tree_docs=200, doc_leaf=8, item_leaf=2, fanout=3)):
        got = Counter(tuple(r) for r in lexical.search(d, q, s).collect())
        assert got == search_brute(docs, items, s.k)


def test_search_prunes():
    rnd = random.Random(6)
    topics = [[f"t{t}x{i}" for i in range(30)] for t in range(40)]
    docs = [" ".join(rnd.choices(topics[i % 40], k=30)) for i in range(4000)]
    s = lexical.Settings(tree_docs=4000)
    items = lexical.Items([(t, " ".join(rnd.choices(topics[t], k=10))) for t in range(40)], s)
    search = lexical.Search(items, np.full(len(items.vocabulary), 900), np.zeros(40, dtype=np.int64), s)
    held = [Counter(items.vocabulary[w] for w in lexical.terms(d) if w in items.vocabulary) for d in docs]
    ids = np.array([i for i, h in enumerate(held) if h])
    held = [h for h in held if h]
    search.add(ids, np.full(len(ids), 100), np.array([len(h) for h in held]), np.array([t for h in held for t in h]), np.array([n for h in held for n in h.values()]))
    assert search.scored < 0.25 * (4000 / s.doc_leaf) * (40 / s.item_leaf)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d, q).schema == lexical.search(d, q.limit(0)).schema
