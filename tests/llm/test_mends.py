"""Long texts, hot benchmark ids, one-word texts, hash tables of embeddings and clashing columns of the pipeline."""

from __future__ import annotations

import random
import time

import corpus_pipeline
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from recordspine.llm import decontamination, embeddings, minhash, pii

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_pii_of_a_very_long_text_is_linear_and_equal_to_plain_overlap_tests():
    rnd = random.Random(4)
    part = lambda: rnd.choice([f"mail u{rnd.randrange(99)}@ex.org", f"ssn {rnd.randrange(100, 999)}-12-{rnd.randrange(1000, 9999)}", f"password=ab{rnd.randrange(10**6)}x", "DE89370400440532013000", "+49 170 1234567", "4111 1111 1111 1111", "10.0.0.1 text"])
    text = " ".join(part() for _ in range(400))
    out, taken = [(*x, pii.score(text, *x)) for x in pii.base_spans(text)], [(s, e) for _, s, e in pii.base_spans(text)]
    for kind, s, e in [*(("iban", *x) for x in pii.ibans(text)), *(("national_id", *m.span()) for m in pii.NATIONAL_ID.finditer(text)), *(("secret", *x) for x in pii.secrets(text))]:
        if pii.score(text, kind, s, e) >= 0.5 and not any(s < y and x < e for x, y in taken):
            out.append((kind, s, e, pii.score(text, kind, s, e)))
            taken.append((s, e))
    assert pii.find_spans(text) == sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))
    took = []
    for n in (20_000, 80_000):
        long = " ".join(part() for _ in range(n))
        began = time.process_time()
        assert len(pii.find_spans(long)) > n // 3
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_benchmark_of_many_ids_with_one_text(spark):
    text = "the committee on rivers met on a cold morning and asked for maps of every bridge in town"
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame([(1, f"noise {text} noise"), (2, "noise only")], "doc_id long, text string")
    got = {r.doc_id: r.n_items for r in decontamination.flag(docs, items, decontamination.Settings(broadcast_rows=1000)).select("doc_id", "n_items").collect()}
    assert got == {1: 20_000, 2: 0}


def test_short_items_are_reported_but_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "the answer is yes of course", "en", "s", 1), (2, "a b c", "en", "s", 1)], KIND)
    bench = spark.createDataFrame([(1, "Yes")], "item_id long, text string")
    assert [(r.doc_id, r.size) for r in decontamination.find_leaks(docs, bench).collect()] == [(1, 1)]


def test_keys_of_one_word_texts_come_from_two_hashes():
    a, b = (np.concatenate([s for s in minhash.shingle_sets([f"w{i}".encode() for i in range(2000)], 5, seed)]) for seed in (0, 1))
    assert len(np.unique(a)) == len(np.unique(b)) == 2000 and not (a == b).any()


def test_embedding_links_through_many_hash_tables(spark):
    """Recall over pairs at the threshold: ids divisible by 100 against all rows, as measured for the README."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(900, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:, None, :] + 0.041 * rnd.normal(size=(900, 5, 64))
    v = np.concatenate([base, near.reshape(-1, 64)]).astype(np.float32)
    s = embeddings.Settings(bucket=16)
    bits, tables = embeddings.tables_for(len(v), s)
    assert bits >= 8 and tables >= 10
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, s).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = [(u[i] @ u.T >= s.threshold).sum() - 1 for i in range(0, len(v), 10)]
    found = sum(got[i] for i in range(0, len(v), 10))
    assert sum(want) > 400 and 0.999 * sum(want) <= found <= sum(want)


def test_stages_keep_columns_of_any_name(spark):
    own = ["_pii", "redacted_text", "pii_spans", "_id", "_hash", "_row", "_key", "toxicity", "toxic_sentences", "_toxic", "a.b"]
    docs = spark.createDataFrame([(1, "write to a.b@ex.org now please my friend", "en", "s", 40, *own), (2, None, "en", "s", None, *own), (3, "", None, None, 0, *own)], KIND + "".join(f", `{c}` string" for c in own))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        rows = {r.doc_id: r for r in kept.collect()}
        assert set(rows) == {1, 2, 3} and all(r[c] == c for r in rows.values() for c in own)
        kept = spark.createDataFrame(list(rows.values()), docs.schema)
    assert rows[1].text == "write to <EMAIL> now please my friend" and rows[1].n_chars == 37
