import re

from conftest import SF
from pyspark.sql import functions as F
from test_llm import near_brute

import corpus_pipeline
from recordspine.llm import pii, sentencepiece_fst, toxicity


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        after = stage(spark, kept, SF)
        rows = {r.doc_id: r for r in after.collect()}
        assert len(rows) == after.count()
        if name == "toxicity":
            model = toxicity.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(rows) == {i for i, r in before.items() if model.score(model.sentence_scores(r.text)) < 0.5}
        elif name == "near_duplicates":
            assert set(rows) == {i for i, (_, c) in near_brute([(i, r.text) for i, r in before.items()], 5).items() if c == i}
        elif name == "decontamination":
            bench = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = {tuple(w[i : i + 13]) for w in bench for i in range(len(w) - 12)}
            words = {i: re.findall(r"\w+", r.text.lower()) for i, r in before.items()}
            assert set(rows) == {i for i, w in words.items() if not any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12))}
        elif name == "personal_data":
            assert {i: r.text for i, r in rows.items()} == {i: pii.redact(r.text, pii.find_spans(r.text)) for i, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.DEFAULT_MODEL)
            assert {i: list(r.piece_ids) for i, r in rows.items()} == {i: sp.encode(r.text) for i, r in before.items()}
            return
        assert after.columns == columns and set(rows) <= set(before)
        kept = spark.createDataFrame(after.collect(), docs.schema)


def test_stages_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "A B c d e f g", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows, want in ((docs, {1, 2, 3}), (docs.limit(0), set())):
        kept = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
        assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).where(F.col("n_pieces") > 0).count() == len(want & {3})


def test_a_row_goes_with_its_own_text_only(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = spark.createDataFrame([(1, a, "en", "s", 19), (3, a, "en", "s", 19), (3, b, "en", "s", 19), (5, a.upper(), "en", "s", 19), (5, a, "en", "s", 19)], kind)
    kept = corpus_pipeline.STAGES[1][1](spark, rows, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (3, b)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    rows = spark.createDataFrame([(1, f"{b} {item} {b}", "en", "s", 0), (1, b, "en", "s", 0), (2, None, "en", "s", 0)], kind)
    kept = corpus_pipeline.STAGES[2][1](spark, rows, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, b), (2, None)]
