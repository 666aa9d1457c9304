"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from recordspine.llm import chat, decontamination, embeddings, lexical, minhash, negatives, pii, quality, sentencepiece_fst, sharding, suffix, toxicity, urls


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_minhash_dedup": minhash.query,
        "op2_quality": quality.query,
        "op3_sentencepiece": sentencepiece_fst.query,
        "op4_suffix_dedup": suffix.query,
        "op5_pii": pii.query,
        "op6_sharding": sharding.query,
        "op7_embedding_dedup": embeddings.query,
        "op8_decontamination": decontamination.query,
        "op9_toxicity": toxicity.query,
        "op10_chat_formatting": chat.query,
        "op11_hard_negatives": negatives.query,
        "op12_url_filter": urls.query,
        "op13_lexical_search": lexical.query,
    }


def oracle_sql():
    """SQL where it can express the query; the others are tested against brute force, round trips or held-out labels."""
    return {"op1_minhash_dedup": minhash.SQL, "op7_embedding_dedup": embeddings.SQL, "op10_chat_formatting": chat.SQL, "op11_hard_negatives": negatives.SQL, "op13_lexical_search": lexical.SQL}
