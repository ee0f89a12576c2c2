"""The pipeline's dedup stage takes the components of op 5's fingerprints, and near copies beyond them."""

import corpus_pipeline
import numpy as np
from tessera.llm import simhash


def test_stage_links_fingerprints(spark):
    """Texts whose fingerprints differ in 4 bits at most go, though they share less than 0.8 of their shingles."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 5)]
    texts = [" ".join(base * 60), " ".join(base * 60 + [f"tail{i}" for i in range(6)]), " ".join(f"v{i}" for i in range(80))]
    bits = bin(simhash.fingerprint(texts[0], 4) ^ simhash.fingerprint(texts[1], 4)).count("1")
    sets = [np.unique(simhash.shingle_hashes(simhash.words(t), 5)) for t in texts]
    assert bits <= simhash.BUDGET and simhash.likeness(sets[0], sets[1]) < simhash.NEAR
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 2}
