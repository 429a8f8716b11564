"""Toxicity: every labelled text takes part in the training, whatever their number."""

import numpy as np

from descry.llm import toxicity
from descry.llm.common import ship

PLAIN = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def labelled(spark, count, late):
    """Half of the texts are toxic by one word; those of the last ``late`` toxic ids, by the hash, have a word of their own."""
    rng = np.random.default_rng(0)
    ranks = spark.range(count).selectExpr("id", f"xxhash64(id, {toxicity.Training().seed}) AS r").orderBy("r").collect()
    ids = [r["id"] for r in ranks if r["id"] % 2]
    own = set(ids[-late:])
    texts = [(i, " ".join([*rng.choice(PLAIN, 6), "grim" if i in own else "vile" if i % 2 else "kind"]), "en" if i % 4 < 2 else None, i % 2) for i in range(count)]
    return ship(spark).createDataFrame(texts, "doc_id bigint, text string, lang string, toxic int")


def test_labels_beyond_any_sample_are_learnt(spark):
    docs = labelled(spark, 5600, 250).cache()
    model = toxicity.train(docs, docs)
    test = spark.createDataFrame([(i, " ".join([*PLAIN, word])) for i, word in enumerate(["grim", "vile", "kind"])], "doc_id bigint, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(test, model).collect()} == {0: 1, 1: 1, 2: 0}
    share = np.exp(model.word_log[:-1, 0])  # 7 words a text, one more in every bucket
    assert np.isclose(1 / share.min(), 2800 * 7 + toxicity.BUCKETS + 1, rtol=1e-3)


def test_shards_are_the_same_for_any_partitions(spark):
    docs = labelled(spark, 300, 10)
    settings = toxicity.Training(texts=70, epochs=3)
    shards = toxicity.labelled_shards(docs, docs, settings).collect()
    assert len(shards) == 5 and sum(len(r["sizes"]) for r in shards) == 300 and all(sum(r["sizes"]) * 4 == len(r["words"]) for r in shards)
    one, other = (toxicity.train(docs.repartition(n), docs.repartition(8 - n), settings) for n in (1, 7))
    assert np.array_equal(one.embedding, other.embedding) and np.array_equal(one.thresholds, other.thresholds) and one.offset == other.offset


def test_best_places_of_long_texts(monkeypatch):
    rng, settings = np.random.default_rng(1), toxicity.Training()
    model = toxicity._start(settings).model()
    sizes = np.array([0, 40, 3, 1, 90])
    first, second, starts = toxicity.laid_out(rng.integers(0, toxicity.BUCKETS**2, sizes.sum()), sizes)
    whole = toxicity._best(model, first, second, starts)
    monkeypatch.setattr(toxicity, "_PLACES", 7)
    parts = toxicity._best(model, first, second, starts)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole[0], parts[0])) and all(np.array_equal(a, b) for a, b in zip(whole[1], parts[1]))
    assert np.allclose(np.concatenate(whole[0], axis=1), model.pooled(first, second, starts, model.projected()), atol=1e-5)
