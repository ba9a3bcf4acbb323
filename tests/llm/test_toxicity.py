import zlib

import numpy as np
from helpers import clashing, documents, saved

from deltaloom.llm import toxicity as tox


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = tox.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    caught = [r["predicted"] for r in out if r["toxic"] == 1]
    assert sum(caught) >= 0.85 * len(caught)


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", "you idiot", "a nice day", "idiot " * 50_000] + ["you idiot"] * 40 + ["a nice day out"] * 60
    ids = [None, 1, 2, 3, 4, *range(5, 105)]
    saved(clashing(documents(spark, texts, ids)), tmp_path)
    labels = [(i, 1, int("idiot" in t)) for i, t in zip(ids[4:], texts[4:], strict=True)] + [(None, 1, 1), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in tox.op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(out) == 105 and out[None]["held_out"] is None and out[None]["predicted"] == out[1]["predicted"] == out[3]["predicted"] == 0
    assert out[2]["predicted"] == 1 and out[4]["predicted"] == 1


def test_no_labels_and_no_rows(spark, tmp_path):
    saved(documents(spark, ["x"], [3]), tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["predicted"] for r in tox.op9_toxicity(spark, str(tmp_path)).collect()] == [0]
    saved(documents(spark, []), tmp_path)
    assert tox.op9_toxicity(spark, str(tmp_path)).collect() == []


def votes_of(y, hits, misses, rng):
    return np.stack([np.where(y, rng.random(len(y)) < h, rng.random(len(y)) < m) for h, m in zip(hits, misses, strict=True)], axis=1).astype(float)


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.1
    votes = votes_of(y, (0.8, 0.8, 0.8, 0.8, 0.01), (0.001, 0.001, 0.02, 0.05, 0.5), rng)
    p, model = tox.label_model(votes, np.array([True, True, True, True, False]))
    assert ((p > 0.5) == y).mean() > 0.95 and model.accuracy[0] > model.accuracy[2] > model.accuracy[3] and model.accuracy[4] > 0.9


def test_copies_of_a_voter_are_linked_and_count_once():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.1
    base = votes_of(y, (0.6, 0.6, 0.6), (0.01, 0.01, 0.01), rng)
    noisy = (rng.random(6000) < 0.1).astype(float)
    votes = np.column_stack([base, noisy, noisy, noisy])
    p, model = tox.label_model(votes, np.ones(6, bool))
    assert sorted((model.parent[3:] >= 3).tolist()) == [False, True, True] and model.correlation[3:].max() > 0.9
    assert np.abs(model.parent[:3]).max() <= 2 or model.correlation[:3].max() < 0.3
    several = base.sum(axis=1) >= 2
    assert (p[several] > 0.9).all()


def test_the_label_model_and_the_classifier_see_no_labels():
    rng = np.random.default_rng(2)
    words = ["fine", "day", "house", "tree", "walk", "blue"]
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.15
        text = " ".join(rng.choice(words, 12).tolist() + (rng.choice(["zorg", "blarg", "fnord"], rng.integers(1, 4)).tolist() if bad else []))
        rows.append((text, int(bad)))
    model = tox.fit(rows)
    x = model.features([t for t, _ in rows])
    y = np.array([k for _, k in rows])
    p, _ = tox.label_model(x[:, : len(model.voters)], model.toxic)  # votes alone
    weights, bias = tox.linear(x, p)  # posteriors alone
    for found in (p, tox.sigmoid(x @ weights + bias), model.score([t for t, _ in rows])):
        assert ((found >= 0.5) == y).mean() > 0.99


def test_training_rows_are_bounded_in_rows(spark):
    docs = documents(spark, ["text"] * 300 + [f"t{i}" for i in range(60)], [1] * 300 + list(range(2, 62)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 62)] + [(None, 1)], "doc_id long, toxic int")
    assert len(tox.training_rows(docs, labels, most=20)) <= 20
    assert len(tox.training_rows(docs, labels)) == 300 * (zlib.crc32(b"1") % 5 != 0) + sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2, 62))
