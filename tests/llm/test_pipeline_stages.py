"""Stages of the pipeline against plain Python."""

import os
import random

import corpus_pipeline as pipeline
from helpers import clashing, documents, saved

from deltaloom.llm import jaccard
from deltaloom.session import shared_dir


def shingles(text, length=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if len(w) >= length else {tuple(w)} if w else set()


def groups(texts, percent=80):
    """The number of each text's group under links of enough similarity."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(texts))]


def near_copies():
    """Texts of 100 words with 0 to 7 of them changed, far from each other: similarities on both sides of 0.8."""
    rng, out = random.Random(3), []
    for k in range(6):
        seed = [f"s{k}x{rng.randrange(400)}" for _ in range(100)]
        for changed in (0, 1, 2, 2, 3, 5, 7):
            w = list(seed)
            for j in rng.sample(range(0, 100, 7), changed):
                w[j] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return [*out, "a b", "A b", "a b c", None, "", ""]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    least = {}
    for i, g in enumerate(groups(texts)):
        least.setdefault(g, i)
    docs = documents(spark, texts).repartition(5)
    assert sorted(r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, "").collect()) == sorted(least.values())


def outcome(stage, docs, spark, sf=""):
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, sf).collect()), key=repr)


def test_near_duplicates_without_or_with_one_doc_id(spark):
    a, b, c = (" ".join(f"{k}{j}" for j in range(40)) for k in "abc")
    found = [(None, a), (3, a), (None, a + " more"), (None, b), (None, b), (7, c), (7, "quite another text than that"), (7, c), (8, ""), (8, ""), (8, None), (None, ""), (None, "")]
    docs = documents(spark, [t for _, t in found], [i for i, _ in found]).repartition(3)
    want = [(3, a), (None, b), (7, c), (7, "quite another text than that"), (8, ""), (8, None), (None, ""), (None, "")]
    assert outcome(pipeline.one_of_each_group, docs, spark) == sorted(want, key=repr)


def test_benchmark_passages_without_or_with_one_doc_id(spark, tmp_path):
    item = "the seventh question asks which of the four rivers is the longest one of all"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [(None, f"before {item} after"), (None, "clean text"), (None, None), (5, f"so {item}"), (5, "another clean text"), (6, ""), (6, item)]
    docs = documents(spark, [t for _, t in found], [i for i, _ in found]).repartition(3)
    want = [x for x in found if item not in (x[1] or "")]
    assert outcome(pipeline.without_benchmark, docs, spark, str(tmp_path)) == sorted(want, key=repr)


def test_decontamination_moves_no_rows(spark, tmp_path):
    """Each row is judged where it lies: texts go through no exchange, whatever the size of the list of leaked ones."""
    item = " ".join(f"item{i}" for i in range(40))
    docs = clashing(documents(spark, [f"before {item} after", "clean", None, "", item, "clean"], [1, 2, 3, None, None, 2]))
    saved(spark.createDataFrame([(7, item), (8, None)], "item_id long, text string"), tmp_path, "benchmark")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.without_benchmark(spark, docs, str(tmp_path))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(2, "clean"), (3, None), (None, ""), (2, "clean")], key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_leave_only_their_result_behind(spark, tmp_path):
    """What the join staged is gone when its result is there, so later stages start with an empty folder."""
    before = staged_names(spark)
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(60)) for i in range(20)] * 2 + ["alone", None]
    out = jaccard.jaccard_components(documents(spark, texts), 5, 80)
    left = {n.rsplit("-", 1)[0] for n in staged_names(spark) - before}
    assert out.count() == 42 and not left & {"incidence", "entries", "open", "marked"} and not any(n.startswith("deltaloom_") for n in left)


def staged_names(spark):
    folder = f"{shared_dir(spark)}/staged".removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()
