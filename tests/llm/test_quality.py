from collections import Counter

from helpers import clashing, documents, rows, saved, texts_of

from deltaloom.llm import quality


def expected(text):
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    chars = sum(len(w.decode()) for w in words)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", " \n\t ", "one two three", "é\x1fñ | # <a>\n\n x\n x\n", "w " * 30, " ".join(f"w{i % 9}" for i in range(60)), " ".join(map(str, range(40))), "long " * 5 + "x" * 100_000, "dup\ndup\nDUP\n"]


def test_measures_of_awkward_texts(spark, tmp_path):
    out = {r[0]: tuple(r[1:7]) for r in quality.op8_quality(spark, saved(clashing(documents(spark, TEXTS)), tmp_path)).collect()}
    assert out == {i: expected(t) for i, t in enumerate(TEXTS)}


def test_measures_of_the_corpus(spark, sf):
    out = quality.op8_quality(spark, sf).collect()
    assert {r[0]: tuple(r[1:7]) for r in out} == {i: expected(t) for i, t in texts_of(sf).items()}
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_empty_table(spark, tmp_path):
    assert rows(quality.op8_quality(spark, saved(documents(spark, []), tmp_path))) == []


def test_verdicts_follow_the_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL")
    out = quality.op8_quality(spark, sf).filter("n_words >= 20").join(labels, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in out)
    assert right >= 0.97 * len(out)


def test_ablations_equal_brute_force(spark, sf):
    ledger = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    policy = quality.POLICIES["strict"]
    bits = [r["fail_bits"] & policy.mask for r in ledger.collect()]
    found = {r["rule"]: (r["n_fail"], r["n_only"], r["n_kept_without"]) for r in quality.ablations(ledger, policy).collect()}
    for i, (name, _) in enumerate(quality.RULES):
        b = 1 << i
        assert found[name] == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(not x & ~b for x in bits))
    assert quality.POLICIES["base"].mask == 3
    ledger.unpersist()
