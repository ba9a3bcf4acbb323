import hashlib
import random
from collections import defaultdict

from helpers import clashing, documents, rows, saved, texts_of

from deltaloom.llm import substrings


def expected(docs):
    """docs: (doc_id, text) pairs."""
    first = {}
    last = float("inf")
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (last if i is None else i):
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "ñandú"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 30, 90]))] for _ in range(8)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return out


def test_equals_brute_force(spark, tmp_path):
    docs = made()
    docs += [(200, None), (201, ""), (202, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (203, "x " * 30_000), (204, "x " * 14), (205, "\x85 " + "a " * 13)]
    df = clashing(documents(spark, [t for _, t in docs], [i for i, _ in docs])).repartition(7)
    assert rows(substrings.op4_substring_dedup(spark, saved(df, tmp_path)).drop("longest_repeat")) == expected(docs)


def test_equals_brute_force_on_the_corpus(spark, sf):
    assert rows(substrings.op4_substring_dedup(spark, sf).drop("longest_repeat")) == expected(list(texts_of(sf).items()))


def test_empty_table(spark, tmp_path):
    assert rows(substrings.op4_substring_dedup(spark, saved(documents(spark, []), tmp_path))) == []


def levels(docs):
    best = [0] * len(docs)
    length = 13
    while True:
        where = defaultdict(set)
        for n, (i, t) in enumerate(docs):
            w = (t or "").split()
            for k in range(len(w) - length + 1):
                where[tuple(w[k : k + length])].add((i, n))
        found = {n for s in where.values() if len({i for i, _ in s}) > 1 for _, n in s}
        if not found:
            return best
        for n in found:
            best[n] = length
        length *= 2


def test_levels_go_on_until_nothing_survives(spark, tmp_path):
    docs = made(9, 60) + [(100, " ".join(map(str, range(300)))), (101, "a " + " ".join(map(str, range(250)))), (102, None), (103, "")]
    docs += [(104, " ".join(map(str, range(1000, 1100)))), (104, " ".join(map(str, range(1000, 1100)))), (None, docs[60][1]), (None, "only " * 40)]
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5)
    got = sorted(((r["doc_id"], r["longest_repeat"]) for r in substrings.op4_substring_dedup(spark, saved(df, tmp_path)).collect()), key=repr)
    want = sorted(((i, n) for (i, _), n in zip(docs, levels(docs), strict=True)), key=repr)
    assert got == want and max(n for _, n in want) == 208


def test_greatest_id_is_not_a_missing_one(spark, tmp_path):
    most = 2**63 - 1
    text = " ".join(map(str, range(20)))
    docs = [(most, text), (most - 1, text), (None, text), (most, "x"), (-(2**63), "y")]
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    assert rows(substrings.op4_substring_dedup(spark, saved(df, tmp_path)).drop("longest_repeat")) == expected(docs)
