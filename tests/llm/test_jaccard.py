import random

from helpers import clashing, documents, rows, saved, texts_of

from deltaloom.llm import jaccard
from deltaloom.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def expected(docs, percent=90):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [j for b, (j, _) in enumerate(sets) if find(b) == find(a) and j is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=repr)


def made(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    seeds = [[rng.choice(words) for _ in range(rng.choice([3, 12, 40, 120]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(seeds)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return out


def test_equals_brute_force(spark, tmp_path):
    docs = made(1)
    chain = [f"c{i}" for i in range(60)]
    docs += [(300 + k, " ".join(["x"] * 0 + [f"d{j}" if j < k else c for j, c in enumerate(chain)])) for k in range(8)]
    docs += [(500 + k, " ".join(f"e{k}x{j}" if j in (k % 90, (k * 7) % 90) else f"b{j}" for j in range(90))) for k in range(40)]
    docs += [(400, None), (401, ""), (402, "a"), (403, "A"), (404, "a b"), (None, "a b"), (None, None), (5, docs[5][1]), (406, "z " * 20_000), (407, "z z z"), (408, "É é")]
    df = clashing(documents(spark, [t for _, t in docs], [i for i, _ in docs])).repartition(6)
    assert rows(jaccard.op10_jaccard_join(spark, saved(df, tmp_path))) == expected(docs)


def test_equals_brute_force_on_the_corpus(spark, sf):
    assert rows(jaccard.op10_jaccard_join(spark, sf)) == expected(list(texts_of(sf).items()))


def test_empty_table(spark, tmp_path):
    assert rows(jaccard.op10_jaccard_join(spark, saved(documents(spark, []), tmp_path))) == []


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (130, 129), (500, 400)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {(i, 0) for i in range(21)} | {(i, 100) for i in range(100, 131)} | {(400, 400), (500, 400)}
    assert got == want
