import random

from helpers import clashing, documents, rows

from deltaloom.llm import decontamination as dec


def distance(item, text):
    """Least edits between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return " ".join((text or "").lower().split()).encode()


def expected(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            item, text = plain(x), plain(t)
            e = distance(item, text)
            if item and 10 * e <= len(item):
                out.append((d, i, e))
    return sorted(out, key=repr)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        p = rng.randrange(len(t))
        kind = rng.random()
        if kind < 0.4:
            t[p] = rng.choice("abcxyz ")
        elif kind < 0.7:
            t.insert(p, rng.choice("abcxyz"))
        else:
            del t[p]
    return "".join(t)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", "thou", "shed", "ñea", "ing", "x"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 6, 12, 20]))) for i in range(8)] + [(20, None), (21, ""), (22, "abc"), (23, "exactly8"), (5, "Same TEXT here now")]
    docs = []
    for i in range(50):
        item = rng.choice(items[:8])[1]
        leak = edited(rng, item, rng.choice([0, 1, 2, 4, 8, 14])) if rng.random() < 0.7 else ""
        docs.append((i, f"{text(rng.randint(0, 15))} {leak}\n{text(rng.randint(0, 15))}"))
    docs += [(60, None), (61, ""), (62, items[0][1].upper().replace(" ", " \n ")), (62, items[0][1]), (None, items[1][1]), (63, "it is exactly8 ok"), (64, "a " * 300 + items[2][1] + " b" * 300)]
    d = clashing(documents(spark, [t for _, t in docs], [i for i, _ in docs]))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows(dec.contaminated(d, b).select("doc_id", "item_id", "edits"))
    assert got == expected(docs, items)
    assert rows(dec.contaminated(d, b, block_bytes=100).select("doc_id", "item_id", "edits")) == got


def test_finds_exact_passages_of_the_corpus(spark, sf):
    found = {(r["doc_id"], r["item_id"]) for r in dec.op3_decontamination(spark, sf).collect()}
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    exact = {(d["doc_id"], i["item_id"]) for d in docs for i in items if dec.normal(i["text"]) in dec.normal(d["text"])}
    assert exact <= found and len(found) <= len(exact) + 3 and exact


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, ["text of a document"])
    items = spark.createDataFrame([], "item_id long, text string")
    assert rows(dec.contaminated(some, items)) == []
    assert rows(dec.contaminated(none, spark.createDataFrame([(1, "some item text")], "item_id long, text string"))) == []


def test_short_items_and_their_budgets(spark):
    rng = random.Random(9)
    words = ["ab", "cde", "fg", "hijk", "é"]
    items = [(str(n), "".join(rng.choice("abcdefgh ñ") for _ in range(n)) + "z") for n in (*range(0, 12), 18, 20, 23, 30, 31, 38, 39, 40, 41)]
    docs = []
    for k in range(120):
        item = rng.choice(items)[1]
        docs.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) + " " + edited(rng, item, rng.choice([0, 0, 1, 2, 3, 4]))))
    docs += [(500, "E = mc2"), (501, "see e = MC2 there")]
    items.append(("x", "E = mc2"))
    d, b = documents(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id string, text string")
    assert rows(dec.contaminated(d, b).select("doc_id", "item_id", "edits")) == expected(docs, items)


def test_very_long_texts(spark):
    item = "a passage of the benchmark that nobody may learn from"
    docs = documents(spark, ["word " * 400_000 + item, "x" * 2_000_000, item * 2000], [1, 2, 3])
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert rows(dec.contaminated(docs, items).select("doc_id", "item_id", "edits")) == [(1, 7, 0), (3, 7, 0)]
