"""run() against a plain version of every stage, on awkward rows."""

import hashlib
import random
import zlib

import corpus_pipeline
from helpers import documents, saved
from test_decontamination import distance, plain
from test_secrets import KINDS
from tokenizers import Tokenizer

from deltaloom.llm import bpe, secrets, toxicity


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def one_of_each(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        key = root(i) if sets[i] else ("none", i if d is None else (d, docs[i][1]))
        if key not in best or (d is None, d) < (docs[best[key]][0] is None, docs[best[key]][0]):
            best[key] = i
    return [docs[i] for i in sorted(best.values())]


def redacted(text):
    if text is None:
        return None
    spans = sorted((m.start(), m.end()) for _, r, g, n in KINDS for m in r.finditer(text) if len(m.group(g)) >= n)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + secrets.REDACTED
        at = max(at, b)
    return out + text[at:]


def expected(docs, labels, items):
    toxic = dict(labels)
    train = [(t, toxic[d]) for d, t in docs if d in toxic and zlib.crc32(str(d).encode()) % 5]
    model = toxicity.fit(train)
    docs = [(d, t) for d, t in docs if model.score([t])[0] < 0.5]
    docs = one_of_each(docs)
    docs = [(d, t) for d, t in docs if not any(10 * distance(plain(x), plain(t)) <= len(plain(x)) for x in items)]
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    out = []
    for d, t in docs:
        ids = tokenizer.encode(redacted(t) or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((d, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def made():
    rng = random.Random(6)
    words = ["river", "stone", "cloud", "walk", "green", "table", "seven", "light", "paper", "ocean", "music", "bread", "window", "garden", "silver"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    items = [text(6), text(9), "E = mc2"]
    docs, labels = [], []
    for i in range(150):
        bad = rng.random() < 0.2
        t = text(rng.randint(5, 40)) + (" " + " ".join(rng.choice(["zorg", "blarg", "fnord"]) for _ in range(3)) if bad else "")
        docs.append((i, t))
        labels.append((i, int(bad)))
    base = text(60)
    docs += [(200, base), (201, base), (202, base + " more"), (203, text(30) + " " + items[0]), (204, items[1].upper()), (205, "see E = MC2"), (206, "password = hunter22222 and " + text(8)), (207, "é ñ 漢字 " + text(5))]
    docs += [(208, None), (209, ""), (210, ""), (None, "alone " + text(12)), (211, "x " * 5000), (212, "zorg blarg fnord")]
    return docs, labels, items


def test_run_equals_plain_stages(spark, tmp_path):
    docs, labels, items = made()
    saved(documents(spark, [t for _, t in docs], [d for d, _ in docs]).repartition(4), tmp_path)
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = expected(docs, labels, items)
    assert sorted((tuple(r) for r in got), key=repr) == want and 100 < len(want) < len(docs) - 20


def test_run_on_empty_tables(spark, tmp_path):
    saved(documents(spark, []), tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
