import hashlib
import re

from helpers import clashing, documents, rows, saved
from pyspark.sql import functions as F

from deltaloom.llm import secrets

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
TEXTS = [
    None,
    "",
    "nothing here",
    'password = "hunter22" and TOKEN:abc and api_key=token:abcdefgh',
    "AKIA" + "Z" * 15 + " AKIA" + "Q" * 16 + "é ñ secret=AKIA" + "B" * 16,
    "é" * 50 + " " + "0123456789abcdef" * 2 + " f" * 30,
    "x token=" + "a" * 30 + " token=" + "a" * 30 + "\n",
    "secret: s3cr3t! " * 500,
    'password = "hunter22" and TOKEN:abc and api_key=token:abcdefgh',
]


def expected(text):
    text = text or ""
    found = [(m.start(), rank, name, m.end()) for rank, (name, p, g, n) in enumerate(KINDS) for m in p.finditer(text) if len(m.group(g)) >= n]
    found.sort()
    spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return *[sum(k == name for _, _, k, _ in found) for name, *_ in KINDS], hashlib.sha256(spans.encode()).hexdigest(), spans


def test_all_spans_of_awkward_texts(spark, tmp_path):
    df = clashing(documents(spark, TEXTS + TEXTS[3:4], [*range(len(TEXTS)), 3]))
    got = rows(secrets.op1_secret_scan(spark, saved(df, tmp_path)))
    assert got == sorted([(i, *expected(t)) for i, t in enumerate(TEXTS)] + [(3, *expected(TEXTS[3]))], key=repr)


def test_empty_table(spark, tmp_path):
    assert rows(secrets.op1_secret_scan(spark, saved(documents(spark, []), tmp_path))) == []


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    def versions(texts):
        return documents(spark, texts).select(secrets.blob_of(F.col("text")).alias("blob"), "text")

    path = f"file://{tmp_path}/ledger"
    ledger = secrets.SecretLedger(spark, path)
    ledger.ingest(versions(TEXTS[3:6]))
    assert ledger.rows().count() == 9
    ledger.ingest(versions(TEXTS[3:7]))
    assert ledger.rows().count() == 12  # three rules over the one new blob
    changed = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{30,}", 0, 30))
    newer = secrets.SecretLedger(spark, path, changed)
    assert newer.unseen(versions(TEXTS[3:7])).select("todo").distinct().collect() == [(["hex@2"],)]
    newer.ingest(versions(TEXTS[3:7]))
    assert newer.rows().count() == 16
    assert {s["kind"] for r in newer.findings().collect() for s in r["spans"] if s["kind"] == "hex" and s["end"] - s["start"] < 30} == set()


def test_redaction_replaces_each_stretch_once(spark):
    got = [r["text"] for r in secrets.redact_documents(documents(spark, TEXTS)).orderBy("doc_id").collect()]
    for text, out in zip(TEXTS, got, strict=True):
        if text is None:
            assert out is None
            continue
        hidden = set()
        for _, p, g, n in KINDS:
            for m in p.finditer(text):
                if len(m.group(g)) >= n:
                    hidden |= set(range(m.start(), m.end()))
        # spans that only touch are stretches of their own, but none touch in these texts
        kept = "".join("\0" if i in hidden else c for i, c in enumerate(text))
        assert out == re.sub("\0+", secrets.REDACTED, kept)


def test_a_ledger_written_twice_counts_once(spark):
    docs = documents(spark, ["password = hunter2222 and token=abcdefgh", None, "clean"])
    texts = docs.select(secrets.blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    ledger = secrets.SecretLedger(spark)
    ledger.ingest(texts)
    once = rows(ledger.findings())
    ledger.rows().write.mode("append").parquet(ledger.path)
    assert rows(ledger.findings()) == once and len(once) == 1


def test_redaction_bears_clashing_columns(spark):
    text = "my password = hunter2222 here"
    docs = documents(spark, [text, None, ""], [1, 2, None]).select("*", *[F.lit(7).alias(c) for c in ("blob", "spans", "clean", "_clean", "rank", "rule", "version", "_c0")])
    out = sorted((tuple(r) for r in secrets.redact_documents(docs).collect()), key=repr)
    assert secrets.redact_documents(docs).columns == docs.columns
    assert [r[1] for r in out if r[0] == 1] == [f"my {secrets.REDACTED} here"] and all(set(r[5:]) == {7} for r in out)
