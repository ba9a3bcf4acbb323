"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once on each text; the ledger row holds the measurements and one failure bit a rule, and the
ledger is stored as a table. A policy is a versioned mask of rules: applying one, or finding what each rule alone
removes, reads the stored bits only and no text.

Defined results: a null text counts as empty, and a text without words fails for too few words; repeated rows get
a row each; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.kernels import by_doc, encoded, in_doc_sums, mix, spread, words_of
from deltaloom.session import ship_package, staged
from deltaloom.sources.tables import table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
RULES_VERSION = 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_stutter")

#: Rules by bit: name and the condition on the measurements under which a text fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("shouting", "n_letters > 0 AND 100 * n_upper > 50 * n_letters"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("exclamations", "100 * n_marks > 50 * n_words"),
    ("stutter", "100 * n_stutter > 30 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """The rules that a text must not fail."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    "base": Policy("base", 1, BASE_RULES),
    "strict": Policy("strict", 1, tuple(name for name, _ in RULES)),
}


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """MEASURES of each text."""
    w = words_of(texts)
    n_words = np.diff(w.first)
    lead = (w.buffer & 0xC0) != 0x80
    space = np.isin(w.buffer, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    symbols = np.isin(w.buffer, np.frombuffer(SYMBOLS, np.uint8))
    upper = (w.buffer >= 65) & (w.buffer <= 90)
    lower = (w.buffer >= 97) & (w.buffer <= 122)
    h, inside = w.windows(WINDOW)
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):  # the same windows of two texts differ
        key = mix(h[at] + (w.doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = spread(at[twice], WINDOW, len(w.hashes))
    stutter = np.zeros(len(w.hashes), bool)
    stutter[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    n_lines, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return [
        n_words,
        in_doc_sums(lead & ~space, texts),
        in_doc_sums(symbols, texts),
        n_dup,
        by_doc(repeated, w.first),
        n_lines,
        in_doc_sums(upper | lower, texts),
        in_doc_sums(upper, texts),
        in_doc_sums(w.buffer == ord("!"), texts),
        by_doc(stutter, w.first),
    ]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits and rules_version: one row a document."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                found = measure(encoded(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.astype(np.int64)) for x in found]], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)), F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits).withColumn("rules_version", F.lit(RULES_VERSION))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of all documents, written to the shared folder."""
    return staged(ledger(docs), "quality-ledger")


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: the documents that fail it, that fail it alone, and that the policy would keep
    without it. One pass over the bits gives all rules' counts."""
    mine = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = rows.agg(
        *[count(bits.bitwiseAND(F.lit(1 << i)) != 0).alias(f"fail{i}") for i, _ in mine],
        *[count(bits == F.lit(1 << i)).alias(f"only{i}") for i, _ in mine],
        count(bits == 0).alias("kept"),
    )
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"fail{i}").alias("n_fail"), F.col(f"only{i}").alias("n_only"), (F.col("kept") + F.col(f"only{i}")).alias("n_kept_without")) for i, name in mine])
    return sums.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.inline(each))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under the strict policy."""
    rows = stored(table(spark, sf_dir, "documents"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), passes(POLICIES["strict"]).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, from one stored ledger of all documents."""
    rows = stored(table(spark, sf_dir, "documents"))
    return ablations(rows, POLICIES["base"]).unionAll(ablations(rows, POLICIES["strict"]))


_SPLIT = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
MEASURED = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS copy, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, {_SPLIT} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\x0B\\f\\r]')) AS lines FROM docs),
windows AS (SELECT copy, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS w FROM split, range(1, greatest(1, len(words) - {WINDOW - 2})) AS r(i)),
twice AS (SELECT copy, i FROM (SELECT copy, i, count(*) OVER (PARTITION BY copy, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT copy, count(DISTINCT i + o) AS n FROM twice, range(0, {WINDOW}) AS r(o) GROUP BY copy),
measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter
  FROM split LEFT JOIN covered USING (copy))"""
ORACLE = f"""{MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {" OR ".join(f"({fails})" for name, fails in RULES if name in BASE_RULES)} AS base_failed,
       NOT ({" OR ".join(f"({fails})" for _, fails in RULES)}) AS kept
FROM measured"""


def _ablation_sql(policy: Policy) -> str:
    mine = [(name, fails) for name, fails in RULES if name in policy.rules]
    any_ = lambda some: " OR ".join(f"({f})" for f in some) or "false"
    return " UNION ALL ".join(
        f"SELECT '{policy.name}' AS policy, {policy.version} AS version, '{name}' AS rule, count(*) FILTER ({fails}) AS n_fail, "
        f"count(*) FILTER (({fails}) AND NOT ({any_(f for n, f in mine if n != name)})) AS n_only, "
        f"count(*) FILTER (NOT ({any_(f for n, f in mine if n != name)})) AS n_kept_without FROM measured"
        for name, fails in mine
    )


ABLATION_ORACLE = f"{MEASURED} " + " UNION ALL ".join(_ablation_sql(p) for p in POLICIES.values())
