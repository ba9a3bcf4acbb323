"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is stored once under its SHA-256 (the blob). A ledger row says that one blob was
scanned by one version of one rule, and holds the spans found. An ingest scans only pairs of blob and rule
version that the ledger lacks, and findings are joined back to every path that ever held the blob.

Defined results: a null text counts as empty; repeated rows and equal texts share one blob and give one result
a row; an empty table gives an empty ledger; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.session import shared_dir, staged
from deltaloom.sources.tables import table


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has min_chars characters or more; rules are listed in order of rank."""

    name: str
    version: int
    pattern: str
    group: int
    min_chars: int


# The patterns of the three kinds. A run of hex digits, or of key characters after AKIA, that is
# too short holds no long enough match either, so these two state their least length in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"
REDACTED = "[SECRET]"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class SecretLedger:
    """A ledger in one folder that driver and executors share; each ingest appends to it.

    An append that was cut off and made again, or two ingests at a time, may leave a pair of blob and rule version twice;
    both rows say the same, and reading folds them."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.path = path or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
        self._empty().write.mode("append").parquet(self.path)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], LEDGER)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, texts: DataFrame) -> DataFrame:
        """Each blob once, with the rules whose present version has not scanned it."""
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.rows().groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))
        mine = F.array(*[F.lit(f"{r.name}@{r.version}") for r in self.rules])
        return (
            blobs.join(known, "blob", "left")
            .withColumn("todo", F.array_except(mine, F.coalesce("known", F.array().cast("array<string>"))))
            .filter(F.size("todo") > 0)
            .drop("known")
        )

    def scan(self, blobs: DataFrame) -> DataFrame:
        """Ledger rows for blobs with todo rules.

        Between the matches lie the pieces that a split gives, so the ends of matches are running sums of
        lengths; they are taken over exploded rows, in time linear in the number of matches.
        """
        rank = {r.name: i for i, r in enumerate(self.rules)}
        found = blobs.select(
            "blob",
            "text",
            *[
                F.when(F.array_contains("todo", f"{r.name}@{r.version}"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{rank[r.name]}")
                for r in self.rules
            ],
        )

        def matches(r: Rule) -> Column:
            """Of one rule: for each match the characters since the last one, its own, and whether it counts."""
            m = F.col(f"m{rank[r.name]}")
            part = m if r.group == 0 else F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
            each = F.zip_with(
                F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(m)),
                F.arrays_zip(m.alias("whole"), part.alias("part")),
                lambda gap, x: F.struct(
                    F.char_length(gap).alias("gap"),
                    F.char_length(x["whole"]).alias("n"),
                    (F.char_length(x["part"]) >= r.min_chars).alias("counts"),
                ),
            )
            none = F.array().cast("array<struct<gap:int,n:int,counts:boolean>>")
            return F.when(m.isNotNull(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(F.size(m) > 0, each).otherwise(none).alias("each")))

        by_rule = found.select("blob", F.explode(F.filter(F.array(*[matches(r) for r in self.rules]), lambda x: x.isNotNull())).alias("r"))
        each = by_rule.select("blob", "r.rule", "r.version", F.posexplode_outer("r.each").alias("i", "x"))
        end = F.sum(F.col("x.gap") + F.col("x.n")).over(Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        span = F.when(F.col("x.counts"), F.struct((F.col("end") - F.col("x.n")).cast("int").alias("start"), F.col("end").cast("int").alias("end")))
        return (
            each.withColumn("end", end)
            .groupBy("blob", "rule")
            .agg(F.first("version").alias("version"), F.sort_array(F.collect_list(span)).alias("spans"))
            .select("blob", "rule", "version", "spans")
        )

    def ingest(self, texts: DataFrame) -> None:
        """texts: blob and text of any number of versions, new or old."""
        self.scan(self.unseen(texts)).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """For each blob with findings of the present rules: kinds and spans by start, then by rank of the rule."""
        rank = F.create_map(*[F.lit(x) for i, r in enumerate(self.rules) for x in (r.name, i)])
        present = F.concat_ws("@", "rule", "version").isin([f"{r.name}@{r.version}" for r in self.rules])
        return (
            self.rows()
            .filter(present & (F.size("spans") > 0))
            .withColumn("rank", rank[F.col("rule")])
            .groupBy("blob")
            .agg(F.flatten(F.collect_set(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"))))).alias("spans"))
            .select("blob", F.sort_array("spans").alias("spans"))
        )

    def by_path(self, paths: DataFrame) -> DataFrame:
        """paths (any columns and blob) with the spans of their blob, an empty array where there are none.

        A blob that a third of all paths hold makes a skewed partition of the left side, which the join splits.
        """
        none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
        return paths.join(self.findings(), "blob", "left").withColumn("spans", F.coalesce("spans", none))


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(text: Column, spans: Column) -> Column:
    """text with each maximal stretch of overlapping spans replaced by REDACTED; spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        upto = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(REDACTED))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, upto).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))).otherwise(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with every secret replaced and n_chars counted anew where that changed the text; columns of any other
    name stay as they are."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name of a column can clash with the ledger's
    text = F.col(own["text"])
    keyed = docs.toDF(*own.values()).withColumn("blob", blob_of(text))
    ledger = SecretLedger(docs.sparkSession)
    ledger.ingest(keyed.select("blob", F.coalesce(text, F.lit("")).alias("text")))
    out = ledger.by_path(keyed).withColumn("_clean", redact(text, F.col("spans")))
    touched = F.size("spans") > 0
    now = {"text": F.when(touched, F.col("_clean")).otherwise(text), "n_chars": F.when(touched, F.char_length("_clean").cast("long")).otherwise(F.col(own.get("n_chars", own["text"])))}
    return out.select(*[now.get(c, F.col(x)).alias(c) for c, x in own.items()])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions of their path doc_id, ingested into a new ledger and joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ledger = SecretLedger(spark)
    ledger.ingest(docs.select(blob_of(F.col("text")).alias("blob"), "text"))
    paths = staged(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")
    found = ledger.by_path(paths)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.name).alias(f"n_{r.name}") for r in RULES],
        F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


_KIND_SQL = """
  SELECT doc_id, copy, '{name}' AS kind, {rank} AS rank,
         list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(whole, 1, i), lambda x: length(x))) AS upto,
         length(whole[i]) AS n, length(part[i]) AS part_n
  FROM (SELECT doc_id, copy, regexp_split_to_array(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}, 0) AS whole,
               regexp_extract_all(text, {pattern}, {group}) AS part FROM docs), range(1, 1 + len(whole)) AS r(i)
"""

ORACLE = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS copy FROM documents), hits AS ("
    + " UNION ALL ".join(
        f"SELECT * FROM ({_KIND_SQL.format(name=r.name, rank=i, pattern=chr(39) + r.pattern.replace(chr(39), chr(39) * 2) + chr(39), group=r.group)}) WHERE part_n >= {r.min_chars}"
        for i, r in enumerate(RULES)
    )
    + """), agg AS (
  SELECT copy, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(CAST(upto - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY upto - n, rank) AS spans
  FROM hits GROUP BY copy)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN agg USING (copy)"""
)
