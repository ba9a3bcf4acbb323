"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct sets of word shingles (equal sets are one row), columns are
shingles. A pair of rows with similarity t or more shares a column among the first n - ceil(t * n) + 1 of each
row's n columns, for any one order of columns; taking rare columns first leaves few rows a column. The product is
taken in blocks: a block holds some rows of each column (its hubs) against all rows of the column, pairs whose
sizes or components rule them out are discarded, and what is left accumulates overlap counts over whole rows.
The sizes are those of the sets, of their columns that no other row has, and the parities of 256 blocks of the
other columns: a block of odd parity in the difference holds a column that only one row has, so
J <= (n_a + n_b - d) / (n_a + n_b + d), where d counts those blocks and the columns of one row alone.
Rows linked to a hub are of its component and need no more pairs with each other, so a large group of near copies
costs one block; blocks go on with twice as many hubs until every column holds rows of one component only.

Defined results: a null text counts as empty; a document without words has the empty set, is linked with nothing
and forms its own component; repeated rows give a row each; a document without a doc_id gets the least doc_id that
it is linked with, else null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm.components import components
from deltaloom.llm.exchange import Batch, Corpus, groups, pack, release, unpack
from deltaloom.llm.kernels import U, mix, words_of
from deltaloom.session import discard, shared_dir, staged
from deltaloom.sources.tables import table

#: Words in a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 3, 90
KEY_BITS = 48
#: Pairs whose columns a worker holds at once.
OVERLAP_ROWS = 256


def shingle_sets(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the first of each text (one longer)."""
    w = words_of(texts)
    h, inside = w.windows(length)
    at = np.flatnonzero(inside)
    doc, key = w.doc[at], h[at]
    n_words = np.diff(w.first)
    for short in range(1, length):  # the whole sequence as one shingle
        rows = np.flatnonzero(n_words == short)
        if len(rows):
            doc = np.concatenate((doc, rows.astype(doc.dtype)))
            key = np.concatenate((key, w.windows(short)[0][w.first[rows]]))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def signatures(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that tell the sets apart, as two columns."""
    out = np.empty((len(first) - 1, 2), U)
    with np.errstate(over="ignore"):
        for j, salt in enumerate((U(0x51ED270B), U(0xB492B66FBE98F273))):
            total = np.concatenate((np.zeros(1, U), np.cumsum(mix(keys ^ salt), dtype=U)))
            out[:, j] = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U))
    return out


def _classes(sig: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first text of each distinct set that isn't empty."""
    found = np.unique(np.ascontiguousarray(sig).view("V16").ravel(), return_index=True)[1] if len(sig) else np.empty(0, np.int64)
    return np.sort(found[sizes[found] > 0])


def _rows_of(keys: np.ndarray, first: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some texts and which text each belongs to."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mine = np.isin(doc, reps)
    return keys[mine], doc[mine]


def _ask_frequency(batch: Batch, length: int) -> tuple[np.ndarray, np.ndarray]:
    keys, first = shingle_sets(batch.texts, length)
    reps = _classes(signatures(keys, first), np.diff(first))
    found, n = np.unique(_rows_of(keys, first, reps)[0] >> U(64 - KEY_BITS), return_counts=True)
    return found, n.astype("u4")


def _magnitude(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray]:
    """Bits of the number of rows that hold a column: 1 for one row, 2 for 2 or 3, and so on."""
    order, at, number = groups(keys)
    if not len(keys):
        return (np.empty(0, np.uint8),)
    total = np.add.reduceat(values[order].astype(np.int64), at)
    return ((np.floor(np.log2(total)) + 1).astype(np.uint8)[number],)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


#: Names of the bound's columns: columns of no other row, and parities of 4 * 64 blocks of the rest.
SIZES = ("alone", "p0", "p1", "p2", "p3")


def _parities(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """64 parity bits a text in each of four columns."""
    block = (mix(keys) >> U(56)).astype(np.int64)
    odd = (np.bincount(doc * 256 + block, minlength=n_docs * 256) & 1).astype(np.uint8).reshape(n_docs, 4, 64)
    return [np.packbits(odd[:, j], axis=1).view(">i8").ravel().astype(np.int64) for j in range(4)]


def _parts(corpus: Corpus, length: int, percent: int) -> DataFrame:
    """kind 0: doc_id, sig and n of each document; kind 1: sig, n, the columns of its prefix that other rows may
    share, and all columns, for each row that has such columns."""
    answers = corpus.ask(lambda b: _ask_frequency(b, length), _magnitude, "u4", "u1", key_bits=KEY_BITS)

    def rows(_: int, batch: Batch, magnitude: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, first = shingle_sets(batch.texts, length)
        sizes, sig = np.diff(first), signatures(keys, first)
        names = [s.tobytes() for s in sig]
        reps = _classes(sig, sizes)
        mine, doc = _rows_of(keys, first, reps)
        short = mine >> U(64 - KEY_BITS)
        level = magnitude[np.searchsorted(np.unique(short), short)] if len(mine) else np.empty(0, np.uint8)
        order = np.lexsort((mine, level, doc))
        start = np.searchsorted(doc, np.arange(len(sizes) + 1))
        rank = np.empty(len(mine), np.int64)
        rank[:] = np.arange(len(mine)) - start[doc[order]] if len(mine) else 0
        chosen = order[(rank < prefix_length(sizes, percent)[doc[order]]) & (level[order] > 1)]
        by_doc = np.split(mine[chosen].view(np.int64), np.searchsorted(doc[chosen], np.arange(1, len(sizes)))) if len(sizes) else []
        shared = [i for i in reps.tolist() if len(by_doc[i])]
        none, n = [None] * len(names), len(names)
        several = level > 1
        bounds = [np.bincount(doc[~several], minlength=n), *_parities(mine[several], doc[several], n)]
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([0] * n + [1] * len(shared), pa.int32()),
                "doc_id": pa.concat_arrays([batch.id_column(), pa.array([None] * len(shared), pa.int64())]),
                "sig": pa.array(names + [names[i] for i in shared], pa.binary()),
                "n": pa.array([*sizes.tolist(), *sizes[shared].tolist()], pa.int64()),
                **{c: pa.array([*none, *x[shared].tolist()], pa.int64()) for c, x in zip(SIZES, bounds, strict=True)},
                "prefix": pa.array(none + [by_doc[i] for i in shared], pa.list_(pa.int64())),
                "keys": pa.array(none + [pack(np.diff(keys[first[i] : first[i + 1]], prepend=U(0))) for i in shared], pa.binary()),
            }
        )

    schema = "kind int, doc_id long, sig binary, n long, " + "".join(f"{c} long, " for c in SIZES) + "prefix array<long>, keys binary"
    out = staged(corpus.map(rows, schema, ((answers, "u1"),)), "incidence", ["kind"])
    discard(answers)
    corpus.close()
    return out


def _overlaps(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b with both rows' columns, those that are similar enough. Rows a of a block are taken one by
    one, and the overlaps with all its rows b are counted at once."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lambda raw, n: np.cumsum(unpack(raw, n, U), dtype=U)
        for whole in found:
            for at in range(0, len(whole), OVERLAP_ROWS):
                part = whole.slice(at, OVERLAP_ROWS).to_pydict()
                block: dict[bytes, list[int]] = {}
                for i, a in enumerate(part["a"]):
                    block.setdefault(a, []).append(i)
                linked = []
                for mine in block.values():
                    row = keys(part["keys_a"][mine[0]], part["n_a"][mine[0]])
                    others = [keys(part["keys_b"][i], part["n_b"][i]) for i in mine]
                    sizes = np.array([len(x) for x in others])
                    column = np.concatenate(others)
                    hit = row[np.minimum(np.searchsorted(row, column), len(row) - 1)] == column
                    overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
                    enough = 100 * overlap >= percent * (len(row) + sizes - overlap)
                    linked += [i for i, e in zip(mine, enough.tolist(), strict=True) if e]
                yield pa.RecordBatch.from_pydict({"u": pa.array([part["a"][i] for i in linked], pa.binary()), "v": pa.array([part["b"][i] for i in linked], pa.binary())})
                del part, block
                release()

    return pairs.select("a", "b", "n_a", "n_b", "keys_a", "keys_b").mapInArrow(count, "u binary, v binary")


def jaccard_components(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    spark = docs.sparkSession
    corpus = Corpus(docs, lower=True)
    parts = _parts(corpus, length, percent)
    members = parts.filter("kind = 0").select("doc_id", "sig", "n")
    sets_name = f"deltaloom_{uuid.uuid4().hex}"
    incident = parts.filter("kind = 1")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    incident.groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).write.option("path", f"{shared_dir(spark)}/staged/{sets_name}").option("compression", "uncompressed").bucketBy(
        tasks, "sig"
    ).saveAsTable(sets_name)
    sets = spark.table(sets_name)
    sets._staged_at, sets._staged_as = f"{shared_dir(spark)}/staged/{sets_name}", sets_name
    entries = staged(incident.select(F.explode("prefix").alias("column"), "sig", "n", *SIZES).distinct().withColumn("comp", F.col("sig")), "entries")
    discard(parts, "kind=1")
    read = entries  # the staged table that entries are read from
    links, tested, labels, hubs_a_column = None, None, None, 1
    while True:
        open_columns = entries.groupBy("column").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("alone", "n", "sig")).alias("hub")).filter("low <> high")
        entries = staged(entries.join(open_columns.select("column", "hub"), "column"), "open")
        discard(read)
        read = entries
        if not entries.take(1):
            break
        if hubs_a_column == 1:
            marked = entries.withColumn("is_hub", F.col("sig") == F.col("hub.sig"))
        else:  # few columns are left, none with a large group of one component alone
            marked = entries.withColumn("is_hub", F.row_number().over(Window.partitionBy("column").orderBy("alone", "n", "sig")) <= hubs_a_column)
        marked = staged(marked.drop("hub"), "marked")
        discard(read)
        read = marked
        hubs = marked.filter("is_hub").select("column", F.col("sig").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), *[F.col(c).alias(f"hub_{c}") for c in SIZES])
        differ = "(alone + hub_alone + " + " + ".join(f"bit_count({c} ^ hub_{c})" for c in SIZES[1:]) + ")"
        near = f"sig <> hub AND comp <> hub_comp AND 100 * (n + hub_n - {differ}) >= {percent} * (n + hub_n + {differ})"
        pairs = marked.join(hubs, "column").filter(near).select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        whole = pairs.join(sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a")).hint("shuffle_merge"), "a").join(
            sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b")).hint("shuffle_merge"), "b"
        )
        found = staged(_overlaps(whole, percent), "linked")
        entries = marked.filter(~F.col("is_hub")).drop("is_hub")
        if found.take(1):
            links = found if links is None else links.union(found)
            labels = staged(components(links), "labels")
            entries = entries.drop("comp").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("column", "sig", "n", *SIZES, F.coalesce("component", "sig").alias("comp"))
        hubs_a_column *= 2
    discard(read)
    discard(sets)
    out = _answer(members, labels)
    discard(parts)
    return out


def _answer(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    least = members.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        named = least.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        of_component = named.groupBy("component").agg(F.min("least").alias("component_id"))
        least = named.join(of_component, "component").select("sig", "component_id")
    else:
        least = least.withColumnRenamed("least", "component_id")
    out = members.join(least, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return staged(out, "components")



def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of similarity 0.9 over distinct 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS copy, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT copy, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
  FROM docs, range(1, greatest(1, len(w) - {SHINGLE - 2}) + CASE WHEN len(w) BETWEEN 1 AND {SHINGLE - 1} THEN 1 ELSE 0 END) AS r(i)),
sizes AS (SELECT copy, count(*) AS n FROM shingles GROUP BY copy),
links AS (SELECT a.copy AS u, b.copy AS v FROM shingles a JOIN shingles b USING (s) JOIN sizes x ON x.copy = a.copy JOIN sizes y ON y.copy = b.copy
  GROUP BY a.copy, b.copy, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
reached(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
least AS (SELECT u AS copy, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.copy = r.v GROUP BY u)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, CASE WHEN sizes.n > 0 THEN component_id ELSE doc_id END AS component_id
FROM docs LEFT JOIN sizes USING (copy) LEFT JOIN least USING (copy)"""
