"""Substring dedup by level-wise doubling.

A window of words that occurs in two documents holds shorter windows that do. So the lengths are taken level by
level: windows repeated at one length alone are extended to twice that length, until no candidates survive. The first
level takes windows of 7 words, and of those only the anchors: in each window of 13 words the one of least hash. Equal
windows of 13 words have equal anchors at the same place, so nothing is lost, and only a quarter of all places is
sent. The level of 13 decides which words go; those of 26, 52, ... extend its repeated windows, in the batches that
still have any, to tell how long a document's longest repeated passage is.

Anchors are known by 48 bits and only choose candidates. Windows are known by 128 bits, made from the 64-bit hashes
of their words.

Defined results: a null text counts as empty; a document without a doc_id is later than all others, and such documents
don't remove each other's words; repeated rows are of one document, so they don't either; texts of any length are taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.exchange import Batch, Batches, Corpus, groups, pack_all, packed_question, replied, unpack_all
from deltaloom.llm.kernels import PLACE, U, Words, by_doc, mix, spread, words_of
from deltaloom.session import discard, staged
from deltaloom.sources.tables import table

#: The asked length, and the first level: twice it is the asked length or more.
LENGTH, FIRST = 13, 7
ANCHOR_BITS = 48


def anchors(w: Words, length: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of length words: whether it lies in one text, and the key of its anchor."""
    h, _ = w.windows(first)
    n = len(w.hashes) - length + 1
    if n <= 0:
        return np.empty(0, bool), np.empty(0, U)
    least = h[:n].copy()
    for j in range(1, length - first + 1):
        np.minimum(least, h[j : j + n], out=least)
    return w.doc[:n] == w.doc[length - 1 :], least >> U(64 - ANCHOR_BITS)


def windows(words: Words, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes at each word of the window that starts there, and whether it lies in one text. length is base doubled
    some times; the hashes of twice a length are made from those of its halves."""
    key, _ = words.windows(base)
    if not len(key):
        return key, key, np.empty(0, bool)
    with np.errstate(over="ignore"):
        check, other = np.zeros(len(key), U), mix(words.hashes ^ PLACE[255])
        for j in range(base):
            check += other[j : j + len(key)] * PLACE[100 + j % 100]
        have = base
        while have < length:
            n = max(0, len(key) - have)
            key, check = (mix(h[:n] * PLACE[201] + mix(h[len(h) - n :] + U(have)) * PLACE[202]) for h in (key, check))
            have *= 2
    n = len(key)
    return key, check, words.doc[:n] == words.doc[length - 1 : length - 1 + n]


ENTRY = "low:i8,several:u1,unknown:u1,check:u8"


def _ranks(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The place of each document in the order of ids, those without one last and alike; and a document of each place."""
    order = np.lexsort((batch.ids, ~batch.known))
    ids, known = batch.ids[order], batch.known[order]
    new = np.ones(len(order), bool)
    new[1:] = (known[1:] != known[:-1]) | (known[1:] & (ids[1:] != ids[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def _by_both(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and check, the first place of each distinct pair in it, and the number of the pair at each place."""
    order = np.argsort(key)
    one, two = np.diff(key[order]) != 0, np.diff(check[order]) != 0
    if (two & ~one).any():  # one key for two windows
        order = np.lexsort((check, key))
        one, two = np.diff(key[order]) != 0, np.diff(check[order]) != 0
    new = np.concatenate(([True], one | two))
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _entries(batch: Batch, key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order, what is asked of each, the number of the window at each place, and whether an earlier
    document of the batch has it."""
    out = np.empty(0, [tuple(x.split(":")) for x in ENTRY.split(",")])
    if not len(key):
        return key, out, np.empty(0, np.int64), np.empty(0, bool)
    rank, where = _ranks(batch)
    order, at, number = _by_both(key, check)
    own = rank[doc]
    low, high = np.minimum.reduceat(own[order], at), np.maximum.reduceat(own[order], at)
    out = np.empty(len(at), out.dtype)
    out["low"], out["unknown"], out["several"], out["check"] = batch.ids[where[low]], ~batch.known[where[low]], low != high, check[order][at]
    return key[order][at], out, number, low[number] < own


def _earlier(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray]:
    """1: an entry's least document isn't the least of all with its window; 2: the window is in two documents; 3: both."""
    if not len(keys):
        return (np.empty(0, np.uint8),)
    order, at, number = _by_both(keys, np.ascontiguousarray(values["check"]))
    known, limits = values["unknown"] == 0, np.iinfo(np.int64)
    low = np.minimum.reduceat(np.where(known, values["low"], limits.max)[order], at)
    high = np.maximum.reduceat(np.where(known, values["low"], limits.min)[order], at)
    some, all_ = np.maximum.reduceat(known[order], at), np.minimum.reduceat(known[order], at)
    several = (np.maximum.reduceat(values["several"][order], at) > 0) | (some & ~all_) | (some & (low < high))
    earlier = some[number] & (~known | (low[number] < values["low"]))
    return (earlier.astype(np.uint8) + 2 * several[number].astype(np.uint8),)


def _ask_anchors(batch: Batch, length: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    inside, key = anchors(words := words_of(batch.texts), length, first)
    at = np.flatnonzero(inside)
    order, start, _ = groups(key[at])
    if not len(at):
        return key[at], np.empty(0, np.uint8)
    doc = words.doc[at][order]
    return key[at][order][start], (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)).astype(np.uint8)


def _repeated(keys: np.ndarray, several: np.ndarray) -> tuple[np.ndarray]:
    """Entries whose key has an entry of another batch, or two rows in its own."""
    order, at, number = groups(keys)
    if not len(keys):
        return (several,)
    size = np.diff(np.append(at, len(keys)))
    return ((np.maximum.reduceat(several[order], at) > 0) | (size > 1))[number],


def _candidates(words: Words, length: int, first: int, answer: np.ndarray) -> np.ndarray:
    """Windows whose anchor is repeated."""
    inside, key = anchors(words, length, first)
    out = inside.copy()
    if len(answer):
        out[inside] = answer[np.unique(key[inside], return_inverse=True)[1]] > 0
    return np.flatnonzero(out)


def _found(batch: Batch, a1: np.ndarray, a2: np.ndarray, length: int, first: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, and for each window whether an earlier document has it and whether any other has."""
    words = words_of(batch.texts)
    at = _candidates(words, length, first, a1)
    key, check, _ = windows(words, length, length)
    _, _, number, before = _entries(batch, key[at], check[at], words.doc[at])
    earlier, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(at):
        earlier[at] = (a2[number] & 1 > 0) | before
        shared[at] = a2[number] & 2 > 0
    return words, earlier, shared


def _wide(words: Words, marks: np.ndarray, length: int) -> np.ndarray:
    """Places of windows of twice the length whose halves are both repeated."""
    n = max(0, len(words.hashes) - 2 * length + 1)
    return np.flatnonzero((marks[:n] > 0) & (marks[length : length + n] > 0) & (words.doc[:n] == words.doc[2 * length - 1 : 2 * length - 1 + n]))


class RepeatedWindows:
    """The windows of a length that documents share, found on a packed corpus."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, first: int = FIRST):
        if not first < length <= 2 * first:
            raise ValueError("the first level has to be shorter than length, and twice as long at least")
        self.length, self.first = length, first
        self.corpus = Corpus(docs)
        self.level1 = self.corpus.ask(lambda b: _ask_anchors(b, length, first), _repeated, "u1", "u1", key_bits=ANCHOR_BITS)

        def ask(batch: Batch, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = words_of(batch.texts)
            at = _candidates(words, length, first, a1)
            key, check, _ = windows(words, length, length)
            return _entries(batch, key[at], check[at], words.doc[at])[:2]

        self.level2 = self.corpus.ask(ask, _earlier, ENTRY, "u1", ((self.level1, "u1"),))
        self.answers = ((self.level1, "u1"), (self.level2, "u1"))

    def removed(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and kept_text."""
        length, first = self.length, self.first

        def rows(_: int, batch: Batch, a1: np.ndarray, a2: np.ndarray) -> Iterator[pa.RecordBatch]:
            words, earlier, _ = _found(batch, a1, a2, length, first)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.id_column(), **_kept(batch, words, earlier, length, True)})

        return self.corpus.map(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", self.answers)

    def with_longest(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and longest_repeat: the greatest of length, 2 * length, ... at which
        a window of the document is also in another one, 0 for none.

        A pass over the batches gives the marks of a level and asks for the next one. It leaves batches of the documents
        that still have repeated windows, which the next level reads; a document that has none left is done."""
        base, first, edges = self.length, self.first, self.corpus.edges(64)

        def first_level(number: int, batch: Batch, a1: np.ndarray, a2: np.ndarray) -> Iterator[pa.RecordBatch]:
            words, earlier, shared = _found(batch, a1, a2, base, first)
            n = len(batch.texts)
            yield _rows(2, {"batch": pa.array([number] * n, pa.int64()), "bucket": pa.array(range(n), pa.int64()), "doc_id": batch.id_column(), **_kept(batch, words, earlier, base, False)})
            yield from _level(number, batch, np.arange(n), words, shared, base, 0, base, edges)

        results, final = [], None
        level, length = self.corpus.derived_rows(self.corpus.map(first_level, LEVEL, self.answers), _alive), base
        discard(self.level1)
        discard(self.level2)
        while True:
            done = level.table.filter("kind IN (2, 3)").drop("blob", "keys", "vals")
            results.append(staged(done, "done"))
            if not level.table.filter("kind = 1").take(1):
                level.close()
                break
            level, length = self._double(level, length, edges), 2 * length
        for rows in results:
            mine = rows.filter("kind = 3").select("batch", "bucket", "longest_repeat")
            final = mine if final is None else final.unionAll(mine)
        return results[0].filter("kind = 2").drop("longest_repeat").join(final, ["batch", "bucket"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat")

    def _double(self, level: Batches, length: int, edges: np.ndarray) -> Batches:
        answers = replied(level.table.filter("kind = 1").select("batch", "bucket", "n", "keys", "vals"), level.tasks, _earlier, ENTRY, "u1")
        base, twice = self.length, 2 * length

        def next_level(number: int, held: dict[str, np.ndarray], answer: np.ndarray) -> Iterator[pa.RecordBatch]:
            batch = _batch_of(held)
            words = words_of(batch.texts)
            at, (_, _, which, _) = _next(batch, words, held["marks"], base, length)
            now = np.zeros(max(0, len(words.hashes) - twice + 1), bool)
            now[at] = answer[which] & 2 > 0
            yield from _level(number, batch, held["place"], words, now, base, length, twice, edges)

        out = self.corpus.derived_rows(level.map(next_level, LEVEL, ((answers, "u1"),), "inner", "kind = 0"), _alive)
        discard(answers)
        level.close()
        return out


def _kept(batch: Batch, words: Words, earlier: np.ndarray, length: int, with_text: bool) -> dict[str, pa.Array]:
    gone = spread(np.flatnonzero(earlier), length, len(words.hashes))
    n_gone = by_doc(gone, words.first)
    kept = []
    for i, text in enumerate(batch.texts):
        own = text.split()
        if n_gone[i]:
            own = compress(own, (~gone[words.first[i] : words.first[i + 1]]).tolist())
        kept.append(b" ".join(own))
    out = {"n_words": pa.array(np.diff(words.first).astype(np.int64)), "n_removed": pa.array(n_gone.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
    return out | ({"kept_text": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())} if with_text else {})


#: Kind 0, a batch of the documents that have repeated windows. Kind 1, what is asked for the next level. Kind 2, a
#: document's result of the first level, bucket being its place in the batch. Kind 3, the longest of a document that is done.
LEVEL_COLUMNS = {
    "kind": pa.int32(), "batch": pa.int64(), "bucket": pa.int64(), "n": pa.int64(), "blob": pa.binary(), "keys": pa.binary(), "vals": pa.binary(),
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "longest_repeat": pa.int64(),
}
LEVEL = ", ".join(f"{c} { {'int32': 'int', 'int64': 'long', 'binary': 'binary', 'string': 'string'}[str(t)] }" for c, t in LEVEL_COLUMNS.items())


def _rows(kind: int, found: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(found["batch"])
    found = found | {"kind": pa.array([kind] * n, pa.int32())}
    return pa.RecordBatch.from_pydict({c: found.get(c, pa.nulls(n, t)) for c, t in LEVEL_COLUMNS.items()})


def _alive(blob: bytes) -> dict[str, np.ndarray]:
    return unpack_all(blob)


def _batch_of(held: dict[str, np.ndarray]) -> Batch:
    ends = np.cumsum(held["size"], dtype=np.int64)
    raw = held["text"].tobytes()
    return Batch(held["id"], held["known"] > 0, [raw[e - n : e] for e, n in zip(ends.tolist(), held["size"].tolist(), strict=True)])


def _next(batch: Batch, words: Words, marks: np.ndarray, base: int, length: int) -> tuple:
    """Places of the candidates of twice the length, and their entries."""
    at = _wide(words, marks, length)
    key, check, _ = windows(words, base, 2 * length)
    return at, _entries(batch, key[at], check[at], words.doc[at])


def _level(number: int, batch: Batch, place: np.ndarray, words: Words, shared: np.ndarray, base: int, was: int, length: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a level leaves of the documents of a batch, which had all reached the length `was`. place: theirs in the batch."""
    marks = np.zeros(len(words.hashes), np.uint8)
    marks[: len(shared)] = shared
    hit = by_doc(marks, words.first) > 0
    reached = np.where(hit, length, was)
    entries = _next(batch, words, marks, base, length)[1]
    asked = packed_question(number, *entries[:2], edges)
    goes_on = hit if len(asked["batch"]) else np.zeros(len(hit), bool)
    done = np.flatnonzero(~goes_on)
    if len(done):
        yield _rows(3, {"batch": pa.array([number] * len(done), pa.int64()), "bucket": pa.array(place[done].astype(np.int64)), "longest_repeat": pa.array(reached[done].astype(np.int64))})
    if goes_on.any():
        left = np.flatnonzero(goes_on)
        texts = [batch.texts[i] for i in left.tolist()]
        blob = {
            "text": np.frombuffer(b"".join(texts), np.uint8), "size": np.array([len(t) for t in texts], np.uint32), "place": place[left].astype(np.uint32),
            "id": batch.ids[left], "known": batch.known[left].astype(np.uint8), "marks": marks[hit[words.doc]],
        }
        yield _rows(0, {"batch": pa.array([number], pa.int64()), "blob": pa.array([pack_all(blob)], pa.binary())})
        yield _rows(1, asked)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that windows of 13 words in earlier documents cover, and the length of the
    longest passage that each shares, in levels."""
    found = RepeatedWindows(table(spark, sf_dir, "documents"))
    out = staged(found.with_longest(), "kept")
    found.corpus.close()
    return out


def _levels_sql(levels: int) -> str:
    """Each level numbers its shared windows; the next one joins two of them."""
    out = []
    for k in range(1, levels):
        out.append(f"""pairs{k} AS (SELECT a.copy, a.doc, a.i, a.id AS x, b.id AS y FROM shared{k - 1} a JOIN shared{k - 1} b ON b.copy = a.copy AND b.i = a.i + {LENGTH << (k - 1)}),
shared{k} AS (SELECT copy, doc, i, dense_rank() OVER (ORDER BY x, y) AS id FROM pairs{k} JOIN (SELECT x, y FROM pairs{k} GROUP BY x, y HAVING count(DISTINCT doc) > 1) USING (x, y)),""")
    return "\n".join(out)


#: Levels that the SQL takes: up to 13 * 2 ** 11 words.
_SQL_LEVELS = 12
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS copy, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'none') AS doc,
  list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT copy, i, w[i] AS word FROM docs, range(1, len(w) + 1) AS r(i)),
windows AS (SELECT copy, doc_id, doc, i, array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ') AS k FROM docs, range(1, greatest(1, len(w) - {LENGTH - 2})) AS r(i)),
found AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k HAVING count(DISTINCT doc) > 1),
gone AS (SELECT DISTINCT copy, i + o AS i FROM windows JOIN found USING (k), range(0, {LENGTH}) AS r(o) WHERE low < coalesce(doc_id, low + 1)),
shared0 AS (SELECT copy, doc, i, dense_rank() OVER (ORDER BY k) AS id FROM windows JOIN found USING (k)),
{_levels_sql(_SQL_LEVELS)}
longest AS (SELECT copy, max(n) AS n FROM ({" UNION ALL ".join(f"SELECT DISTINCT copy, {LENGTH << k} AS n FROM shared{k}" for k in range(_SQL_LEVELS))}) GROUP BY copy),
kept AS (SELECT copy, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (copy, i) GROUP BY copy),
removed AS (SELECT copy, count(*) AS n FROM gone GROUP BY copy)
SELECT doc_id, len(w) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(longest.n, 0) AS longest_repeat
FROM docs LEFT JOIN kept USING (copy) LEFT JOIN removed USING (copy) LEFT JOIN longest USING (copy)"""
