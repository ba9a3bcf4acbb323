"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters with at most k edits keeps m - q + 1 - k * q of its q-grams, on diagonals (place in the
text less place in the item) that differ by k at most. So shared q-grams are counted for each text and item in
overlapping bands of diagonals twice k + 1 wide; bands that meet the bound are kept, and a banded alignment finds
the least number of edits there. q is Q, or what leaves a bound of one for a short item: m / (k + 1); an item
without edits that is shorter than Q is a q-gram itself. Items come in blocks of bounded bytes, and one scan of all
texts takes BLOCKS_A_SCAN of them.

Texts are compared in lower case, with runs of white space as one space, as UTF-8 bytes; edits count bytes.

Defined results: a null text counts as empty; items that are null or only white space match nothing; texts of any
length are taken whole; repeated rows and items give a row each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from deltaloom.llm.kernels import U
from deltaloom.session import ship_package
from deltaloom.sources.tables import table

#: Bytes in a q-gram at most (one machine word), edits in a hundred bytes, bytes of items in a block, blocks in a scan.
Q, PERCENT, BLOCK_BYTES, BLOCKS_A_SCAN = 8, 10, 2 << 20, 8
TABLE_BITS = 22


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass").replace(b"\0", b" ")


def budget(m: int, percent: int = PERCENT) -> int:
    return m * percent // 100


def gram_bytes(m: int, percent: int = PERCENT) -> int:
    """Bytes in the q-grams of an item of m bytes, so that a match shares one at least."""
    return max(1, min(Q, m // (budget(m, percent) + 1)))


def words8(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place of a buffer on as a number, zeros after its end."""
    return np.ndarray((len(buffer),), "<u8", buffer + bytes(8), 0, (1,)).astype(U)


def grams(buffer: bytes, q: int) -> np.ndarray:
    """The q bytes from each place of a buffer on, as far as there are q, as a number."""
    return cut(words8(buffer)[: max(0, len(buffer) - q + 1)], q)


def cut(code: np.ndarray, q: int) -> np.ndarray:
    return code if q == 8 else code & U((1 << 8 * q) - 1)


@dataclass
class Block:
    """Items of one gram length and where each q-gram stands in them."""

    q: int
    ids: list
    items: list[bytes]
    edits: np.ndarray
    least: np.ndarray  # q-grams that a match shares
    codes: np.ndarray  # sorted, with item and place
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray

    @classmethod
    def of(cls, q: int, rows: list[tuple], percent: int) -> Block:
        items = [t for _, t in rows]
        code = [grams(t, q) for t in items]
        codes = np.concatenate(code)
        item = np.repeat(np.arange(len(items)), [len(c) for c in code])
        place = np.concatenate([np.arange(len(c)) for c in code])
        order = np.argsort(codes, kind="stable")
        edits = np.array([budget(len(t), percent) for t in items], np.int64)
        sizes = np.array([len(t) for t in items], np.int64)
        present = np.zeros(1 << TABLE_BITS, bool)
        present[slot(codes)] = True
        return cls(q, [i for i, _ in rows], items, edits, np.maximum(sizes - q + 1 - edits * q, 1), codes[order], item[order], place[order], present)


def blocks_of(rows: Iterable[tuple], percent: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most block_bytes of items, or of one item."""
    open_: dict[int, tuple[list, int]] = {}
    for i, text in rows:
        item = normal(text)
        if not item:
            continue
        q = gram_bytes(len(item), percent)
        mine, size = open_.get(q, ([], 0))
        if mine and size + len(item) > block_bytes:
            yield Block.of(q, mine, percent)
            mine, size = [], 0
        mine.append((i, item))
        open_[q] = mine, size + len(item)
    for q, (mine, _) in sorted(open_.items()):
        yield Block.of(q, mine, percent)


def slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * U(0x9E3779B97F4A7C15)) >> U(64 - TABLE_BITS)).astype(np.int64)


def regions(code: np.ndarray, offsets: np.ndarray, block: Block) -> list[tuple[int, int, int]]:
    """Text, item, and first diagonal of each band that shares enough q-grams. code: eight bytes from each place of the
    texts, joined by a zero byte; offsets: where each text starts."""
    code = cut(code, block.q)
    at = np.flatnonzero(block.present[slot(code)])
    low, high = np.searchsorted(block.codes, code[at], "left"), np.searchsorted(block.codes, code[at], "right")
    n = high - low
    at, low, n = at[n > 0], low[n > 0], n[n > 0]
    if not len(at):
        return []
    entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    where = np.repeat(at, n)
    item = block.item[entry]
    doc = np.searchsorted(offsets, where, "right") - 1
    longest = max(map(len, block.items))
    diagonal = where - offsets[doc] - block.place[entry] + longest  # never below 0
    cell = diagonal // (block.edits[item] + 1)
    key, count = np.unique(((doc * len(block.items) + item) << 32) + cell, return_counts=True)
    follows = np.zeros(len(key), bool)
    follows[:-1] = key[1:] == key[:-1] + 1
    both = count.copy()
    both[:-1] += np.where(follows[:-1], count[1:], 0)
    pair = key >> 32
    good = both >= block.least[pair % len(block.items)]
    cells = key & 0xFFFFFFFF
    return [(int(p // len(block.items)), int(p % len(block.items)), int(c * (block.edits[p % len(block.items)] + 1) - longest)) for p, c in zip(pair[good], cells[good], strict=True)]


def aligned(text: bytes, item: bytes, first: int, edits: int, most: int) -> tuple[int, int]:
    """Least edits between the item and a stretch of text on the band's diagonals, and where such a stretch ends; beyond
    `most` edits, any number that is more. edits: the item's budget, which the band's width comes from."""
    low, high = first - edits, first + 2 * (edits + 1) + edits
    start = max(0, low)
    exact = text.find(item, start, max(0, high) + len(item))
    if exact >= 0:
        return 0, exact + len(item)
    width = high - low + 1
    pad = np.zeros(width + len(item) + 1, np.uint8)
    own = np.frombuffer(text, np.uint8)[start : max(start, low + len(pad))]
    pad[start - low : start - low + len(own)] = own
    row, steps = np.zeros(width, np.int64), np.arange(width)
    for i, c in enumerate(item):
        step = row + (pad[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
        if i % 16 == 15 and row.min() > most:  # the least of a row never falls again
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), max(0, min(len(text), low + best + len(item)))


def matches(texts: list[bytes], blocks: list[Block]) -> list[tuple]:
    """Text, item's id, edits and end of the best match, for each text and item within the item's budget."""
    code = words8(b"\0".join(texts) + b"\0")
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    out = []
    for block in blocks:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, first in regions(code, offsets, block):
            most = best.get((d, i), (int(block.edits[i]), 0))[0]
            if (d, i) in best and not most:
                continue
            found = aligned(texts[d], block.items[i], first, int(block.edits[i]), most)
            if found[0] <= most and ((d, i) not in best or found < best[d, i]):
                best[d, i] = found
        out += [(d, block.ids[i], e, end) for (d, i), (e, end) in best.items()]
    return out


def _scans(docs: DataFrame, benchmark: DataFrame, percent: int, block_bytes: int) -> Iterator[list[Block]]:
    """The blocks of each scan, one at least."""
    ship_package(docs.sparkSession)
    rows = (tuple(r) for r in benchmark.filter("text IS NOT NULL").select("item_id", "text").toLocalIterator())
    blocks = list(blocks_of(rows, percent, block_bytes))
    for at in range(0, max(1, len(blocks)), BLOCKS_A_SCAN):
        yield blocks[at : at + BLOCKS_A_SCAN]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item. Rows are judged where they lie, so none moves."""
    at = docs.columns.index("text")
    for blocks in _scans(docs, benchmark, percent, block_bytes):
        docs = docs.mapInArrow(_kept(blocks, at), docs.schema)
    return docs


def _kept(blocks: list[Block], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                part = whole.slice(first, 256)
                texts = part.column(at)
                keep = np.ones(len(part), bool)
                keep[[f[0] for f in matches([normal(t) for t in texts.to_pylist()], blocks)]] = False
                yield part.filter(pa.array(keep | ~np.array(texts.is_valid().to_numpy(zero_copy_only=False), bool)))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits and match_end (bytes of the normalized text): a row for each document and item in it.

    The driver holds the items, and a task those of one scan: BLOCKS_A_SCAN * block_bytes, if no item is longer."""
    ids = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {ids.simpleString()}, edits int, match_end long"
    out = None
    for blocks in _scans(docs, benchmark, percent, block_bytes):
        found = docs.select("doc_id", "text").mapInArrow(_scan(blocks, to_arrow_type(ids)), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _scan(blocks: list[Block], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                texts = [normal(t) for t in part.column(1).to_pylist()]
                found = matches(texts, blocks)
                columns = [part.column(0).take(pa.array([f[0] for f in found], pa.int64())), *[pa.array([f[j] for f in found], t) for j, t in ((1, item_type), (2, pa.int32()), (3, pa.int64()))]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "edits", "match_end"])

    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item with at most a tenth of its bytes edited."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
