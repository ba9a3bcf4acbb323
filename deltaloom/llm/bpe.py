"""BPE encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The most frequent words of the whole corpus are counted, encoded once by exact merging and compiled into a
shared-suffix automaton whose edge outputs add up to a word's number; the number leads to its ids. The automaton
is one file of sorted arrays: the driver writes it to the shared folder, Spark hands it to every executor, and
workers map it into memory. Words that it lacks are merged exactly, many at a time.

Counting uses a mergeable Misra-Gries summary in each task, so all texts count while memory stays bounded; the
lexicon only saves time, and no result depends on which words it holds.

Defined results: a null text counts as empty; an empty text has no tokens, and the digests are those of the empty
string; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.exchange import release
from deltaloom.session import shared_dir, ship_package, staged
from deltaloom.sources.tables import table

#: Words in the lexicon, and words that one task counts at a time.
LEXICON_WORDS, SUMMARY_WORDS = 32_768, 65_536
#: Words whose ids a worker keeps besides the lexicon, and the bytes up to which words are merged as a matrix.
KEPT_WORDS, MATRIX_BYTES = 400_000, 48
#: Texts of these characters alone need no normalizer besides lower(): printable ASCII, line ends, Latin letters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
# The splitting pattern for texts that PLAIN matches, where letters and numbers are these.
LETTERS, NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file: word splitting, exact merging, and the text of each id."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab = model["vocab"]
        self.token = {i: t for t, i in (vocab | self.special).items()}
        letters, tail = byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + tail] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.width = max(self.token) + 1
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in reversed(list(enumerate(pairs)))}
        keys = np.array([a * self.width + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        ranks, made = np.array(list(self.merges.values()), np.int64).T
        self.ranks, self.made = ranks[order], made[order]
        self.path = path

    @functools.cached_property
    def steps(self):
        """The library's normalizer and splitter, and the byte of each letter."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        return library.normalizer, library.pre_tokenizer, {c: b for b, c in enumerate(byte_letters())}

    def chunks(self, text: str) -> list[str] | None:
        """The lower-cased words between white space, which no piece crosses; None for a text that isn't plain."""
        if PLAIN.fullmatch(text) and not (self.specials and "<|" in text and self.specials.search(text)):
            return text.lower().split()
        return None

    def pieces(self, text: str) -> list[str]:
        """What is merged by itself, in order; special tokens stand for themselves. Texts that aren't plain go
        through the normalizer and splitter of the library."""
        if (chunks := self.chunks(text)) is not None:
            return [p for c in chunks for p in SPLIT.findall(c)]
        normalizer, splitter, back = self.steps
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                out.append(part)
            else:
                found = splitter.pre_tokenize_str(normalizer.normalize_str(part))
                out += [bytes([back[c] for c in word]).decode("utf-8") for word, _ in found]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merges of one word: the lowest rank first, the leftmost of equals, through a heap of pairs."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, a, b, made) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (hit := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (hit[0], left, ids[left], ids[right], hit[1]))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merges of many words: those of similar length as rows of a matrix, one merge in each row a round."""
        out: list[list[int] | None] = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, MATRIX_BYTES)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ids in zip(part.tolist(), self._matrix([words[i] for i in part.tolist()], sizes[part], high), strict=True):
                    out[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.inner[raw], -1)
        ids[np.arange(len(words)), sizes - 1] = self.final[raw[np.arange(len(words)), sizes - 1]]
        none = np.int64(1 << 40)

        def ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = np.where((a >= 0) & (b >= 0), a * self.width + b, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            return np.where(hit, self.ranks[at], none), np.where(hit, self.made[at], -1)

        rank, made = ranked(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        while len(live):
            best = rank[live].argmin(axis=1)
            on = rank[live, best] < none
            live, best = live[on], best[on]
            if not len(live):
                break
            ids[live, best] = made[live, best]
            for grid, fill in ((ids, -1), (rank, none), (made, -1)):  # what stood after the pair moves one place up
                part, keep = grid[live], np.arange(grid.shape[1])
                source = np.minimum(keep + (keep > best[:, None]), grid.shape[1] - 1)
                part = np.take_along_axis(part, source, axis=1)
                part[:, -1] = fill
                grid[live] = part
            for shift in (-1, 0):  # the pairs on both sides of the new token
                left = best + shift
                ok = (left >= 0) & (left < width - 1)
                r, j = live[ok], left[ok]
                rank[r, j], made[r, j] = ranked(ids[r, j], ids[r, j + 1])
        return [row[:n].tolist() for row, n in zip(ids, (ids >= 0).sum(axis=1).tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """A minimal acyclic automaton over the bytes of words, with numbers as outputs that lead to ids.

    File: four counts, then edge keys (state * 256 + byte, sorted), edge targets, edge outputs, states' final
    flags, offsets into the ids, ids.
    """

    LAYOUT = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.uint8), ("offsets", np.int32), ("ids", np.int32))

    def __init__(self, buffer):
        n_edges, n_states, n_words, n_ids = struct.unpack_from("<4q", buffer)
        at = 32
        for (name, kind), n in zip(self.LAYOUT, (n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids), strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compiled(cls, entries: dict[bytes, list[int]]) -> bytes:
        """The file for words and their ids. Words are added in order; the last word's states are replaced by
        equal ones as soon as no later word can pass through them."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def frozen(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, [], -1]]  # of the last word: final, edges, byte that leads here
        words = sorted(entries)

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges, label = path.pop()
                path[-1][1].append((label, frozen(final, edges)))

        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            close(same)
            path.extend([False, [], b] for b in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        root = frozen(path[0][0], path[0][1])
        reach: list[int] = []  # words that can end from each state; targets come before their sources
        for final, edges in states:
            reach.append(final + sum(reach[t] for _, t in edges))
        rows = []
        for s, (final, edges) in enumerate(states):
            number = int(final)
            for label, target in edges:
                rows.append((s * 256 + label, target, number))
                number += reach[target]
        rows = [((len(states) * 256 + key % 256) if key // 256 == root else key, target, number) for key, target, number in rows]
        rows.append((-1, root, 0))  # the root gets the highest number, and its place is told by the first edge
        rows.sort()
        ids = [entries[w] for w in words]
        columns = [
            np.array([r[0] for r in rows], np.int64),
            np.array([r[1] for r in rows], np.int32),
            np.array([r[2] for r in rows], np.int32),
            np.array([f for f, _ in states] + [states[root][0]], np.uint8),
            np.cumsum([0, *map(len, ids)]).astype(np.int32),
            np.array([i for x in ids for i in x], np.int32),
        ]
        body = b"".join((raw := c.tobytes()) + b"\0" * (-len(raw) % 8) for c in columns)
        return struct.pack("<4q", len(rows), len(states) + 1, len(words), len(columns[-1])) + body

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon; all words go one byte on at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), len(self.final) - 1, np.int64)
        total = np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + raw[(ends - sizes)[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.targets[at], -1)
            total[live] += np.where(hit, self.outputs[at], 0)
            step += 1
            live = live[hit & (sizes[live] > step)]
        good = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) & (sizes > 0)
        return np.where(good, total, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


def summary_cut(counts: Counter, most: int) -> None:
    """Misra-Gries: beyond most words, the count of the next one is taken from all, and words at 0 go."""
    if len(counts) > most:
        cut = heapq.nlargest(most + 1, counts.values())[-1]
        for w in [w for w, n in counts.items() if n <= cut]:
            del counts[w]
        for w in counts:
            counts[w] -= cut


def frequent_words(texts: DataFrame, path: str, most: int = LEXICON_WORDS, summary: int = SUMMARY_WORDS) -> list[str]:
    """The most frequent words over all texts. What a task reports is bounded, and the driver gets the words of the
    power of two that has the last one and of those above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    chunks = own.chunks(text)
                    counts.update(chunks if chunks is not None else (p for p in own.pieces(text) if p not in own.special))
                    if len(counts) > 4 * summary:
                        summary_cut(counts, summary)
        pieces: Counter = Counter()
        while counts:
            chunk, n = counts.popitem()
            for piece in SPLIT.findall(chunk):
                pieces[piece] += n
        summary_cut(pieces, summary)
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["word", "n"])
        del counts, pieces
        release()

    found = staged(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    powers = found.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).collect()  # 64 at most
    enough, least = 0, 0
    for power, words in sorted(powers, reverse=True):
        enough, least = enough + words, 1 << power
        if enough >= most:
            break
    return [r["word"] for r in found.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def publish(spark: SparkSession, content: bytes) -> str:
    """Write a file to the shared folder and hand it to every executor; gives its name for SparkFiles."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm, where = spark._jvm, f"{shared_dir(spark)}/{name}"
    target = jvm.org.apache.hadoop.fs.Path(where)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(target.toString() if "://" in where or where.startswith("file:") else f"file://{where}")
    return name


@functools.lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


Entry = tuple[str, str, int]  # ids joined, tokens joined, number of ids


class Encoder:
    """The ids of the chunks and pieces that a worker meets, joined by spaces: a string each, which chunks that are one piece share with it."""

    def __init__(self, own: Vocabulary, lexicon: Lexicon):
        self.own, self.lexicon = own, lexicon
        self.token = {str(i): t for i, t in own.token.items()}
        self.special = {w: str(i) for w, i in own.special.items()}
        self.chunk: dict[str, str] = {}
        self.piece: dict[str, str] = dict(self.special)

    def learn_pieces(self, pieces: Iterable[str]) -> None:
        new = [w for w in pieces if w not in self.piece]
        raw = [w.encode("utf-8") for w in new]
        numbers = self.lexicon.numbers(raw).tolist() if raw else []
        rest = [i for i, n in enumerate(numbers) if n < 0]
        merged = dict(zip(rest, self.own.merge_all([raw[i] for i in rest]), strict=True))
        for i, (w, n) in enumerate(zip(new, numbers, strict=True)):
            self.piece[w] = " ".join(map(str, merged[i] if n < 0 else self.lexicon.ids_of(n)))

    def ids(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, joined by spaces."""
        if len(self.chunk) > KEPT_WORDS:
            self.chunk, self.piece = {}, dict(self.special)
        chunks = [self.own.chunks(t) if t else [] for t in texts]
        others = {i: self.own.pieces(t) for i, (c, t) in enumerate(zip(chunks, texts, strict=True)) if c is None}
        split = {c: SPLIT.findall(c) for c in {c for r in chunks if r for c in r} if c not in self.chunk}
        self.learn_pieces({p for x in (*split.values(), *others.values()) for p in x})
        piece, chunk = self.piece, self.chunk
        for c, parts in split.items():
            if len(parts) == 1:
                chunk[parts[0]] = piece[parts[0]]
            else:
                chunk[c] = " ".join([piece[p] for p in parts])
        return [" ".join([piece[p] for p in others[i]]) if r is None else " ".join([chunk[c] for c in r]) for i, r in enumerate(chunks)]

    def encode(self, texts: list[str | None]) -> list[list[Entry]]:
        """The entry of each text, or none where it has no ids."""
        split = [(joined, joined.split()) for joined in self.ids(texts)]
        return [[(joined, " ".join([self.token[i] for i in ids]), len(ids))] if ids else [] for joined, ids in split]


def with_tokens(texts: DataFrame, path: str, lexicon: str, keep_ids: bool = False) -> DataFrame:
    """The id column and text of a table to: id, n_tokens, ids_sha256, decoded_sha256, and ids where asked for.

    The decoded text is made from the tokens of the ids, joined as the tokenizer file's decoder (none) does.
    """
    key = texts.columns[0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        known = Encoder(own, mapped(lexicon))
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                found = [r[0] if r else ("", "", 0) for r in known.encode(batch.column(1).to_pylist())]
                columns = [
                    batch.column(0),
                    pa.array([n for _, _, n in found], pa.int64()),
                    pa.array([digest(ids) for ids, _, _ in found], pa.string()),
                    pa.array([digest(tokens) for _, tokens, _ in found], pa.string()),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([list(map(int, ids.split())) for ids, _, _ in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del known
        release()

    schema = f"`{key}` {texts.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return texts.mapInArrow(encode, schema)


def decode(own: Vocabulary, ids: Iterable[int]) -> str:
    return " ".join(own.token[i] for i in ids if i in own.token)


def encoded_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select("doc_id", "text")
    own = vocabulary(path)
    words = [w.encode("utf-8") for w in frequent_words(texts.select("text"), path)]
    entries = dict(zip(words, own.merge_all(words), strict=True))
    return with_tokens(texts, path, publish(spark, Lexicon.compiled(entries)), keep_ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents through a lexicon of the words most frequent in them."""
    return encoded_documents(table(spark, sf_dir, "documents"), path or tokenizer_path())
