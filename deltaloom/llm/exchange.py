"""Questions about keys that all batches of a corpus hold, asked and answered in packed form.

Texts are packed into batches of a few MB and stored once in a table bucketed by batch. A question gives each
batch's distinct keys (64-bit hashes, sorted) with a value each; ranges of keys go to buckets, where one task sees
all batches' entries for its range and answers every entry; and the answers go back to the batches, by a join that
moves only the answers. A key enters a bucket at most once a batch however often it occurs, so a key that a third
of all rows hold doesn't make a hot group, and sorted keys pack into a few bytes.

Defined results: a null text counts as empty, and a doc_id may be null, which a flag tells; rows of any number with one
doc_id stay rows of their own; a text of any length is in one batch; an empty table has no batches and no answers; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.kernels import encoded
from deltaloom.session import discard, shared_dir, ship_package, shuffles_dropped

#: Bytes of text in a batch, bytes of text for each bucket of keys, and bytes of input for each task that reads batches.
BATCH_BYTES, BUCKET_BYTES, LEAST_BUCKETS, TASK_BYTES, MOST_TASKS = 2 << 20, 8 << 20, 48, 64 << 20, 1 << 20
TOTALS = 4
CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed: high bytes of small numbers vanish."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return CODEC.compress(raw, asbytes=True) if raw else b""


def pack_all(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one blob."""
    return pickle.dumps({name: (pack(a), len(a), a.dtype.str) for name, a in arrays.items()})


def unpack_all(blob: bytes) -> dict[str, np.ndarray]:
    return {name: unpack(*x) for name, x in pickle.loads(blob).items()}


def unpack(raw: bytes, n: int, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(CODEC.decompress(raw, n * kind.itemsize, asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


@dataclass
class Batch:
    ids: np.ndarray  # 0 where there is none
    known: np.ndarray  # whether there is one
    texts: list[bytes]

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.known)


def _packed(ids: list, texts: list[bytes]) -> bytes:
    table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> Batch:
    table = pa.ipc.open_stream(blob).read_all()
    ids = table.column("id").combine_chunks()
    return Batch(ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool), table.column("text").to_pylist())


def reading_tasks(df: DataFrame) -> int:
    """Tasks for a table made from df: spark.sql.shuffle.partitions, or more where the optimizer's size of df asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // TASK_BYTES), MOST_TASKS) if size < 1 << 60 else 1)


def by_batch(rows: DataFrame, tasks: int) -> DataFrame:
    """Store rows in a table bucketed by batch, so that all that is read by batch is read without an exchange."""
    spark, name = rows.sparkSession, f"deltaloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/staged/{name}"
    with shuffles_dropped(spark):
        rows.write.option("path", path).option("compression", "uncompressed").bucketBy(tasks, "batch").saveAsTable(name)
    out = spark.table(name)
    out._staged_at, out._staged_as = path, name
    return out


class Batches:
    """A stored table of batches, a blob each, and the questions asked of them."""

    spark: SparkSession
    tasks: int
    buckets: int
    read: Callable = staticmethod(_unpacked)  # what a blob holds

    def store(self, batches: DataFrame) -> None:
        """Write batch and blob (and other columns) to a table of this name, bucketed by batch."""
        self.table = by_batch(batches, self.tasks)

    def derived(self, fn: Callable[..., bytes], read: Callable, answers: tuple = ()) -> Batches:
        """Batches whose blobs fn(batch number, what a blob holds, arrays of answers) makes, and read reads."""
        def made(number: int, held, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "blob": pa.array([fn(number, held, *arrays)], pa.binary())})

        return self.derived_rows(self.map(made, "batch long, blob binary", answers), read)

    def derived_rows(self, rows: DataFrame, read: Callable) -> Batches:
        """Batches of rows with batch, blob and other columns, made by map()."""
        out = Batches()
        out.spark, out.tasks, out.buckets, out.read = self.spark, self.tasks, self.buckets, read
        out.store(rows)
        return out

    def map(self, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str, answers: tuple[tuple[DataFrame, str], ...] = (), how: str = "left", where: str = "true") -> DataFrame:
        """fn(batch number, what its blob holds, an array for each of answers) on every batch; with how = inner on those
        with answers alone. answers: tables from ask() and kinds."""
        read = self.read
        joined = self.table.filter(where).select("batch", "blob")
        for i, (rows, _) in enumerate(answers):
            mine = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "answer"))).alias(f"a{i}"))
            joined = joined.join(mine.hint("shuffle_merge"), "batch", how)
        kinds = [np.dtype(eval_kind(k)) for _, k in answers]

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in found:
                for i in range(len(part)):
                    row = part.slice(i, 1)
                    arrays = []
                    for j, kind in enumerate(kinds):
                        parts = [unpack(x["answer"], x["n"], kind) for x in row.column(2 + j)[0].as_py() or []]
                        arrays.append(np.concatenate(parts) if parts else np.empty(0, kind))
                    yield from fn(row.column(0)[0].as_py(), read(row.column(1)[0].as_py()), *arrays)
                    del row, arrays
                    release()

        return joined.mapInArrow(run, schema)

    def ask(self, question: Callable, reply: Callable, value: str, answer: str, answers: tuple = (), key_bits: int = 64, how: str = "left") -> DataFrame:
        """question(what a blob holds, arrays of answers) gives sorted keys below 2**key_bits and a value each;
        reply(keys, values) of a bucket's entries gives an answer each and up to TOTALS totals. The result is staged."""
        edges = self.edges(key_bits)

        def asked(number: int, batch: Batch, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = packed_question(number, *question(batch, *arrays), edges)
            if len(rows["batch"]):
                yield pa.RecordBatch.from_pydict(rows)

        return replied(self.map(asked, QUESTION, answers, how), self.tasks, reply, value, answer)

    def edges(self, key_bits: int) -> np.ndarray:
        """The least key of each bucket but the first."""
        return np.array([-(-(b << key_bits) // self.buckets) for b in range(1, self.buckets)], dtype=object).astype(np.uint64)

    def close(self) -> None:
        """Drop the table; only its results may be read from now on."""
        discard(self.table)


class Corpus(Batches):
    """doc_id and text of documents in batches."""

    def __init__(self, docs: DataFrame, lower: bool = False, batch_bytes: int = BATCH_BYTES):
        self.spark = docs.sparkSession
        ship_package(self.spark)

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
            ids, texts, size = [], [], 0

            def full() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "bytes": pa.array([size], pa.int64()), "blob": pa.array([_packed(ids, texts)], pa.binary())})

            for part in found:
                for i, text in zip(part.column(0).to_pylist(), encoded(part.column(1).to_pylist(), lower), strict=True):
                    if texts and size + len(text) > batch_bytes:
                        yield full()
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(i)
                    texts.append(text)
                    size += len(text) + 64
            if texts:
                yield full()

        packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "batch long, bytes long, blob binary")
        self.tasks = reading_tasks(docs)
        self.store(packed)
        self.bytes = self.table.agg(F.sum("bytes")).first()[0] or 0
        self.buckets = max(LEAST_BUCKETS, -(-self.bytes // BUCKET_BYTES))


QUESTION = "batch long, bucket long, n long, keys binary, vals binary"


def packed_question(number: int, keys: np.ndarray, values: np.ndarray, edges: np.ndarray) -> dict[str, pa.Array]:
    """The columns of QUESTION: a row for each bucket that the batch has keys of."""
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    some = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
    return {
        "batch": pa.array([number] * len(some), pa.int64()),
        "bucket": pa.array([b for b, _, _ in some], pa.int64()),
        "n": pa.array([j - i for _, i, j in some], pa.int64()),
        "keys": pa.array([pack(np.diff(keys[i:j], prepend=np.uint64(0))) for _, i, j in some], pa.binary()),
        "vals": pa.array([pack(values[i:j]) for _, i, j in some], pa.binary()),
    }


def replied(questions: DataFrame, tasks: int, reply: Callable, value: str, answer: str) -> DataFrame:
    """Each bucket's entries of all batches answered by one call of reply; stored by batch."""
    value_kind, answer_kind = np.dtype(eval_kind(value)), np.dtype(eval_kind(answer))

    def answered(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = np.concatenate([np.cumsum(unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
        values = np.concatenate([unpack(r["vals"], r["n"], value_kind) for r in rows])
        found, *totals = reply(keys, values)
        found = np.ascontiguousarray(found.astype(answer_kind))
        cuts = np.cumsum([0, *[r["n"] for r in rows]])
        out = pa.table(
            {
                "batch": group.column("batch"),
                "bucket": group.column("bucket"),
                "n": group.column("n"),
                "answer": pa.array([pack(found[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                **{f"t{k}": pa.array([float(totals[k]) if k < len(totals) and not i else 0.0 for i in range(len(rows))], pa.float64()) for k in range(TOTALS)},
            }
        )
        del rows, keys, values, found
        release()
        return out

    replies = questions.groupBy("bucket").applyInArrow(answered, "batch long, bucket long, n long, answer binary, " + ", ".join(f"t{k} double" for k in range(TOTALS)))
    return by_batch(replies.repartition(tasks, "batch"), tasks)


def release() -> None:
    """Give memory that this worker no longer uses back to the machine, which the executor's limit counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def eval_kind(text: str):
    """'u1', or fields as 'c:u4,r:u2'."""
    return [tuple(x.split(":")) for x in text.split(",")] if ":" in text else text


def totals(rows: DataFrame) -> list[float]:
    r = rows.agg(*[F.coalesce(F.sum(f"t{k}"), F.lit(0.0)) for k in range(TOTALS)]).first()
    return list(r)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, first place of each distinct key in that order, and the number of its group for each key."""
    order = np.argsort(keys)
    if not len(keys):
        return order, order, order
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number
