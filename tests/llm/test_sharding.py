import random
import zlib
from collections import defaultdict

from helpers import clashing, documents, rows, saved, texts_of

from deltaloom.llm import sharding


def check(out, texts):
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in texts)
    by_shard, homes = defaultdict(list), defaultdict(set)
    text = dict(texts)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_shard[r["shard"]].append(r)
        homes[raw].add(r["shard"])
    assert set(by_shard) <= set(range(8))
    assert all(len(h) == 1 for h in homes.values())
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return [sum(r["size"] for r in by_shard[s]) for s in range(8)]


def test_shards_are_even_and_hold_groups(spark, sf):
    out = sharding.op2_lpt_sharding(spark, "/root/testdata/sf0.01").collect()
    loads = check(out, list(texts_of("/root/testdata/sf0.01").items()))
    assert max(loads) - min(loads) <= 8


def test_equals_brute_force_schedule(spark):
    texts = ["x" * n for n in (900, 500, 500, 400, 300, 200, 100, 100, 50, 50, 20, 10, 5, 3, 2, 1)] * 2
    df = spark.createDataFrame([(t.encode(), len(t)) for t in texts], "g binary, n long")
    got = {bytes(r["g"]): r["shard"] for r in sharding.with_shards(df, "g", "n", 3).collect()}
    sizes = defaultdict(int)
    for t in texts:
        sizes[t.encode()] += len(t)
    loads = [0] * 3
    for g in sorted(sizes, key=lambda g: -sizes[g]):
        loads[loads.index(min(loads))] += sizes[g]
    mine = [0] * 3
    for g, s in got.items():
        mine[s] += sizes[g]
    assert sorted(mine) == sorted(loads)


def one_by_one(sizes, shards):
    loads, given = [0] * shards, defaultdict(lambda: [0] * shards)
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            s = loads.index(min(loads))
            loads[s] += size
            given[size][s] += 1
    return dict(given)


def test_many_at_a_time_gives_what_one_by_one_gives():
    rng = random.Random(7)
    for shards in (1, 2, 3, 8):
        for _ in range(60):
            sizes = [(size, rng.choice([1, 2, 5, 8, 40, 300])) for size in rng.sample(range(1, rng.choice([12, 500])), rng.randint(1, 10))]
            assert sharding.schedule(sizes, shards) == one_by_one(sizes, shards)


def test_many_small_groups_are_scheduled_as_groups(spark):
    df = spark.createDataFrame([(str(i % 9000).encode(), 1 + i % 9000 % 7) for i in range(18_000)], "g binary, n long")
    out = sharding.with_shards(df, "g", "n", 4).collect()
    homes, loads = defaultdict(set), [0] * 4
    for r in out:
        homes[bytes(r["g"])].add(r["shard"])
        loads[r["shard"]] += r["n"]
    assert len(out) == 18_000 and all(len(h) == 1 for h in homes.values())
    assert max(loads) - min(loads) <= 2


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 5), (None, 5), (b"a", 4), (b"b", 3)], "g binary, n long")
    got = rows(sharding.with_shards(df, "g", "n", 2).select("g", "shard"))
    assert len(got) == 4 and len({s for g, s in got if g is None}) == 1


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", "a", "a", "é" * 1000, "b" * 100_000, "a"]
    df = clashing(documents(spark, texts, [0, 1, 2, 3, 4, 5, 2]))
    out = sharding.op2_lpt_sharding(spark, saved(df, tmp_path)).collect()
    check(out, list(zip([0, 1, 2, 3, 4, 5, 2], texts, strict=True)))
    assert rows(sharding.op2_lpt_sharding(spark, saved(documents(spark, []), tmp_path / "none"))) == []
