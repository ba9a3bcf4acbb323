import hashlib

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.llm import chat

TALKS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>"), (1, 2, "assistant", "\\<|\\\\"), (1, 3, "user", None),
    (2, 0, "system", "only"), (3, None, "assistant", ""), (3, 1, "a\\n\nb", "x" * 50_000), (3, 1, "a\\n\nb", "x" * 50_000), (3, 2, None, "é\n"),
    (None, 5, "assistant", "no id"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"),
]


def expected(talks):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv in {t[0] for t in talks}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in talks if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_reads_back_awkward_turns(spark, tmp_path):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example", "2 AS formatted")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:5]) for r in chat.op7_prefix_targets(spark, str(tmp_path)).collect()}
    attack = [(-1, 0, "user", chat.ATTACK), (-1, 1, "assistant", chat.ATTACK)]
    assert got == expected(TALKS + attack)


def test_one_example_a_target(spark):
    df = spark.createDataFrame(TALKS[:4], "conv_id long, turn long, role string, text string")
    found = chat.expand(df).orderBy("example").collect()
    assert len(found) == 3 and [r["loss_start"] is None for r in found] == [False, False, True]
    assert found[1]["formatted"].startswith(found[0]["formatted"])
    body = found[1]["formatted"][found[1]["loss_start"] : found[1]["loss_end"]]
    assert body == "\\\\<\\|\\\\\\\\"


def test_empty_table_still_has_the_attack(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r[0] for r in rows(chat.op7_prefix_targets(spark, str(tmp_path)))] == [-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\ny", "\\n"]), st.text("<|>\\imn_startend\n é", max_size=30)), min_size=1, max_size=5))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    longest = chat.expand(df).orderBy("example").collect()[-1]["formatted"]
    back = spark.createDataFrame([(longest,)], "f string").select(chat.read_back(chat.F.col("f")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in back] == turns
