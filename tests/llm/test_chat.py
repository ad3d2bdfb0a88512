import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from herdwise.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def shown(spark, rows):
    df = C.format_chats(spark.createDataFrame(rows, TURNS))
    df = df.withColumn("turns", C.read_back(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_mask")))
    return {r["conv_id"]: r for r in df.collect()}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_sep|>", ""]), st.lists(st.sampled_from([*C.CHAT.controls, C.CHAT.open, C.CHAT.close, C.CHAT.part, "\\", "<\\|", "[\\INST]", "é", "\n", "<", "|", "a"]), max_size=6).map("".join)), min_size=1, max_size=5), min_size=1, max_size=25))
def test_round_trip(spark, chats):
    rows = [(i, t, role, text) for i, chat in enumerate(chats) for t, (role, text) in enumerate(chat)]
    got = shown(spark, rows)
    for i, chat in enumerate(chats):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == chat
        assert got[i]["loss"] == "".join(text for role, text in chat if role == "assistant")


def test_neighbours_of_a_role_share_a_header(spark):
    got = shown(spark, [(1, 2, "assistant", "b"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 3, "user", None)])[1]
    t = C.CHAT
    assert got["formatted"] == f"{t.open}user{t.sep}q{t.close}{t.open}assistant{t.sep}a{t.part}b{t.close}{t.open}user{t.sep}{t.close}"
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss_mask"]] == ["a", "b"]


def test_awkward_rows(spark):
    got = shown(spark, [(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, "assistant", "n"), (2, 5, "assistant", "m" * 100_000)])
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")] and len(got[1]["turns"]) == 2 and len(got[2]["loss"]) == 100_001
    assert shown(spark, []) == {}


def test_the_query_adds_the_forged_conversation(spark, tmp_path):
    spark.createDataFrame([(3, 0, "system", "s"), (3, 1, "assistant", "é")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["conv_id"]: r for r in C.op3_chat_format(spark, str(tmp_path)).collect()}
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_sha256"] == hashlib.sha256(C.FORGED.encode()).hexdigest()
    assert rows[3]["turns_sha256"] == hashlib.sha256("system\ns\nassistant\né\n".encode()).hexdigest() and rows[3]["loss_chars"] == 1


def test_spans_of_a_long_conversation(spark):
    n = 3 * C.BLOCK + 7
    texts = ["é" * (i % 5) + "<|" * (i % 3) for i in range(n)]
    got = shown(spark, [(1, i, "assistant" if i % 4 else "user", t) for i, t in enumerate(texts)])[1]
    assert got["loss"] == "".join(t for i, t in enumerate(texts) if i % 4) and len(got["loss_mask"]) == sum(1 for i in range(n) if i % 4)
