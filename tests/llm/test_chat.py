import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<sep>", "\\", "\\\\n", "<\\/s>", "<", "</s", "<s>[INST]<s>", "é\n ", "[[INST]]", "<<s>>", ""]


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1))).collect()}


def read(spark, rows):
    df = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    return {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(df).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(c, i, "user" if (i + c) % 3 else "assistant", t) for c in range(3) for i, t in enumerate(ODD)]
    rows += [(9, i, f"role{x}", x) for i, x in enumerate(ODD)]
    got = read(spark, rows)
    for c in {r[0] for r in rows}:
        assert got[c] == [(r, t) for k, _, r, t in sorted(rows) if k == c]


def test_template_merges_adjacent_turns(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d")]
    assert formatted(spark, rows)[1].formatted == "<s>[INST]user[/INST]a<sep>b</s><s>[INST]assistant[/INST]c<sep>d</s>"


def test_mask_covers_assistant_texts_only(spark):
    rows = [(1, 0, "system", "s</s>é"), (1, 1, "assistant", "x<sep>é"), (1, 2, "assistant", "z"), (1, 3, "user", "u"), (1, 4, "assistant", "")]
    r = formatted(spark, rows)[1]
    raw = r.formatted.encode()
    cuts = [raw[m.start : m.start + m.bytes].decode() for m in r["mask"]]
    assert cuts == ["s<\\/s>é", "x<\\sep>é", "z", "u", ""]
    assert [m.loss for m in r["mask"]] == [False, True, True, False, True]


def test_loss_is_read_through_the_mask(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>\\"), (1, 2, "user", "c"), (1, 3, "assistant", "dé")]
    df = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert chat.read_chats(df).first().loss == "b</s>\\dé"
    shifted = df.withColumn("mask", F.transform("mask", lambda m: F.struct((m["start"] - 1).alias("start"), m["bytes"].alias("bytes"), m["loss"].alias("loss"))))
    flipped = df.withColumn("mask", F.transform("mask", lambda m: F.struct(m["start"].alias("start"), m["bytes"].alias("bytes"), (~m["loss"]).alias("loss"))))
    assert chat.read_chats(shifted).first().loss != "b</s>\\dé" and chat.read_chats(flipped).first().loss == "ac"


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 5, "b", "2"), (1, 5, "a", "1"), (1, 5, "a", "1"), (None, 0, "user", "n")]
    got = read(spark, rows)
    assert got[1] == [("", ""), ("a", "1"), ("a", "1"), ("b", "2")] and got[None] == [("user", "n")]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * 50) for i in range(3000)]
    assert len(read(spark, rows)[1]) == 3000


def test_query_has_the_extra_conversation(spark):
    from kilnwork.llm.queries import op9_chat

    r = op9_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_no_python_in_the_plan(spark):
    df = chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).filter("turn >= 0")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "mask" in plan
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>/\\[]INSTsep|é \n", max_size=12), min_size=1, max_size=30))
def test_any_text_round_trips(spark, texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    assert [t for _, t in read(spark, rows)[1]] == texts
