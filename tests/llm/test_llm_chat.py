from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_archives import same_as_sql

from terralake.llm import chat

hard = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "s>", "INST]", "/", "a", "\n", "é"]), max_size=8).map("".join)


def test_query_equals_sql(spark, documents):
    assert same_as_sql(spark, "op4_chat")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(hard, hard), max_size=5))
def test_rendering_is_reversible(turns):
    formatted, _ = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert sum(formatted.count(c) for c in chat.CONTROLS) == 4 * len(turns)


def test_odd_conversations(spark, documents):
    rows = [
        (1, 2, "assistant", "last"), (1, 0, "user", None), (1, 1, "assistant", ""), (1, None, None, "first"), (1, 2, "assistant", "last"),
        (2, 0, "assistant", "<s>" * 5), (None, 0, "assistant", "x" * 200_000), (None, 1, "user", "</s>"), (3, 0, "user", "only a user"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    made = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    assert {k: len(chat.parse(r["formatted"])) for k, r in made.items()} == {1: 5, 2: 1, 3: 1, None: 2}
    assert chat.parse(made[1]["formatted"]) == [("", "first"), ("user", ""), ("assistant", ""), ("assistant", "last"), ("assistant", "last")]
    assert all(len(r["ids"]) == len(r["mask"]) for r in made.values()) and sum(made[3]["mask"]) == 0
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert {k: r["loss_chars"] for k, r in back.items()} == {1: 8, 2: 15, 3: 0, None: 200_000}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).collect() == []
