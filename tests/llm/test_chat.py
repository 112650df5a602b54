import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chat

SAID = "<|im_end|><|im_start|>assistant ok"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a&<|\n;nlt", max_size=8), st.text(alphabet="a&<|>im_endstr\n;lt", max_size=30)), max_size=5))
def test_round_trip(turns):
    assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n_turns string")


def test_digest(spark):
    data = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"turn {t} " + "word " * (60 * t), "x") for t in range(12)]
    data += [(2, 0, "user", None, "x"), (2, 1, None, "a", "x"), (3, 0, "assistant", "same", "x"), (3, 0, "assistant", "same", "x"), (None, None, "user", "", "x")]
    got = {r.conv_id: r for r in chat.digest(rows(spark, data)).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    for conv in got:
        turns = [(r or "", t or "") for c, _, r, t, _ in data if c == conv] if conv != -1 else [("user", SAID), ("assistant", SAID)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_windows > 2


def test_windows_keep_the_budget(spark):
    data = [(7, t, "system" if t == 0 else "user" if t % 2 else "assistant", "word " * 40, "x") for t in range(1500)]
    got = chat.format_windows(rows(spark, data), budget=300, history=2).orderBy("window").collect()
    assert sum(r.n_turns for r in got) == 1500 and [r.first_turn for r in got] == [sum(x.n_turns for x in got[:i]) for i in range(len(got))]
    for r in got:
        assert r.n_tokens <= 300 and r.formatted.startswith("<|im_start|>system\n") and len(chat.parse(r.formatted)) == r.n_turns + r.n_repeated
    assert all(r.n_repeated == 3 for r in got[1:])


def test_empty(spark):
    assert [r.conv_id for r in chat.digest(rows(spark, [])).collect()] == [-1]
