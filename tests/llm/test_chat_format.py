import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxmill.llm import chat_digest, chat_format
from boxmill.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
PARTS = ["<|turn|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\\n", "<", "|", "<|", "n", "\n", "é", " ", "<\\|", "assistant\n"]
HOSTILE = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), HOSTILE), HOSTILE), max_size=6))
def test_hostile_texts_are_read_back(turns):
    windows = chat_format.Windows(1, 10**9, 0)
    for role, text in turns:
        assert not list(windows.add(role, text, 1))
    formatted = windows.close()[2]
    assert chat_format.read_turns(formatted) == turns
    assert formatted.count("<|turn|>") == formatted.count("<|end|>") == len(turns)
    assert not re.search(r"</?s>|\[/?INST\]", formatted)


def slow_digest(turns):
    joined = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_equals_plain_digests(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    expected = {}
    for conv, turns in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        expected[conv] = slow_digest([(r or "", t or "") for _, _, r, t in turns])
    ours = QUERIES["op3_chat_formatting"](spark, SF_DIR).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in ours} == expected
    assert len(ours) == len(expected)
    assert sum(r["n_windows"] for r in ours) > len(ours)


def slow_windows(turns, budget, history):
    """``(repeated, fresh)`` turn numbers per window; turns are (role, cost). Prefix sums over the whole list."""
    prefix = [0, *itertools.accumulate(c for _, c in turns)]
    system = [0] if turns and turns[0][0] == "system" else []
    found, at = [], 0
    while at < len(turns):
        repeated = []
        if at:
            room = min(history, budget - turns[at][1] - sum(turns[s][1] for s in system))
            back = at
            while back - 1 >= len(system) and prefix[at] - prefix[back - 1] <= room:
                back -= 1
            repeated = system + list(range(back, at))
        carried = sum(turns[r][1] for r in repeated)
        end = at + 1
        while end < len(turns) and prefix[end + 1] - prefix[at] + carried <= budget:
            end += 1
        found.append((repeated, list(range(at, end))))
        at = end
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.integers(0, 40)), max_size=20), st.integers(10, 120), st.integers(0, 60))
def test_windows_follow_prefix_sums(turns, budget, history):
    made = chat_format.Windows(1, budget, history)
    rows = [row for k, (role, n) in enumerate(turns) for row in made.add(role, f"t{k}", n)]
    rows += [made.close()] if turns else []
    expected = slow_windows([(r, n + chat_format.TURN_TOKENS) for r, n in turns], budget, history)
    assert len(rows) == len(expected)
    for (_, _, text, n_turns, n_repeated, tokens, over, spans), (repeated, fresh) in zip(rows, expected):
        numbers = [int(body[1:]) for _, body in chat_format.read_turns(text)]
        assert numbers == repeated + fresh and n_turns == len(numbers) and n_repeated == len(repeated)
        assert tokens == sum(turns[k][1] + chat_format.TURN_TOKENS for k in numbers) and over == (tokens > budget)
        assert over <= (len(fresh) == 1)
        assert [text[s["start"] : s["end"]] for s in spans] == [f"t{k}" for k in fresh if turns[k][0] == "assistant"]


def test_awkward_rows(spark):
    rows = [
        (None, 1, "assistant", "nobody's"),
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 0, "assistant", ""),
        (1, 1, "assistant", "same"),
        (1, 1, "assistant", "same"),
        (2, 0, "system", "s " * 5000),
        (2, 1, "assistant", "long " * 40_000),
        (2, 2, "user\nwith break", "end"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS window", "'y' AS tokens")
    windows = chat_format.windows(df)
    ours = {r["conv_id"]: tuple(r)[1:5] for r in chat_digest.digests(windows).collect()}
    by_conv = {c: [(r or "", t or "") for i, _, r, t in rows if i == c] for c in (None, 1, 2)}
    assert ours == {c: slow_digest(turns) for c, turns in by_conv.items()}
    assert [r["over_budget"] for r in windows.where("conv_id = 2").orderBy("window").collect()] == [True, True, True]
    assert chat_format.windows(df.limit(0)).count() == chat_digest.digests(chat_format.windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("budget", [60, 400])
def test_system_turn_opens_every_window(spark, budget):
    turns = [(1, 0, "system", "be kind"), *((1, k, ("user", "assistant")[k % 2], f"word {k} " * 5) for k in range(1, 40))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat_format.windows(df, budget=budget, history=30).collect():
        assert chat_format.read_turns(r["text"])[0] == ("system", "be kind")
        assert r["tokens"] <= budget and not r["over_budget"]
