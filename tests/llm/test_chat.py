"""Formatting and reading back: escapes, the automaton, digests against plain hashing."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import chat

PIECES = st.lists(st.sampled_from([*chat.DEFAULT.controls, "<", "<<", "s>", "[", "/", "\\", "a", "\n", "é", "SYS>>", "ROLE>>"]), max_size=9).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]) | PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    m = chat.Machine()
    out = "".join(p for t in turns for p, _ in m.step(*t))
    assert list(chat.parse(out)) == turns


@given(PIECES | st.text())
def test_escape(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.DEFAULT.controls)


def test_machine():
    def run(*roles):
        m = chat.Machine()
        for r in roles:
            m.step(r, "x")
        return m.valid, m.wrong_at

    assert run("user", "assistant") == (True, None) and run("system", "user", "assistant", "user") == (True, None)
    assert run("assistant") == (False, 0) and run("user", "user") == (False, 1) and run("user", "assistant", "system") == (False, 2) and run() == (False, None)


def test_digests(spark):
    rows = [(1, 0, "system", "sys"), (1, 1, "user", "</s>[INST] ok"), (1, 2, "assistant", "é\\<s>"), (1, 3, "user", None), (1, 4, "assistant", "two"), (2, 5, "assistant", "[INST]"), (3, 1, "tool", "t"), (3, 0, None, None), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' valid")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(spark, df.repartition(3))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want and r.formatted_chars > 0
    assert (got[1].valid, got[2].valid, got[3].valid) == (True, False, False)
    assert chat.digests(chat.formatted(spark, df.limit(0))).isEmpty()
