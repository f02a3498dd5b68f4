from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(own), digest(said), len(loss), digest(loss))
    return out


def check(spark, rows, **options):
    got = C.digest(spark.createDataFrame(rows, TURNS), **options).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="<|/s>[INST]\\ end\nté", max_size=40), min_size=1, max_size=9), min_size=1, max_size=6))
def test_any_text_reads_back(spark, convs):
    roles = ["system", "user", "assistant"]
    rows = [(i, j, roles[(j + i) % 3], t) for i, conv in enumerate(convs) for j, t in enumerate(conv)]
    check(spark, rows, budget=40, history=8)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 3, "user", "x"), (2, None, "assistant", "<|start|>"), (2, 1, "ro\nle\\", "y"), (3, 0, "assistant", "long " * 50_000), (4, 0, "system", "s" * 9000), (4, 1, "assistant", "a")]
    check(spark, rows)
    assert C.digest(spark.createDataFrame([], TURNS)).count() == 0


def test_windows_keep_their_budget(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = C.windows(turns, budget=300, history=80).collect()
    longest = turns.selectExpr("max(length(text))").first()[0]
    assert max(len(r.text) for r in rows) <= max(4 * 300, longest + 200) + 4 * 80 + longest
    small = [r for r in rows if r.text.count(C.START) - r.n_repeated > 1]
    assert small and all(len(r.text) <= 4 * 300 + 4 * r.text.count(C.START) for r in small)


def test_system_turn_and_history_are_repeated_but_not_learned(spark):
    rows = [(1, 0, "system", "rules"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} " * 6) for i in range(1, 20))]
    got = C.windows(spark.createDataFrame(rows, TURNS), budget=120, history=30).orderBy("first_turn").collect()
    assert len(got) > 2 and all(r.text.startswith("<|start|>system\nrules<|end|>\n") for r in got)
    assert all(r.n_repeated >= 2 for r in got[1:])
    learned = "".join(r.text[s.start : s.start + s.length] for r in got for s in r.loss)
    assert learned == "".join(t for _, _, role, t in rows if role == "assistant")


def test_one_long_conversation(spark):
    check(spark, [(7, i, "assistant" if i % 2 else "user", f"message {i}") for i in range(3000)])
