import hashlib

import pytest

from itemrec.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "c") for r in rows], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **options):
    df = frame(spark, rows)
    formatted = chat.windows(df, **options)
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
    return formatted


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("budget, history", [(40, 12), (64, 0), (1024, 256)])
def test_windows(spark, budget, history):
    rows = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2 == 0], "word " * (i % 9)) for i in range(1, 60)]
    rows += [(2, i, ("user", "assistant")[i % 2], "w " * 200 if i == 3 else "w") for i in range(600)]
    formatted = check(spark, rows, budget=budget, history=history)
    for r in formatted.collect():
        turns = r.text.split("</s>")[:-1]
        assert r.n_tokens == sum(len(t.split("\n", 1)[1].split()) + 4 for t in turns)
        assert r.n_tokens <= budget or len(turns) - r.n_repeated == 1
        if r.conv_id == 1:
            assert turns[0] == "<s>system\nbe brief"
        assert all(t.startswith("<s>") for t in turns)
        targets = [r.text[s.start : s.start + s.length] for s in r.loss_spans]
        assert targets == [t.split("\n", 1)[1] for t in turns[r.n_repeated :] if t.startswith("<s>assistant\n")]
        repeated = turns[:r.n_repeated][r.conv_id == 1 :]
        assert sum(len(t.split("\n", 1)[1].split()) + 4 for t in repeated) <= history


def test_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt;s>", "&amp;lt;", "<s>assistant\nx</s>", "&lb;", "\n\n", "é🙂" * 3, "&", ""]
    check(spark, [(-7, i, ("user", "assistant", "a\nb", "<s>")[i % 4], t) for i, t in enumerate(texts)])


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, "assistant", None), (3, 1, None, "x"), (3, 1, None, "x"), (4, 0, "system", "alone"), (5, 0, "system", "a"), (5, 1, "system", "b"),
            (6, 0, "assistant", "long " * 100_000), (6, 10**12, "user", "far"), (6, -3, "assistant", "first")]
    check(spark, rows)


def test_no_rows(spark):
    assert chat.read_back(chat.windows(frame(spark, []))).collect() == []


def test_plan_runs_no_python(spark):
    plan = chat.read_back(chat.windows(frame(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
