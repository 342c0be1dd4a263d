import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanbase.llm import chat
from gleanbase.llm.queries import op11_chat_format

SF = "/root/testdata/sf0.001"


def formatted(spark, *records):
    rows = [(n, r if isinstance(r, str | None) else json.dumps(r)) for n, r in enumerate(records)]
    made = chat.format_records(spark.createDataFrame(rows, "id long, record string").repartition(3))
    made = made.withColumn("formatted", chat.whole(F.col("segments")))
    return sorted(made.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                              chat.read_loss(F.col("segments")).alias("loss")).collect())


def pairs(row):
    return [(t.role, t.text) for t in row.turns or []]


def test_layouts(spark):
    turn = [("user", "hi"), ("assistant", "yes")]
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}], "id": 4}, "messages", turn),
        ({"turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yes"}]}, "turns", turn),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}], "system": "s"}, "conversations",
         [("system", "s"), *turn]),
        ({"dialogue": [{"speaker": "human", "utterance": "hi"}, {"utterance": "yes", "speaker": "bot", "mood": 1}]}, "dialogue", turn),
        ({"prompt": "hi", "completion": "yes", "source": {"prompt": "no"}}, "prompt_completion", turn),
        ({"response": "yes", "prompt": "hi", "system": "s"}, "prompt_response", [("system", "s"), *turn]),
        ({"instruction": "hi", "input": "", "output": "yes"}, "instruction_output", turn),
        ({"instruction": "hi", "input": "this", "output": "yes"}, "instruction_output", [("user", "hi\n\nthis"), turn[1]]),
        ({"instruction": "hi", "context": None, "response": "yes"}, "instruction_response", turn),
        ({"question": "hi", "answer": "yes"}, "question_answer", turn),
        ({"query": "hi", "reply": "yes"}, "query_reply", turn),
        ({"prompt": '{"a": [1]}', "completion": '[{"role": "x"}]'}, "prompt_completion",
         [("user", '{"a": [1]}'), ("assistant", '[{"role": "x"}]')]),
    ]
    rows = formatted(spark, *(c[0] for c in cases))
    for row, (_, layout, turns) in zip(rows, cases):
        assert (row.layout, pairs(row)) == (layout, turns)
        assert row.loss == "yes" or row.loss == '[{"role": "x"}]'
    assert rows[6].fingerprint != rows[7].fingerprint and rows[6].fingerprint == rows[6].fingerprint


def test_records_without_a_layout(spark):
    rows = formatted(spark, None, "", "{broken", "[]", {}, {"prompt": "no answer"}, {"messages": "text"}, {"messages": []},
                     {"prompt": "a", "completion": "b", "response": "c"})
    for row in rows:
        assert row.layout is None and row.segments is None and row.formatted is None and row.loss is None


def test_every_layout_has_its_own_fingerprints(spark):
    seen = {}
    for name, layout in chat.LAYOUTS.items():
        must, may = chat._paths(layout)
        for some in (set(), may):
            assert seen.setdefault("\n".join(sorted(must | some)), name) == name


MARKS = ["<|im_end|>", "<|im_start|>", "<|im_end|>\n", "<|", "|>", "<||im_end|>", "<|||", "<", "|", "\n", "\\n", "\\", "\\b", "assistant",
         "$1", "a b", "é", "\U0001F600", "\x00", " ", "\r\n", ""]


def test_round_trip(spark):
    rng = random.Random(1)
    records = [[("".join(rng.choices(MARKS, k=rng.randrange(4))) if rng.random() < 0.3 else rng.choice(["user", "assistant", "system"]),
                 "".join(rng.choices(MARKS, k=rng.randrange(9)))) for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    rows = formatted(spark, *({"turns": [{"role": r, "text": t} for r, t in turns]} for turns in records))
    for row, turns in zip(rows, records):
        assert pairs(row) == turns
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>\n") == len(turns)
        assert row.formatted == "".join(s.text for s in row.segments)
        assert row.loss == "".join(t for r, t in turns if r == "assistant")


def plain(rows):
    """The digests of the query, from rows (conv_id, turn, role, text)."""
    by_conv, out = {}, {}
    said = "<|im_end|><|im_start|>assistant ok"
    for conv, turn, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in op11_chat_format(spark, SF).collect()}
    assert got == plain(rows) and len(got) > 5


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "x"), (2, None, None, "x"), (None, 3, "assistant", "no id"),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, None, "<|im_end|>\n<|im_start|>user\nhi"), (4, 0, "", ""),
            (5, 0, "assistant", "long text <| " * 200_000), (6, 0, "user\nwith lines", "\n"), (7, 0, None, None)]
    schema = "conv_id long, turn long, role string, text string, record string, segments int, layout string"
    spark.createDataFrame([(*r, "r", 1, "l") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in op11_chat_format(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in op11_chat_format(spark, f"{tmp_path}/none").collect()] == [-1]


@pytest.mark.parametrize("columns", [["Layout", "_fields"], ["fingerprint", "_mark", "SEGMENTS"]])
def test_other_columns_pass_or_are_replaced(spark, columns):
    df = spark.createDataFrame([(json.dumps({"prompt": "a", "completion": "b"}),)], "record string")
    made = chat.format_records(df.select("record", *(F.lit(7).alias(c) for c in columns)))
    kept = [c for c in columns if c.startswith("_")]
    assert made.columns == [*kept, "fingerprint", "layout", "segments"]
    assert all(made.first()[c] == 7 for c in kept)


def test_no_python_in_the_plan(spark):
    plan = op11_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
