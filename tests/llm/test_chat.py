"""Chat formatting: layouts, reversible escapes, the loss mask and the query against plain Python and DuckDB."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import chat
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "/", "s>", "INST]", "a", "\n", "é", " ", "<<s>", "[[INST]"]


def chats(spark, rows):
    return chat.read_back(chat.formatted(chat.canonical(spark.createDataFrame(rows, SCHEMA))))


def test_escapes_are_reversible(spark):
    rnd = random.Random(12)
    rows = [(k, j, rnd.choice(["user", "assistant", "system", "<s>", "a</s>", ""]), "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 9))))
            for k in range(150) for j in range(rnd.randint(1, 6))]
    want = {}
    for k, _, role, text in rows:
        want.setdefault(k, []).append((role, text))
    found = {r.conv_id: r for r in chats(spark, rows).collect()}
    assert set(found) == set(want)
    for k, turns in want.items():
        assert [tuple(t) for t in found[k].turns] == turns
        assert found[k].loss_text == "".join(t for r, t in turns if r == "assistant")
        body = found[k].text
        assert body.count("</s>") == len(turns) and body.count("[INST]") == len(turns) and body.count("<s>") == 1
        at = len("<s>")     # the mask names exactly the assistant's characters
        for (role, text), mask in zip(turns, found[k].loss_mask, strict=True):
            piece = body[at:body.index("</s>", at) + 4]
            assert (mask.length > 0) == (role == "assistant" and text != "")
            if role == "assistant":
                assert piece[mask.start:mask.start + mask.length] == piece[len("[INST]assistant[/INST]"):-4]
            at += len(piece)


def test_every_layout_gives_the_same_turns(spark):
    pair = [("user", "ask"), ("assistant", "say")]
    records = [
        ({"prompt": "ask", "completion": "say"}, "prompt_completion", pair),
        ({"prompt": "ask", "response": "say", "id": 7}, "prompt_response", pair),
        ({"system": "be kind", "prompt": "ask", "completion": "say"}, "prompt_completion", [("system", "be kind"), *pair]),
        ({"instruction": "ask", "output": "say"}, "instruction", pair),
        ({"instruction": "ask", "input": "this", "output": "say"}, "instruction", [("user", "ask\n\nthis"), ("assistant", "say")]),
        ({"instruction": "ask", "input": "", "output": "say"}, "instruction", pair),
        ({"context": "given", "question": "ask", "answer": "say"}, "question_answer", [("user", "given\n\nask"), ("assistant", "say")]),
        ({"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "say"}]}, "messages", pair),
        ({"chat": {"messages": [{"role": "user", "content": "ask"}, {"content": "say", "role": "assistant"}]}}, "nested_messages", pair),
        ({"conversations": [{"from": "human", "value": "ask"}, {"from": "gpt", "value": "say"}]}, "speaker_values", pair),
        ({"contents": [{"role": "user", "parts": [{"text": "as"}, {"text": "k"}]}, {"role": "model", "parts": [{"text": "say"}]}]}, "message_parts", pair),
        ({"messages": []}, None, []),
        ({"prompt": "ask", "completion": "say", "messages": [{"role": "user", "content": "ask"}]}, None, []),
        ({"unknown": 1}, None, []),
        (None, None, []),
    ]
    rows = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(99, "no json {")]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("layout", F.lit("clash")).withColumn("_layout", F.lit("clash"))
    found = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(chat.records(df, "record")).collect()}
    assert found == {**{i: (name, turns) for i, (_, name, turns) in enumerate(records)}, 99: (None, [])}


def test_typed_tables_are_read_by_their_schema(spark):
    df = spark.createDataFrame([(1, "ask", None), (2, None, "say")], "conv_id long, prompt string, completion string")
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical(df).collect()}
    assert found == {1: [("user", "ask"), ("assistant", "")], 2: [("user", ""), ("assistant", "say")]}
    # fields that no layout names do not matter
    assert chat.canonical(df.withColumn("score", F.lit(1))).first().layout == "prompt_completion"


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (None, None, "assistant", "first"), (1, 0, None, None), (1, 0, "user", None), (1, 0, "assistant", ""),
            (2, 5, "user", "tie"), (2, 5, "user", "tie"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (3, 0, "assistant", "w " * 50_000)]
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chats(spark, rows).collect()}
    assert found == {None: [("assistant", "first"), ("user", "no id")], 1: [("", ""), ("assistant", ""), ("user", "")],
                     2: [("assistant", "a"), ("assistant", "b"), ("user", "tie"), ("user", "tie")], 3: [("assistant", "w " * 50_000)]}
    assert chats(spark, []).count() == 0


def test_clashing_layouts_and_marks_are_refused():
    with pytest.raises(ValueError):
        chat.by_fingerprint((chat.Layout("a", (("user", ("x",)),)), chat.Layout("b", (("assistant", ("x",)),))))
    with pytest.raises(ValueError):
        chat.Template(start="<<SYS>>")


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "<s> [INST] \\ <\\s>"), (1, 1, "assistant", None), (1, 1, None, "x"), (None, 0, "assistant", "[\\\\/INST]"), (2, None, "assistant", "ß")]
    spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("messages", F.lit("z")).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, files in ((str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet"), (SF_SMALL, f"{SF_SMALL}/conversations.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{files}')")
        got = chat.op12_chat_format(spark, folder)
        want = con.sql(chat.ORACLE_SQL)
        assert want.columns == got.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_no_python_in_the_plan(spark):
    plan = chat.op12_chat_format(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    trick = [r for r in chat.op12_chat_format(spark, SF_SMALL).collect() if r.conv_id == -1]
    lines = "".join(f"{r}\n{chat.TRICK}\n" for r in ("user", "assistant"))
    assert [(r.n_turns, r.turns_sha256, r.loss_chars) for r in trick] == [(2, hashlib.sha256(lines.encode()).hexdigest(), len(chat.TRICK))]
