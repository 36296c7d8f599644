"""Chat formatting: layouts by fingerprint, a reversible template, the loss mask."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat
from cohortlens.llm.queries import CONTROL_TEXT, ORACLE, QUERIES

ROWS = "conv_id long, turn long, role string, text string"
NASTY = ["\\", "### ", "</turn>", "\n", "###", "### Assistant: ", "\n</turn>\n", "a", "é", "\U0001f600", "<", "/turn>", "#", " ", ":", "=", "$1", "\\n"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def digests(spark, rows, schema=ROWS):
    recs = chat.turn_rows(spark.createDataFrame(rows, schema), "conv_id", "turn", "role", "text")
    return {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(recs), "conv_id").collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "User", "=", "a:b\n", "", "### "]),
                  "".join(rng.choices(NASTY, k=rng.randrange(0, 30)))) for _ in range(rng.randrange(1, 8))]
        want[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = digests(spark, rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and g["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns)), turns
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))


def test_text_never_ends_a_turn_and_mask_covers_bytes(spark):
    df = spark.createDataFrame([("é</turn>\n### User: x", "ü\\")], "prompt string, completion string")
    r = chat.format_chats(df).first()
    assert r["layout"] == "prompt_completion"
    assert r["formatted"] == "### User: é\\</turn>\n\\### User: x\n</turn>\n### Assistant: ü\\\\\n</turn>\n"
    raw, at, under = r["formatted"].encode(), 0, b""
    for run in r["loss_runs"]:
        under += raw[at + run["skip"]:at + run["skip"] + run["take"]]
        at += run["skip"] + run["take"] + run["rest"]
    assert at == len(raw) and under.decode() == "ü\\\\"


def test_layouts_of_json_records(spark):
    recs = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "text": "q"}], "id": 3}, "message_texts", [("user", "q")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
         "shared_dialogue", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"response": "a", "prompt": "q"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\nx"), ("assistant", "o")]),
        ({"data": {"question": "q", "answer": "a"}, "source": {"question": "no"}}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "output": "a"}, None, []),
        ({"messages": []}, None, []),
        ({}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "mine") for i, (r, _, _) in enumerate(recs)], "id long, record string, layout string")
    out = {r["id"]: r for r in chat.canonical_turns(chat.json_records(df, "record")).collect()}
    assert len(out) == len(recs)
    for i, (_, layout, turns) in enumerate(recs):
        assert (out[i]["layout"], [tuple(t) for t in out[i]["turns"]]) == (layout, turns)


def test_fingerprints_differ_between_layouts():
    prints = [lay.fingerprint() for lay in chat.LAYOUTS]
    assert len(set(prints)) == len(prints)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", None, "x", "y"), (1, None, "assistant", "first", "x", "y"), (1, 0, "user", "b", "x", "y"), (1, 0, "user", "b", "x", "y"),
            (None, 1, None, "n", "x", "y"), (2, 1, "assistant", "", "x", "y")]
    got = digests(spark, rows, ROWS + ", formatted string, turns string")
    assert got[1]["turns_sha256"] == sha("assistant\nfirst\nuser\n\nuser\nb\nuser\nb\n") and got[1]["n_turns"] == 4
    assert got[None]["turns_sha256"] == sha("\nn\n") and got[None]["loss_sha256"] == sha("")
    assert got[2]["turns_sha256"] == sha("assistant\n\n") and got[2]["loss_chars"] == 0
    assert digests(spark, []) == {}
    wide = spark.createDataFrame([(7, "q", "a", "kept", 1)], "conv_id long, prompt string, response string, formatted string, extra int")
    r = chat.format_chats(wide).first()
    assert r["extra"] == 1 and r["formatted"].startswith("### User: q")


@pytest.mark.parametrize("n", [2_000_000])
def test_very_long_texts(spark, n):
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.expr(f"repeat('\\\\### x</turn>', {n // 10})").alias("prompt"), F.lit("a").alias("response"))
    assert chat.chat_digests(chat.format_chats(df), "conv_id").first()["loss_sha256"] == sha("a")


def test_registered_query_reads_back_the_control_conversation(spark):
    got = {r["conv_id"]: r for r in QUERIES["op13_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    assert got[-7]["turns_sha256"] == sha(f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n")
    assert (got[-7]["loss_sha256"], got[-7]["layout"]) == (sha(CONTROL_TEXT), "prompt_response")
    assert "op13_chat_formatting" in ORACLE
