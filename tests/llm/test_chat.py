import hashlib

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from tagloom.llm import chat
from tagloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, conv string, turns int, segments string"
TEXTS = [
    "plain", "", None, "\\", "\\\\n \\", "</turn>", "<turn user>x</turn>\n", "<\\/turn>", "</turn\\>", "$1 \\$0", "### Assistant:\n", "a\n\nb</turn>", "<turn\\ ",
    "ü日本\U0001f600" * 3, "long </turn> " * 5000,
]


def test_round_trip(spark):
    rows = [(i, 0, "user", t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(i, 1, "assistant", t, "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [(90, 0, "a>b\\<turn ", "odd role", None, None, None), (90, 1, None, "no role", None, None, None), (None, None, "user", "no key", None, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {
        r["conv"]: r
        for r in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    }
    for i, text in enumerate(TEXTS):
        assert [tuple(t) for t in got[i]["back"]] == [("user", text or ""), ("assistant", text or "")]
        assert got[i]["loss"] == (text or "") and got[i]["valid"]
        assert got[i]["formatted"].count("<turn ") == got[i]["formatted"].count("</turn>") == 2
        assert got[i]["formatted"] == "".join(s["text"] for s in got[i]["segments"])
    assert [tuple(t) for t in got[90]["back"]] == [("a>b\\<turn ", "odd role"), ("", "no role")] and not got[90]["valid"]
    assert [tuple(t) for t in got[None]["back"]] == [("user", "no key")]


@pytest.mark.parametrize("markers", [("<|start|>", "<|sep|>", "<|end|>"), ("### ", ": ", "\n\n"), ("[INST ", "]", "[/INST]"), ("a", "b", "ccc"), ("«", "»\n", "¶")])
def test_other_templates(spark, markers):
    template = chat.Template(*markers, loss_roles=("user",))
    texts = [*TEXTS, "".join(markers), markers[2] * 3, markers[2][:-1], "\\0\\1\\2\\3", "".join(m[0] for m in markers), *markers, "abcabccc\\\\0"]
    roles = ["user", "a: b", *markers, "\\1"]
    rows = [(i, j, roles[(i + j) % len(roles)], texts[(i + k) % len(texts)]) for i in range(len(texts)) for j, k in enumerate((0, 3, 7))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    for r in out.withColumn("back", chat.read_back(F.col("formatted"), template)).withColumn("loss", chat.loss_text(F.col("segments"), template)).collect():
        mine = [(role, text or "") for i, _, role, text in rows if i == r["conv"]]
        assert [tuple(t) for t in r["back"]] == mine
        assert r["loss"] == "".join(text for role, text in mine if role == "user")


@pytest.mark.parametrize("markers", [("", ">", "x"), ("\\a", ">", "x"), ("0", ">", "x"), ("<a", "\n", "\n\n"), ("<", "x<", "<x")])
def test_templates_that_cannot_work(markers):
    with pytest.raises(ValueError):
        chat.Template(*markers)


def test_state_machine(spark):
    cases = {"sua": True, "ua": True, "u": True, "uau": True, "s": False, "a": False, "uu": False, "aua": False, "usa": False, "su": True, "uaa": False, "suas": False}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, j, names[c], "t") for i, case in enumerate(cases) for j, c in enumerate(case)]
    got = {r["conv"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_ties_and_repeats_and_empty(spark):
    schema = "conv_id int, turn int, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    frame = chat.format_chats(spark.createDataFrame(rows, schema))
    assert [s["text"] for s in frame.first()["segments"]][1::3] == ["first", "a", "a", "b"]
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, sf_dir):
    name = "op8_chat_formatting"
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, duck(sf_dir).execute(ORACLES[name]).df()) is None
    hard = r"\### Assistant: </turn> ok"
    extra = got[got.conv_id == -7].iloc[0]
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert extra.loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and extra.loss_chars == len(hard)
