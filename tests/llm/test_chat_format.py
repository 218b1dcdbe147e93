import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss int"


def corpus():
    rnd = random.Random(8)
    bits = ["hello ", "\\", "\\\\", "###", "####", "### User: ", "</turn>", " </turn>\n", "</part>", " </part>\n", "\\c", ":", "\n", "é👍", "</tur", "n>", "\\### Assistant: </turn> ok", "$1", ""]
    rows = []
    for conv in range(60):
        for turn in range(rnd.choice([1, 2, 5, 12])):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "a:b\\c", "x: y"]), "".join(rnd.choices(bits, k=rnd.randrange(6)))))
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (101, None, "user", "no turn"), (101, 0, "assistant", "x"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "y")]
    rows += [(102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (102, 0, "user", "tie"), (103, 0, "assistant", "long " * 40000)]
    return [(*r, "clash", 1) for r in rows]


def want(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    return {c: [(role, text) for _, role, text in sorted(t)] for c, t in convs.items()}


def esc(text):
    text = text.replace("\\", "\\\\")
    for w in ("###", "</part>", "</turn>"):
        text = text.replace(w, "\\" + w)
    return text


def test_round_trip_and_loss_spans(spark):
    rows = corpus()
    out = cf.read_back(cf.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    expected = want(rows)
    assert len(out) == len(expected)
    for r in out:
        turns = expected[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert [r.formatted[s.start : s.end] for s in r.loss] == [esc(t) for role, t in turns if role == "assistant"]
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert r.formatted.count(" </turn>\n") == merged


def test_template(spark):
    rows = [(1, 0, "user", "a ### b", "", 0), (1, 1, "assistant", "c", "", 0), (1, 2, "assistant", "d\\", "", 0)]
    r = cf.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "### user: a \\### b </turn>\n### assistant: c </part>\nd\\\\ </turn>\n"


def test_empty_table(spark):
    assert cf.read_back(cf.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok"])
def test_digests_of_the_fixed_conversation(spark, text):
    rows = [(-7, 0, "user", text, "", 0), (-7, 1, "assistant", text, "", 0)]
    r = cf.read_back(cf.format_chats(spark.createDataFrame(rows, SCHEMA))).select(F.sha2("loss_text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(text.encode()).hexdigest()
