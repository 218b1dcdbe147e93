import random
import time
from difflib import SequenceMatcher

import pytest

from palimpsest.functions import matching as M
from palimpsest.operators import chapters as K


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_runs_are_those_of_difflib(monkeypatch, most):
    monkeypatch.setattr(M, "MOST_BITS", most)
    rnd = random.Random(2)
    for n in range(1500):
        a = "".join(rnd.choice(["ab", "abcde "][n % 2]) for _ in range(rnd.randint(0, 40)))
        b = "".join(c for c in a if rnd.random() > 0.1) if n % 3 else "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 40)))
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert M.matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks()][:-1]
        assert M.changed(a, b) == [x[1:] for x in m.get_opcodes() if x[0] != "equal"]
        assert M.ratio(a, b) == m.ratio() <= (2.0 * M.most_common(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_marks_of_a_long_line_are_told_in_time(spark):
    a = " ".join(f"word{i % 50}," if i % 20 == 0 else f"word{i % 50}" for i in range(2000))
    df = spark.createDataFrame([(a, a.replace(", ", " ")), (a, a), (None, a)], "a string, b string").coalesce(1)
    df.limit(0).select(K.mark_changes("a", "b").alias("said")).collect()
    began = time.time()
    said = [r.said for r in df.select(K.mark_changes("a", "b").alias("said")).collect()]
    assert said[0] == ["“,” missing in Staging"] * 100 and said[1:] == [[], None]
    assert time.time() - began < 15


def test_relocation_reads_pairs_as_a_stream_and_long_rows_in_time(spark):
    from palimpsest.operators import sections as S

    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    long, other = text(500), text(500)
    near = long.replace("a", "z", 20)
    rows = spark.createDataFrame([(1, 0, "prose", "prod", long, None), (2, 0, "prose", "prod", long, None)], "pair_id long, section long, kind string, op string, prod string, stage string")
    there = spark.createDataFrame([(1, "stage", near), *[(1, "stage", text(500)) for _ in range(20)], (2, "stage", other)], "pair_id long, side string, text string")
    got = S.relocated(rows, there)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert {r.pair_id: r.stage for r in got.collect()} == {1: near, 2: None}


def test_a_long_line_is_told_from_an_index_line_in_time(spark):
    from palimpsest.functions import text as X

    long = "word lamp " * 12_000
    df = spark.createDataFrame([(long + "end",), (long + "12",), ("12",), ("a 12",), (None,)], "t string").coalesce(1)
    began = time.time()
    assert [r.i for r in df.select(X.is_index_line(df.t).alias("i")).collect()] == [False, True, False, True, None]
    assert time.time() - began < 10
