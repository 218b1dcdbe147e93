import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from palimpsest.operators import compare as C
from palimpsest.operators import issues as I
from palimpsest.operators import ordered as O
from palimpsest.sources import relations as R
from palimpsest.streaming import arrivals


def test_bags_keep_multiplicity(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "p int, w string")
    b = spark.createDataFrame([(1, "x"), (1, "z")], "p int, w string")
    assert {(r.w, r.lost, r.gained) for r in C.bag_difference(a, b, ["p", "w"]).collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}
    m = C.match_by_key(a.withColumn("o", F.lit(1)), b.withColumn("o", F.lit(1)), ["p", "w"], ["o"])
    assert {(r.w, r.nth, r.status) for r in m.collect()} == {("x", 1, "same"), ("x", 2, "missing"), ("y", 1, "missing"), ("z", 1, "added")}


def test_alignment_is_order_true_and_one_to_one(spark):
    rows = [(1, "prod", i, t) for i, t in enumerate(["intro", "press the button", "care text", "end"])] + [(1, "stage", i, t) for i, t in enumerate(["intro", "press a button", "end", "new"])]
    got = {(r.op, r.prod_ord, r.stage_ord) for r in C.aligned(spark.createDataFrame(rows, "pair_id long, side string, ord long, key string"), ["pair_id"]).collect()}
    assert got == {("same", 0, 0), ("changed", 1, 1), ("missing", 2, None), ("same", 3, 2), ("added", None, 3)}


def test_word_diff_spells_out_similar_words(spark):
    df = spark.createDataFrame([(["Nevigate", " ", "to"], ["Navigate", " ", "to"]), (["a", " ", "cat"], ["a", " ", "dog"])], "a array<string>, b array<string>")
    first, second = [r.d for r in df.select(C.word_diff("a", "b").alias("d")).collect()]
    assert [(o.type, o.text, o.level) for o in first] == [("equal", "N", None), ("del", "e", "char"), ("ins", "a", "char"), ("equal", "vigate to", None)]
    assert [(o.type, o.text) for o in second] == [("equal", "a "), ("del", "cat"), ("ins", "dog")]


def test_greedy_pairs_take_the_best_first(spark):
    rnd = random.Random(1)
    rows = [(g, a, b, round(rnd.random(), 2)) for g in range(3) for a in range(5) for b in range(6)]
    got = {tuple(r) for r in C.greedy_pairs(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s").collect()}
    want, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, s))
    assert got == want


def test_longest_rising(spark):
    rnd = random.Random(2)
    rows = [(p, i, rnd.randrange(30)) for p in range(4) for i in range(25)]
    got = C.longest_rising(spark.createDataFrame(rows, "p int, o int, v int"), ["p"], "o", "v").collect()
    for p in range(4):
        mine = [r.v for r in sorted((r for r in got if r.p == p), key=lambda r: r.o)]
        assert all(a < b for a, b in zip(mine, mine[1:], strict=False))
        best = []
        for _, _, v in (r for r in rows if r[0] == p):
            best.append(1 + max((b for b, (_, _, w) in zip(best, [r for r in rows if r[0] == p], strict=False) if w < v), default=0))
        assert len(mine) == max(best)


def test_as_of_and_sections(spark):
    heads = spark.createDataFrame([(1, 0, 0, 2, "A"), (1, 1, 1, 5, "B")], "pair_id int, ord int, page int, y int, title string")
    items = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 2, "y"), (1, 1, 4, "z"), (1, 3, 0, "w")], "pair_id int, page int, y int, t string")
    got = {(r.t, r.title) for r in O.last_before(items, heads, ["pair_id"], ["page", "y"], "title").collect()}
    assert got == {("x", None), ("y", "A"), ("z", "A"), ("w", "B")}
    inside = {(r.t, r.section) for r in O.in_section(items, O.section_bounds(heads, ["pair_id"]), ["pair_id"]).collect()}
    assert inside == {("y", 0), ("z", 0), ("w", 1)}


def test_paragraphs_and_markers(spark):
    rows = spark.createDataFrame([(1, 0, "This goes"), (1, 1, "on and hyphen-"), (1, 2, "ated."), (1, 3, "new one")], "pair_id int, ord int, text string")
    t = F.col("text")
    merged = O.merge_wrapped(rows, F.rlike(t, F.lit(r"\.$")), F.rlike(t, F.lit("^[a-z]"))).orderBy("ord").collect()
    assert [r.text for r in merged] == ["This goes on and hyphenated.", "new one"]
    marks = spark.createDataFrame([(1, 0, "1."), (1, 1, "Press"), (1, 2, "2.")], "pair_id int, ord int, text string")
    assert [r.text for r in O.attach_markers(marks, F.rlike(t, F.lit(r"^\d\.$"))).collect()] == ["1. Press"]


def test_review_fails_nothing_and_json_sink(spark, tmp_path):
    rows = [(1, "error", "review", "content", "a"), (1, "warning", "confirmed", "links", "b"), (2, "error", "confirmed", "tables", "c")]
    issues = spark.createDataFrame(rows, "pair_id int, severity string, confidence string, category string, message string")
    assert {(r.pair_id, r.passed) for r in I.verdicts(issues, ["pair_id"]).collect()} == {(1, True), (2, False)}
    I.write_json(I.report(issues, ["message"]), str(tmp_path / "out"))
    docs = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted((d["pair_id"], [i["category"] for i in d["issues"]]) for d in docs) == [(1, ["content", "links"]), (2, ["tables"])]


def test_relations_read_what_is_there(spark, tmp_path):
    spark.createDataFrame([(1, "prod", 0, 612, "more")], "pair_id long, side string, page int, width int, extra string").write.parquet(str(tmp_path / "pages"))
    got = R.read_relation(spark, str(tmp_path / "pages"), "pages")
    assert got.columns == ["pair_id", "side", "page", "width", "height"] and tuple(got.first()) == (1, "prod", 0, 612.0, None)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    assert R.document_files(spark, str(tmp_path)).select("length").first()[0] == 8


def test_arrivals_are_compared_once(spark, tmp_path):
    incoming = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(incoming)
    run = lambda: arrivals.compare_arrivals(spark, incoming, "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.select("doc_id", F.length("text").alias("n"))).awaitTermination(60)
    assert run() and run()
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 3), (2, 1)]


def test_ratio_is_the_one_of_sequences():
    assert abs(SequenceMatcher(None, "press the button", "press a button", autojunk=False).ratio() - 0.8667) < 1e-3
