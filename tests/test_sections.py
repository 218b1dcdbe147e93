import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from palimpsest.operators import findings as N
from palimpsest.operators import sections as S

RECORD = "pair_id bigint, section bigint, side string, ord bigint, kind string, text string"
ROW = "pair_id bigint, section bigint, kind string, op string, prod string, stage string"


def rows_of(spark, *rows):
    return spark.createDataFrame([(1, 1, "prose", *r) for r in rows], ROW)


def test_alignment_keeps_unrelated_lines_apart_and_kinds_together(spark):
    a = ["Intro line here", "Useful tools for you", "Press the red button now", "End of it."]
    b = ["Intro line here", "EPREL Registration Number", "Press the green button now", "End of it"]
    recs = [(1, 1, s, n, "prose", t) for s, ts in (("prod", a), ("stage", b)) for n, t in enumerate(ts)] + [(1, 1, "prod", 9, "table", "cell"), (1, 1, "stage", 9, "table", "c ell")]
    got = {(r.kind, r.op, r.prod, r.stage) for r in S.aligned_rows(spark.createDataFrame(recs, RECORD)).collect()}
    assert got == {("prose", "equal", a[0], b[0]), ("prose", "prod", a[1], None), ("prose", "stage", None, b[1]), ("prose", "change", a[2], b[2]), ("prose", "equal", a[3], b[3]), ("table", "equal", "cell", "c ell")}


def test_alignment_is_that_of_its_definition(spark):
    rnd = random.Random(1)
    recs = [(p, 1, s, n, "prose", rnd.choice(["aaa bbb", "ccc ddd", "eee fff", "aaa ccc"])) for p in range(5) for s in ("prod", "stage") for n in range(rnd.randrange(1, 9))]
    got = S.aligned_rows(spark.createDataFrame(recs, RECORD)).collect()
    for p in range(5):
        a, b = ([t for q, _, side, _, _, t in recs if q == p and side == s] for s in ("prod", "stage"))
        equal = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        mine = [r for r in got if r.pair_id == p]
        assert sum(r.op == "equal" for r in mine) == equal
        assert sorted(r.prod_ord for r in mine if r.prod_ord is not None) == list(range(len(a))) and sorted(r.stage_ord for r in mine if r.stage_ord is not None) == list(range(len(b)))
        assert all(len(set(r.prod.split()) & set(r.stage.split())) >= 0.2 * len(set(r.prod.split()) | set(r.stage.split())) for r in mine if r.op == "change")


def test_lines_found_elsewhere(spark):
    rows = rows_of(spark, ("prod", "Clean the lens with a soft dry cloth", None), ("prod", "Clean the lamp with a soft wet cloth", None), ("stage", None, "Nothing like it anywhere"), ("prod", "short", None), ("equal", "x", "x"))
    there = [("stage", "Clean the lens with a soft, dry cloth."), ("stage", "Something else altogether"), ("prod", "whatever this is")]
    got = {r.prod: (r.op, r.stage, r.relocated) for r in S.relocated(rows, spark.createDataFrame([(1, *t) for t in there], "pair_id bigint, side string, text string")).collect()}
    assert got["Clean the lens with a soft dry cloth"] == ("equal", there[0][1], "stage")
    assert got["Clean the lamp with a soft wet cloth"][0] == "change" and got["short"] == ("prod", None, None) and got["x"] == ("equal", "x", None) and got[None][0] == "stage"


def test_relocation_equals_a_full_search(spark):
    rnd = random.Random(2)
    words = ["lamp", "lens", "clean", "dry", "cloth", "press", "button", "power"]
    say = lambda: " ".join(rnd.choices(words, k=rnd.randrange(3, 7)))
    lone, there = sorted({say() for _ in range(25)}), sorted({say() for _ in range(30)})
    got = {r.prod: (r.op, r.stage) for r in S.relocated(rows_of(spark, *[("prod", t, None) for t in lone]), spark.createDataFrame([(1, "stage", t) for t in there], "pair_id bigint, side string, text string")).collect()}
    for t in lone:
        scored = [(SequenceMatcher(None, o, t, autojunk=False).ratio(), o) for o in there if len(o) >= 12 and abs(len(o) - len(t)) <= 0.5 * max(len(o), len(t))]
        best = max((r for r, _ in scored), default=0)
        if len(t) < 12 or best < 0.68:
            assert got[t] == ("prod", None)
        else:
            assert got[t][0] == ("equal" if best >= 0.94 else "change") and dict((o, r) for r, o in scored)[got[t][1]] == best


def test_runs_of_index_entries_become_furniture(spark):
    rows = [(1, 1, "prose", n, "prod", t, None, None) for n, t in enumerate(["Setup 4", "Care 5", "Lamp 6", "no entry", "Safety 9"])] + [(1, 1, "prose", 9, "equal", "Setup 4", "Setup 4", None)]
    got = S.index_runs_refiled(spark.createDataFrame(rows, "pair_id bigint, section bigint, kind string, ord int, op string, prod string, stage string, callout string")).orderBy("ord").collect()
    assert [r.kind for r in got] == ["chrome"] * 5 + ["prose"]


def test_bounds_and_neighbours_follow_what_both_have(spark):
    kind = "struct<page:int,y:double>"
    rows = [(1, 0, (0, 1.0), (0, 1.0)), (1, 1, None, (1, 1.0)), (1, 2, (3, 2.0), (4, 2.0))]
    m = spark.createDataFrame(rows, f"pair_id bigint, n int, prod {kind}, stage {kind}")
    assert [(r.n, r.stage_end.page if r.stage_end else None) for r in S.wide_bounds(m).orderBy("n").collect()] == [(0, 4), (2, None)]
    assert [(r.before, r.after) for r in S.neighbours(m).orderBy("n").collect()] == [(None, 2), (0, 2), (0, None)]
    s = spark.createDataFrame([("Setup", "matched", None), ("Care of lamps", "differs", "Missing text")], "title string, status string, message string")
    assert [S.filtered(s, True).count(), S.filtered(s, heading="CARE").count(), S.filtered(s, message="Missing text").count(), S.filtered(s).count()] == [1, 1, 1, 2]


def test_callout_icons(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    text = "Caution: never look into the lamp while it is switched on"
    blocks = [(1, "prod", 0, 1, text, 100.0, 50.0, 400.0, 70.0), (1, "prod", 0, 2, "Another note about cleaning lenses carefully", 100.0, 150.0, 400.0, 170.0), (1, "stage", 2, 7, text.lower(), 120.0, 50.0, 400.0, 70.0), (1, "stage", 2, 8, "another note about cleaning lenses carefully", 120.0, 150.0, 400.0, 170.0)]
    images = [(1, "prod", 0, 60.0, 50.0, 80.0, 70.0, 0.5), (1, "prod", 0, 60.0, 150.0, 80.0, 170.0, 0.5), (1, "stage", 2, 30.0, 50.0, 50.0, 70.0, 0.05), (1, "stage", 2, 40.0, 150.0, 60.0, 170.0, 0.6)]
    got = N.callout_icon_issues(spark.createDataFrame(blocks, f"pair_id bigint, side string, page int, block int, text string, {box}"), spark.createDataFrame(images, f"pair_id bigint, side string, page int, {box}, colour double")).collect()
    assert [(r.block, r.stage_block) for r in got] == [(1, 7)]


def test_slices_and_their_headings(spark):
    records = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (1, -1, 5), (1, 1, 9)], "pair_id int, slice int, ord int")
    marks = spark.createDataFrame([(1, 0, "A"), (1, 5, "B")], "pair_id int, ord int, title string")
    assert {(r.slice, r.heading) for r in N.slice_anchors(records, marks).collect()} == {(0, "A"), (1, "B")}
    assert spark.range(1).select(F.size(N.callout_key(F.lit("Note: of the the lamp, LAMP is on"))).alias("n")).first().n == 2
