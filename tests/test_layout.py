import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import figures as P
from palimpsest.operators import lists as L
from palimpsest.operators import sweep as S
from palimpsest.operators import tables as T
from palimpsest.operators import verify as V


def test_clusters_grow_until_none_touch(spark):
    rnd = random.Random(3)
    rows = [(1, "prod", p, i, float(x), float(y), x + rnd.uniform(5, 25), y + rnd.uniform(5, 25)) for p in range(3) for i, (x, y) in enumerate((rnd.uniform(0, 400), rnd.uniform(0, 400)) for _ in range(40))]
    got = P.clusters(spark.createDataFrame(rows, "pair_id int, side string, page int, shape int, x0 double, y0 double, x1 double, y1 double")).collect()
    for p in range(3):
        boxes = {}
        for r in (r for r in got if r.page == p):
            b = boxes.setdefault(r.cluster, [r.x0, r.y0, r.x1, r.y1])
            b[:] = [min(b[0], r.x0), min(b[1], r.y0), max(b[2], r.x1), max(b[3], r.y1)]
        all_boxes = list(boxes.values())
        assert not any(a[0] - 12 <= b[2] and b[0] - 12 <= a[2] and a[1] - 12 <= b[3] and b[1] - 12 <= a[3] for i, a in enumerate(all_boxes) for b in all_boxes[:i])
    assert len(got) == len(rows)


def test_pages_of_one_shape_cost_no_call_of_pandas(spark):
    rows = [(i, "prod", 0, k, 20.0 * k, 0.0, 20.0 * k + 5.0 + 5.0 * (i % 2), 9.0) for i in range(400) for k in range(i % 3)]
    got = P.clusters(spark.createDataFrame(rows, "pair_id int, side string, page int, shape int, x0 double, y0 double, x1 double, y1 double"))
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert sorted((r.pair_id, r["shape"], r.cluster) for r in got.collect()) == [(i, k, k if i % 2 == 0 else 0) for i in range(400) for k in range(i % 3)]


def test_fingerprints_and_similarity(spark):
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 255, (64, 48)).astype(np.uint8)
    rows = [(bytearray(a.tobytes()), 48, 64), (bytearray((a // 2).tobytes()), 48, 64), (bytearray(rnd.integers(0, 255, (64, 48)).astype(np.uint8).tobytes()), 48, 64), (None, 0, 0)]
    df = spark.createDataFrame(rows, "g binary, w int, h int").withColumn("f", P.fingerprint("g", "w", "h")).withColumn("i", F.monotonically_increasing_id())
    f = {i: r for i, r in enumerate(df.orderBy("i").collect())}
    assert f[3].f.dhash is None and f[0].f.stddev > 50
    pair = lambda i, j: spark.createDataFrame([(f[i].f, f[j].f)], df.select(F.col("f").alias("a"), F.col("f").alias("b")).schema).select(P.similarity(F.col("a"), F.col("b"))).first()[0]
    assert pair(0, 0) > 0.999 and pair(0, 1) > 0.95 and pair(0, 2) < 0.6


def test_stitching_and_headers(spark):
    schema = "pair_id int, side string, page int, tbl int, n_cols int, edges array<double>, top double, bottom double, opens_with_text boolean"
    rows = [(1, "stage", 0, 0, 3, [0.0, 5.0, 9.0], 0.5, 0.95, False), (1, "stage", 1, 0, 3, [0.0, 5.0, 9.0], 0.05, 0.95, False), (1, "stage", 2, 0, 2, [1.0, 5.0, 9.5], 0.05, 0.4, False), (1, "stage", 3, 0, 3, [0.0, 5.0, 9.0], 0.05, 0.4, False)]
    assert [r.table for r in T.stitched(spark.createDataFrame(rows, schema)).orderBy("page").collect()] == [1, 1, 1, 2]
    parts = spark.createDataFrame([(1, "stage", 1, 0, ["item", "range"]), (1, "stage", 1, 1, ["item", "range"]), (1, "stage", 1, 2, ["setting", "5"])], "pair_id int, side string, table int, page int, header array<string>")
    assert [r.page for r in T.headers_not_repeated(parts).collect()] == [2]


def test_table_findings(spark):
    kind = "struct<n_cols:int,fragments:int,edges:array<double>>"
    rows = [(1, (3, 1, [0.0, 50.0, 100.0]), (3, 2, [0.0, 55.0, 100.0])), (2, (3, 1, [0.0, 50.0, 100.0]), (2, 1, [0.0, 100.0]))]
    got = {(r.i, r.message) for r in T.compare_tables(spark.createDataFrame(rows, f"i int, prod {kind}, stage {kind}")).collect()}
    assert got == {(1, "Table split across more pages"), (1, "Table column layout differs"), (2, "Table columns differ")}


def test_vertical_merges_and_words_in_cells(spark):
    cells = [(1, "prod", 0, 0, r, 0, f"t{r}", 0.0, 10.0 * r, 10.0, 10.0 * r + 10, top, bottom) for r, (top, bottom) in enumerate([(True, False), (False, False), (False, True), (True, True)])]
    df = spark.createDataFrame(cells, "pair_id int, side string, page int, tbl int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double, border_top boolean, border_bottom boolean")
    assert [(r["row"], r.rows) for r in T.column_merges(df).orderBy("row").collect()] == [(0, 3), (3, 1)]
    words = spark.createDataFrame([(1, "prod", 0, 7, 1.0, 11.0, 3.0, 15.0), (1, "prod", 0, 8, 50.0, 1.0, 60.0, 5.0)], "pair_id int, side string, page int, word_id int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.word_id, r["row"]) for r in T.words_to_cells(words, df).collect()] == [(7, 1)]
    fills = spark.createDataFrame([(1, "prod", 0, 0x101010, 0.0, 0.0, 10.0, 5.0)], "pair_id int, side string, page int, fill int, x0 double, y0 double, x1 double, y1 double")
    assert [r["row"] for r in T.dark_regions(df.where("row = 0"), fills).collect()] == [0]


def test_words_of_one_id_are_one_word(spark):
    key = "pair_id int, side string, page int, "
    cells = spark.createDataFrame([(1, "prod", 0, 0, 5, 0, 0.0, 0.0, 10.0, 10.0), (1, "prod", 0, 0, 6, 0, 20.0, 0.0, 30.0, 10.0)], key + "tbl int, row int, col int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(1, "prod", 0, 7, x, 1.0, x + 2.0, 3.0) for x in (24.0, 4.0, 5.0)] + [(1, "prod", 0, None, 4.0, 1.0, 6.0, 3.0)], key + "word_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.word_id or 0, r["row"]) for r in T.words_to_cells(words, cells).collect()) == [(0, 5), (7, 5)]


def test_each_table_is_dark_by_its_own_box(spark):
    key = "pair_id int, side string, page int, "
    tables = spark.createDataFrame([(1, "prod", 0, 3, x, 0.0, x + 10.0, 10.0) for x in (0.0, 50.0)] + [(1, "prod", 0, 4, 2.0, 2.0, 2.0, 2.0)], key + "tbl int, x0 double, y0 double, x1 double, y1 double")
    fills = spark.createDataFrame([(1, "prod", 0, 0x101010, 0.0, 0.0, 10.0, 5.0)], key + "fill int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.tbl, r.x0) for r in T.dark_regions(tables, fills).collect()] == [(3, 0.0)]


def test_frames_of_just_that_saturation_count(spark):
    key = "pair_id int, side string, page int, "
    box = ", x0 double, y0 double, x1 double, y1 double"
    figures = spark.createDataFrame([(1, "prod", page, 1, 0.0, 0.0, 100.0, 80.0) for page in range(1, 13)], key + "fig int" + box)
    # Nine twentieths to the point, and one channel less.
    strokes = {page: (20 * page << 16) + (11 * page << 8) + 11 * page for page in range(1, 13)}
    draws = spark.createDataFrame([(1, "prod", page, "s", True, 1, c + less, 10.0, 10.0, 40.0, 40.0) for page, c in strokes.items() for less in (0, 0x0101)], key + "type string, closed boolean, items int, stroke int" + box)
    assert sorted(r.page for r in P.highlight_boxes(figures, draws).collect()) == list(range(1, 13))


def test_lines_do_not_hang_on_the_order_of_the_rows(spark):
    schema = "pair_id int, side string, page int, text string, x0 double, y0 double, x1 double, y1 double"
    # Two words start at one point; whether the third shares half a height with the one before depends on which is the last.
    words = [(1, "s", 0, "tall", 16.0, 160.0, 36.0, 184.0), (1, "s", 0, "low", 16.0, 160.0, 75.0, 166.0), (1, "s", 0, "next", 124.0, 164.0, 157.0, 184.0)]
    lines = [sorted((r.band, r.piece, r.x0, r.x1) for r in S.printed_lines(spark.createDataFrame(w, schema).coalesce(1)).collect()) for w in (words, words[::-1], [words[1], words[0], words[2]])]
    assert lines[0] == lines[1] == lines[2]


def test_marker_changes_are_grouped(spark):
    schema = "pair_id int, page int, y double, text string"
    prod = L.list_items(spark.createDataFrame([(1, 0, 20.0 * i, f"{i + 1}. Do step {w}") for i, w in enumerate("vwxyz")], schema))
    stage = L.list_items(spark.createDataFrame([(1, 0, 20.0 * i, f"{m} Do step {w}") for i, (m, w) in enumerate(zip(["a.", "(b)", "c .", "d.", "e."], "vwxyz", strict=True))], schema))
    (run,) = L.marker_changes(prod, stage).collect()
    assert run.n == 5 and run.summary == "is step 1 in the baseline but item a in the candidate (and 4 more like it)"
    assert L.marker_changes(prod, prod).count() == 0


def test_detached_markers_join_their_text(spark):
    schema = "pair_id int, side string, page int, block int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, "s", 0, 0, "1.", 100.0, 0.0, 108.0, 10.0), (1, "s", 0, 1, "Press", 125.0, 0.0, 160.0, 10.0), (1, "s", 0, 2, "far", 300.0, 0.0, 320.0, 10.0), (1, "s", 0, 3, "2.", 100.0, 20.0, 108.0, 30.0), (1, "s", 0, 4, "Hold", 125.0, 21.0, 160.0, 31.0)]
    got = {(r.marker, r.text) for r in L.detached_items(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("1.", "Press"), ("2.", "Hold")}


def test_shared_run_and_anchor(spark):
    df = spark.createDataFrame([("see the user manual online", "the user manual"), ("abc", None)], "a string, b string")
    assert [r.n for r in df.select(L.shared_run("a", "b").alias("n")).collect()] == [15, 0]
    assert df.select(L.link_anchor(F.col("a"), F.lit("USER  manual"))).first()[0] == 7


def test_printed_lines_and_boxes(spark):
    schema = "pair_id int, side string, page int, text string, x0 double, y0 double, x1 double, y1 double"
    words = [(1, "s", 0, "b", 20.0, 1.0, 30.0, 11.0), (1, "s", 0, "a", 5.0, 0.0, 15.0, 10.0), (1, "s", 0, "far", 100.0, 0.5, 120.0, 10.5), (1, "s", 0, "next", 5.0, 20.0, 25.0, 30.0)]
    got = [r.text for r in S.printed_lines(spark.createDataFrame(words, schema)).orderBy("y0", "x0").collect()]
    assert sorted(got) == ["a b", "far", "next"]
    boxes = V.box_clusters(spark.createDataFrame(words, schema)).orderBy("y0").collect()
    assert sorted((r.n, r.x1) for r in boxes) == [(1, 25.0), (1, 120.0), (2, 30.0)]


def test_inventory_and_gaps(spark):
    key = "pair_id int, side string, page int"
    box = ", x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([(1, s, 0) for s in ("prod", "stage") for _ in range(3)], key)
    images = spark.createDataFrame([(1, "prod", 0, 0.0, 0.0, 200.0, 180.0), (1, "prod", 0, 0.0, 0.0, 14.0, 14.0)], key + box)
    links = spark.createDataFrame([(1, "prod", 0, "http://a"), (1, "stage", 0, "http://b")], key + ", uri string")
    inv = S.inventory(words, images, links, spark.createDataFrame([(1, "stage", 0)], key))
    side = lambda s: inv.where(F.col("side") == s).select(F.struct(*[c for c in inv.columns if c != "side"]).alias(s))
    gaps = S.page_gaps(side("prod").join(side("stage"), F.col("prod.page") == F.col("stage.page")))
    assert {r.gap for r in gaps.collect()} == {"artwork", "links lost", "links added", "table"}


def test_verdicts_never_promote_a_review(spark):
    rows = [("drop", "confirmed"), ("confirmed", "review"), ("review", "confirmed"), ("confirmed", "confirmed")]
    got = V.applied(spark.createDataFrame(rows, "verdict string, confidence string")).collect()
    assert sorted(r.confidence for r in got) == ["confirmed", "review", "review"]


def test_small_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    words = lambda *w: F.array(*map(F.lit, w))
    assert value(V.cross_present(words("a", "b"), words("a", "b", "c"))) is True
    assert value(V.token_f1(words("a", "a", "b"), words("a", "c"))) == 0.4
    assert value(V.content_label(F.lit("text"), F.lit(9))) == "paragraph"
    assert value(V.advisory(F.lit(0.0), F.lit("Front"), F.lit("a b c d"))) is True
    assert value(S.gap_changed(F.lit(10.0), F.lit(17.0))) is True
    assert value(L.indent_changed(F.lit(10.0), F.lit(15.0))) is False
    assert value(L.marker_size_changed(F.lit(10.0), F.lit(20.0))) is False
    assert value(P.broken_reason(F.lit(0), F.lit(True), F.lit(False), F.lit(5), F.lit(5.0))) == "empty stream"


def test_closest_rows_are_those_of_the_plain_greedy_match(spark):
    rnd = random.Random(5)
    sides = [{(t, r): [rnd.choice("abcdef") for _ in range(rnd.randint(3, 5))] for t in range(3) for r in range(40)} for _ in range(2)]
    df = lambda side: spark.createDataFrame([(t, r, w) for (t, r), words in side.items() for w in words], "tbl int, row int, token string")
    want = set()
    for t in range(3):
        scored = []
        for (u, p), a in sides[0].items():
            for (v, s), b in sides[1].items():
                score = sum(min(a.count(w), b.count(w)) for w in set(a)) / max(len(a), len(b))
                if u == v == t and score >= 0.6:
                    scored.append((-score, p, s))
        left, right = set(), set()
        for score, p, s in sorted(scored):
            if p not in left and s not in right:
                left.add(p)
                right.add(s)
                want.add((t, p, s, -score))
    got = T.closest_rows(df(sides[0]), df(sides[1]))
    assert {tuple(r) for r in got.select("tbl", "prod_row", "stage_row", "similarity").collect()} == want
    # Copies are not paired with each other all to all.
    assert "Join" not in got._jdf.queryExecution().toString()
