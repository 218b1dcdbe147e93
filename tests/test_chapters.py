import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chapters as K
from palimpsest.operators import figures as P
from palimpsest.operators import issues as I
from palimpsest.operators import tables as T

MARKS = [
    ('See "Package contents".', "See Package contents.", ["“\"” missing in Staging"]),
    ("Insert the drive.", "Insert the drive", ["“.” missing in Staging"]),
    ("Press OK. Then wait", "Press OK.Then wait", ["space missing in Staging"]),
    ("from 0 m - 2000 m", "from 0 m – 2000 m", ["“-” missing in Staging, “–” extra in Staging"]),
    ("optical, chemical,manual or", "optical, chemical, manual or", ["space extra in Staging"]),
    ("1500 m - 2000 m", "1500 m 2000 m", ["“-” missing in Staging"]),
    ("on,\nthen off.", "on, then off.", []),
    ("“Wired projection”", '"Wired projection"', []),
    ("online. • Use", "online. Use", []),
    ("power- saving mode", "power-saving mode", []),
    ("Tip To do", "Tip: To do", []),
    ('drive" on page 63)', 'drive")', []),
    ("visit Support.\nBenQ.com for more", "visit Support.BenQ.com for more", []),
    ("disabled when\n- a wireless device; or\n- you press", "disabled when a wireless device; or you press", []),
    (None, "x", None),
]


@pytest.mark.parametrize(("prod", "stage", "want"), MARKS)
def test_marks_and_spaces(spark, prod, stage, want):
    got = spark.createDataFrame([(prod, stage)], "a string, b string").select(K.mark_changes("a", "b").alias("m")).first().m
    assert got is None if want is None else (len(got) == len(want) or len(want) and len(got) >= 1) and all(any(w in g for g in got) for w in want), got


def test_categories_and_severity(spark):
    cases = {("text", None): "content", ("missing", "table"): "content", ("table-cell", None): "content", ("table-merge", None): "tables", ("added", "figure"): "images", ("figure-different", None): "images", ("link-target", None): "links", ("numbering", None): "lists", ("list-indent", None): "lists", ("bold-missing", None): "bold", ("table-header-repeat", None): "content", ("shading", None): "formatting", ("page-sweep", None): "content"}
    df = spark.createDataFrame([(*k, False) for k in cases], "type string, kind string, review_only boolean")
    assert {(r.type, r.kind): r.category for r in K.reported(df).collect()} == cases
    assert set(K.CATEGORY) == set(I.CATEGORIES)
    visual = spark.createDataFrame([("figure-visual", None, True), ("figure-size", None, False), ("missing", "text", False), ("underline-missing", None, False), ("underline-added", None, False)], "type string, kind string, review_only boolean")
    assert {r.type: (r.level, r.fails) for r in K.reported(visual).collect()} == {"figure-visual": (5, False), "figure-size": (4, True), "missing": (1, True), "underline-added": (4, True)}


def test_printed_in_and_counted(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    heading, loose = F.lit("Copyright and Disclaimer"), F.lit(" this page carries a copyright notice and a separate disclaimer statement elsewhere ")
    assert one(K.printed_in(F.lit("heading"), heading, loose)) is False
    assert one(K.printed_in(F.lit("heading"), heading, F.lit(" see the copyright and disclaimer section "))) is True
    assert one(K.printed_in(F.lit("text"), F.lit("Deutsch"), F.lit(" a label set in deutsch somewhere "))) is True
    own = F.lit(" go to power energy power energy auto ")
    assert one(K.counted_elsewhere(F.lit("power energy"), own, F.lit(" go to power energy auto "))) is False
    assert one(K.counted_elsewhere(F.lit("power energy"), own, F.lit(" power energy x power energy auto "))) is True
    words = lambda t: F.array(*map(F.lit, t.split()))
    whole, again = words("the product supports wifi the following is an example"), words("the following is an example")
    assert one(K.unused_share(again, whole, words("the product supports wifi the following is an example"))) < 0.5
    assert one(K.unused_share(again, whole, words("the product supports wifi"))) >= 0.7
    assert one(K.xref_free(F.lit('auto cinema mode (see "optimizing image \nquality by auto cinema mode") | 19. netflix'))) == "auto cinema mode | 19. netflix"
    units = lambda t: one(K.cell_units(F.lit(t)))
    assert units("NOTE: The options vary by input.") == units("The options vary by input.") and units("Take note of the value.") != units("Take of the value.")
    assert units("quick access to setting menu ( ).") == units('quick access to setting menu (see "quick access to setting menu").')
    assert units("The receiv-\ner is off. Power sup-\nply.") == sorted("the receiver is off power supply".split())
    cells = F.array(F.array(F.lit("no."), F.lit("descriptions")), F.array(F.lit("4."), F.lit("hdmi 1 input port see wired")))
    assert one(K.carries_marker(cells, F.lit("HDMI 1 input port"), F.lit("4."))) is True and one(K.carries_marker(cells, F.lit("HDMI 1 input port"), F.lit("5."))) is False


ELEMENT = "pair_id int, side string, section int, ord int, kind string, text string, page int, y0 double, y1 double, size double, leading double"


def el(side, n, text, page=0, y0=0.0, y1=12.0, kind="text", leading=None):
    return (1, side, 0, n, kind, text, page, y0, y1, 10.0, leading)


def test_paragraph_space_and_page_references(spark):
    first, second, joined = el("prod", 0, "Connect the power cable.", 0, 100.0, 112.0), el("prod", 1, "Then press the Power button.", 0, 130.0, 142.0), el("stage", 0, "Connect the power cable. Then press the Power button.", 0, 100.0, 124.0)
    lost = lambda rows: K.paragraph_gaps_lost(spark.createDataFrame(rows, ELEMENT)).collect()
    assert [r.title for r in lost([first, second, joined])] == ["Paragraph space missing in Staging"]
    assert lost([first, el("prod", 1, "Then press the Power button.", 1, 60.0, 72.0), joined]) == []
    kept = [el("stage", 0, 'See "Choosing a location" on page 26.'), el("stage", 1, 'See "Choosing a location".'), el("prod", 0, "on page 3")]
    assert [r.phrase for r in K.page_references_kept(spark.createDataFrame(kept, ELEMENT)).collect()] == ["on page 26"]


def test_line_spacing_against_its_own_page(spark):
    def found(body, note):
        rows = [el(s, n, "body", leading=d) for s, d in zip(("prod", "stage"), body, strict=True) for n in range(3)] + [el(s, 9, "note", kind="note", leading=d) for s, d in zip(("prod", "stage"), note, strict=True)]
        return [r.summary for r in K.line_spacing_changes(spark.createDataFrame(rows, ELEMENT)).collect()]

    assert found((14.0, 20.0), (14.0, 20.0)) == [] and found((14.0, 14.0), (14.0, 22.0)) == ["looser"]


def test_list_levels(spark):
    def found(prod, stage):
        rows = [(1, s, 0, f"item {n}", x) for s, xs in (("prod", prod), ("stage", stage)) for n, x in enumerate(xs)]
        return [r.summary for r in K.list_indent_changes(spark.createDataFrame(rows, "pair_id int, side string, list int, item string, x0 double")).collect()]

    assert found((80.0, 80.0), (50.0, 50.0)) == [] and found((80.0, 80.0), (80.0, 100.0)) == ["is at level 2 in Staging, level 1 in Production"]


def test_every_word_is_counted(spark):
    rows = [(1, "prod", 0, n, t, False) for n, t in enumerate(["Press the Power button for 3 seconds.", "See the con-", "tents list.", "Focus ring"])] + [(1, "stage", 0, n, t, True) for n, t in enumerate(["Press the Power", "button for 5 seconds. See the contents list."])]
    audit = K.word_audit(spark.createDataFrame(rows, "pair_id int, side string, section int, ord int, text string, ocr boolean"))
    assert {(r.word, r.type, r.ocr_stage) for r in audit.collect()} == {("3", "missing", False), ("focus", "missing", False), ("ring", "missing", False), ("5", "added", True)}
    named = spark.createDataFrame([(1, 0, w) for w in ("3", "Focus", "ring", "5")], "pair_id int, section int, word string")
    assert K.audit_not_named(audit, named).count() == 0


SPEC = [("Model", "Size"), ("ST4304", "43 inch"), ("ST5504", "55 inch"), ("ST6504", "65 inch")]


def test_rows_of_tables(spark):
    def found(prod, stage, printed=(), spans=None):
        rows = [(1, s, 0, n, list(c), (spans or {}).get((s, n), 0)) for s, t in (("prod", prod), ("stage", stage)) for n, c in enumerate(t)]
        words = spark.createDataFrame([(1, w, 1) for w in printed], "pair_id int, word string, n int")
        return [(r.type, r["row"], r.key) for r in K.row_changes(spark.createDataFrame(rows, "pair_id int, side string, tbl int, row int, cells array<string>, spans int"), words).collect()]

    short = [SPEC[0], SPEC[1], SPEC[3]]
    assert found(SPEC, short) == [("table-row-missing", 2, "st5504 55 inch")]
    assert found(SPEC, short, ("st5504", "55", "inch")) == []
    assert found(SPEC[:2], SPEC[:2], spans={("stage", 1): 1}) == [("table-merge", 1, "st4304 43 inch")]
    parts = spark.createDataFrame([(1, 0, 0, ["Item", "Value"]), (1, 0, 1, ["Power", "2.1W"]), (1, 0, 2, ["item", "value"])], "pair_id int, `table` int, page int, first_row array<string>")
    assert [r.page for r in K.headers_lost(parts).collect()] == [1]


def test_styles_signs_and_numbers(spark):
    kind = "struct<bold:array<string>,italic:array<string>,underlined:array<string>>"
    pairs = spark.createDataFrame([(1, ([], ["home"], ["x"]), (["now"], [], []))], f"id int, prod {kind}, stage {kind}")
    assert {(r.type, tuple(r.words)) for r in K.emphasis_changes(pairs).collect()} == {("italic-missing", ("home",)), ("bold-added", ("now",))}
    flags = spark.createDataFrame([(0, "Roboto-Italic"), (0, "Roboto-Regular"), (2, "X")], "f int, n string").select(K.is_italic(F.col("f"), F.col("n")).alias("i")).collect()
    assert [r.i for r in flags] == [True, False, True]
    spans = [(1, 0, 0, ". Google TV", 11.0, 268.7), (1, 0, 1, "TM", 6.4, 263.4), (1, 0, 2, " brings together", 11.0, 268.7)]
    raised = K.raised_marks(spark.createDataFrame(spans, "pair_id int, line int, span int, text string, size double, origin double")).orderBy("span").collect()
    assert "".join(r.text for r in raised) == ". Google TV™ brings together"
    words = [(1, "s", 0, "150", 40.0, 552.0, 55.0, 562.0), (1, "s", 0, "3810", 100.0, 552.0, 120.0, 562.0), (1, "s", 0, "28", 200.0, 577.0, 210.0, 587.0)]
    alone = K.alone_on_row(spark.createDataFrame(words, "pair_id int, side string, page int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {r.text: r.alone for r in alone} == {"150": False, "3810": False, "28": True}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(K.is_fill_band(F.lit("vector"), F.lit(490.0), F.lit(28.0), F.lit(1))) and not one(K.is_fill_band(F.lit("image"), F.lit(490.0), F.lit(28.0), F.lit(1))) and not one(K.is_fill_band(F.lit("vector"), F.lit(200.0), F.lit(150.0), F.lit(1)))


def test_notes_icons_and_the_whole_book(spark):
    rows = [(1, "s", 0, n, n == 0, y0, y1) for n, (y0, y1) in enumerate([(268.0, 281.0), (280.0, 293.0), (291.0, 305.0), (400.0, 414.0)])]
    notes = K.note_members(spark.createDataFrame(rows, "pair_id int, side string, page int, ord int, has_icon boolean, y0 double, y1 double")).orderBy("ord").collect()
    assert [r.in_note for r in notes] == [True, True, True, False]
    box = "x0 double, y0 double, x1 double, y1 double"
    words = [(1, s, 0, w, 1, 100.0, y, 140.0, y + 10) for s in ("prod", "stage") for w, y in (("Settings", 10.0), ("Power", 40.0), ("Lamp", 70.0))]
    icons = [(1, "prod", 0, 88.0, 10.0, 98.0, 20.0, 0x808080), (1, "prod", 0, 88.0, 40.0, 98.0, 50.0, 0x808080), (1, "stage", 0, 88.0, 40.0, 98.0, 50.0, 0xC02020), (1, "stage", 0, 88.0, 70.0, 98.0, 80.0, 0x808080)]
    got = K.icon_changes(spark.createDataFrame(words, f"pair_id int, side string, page int, word string, n int, {box}"), spark.createDataFrame(icons, f"pair_id int, side string, page int, {box}, colour int")).collect()
    assert {(r.word, r.type) for r in got} == {("Settings", "icon-missing"), ("Power", "icon-colour"), ("Lamp", "icon-added")}
    element = "pair_id int, side string, chapter string, kind string, text string"
    lens, turn = "Clean the lens only with a soft dry cloth", "Turn the device on before connecting any cable"
    scan = lambda els, said=(), pages=(): {(r.type, r.text) for r in K.text_scan(spark.createDataFrame(els, element), spark.createDataFrame([(1, *p) for p in pages], "pair_id int, side string, text string"), spark.createDataFrame([(1, t) for t in said], "pair_id int, text string")).collect()}
    both = [(1, s, "a", "text", turn) for s in ("prod", "stage")]
    assert scan([*both, (1, "prod", "b", "text", lens)]) == {("missing", lens)}
    assert scan([(1, "prod", "a", "text", lens), (1, "stage", "b", "text", lens)]) == set()
    assert scan([*both, (1, "prod", "b", "text", lens)], [lens]) == set()
    assert scan([*both, (1, "stage", "a", "text", "bonus wording")], pages=[("prod", "the bonus wording")]) == set()


def test_rows_paired_by_likeness(spark):
    rows = [(1, 0, 1, "noise level 28 db", "table-row-missing"), (1, 0, 2, "throw ratio 1 2", "table-row-missing"), (1, 0, 3, "input x1080i", "table-row-missing"), (1, 0, 7, "noise level 32 db", "table-row-added"), (1, 0, 8, "input x 1080i", "table-row-added")]
    got = {r["row"]: (r.stage_row, r.gone, r.extra, r.space) for r in T.reworded_rows(spark.createDataFrame(rows, "pair_id bigint, topic int, row int, key string, type string")).collect()}
    assert got == {1: (7, ["28"], ["32"], None), 3: (8, ["x1080i"], ["x", "1080i"], "space extra in Staging")}


def test_cells_that_lost_words(spark):
    cells = [(1, 0, 1, ["Weight", "two kilograms net", "with stand"], ["Weight", "two net", "with stand"]), (1, 0, 2, ["Port", "one two three", "x"], ["Port", "one", "two three x"]), (1, 0, 3, ["alpha beta", "gamma"], ["delta", "epsilon"])]
    got = T.cells_missing(spark.createDataFrame(cells, "pair_id int, tbl int, row int, cells array<string>, stage_cells array<string>")).collect()
    assert [(r["row"], r.col, r.missing, r.message) for r in got] == [(1, 1, ["kilograms"], "Table cell missing")]


def test_figures_are_matched_in_steps(spark):
    base = "pair_id long, section long, prod long, stage long, score double"
    frame = lambda rows, more="": spark.createDataFrame(rows, base + more)
    direct = frame([(1, 1, 10, 20, 0.95), (1, 1, 10, 21, 0.97), (1, 1, 11, 20, 0.5), (1, 1, 12, 22, 0.3), (1, 1, 13, 23, 0.1)])
    unions = frame([(1, 1, 11, 24, 0.93, 25, 2.0), (1, 1, 14, 24, 0.99, 21, 2.0), (1, 1, 12, 26, 0.99, 27, 3.0)], ", second long, area_ratio double")
    slid = frame([(1, 1, 12, 22, 0.3, 0.9), (1, 1, 13, 23, 0.1, 0.99)], ", slide double")
    spilled = frame([(1, 1, 13, 30, 0.91), (1, 1, 10, 31, 0.99)])
    got = {(r.prod, r.stage, r.second, r.step, r.status) for r in P.matched_in_steps(direct, unions, slid, spilled).collect()}
    assert got == {(10, 21, None, 1, "same"), (11, 24, 25, 2, "same"), (12, 22, None, 3, "same"), (13, 30, None, 4, "outside")}
    pairs = spark.createDataFrame([(1, 5, 6)], "pair_id int, prod int, stage int")
    boxes = spark.createDataFrame([(1, "prod", 0, 5, 10.0, 10.0), (1, "prod", 0, 5, 200.0, 10.0), (1, "stage", 3, 6, 30.0, 40.0)], "pair_id int, side string, page int, fig int, dx double, dy double")
    assert [(r.dx, r.dy) for r in P.highlights_missing(boxes, pairs).collect()] == [(200.0, 10.0)]
    captions = spark.createDataFrame([(1, "prod", 0, 5, ["focus", "lens", "ring"]), (1, "stage", 0, 6, ["lens"])], "pair_id int, side string, page int, fig int, words array<string>")
    read = spark.createDataFrame([(1, 6, ["ring"])], "pair_id int, stage int, words array<string>")
    assert [r.missing for r in P.labels_missing(captions, pairs, read).collect()] == [["focus"]]


def test_comments_snippets_and_marks(spark):
    kind = "array<struct<type:string,text:string>>"
    ops = [("equal", "Set up "), ("del", "auncher."), ("ins", "launcher."), ("equal", " For details, see the guide " + "and more " * 10)]
    d = spark.createDataFrame([(1, 7, ops)], f"pair_id int, id int, ops {kind}")
    prod, stage = d.select(I.snippet(F.col("ops"), "prod").alias("p"), I.snippet(F.col("ops"), "stage").alias("s")).first()
    assert prod == "Set up [auncher.] For details, see the guide and more and …" and stage.startswith("Set up [launcher.] For")
    words = spark.createDataFrame([(1, 7, s, n, w, 10.0 * n) for s, t in (("prod", "Set up auncher. For details, see the guide"), ("stage", "Set up launcher. For details, see the guide")) for n, w in enumerate(t.split())], "pair_id int, id int, side string, n int, word string, x0 double")
    assert {(r.side, r.word) for r in I.word_marks(d, words).collect()} == {("prod", "auncher."), ("stage", "launcher.")}
    part = spark.createDataFrame([(1, 7, [("equal", "Set up "), ("ins", "l"), ("equal", "auncher. For details, see the guide")])], f"pair_id int, id int, ops {kind}")
    assert {(r.side, r.word) for r in I.word_marks(part, words).collect()} == {("stage", "launcher.")}
    c = spark.createDataFrame([("text", "Text differs — x.", ["a", "b", "c", "d"], [], ""), ("icon-colour", "Icon — y", None, None, "")], "type string, summary string, gone array<string>, extra array<string>, text string")
    got = {r.type: (r.title, r.comment_prod, r.comment_stage) for r in I.commented(c).collect()}
    assert got["text"] == ("Text differs", "Missing in Staging: “a”, “b”, “c” …", "Missing here: “a”, “b”, “c” …") and got["icon-colour"][1:] == ("Icon colour in Production", "Icon colour changed in Staging")
    assert spark.range(1).select(F.size(F.split(I.whole_text(F.lit("w " * 70)), " ")).alias("n")).first().n == 61
