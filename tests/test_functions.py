import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import text as X


def apply(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


CASES = [
    (X.fold_digits, {"٣ pages ४": "3 pages 4", "１２": "12", "x": "x"}),
    (X.fold_width, {"ＡＢｃ（１）": "ABc(1)", "終わり。": "終わり。"}),
    (X.fold_cjk_spaces, {"日 本 語": "日本語", "SIG, Inc.": "SIG, Inc.", "電源、 接続": "電源、接続", "ｶﾀ ｶﾅ": "ｶﾀｶﾅ", "部件 (劳务": "部件(劳务", "和/ 或": "和/或", "方式 , 包括": "方式, 包括", "1. 项目": "1. 项目", "日本 and 語": "日本 and 語", "語 Wi-Fi 語": "語 Wi-Fi 語", "  ": "  ", "": "", None: None}),
    (X.starts_lower_or_caseless, {"abc": True, "Abc": False, "日本": True, "1a": False}),
    (X.ends_with_terminator, {"Done.": True, "Done.)": True, "Done": False, "終わり。": True, "List:": True, "": False, "«Ja!» ": True}),
    (X.split_sentences, {"One here. Two there! 3. Step": ["One here.", "Two there!", "3. Step"], "e.g. this one": ["e.g. this one"], "一。二！": ["一。", "二！"], "Stop.日本": ["Stop.", "日本"], "1. Press it. Then go": ["1. Press it.", "Then go"]}),
    (X.callout_label, {"Note: mind": "NOTE", "hinweis : x": "HINWEIS", "注意：x": "注意", "Notebook: x": None}),
    (X.strip_page_references, {"See it on page 12 now": "See it now", "siehe Seite 4.": ".", "第 3 ページ": "", "12 頁 and on": " and on", "as on page, here": "as, here", "REFER TO PÁG. 7)": ")", "on page": "", "a page of text": "a page of text", "homepage 12": "homepage 12", "page 12345": "page 12345"}),
    (X.normalize_block_text, {"- item\nwrapped hyphen-\nated": "• item wrapped hyphenated", "ﬁne “x”": 'fine "x"', "end.Next": "end.Next"[:4] + " Next"}),
    (X.compare_key, {"* Foot note.": "Foot note", "(*) Foot": "Foot", "†: Foot": "Foot", "*": "*", "well-known. ": "wellknown", "power- saving mode": "powersaving mode", "0 m - 2000 m": "0 m - 2000 m", "-5 to -3": "-5 to -3", "a-b-c..": "abc", "": ""}),
    (X.align_key, {"a  b\t c": "abc"}),
    (X.ascii_blob, {"Ａ-1 é": "a1"}),
    (X.unicode_blob, {"Ｓtraße é": "strassee"}),
    (X.normalize_word, {"ﬁn²": "fin2"}),
    (X.font_family, {"ABCDEF+Arial-BoldItalic": "Arial", "Times,Italic": "Times", "Noto Sans": "Noto Sans"}),
    (X.font_core, {"ABCDEF+Arial-BoldMT": "arial"}),
    (X.size_pt, {"12.5 pt": 12.5, "none": None}),
    (X.uri_authority, {"HTTPS://A.com/": "a.com", "mailto:X@y.z": "x@y.z", "a.com.": "a.com"}),
    (X.marker_kind, {"1.": "number", "(a)": "letter", "iv)": "roman", "•": "bullet", "i": "letter", "word": "bullet", "150.": "number", "x)": "letter", "xx.": "roman", None: None}),
    (X.is_bare_number_list, {"1 2. 3)": True, "1": False, "1 a": False}),
    (X.is_bare_part_labels, {"A1 B2": True, "Alpha": False}),
    (X.is_caption_like, {"Front view": True, "It is done.": False}),
    (X.is_non_prose, {"12 mm 5": True, "Menu > Sound": True, "Turn the unit off now.": False, "SW272 SW242 or or": True, "10-90% 0-3000m 0-40°C": True, "3. HDMI in ports 3": False, "Rt": False, "L2 R2 Lt Rt": True, "Hold it for 10 seconds. •": False, "": False}),
    (X.is_prose_line, {"Rt": False, "Release button": False, "Press the button.": True, "one two three four five six seven eight": True}),
    (X.is_value, {"12mm": True, "-3.5dB": True, "12parsec": False, "10-90%": True, "x": False}),
    (X.alnum_blob, {"Wi-Fi 日本 4K": "wi fi 日 本 4k"}),
    (X.content_words, {"The menu Projector 123 lamp": ["projector", "lamp"]}),
    (X.nfkc_casefold, {"ＷＩＦＩ Straße": "wifi strasse"}),
    (X.artifact_set, {"a\ufffd (cid:3) (cid: 4) \ue000": ["\ufffd", "(cid:N)", "\ue000"]}),
    (X.is_toc_listing, {"Setup ..... 4": True, "Setup": False}),
    (X.is_excluded_heading, {"Table of Contents": True, "FAQ": True, "Setup": False}),
    (X.is_page_number, {"- 12 -": True, "xiv": True, "twelve": False}),
    (X.encoding_artifacts, {"a�b (cid:3)": ["�", "(cid:3)"], "ok": []}),
    (X.token_set, {"the big 日本 cat": ["the", "big", "日", "本", "cat"]}),
    (X.diff_tokens, {"a, 日本b": ["a", ",", " ", "日", "本", "b"], "": [], "x_1  (y)\n": ["x_1", "  ", "(", "y", ")", "\n"], "don't": ["don", "'", "t"]}),
    (lambda c: X.clip(c, 5), {"abcdefgh": "abcd…", "abc": "abc"}),
]


@pytest.mark.parametrize(("f", "cases"), CASES)
def test_scalars(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_every_decimal_digit_is_folded(spark):
    digits = [chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), None) is not None]
    assert apply(spark, X.fold_digits, digits) == [str(unicodedata.decimal(d)) for d in digits]


def test_cap(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    assert df.select(X.cap(F.col("x"), 2)).first()[0] == "a b … (+1 more sentences)"


def test_geometry(spark):
    a = G.box(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    b = G.box(*[F.lit(float(v)) for v in (5, 0, 15, 10)])
    r = spark.range(1).select(G.overlap_fraction(a, b).alias("o"), G.touches(a, b).alias("t"), G.area(G.union(a, b)).alias("u"), G.centre_inside(a, b).alias("c"), G.is_sane(a).alias("s"), G.page_share(F.lit(30.0), F.lit(120.0)).alias("p")).first()
    assert (r.o, r.t, r.u, r.c, r.s, r.p) == (0.5, True, 150.0, True, True, 0.25)
