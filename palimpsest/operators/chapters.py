"""What a chapter's two editions differ in: words, marks, spaces, markers, indents, rows, references, and how each difference is filed.

Elements: pair_id, side, section, ord, kind (text, note, heading, table, figure), text, page, box. Tables hold arrays of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.functions.matching import changed
from palimpsest.operators.ordered import islands

# Which category each type of difference belongs to, and how severe it is (1 is worst; up to FAILING_SEVERITY fails).
CATEGORY = {
    "content": ["text", "missing", "added", "moved", "punctuation", "symbol", "text-space", "text-encoding", "glyph-render", "capitalisation", "table-cell", "table-cell-sequence", "table-row-missing", "table-row-added", "table-as-text", "table-header-repeat", "section-missing", "section-added", "page-ref-in-staging", "paragraph-gap", "page-count", "scanned-page", "note-label"],
    "images": ["figure-missing", "figure-added", "figure-different", "figure-content", "figure-review", "figure-size", "figure-alignment", "figure-elsewhere", "figure-wrong-section", "figure-label-missing", "figure-visual", "figure-broken", "icon-missing", "icon-added", "icon-colour", "icon-changed"],
    "links": ["link-missing", "link-added", "link-target", "link-broken", "link-page-ref-dropped", "link-page-ref-inconsistent"],
    "lists": ["numbering", "list-marker-missing", "list-marker-added", "list-indent", "list-label-layout", "list-marker-glyph", "marker-size"],
    "bold": ["bold-missing", "bold-added"],
    "tables": ["table-merge", "table-shape", "table-columns", "table-cell-layout", "table-fill-missing", "table-header-fill"],
    "formatting": ["shading", "underline-missing", "underline-added", "italic-missing", "italic-added", "line-spacing", "size", "colour", "emphasis"],
    "sweep": ["sweep-words", "sweep-link", "sweep-table", "marker-spacing"],
}
LEVEL = {
    1: ["missing", "added", "section-missing", "section-added", "table-row-missing", "table-row-added", "figure-missing", "figure-added", "icon-missing", "icon-added", "link-missing", "link-broken", "page-count"],
    2: ["text", "numbering", "table-cell", "link-target", "figure-different", "figure-broken", "table-as-text", "text-encoding", "bold-missing", "bold-added"],
    3: ["punctuation", "symbol", "text-space", "capitalisation", "note-label", "moved", "table-merge", "table-columns", "table-shape", "list-marker-missing", "list-marker-added", "paragraph-gap", "page-ref-in-staging", "table-header-repeat"],
}
FAILING_SEVERITY, REVIEW_SEVERITY = 4, 5
NEVER_REPORTED = ["underline-missing"]
ORANGE = ["list-indent", "table-merge", "table-columns", "table-cell-layout", "figure-alignment", "figure-size", "shading", "marker-size", "icon-changed", "underline-missing", "underline-added", "line-spacing", "glyph-render"]
NOISE = {"order": ["moved", "table-cell-sequence", "figure-wrong-section"], "styling": ["bold-missing", "bold-added", "underline-missing", "underline-added", "italic-missing", "italic-added", "shading", "marker-size", "line-spacing", "icon-colour"], "layout": ["list-indent", "figure-alignment", "list-label-layout", "list-marker-glyph", "table-cell-layout", "table-shape", "table-header-repeat"]}
SPACING, INDENT_STEP, GAP_SHARE, AUDIT_SHARE = 0.15, 6.0, 0.8, 3
QUOTES = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'"}


def _of(table: dict, kind: Column, other) -> Column:
    out = None
    for name, kinds in table.items():
        out = F.when(kind.isin(kinds), F.lit(name)) if out is None else out.when(kind.isin(kinds), F.lit(name))
    return out.otherwise(other)


def category_of(kind: Column, of: Column) -> Column:
    """The category of a difference's type; of what is missing or added, figures are images; what no table names is content."""
    figure = kind.isin("missing", "added") & F.coalesce(of == "figure", F.lit(False))
    return F.when(figure, "images").otherwise(_of(CATEGORY, kind, F.lit("content")))


def severity_of(kind: Column, review_only: Column) -> Column:
    """1 (says or lacks something outright) to 4, and 5, which fails nothing, for what is only up for review."""
    return F.when(F.coalesce(review_only, F.lit(False)), F.lit(REVIEW_SEVERITY)).otherwise(_of(LEVEL, kind, F.lit(FAILING_SEVERITY)))


def noise_of(kind: Column) -> Column:
    return _of(NOISE, kind, F.lit(""))


def content_label(kind: Column, of: Column, gone: Column, extra: Column) -> Column:
    """Which of the seven kinds of content change a difference is; over eight changed words make it the paragraph. `gone` and `extra` are arrays of words."""
    table = F.coalesce(of == "table", F.lit(False))
    n = lambda words: F.aggregate(F.coalesce(words, F.expr("cast(array() as array<string>)")), F.lit(0), lambda s, w: s + F.size(X.words(w)))
    a, b = n(gone), n(extra)
    text = F.when(a + b > 8, "Changed paragraphs").when((a > 0) & (b > 0), "Changed words or numbers").when(a > 0, "Missing text").otherwise("Added/removed text")
    return (
        F.when(kind.isin("missing", "section-missing"), F.when(table, "Tables/content changes").otherwise("Missing text"))
        .when(kind.isin("added", "section-added"), F.when(table, "Tables/content changes").otherwise("Added/removed text"))
        .when(kind == "moved", "Different reading order").when(F.startswith(kind, F.lit("table-")), "Tables/content changes")
        .when(kind == "page-ref-in-staging", "Added/removed text")
        .when(F.startswith(kind, F.lit("page-")) | (kind == "scanned-page"), "Page-level differences").when(kind == "text", text)
        .when(kind == "paragraph-gap", "Changed paragraphs").when(kind.isin("punctuation", "symbol", "numbering", "text-encoding", "glyph-render", "text-space"), "Changed words or numbers").otherwise("")
    )


def reported(differences: DataFrame) -> DataFrame:
    """Differences with category, severity, colour and noise group, without the types that are never reported. Have: type, kind, review_only."""
    t = F.col("type")
    kept = differences.where(~t.isin(NEVER_REPORTED))
    level = severity_of(t, F.col("review_only"))
    return kept.withColumn("category", category_of(t, F.col("kind"))).withColumn("level", level).withColumn("fails", level <= FAILING_SEVERITY).withColumn("colour", F.when(t.isin(ORANGE), "orange").otherwise("red")).withColumn("noise", noise_of(t))


def printed_in(kind: Column, text: Column, blob: Column) -> Column:
    """Whether an element is printed among other words (one blank between each): as one phrase; a text of up to three words, unless it is a heading, also in pieces."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    def found(p: Column) -> Column:
        words = F.split(p["own"], " ")
        phrase = F.contains(p["blob"], padded(p["own"]))
        scattered = (kind != "heading") & (F.size(words) <= 3) & F.forall(words, lambda w: F.contains(p["blob"], padded(w)))
        return F.coalesce((p["own"] != "") & (phrase | scattered), F.lit(False))

    return X.bound(F.struct(X.alnum_blob(text).alias("own"), padded(X.alnum_blob(blob)).alias("blob")), found)


def counted_elsewhere(phrase: Column, own: Column, other: Column) -> Column:
    """Whether the other side prints a phrase as often as this one does: a repeat that went is not made up for by the copy that stayed."""
    times = lambda blob: F.size(F.split(blob, F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), phrase, F.lit("\\E(?![\\p{L}\\p{N}])")), -1)) - 1
    return times(other) >= times(own)


def xref_free(text: Column) -> Column:
    """A text without cross-references in brackets, wherever they wrap, and without those to pages."""
    return F.regexp_replace(X.strip_page_references(F.regexp_replace(text, r'(?is)\(\s*(?:see\b[^()|]*|["“][^"”()]*["”])?\s*\)', "")), r"\s+", " ")


def cell_units(text: Column) -> Column:
    """A cell's words as a sorted bag, wrapped words whole, references and a callout label at its start left out."""
    joined = F.regexp_replace(text, r"(\p{L})-\s*\n\s*(?=\p{Ll})", "$1")
    return F.array_sort(F.regexp_extract_all(F.lower(X.strip_callout_label(xref_free(joined))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def carries_marker(cells: Column, text: Column, marker: Column) -> Column:
    """Whether a table's row holds a text beside a cell that is its marker. Cells: ARRAY<ARRAY<STRING>>."""
    return F.exists(cells, lambda row: F.array_contains(F.transform(row, F.trim), F.trim(marker)) & F.exists(row, lambda c: F.contains(X.alnum_blob(c), X.alnum_blob(text))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def mark_changes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Marks and spaces that two texts of the same words differ in: “x” missing in Staging, “y” extra in Staging, space missing (or extra) in Staging.

    What layout decides is none: line breaks, hyphens and dashes at them, curly quotes, bullets, callout colons, references to pages. A
    blank where one side breaks its line is none either.
    """
    import re

    words = "|".join(sorted(map(re.escape, X.PAGE_WORDS), key=len, reverse=True))
    leads = "|".join(sorted(map(re.escape, X.PAGE_LEADS), key=len, reverse=True))
    page = re.compile(rf"\s*(?:\b(?:{leads})\s+)?\b(?:{words})\.?\s*\d{{1,4}}\b", re.IGNORECASE)
    label = re.compile(rf"^\s*({'|'.join(sorted(map(re.escape, X.CALLOUTS), key=len, reverse=True))})\b\s*[:：]?\s*", re.IGNORECASE)

    quotes = str.maketrans(QUOTES)
    digit, bullet = re.compile(r"\d"), re.compile(f"[{X.BULLETS}]")
    leading, hyphen = re.compile(rf"(?:(?<=^)|(?<=\s))[{X.BULLETS}]\s*"), re.compile(r"(\w)-\s+(?=[a-z])")
    token = re.compile(r"\w+|[^\w\s]|\s+")

    def plain(t: str) -> tuple[list[str], set[tuple[str, str]]]:
        # Each rule is tried only where the sign that it starts from is there.
        t = t.translate(quotes)
        t = page.sub("", t) if digit.search(t) else t
        t = re.sub(r"\n\s*-\s+", "\n", t) if "\n" in t else t
        t = leading.sub("", t) if bullet.search(t) else t
        t = f"{m[1]} {t[m.end():]}" if (m := label.match(t)) else t
        t = hyphen.sub(r"\1-", t) if "-" in t else t
        ends = {(a, b) for a, b in re.findall(r"(\S+)\s*\n\s*(\S+)", t)} if "\n" in t else set()
        return token.findall(" ".join(t.split())), ends

    def changes(a: str, b: str) -> list[str]:
        if a == b:
            return []
        (x, wx), (y, wy) = plain(a), plain(b)
        said = []
        for i, j, k, m in changed(x, y):
            gone, new = x[i:j], y[k:m]
            if any(re.match(r"\w", t) for t in gone + new):
                continue
            marks = [(t, "missing") for t in gone if t.strip()] + [(t, "extra") for t in new if t.strip()]
            if marks:
                said.append(", ".join(f"“{t}” {what} in Staging" for t, what in marks))
                continue
            side, at, wraps, what = (x, i, wx, "missing") if gone else (y, k, wy, "extra")
            run = lambda toks: "".join(toks).split(" ")
            if (run(side[:at])[-1], run(side[at + 1 :])[0]) not in wraps:
                said.append(f"space {what} in Staging")
        return said

    for a, b in batches:
        yield pd.Series([changes(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def paragraph_gaps_lost(elements: DataFrame) -> DataFrame:
    """Paragraphs that the baseline sets apart on one page and the candidate prints as one.

    The gap above the second is at least four fifths of its size; a page break is no gap. Elements: text, page, y0, y1, size.
    """
    w = Window.partitionBy("pair_id", "section").orderBy("ord")
    prod = elements.where("side = 'prod'").withColumn("_p", F.lag(F.struct("text", "page", "y1")).over(w))
    apart = prod.where((F.col("_p.page") == F.col("page")) & (F.col("y0") - F.col("_p.y1") >= GAP_SHARE * F.col("size"))).select("pair_id", "section", F.col("_p.text").alias("first"), F.col("text").alias("second"), X.alnum_blob(F.concat_ws(" ", "_p.text", "text")).alias("_both"))
    stage = elements.where("side = 'stage'").select("pair_id", "section", X.alnum_blob(F.col("text")).alias("_blob"))
    both = apart.join(stage, ["pair_id", "section"]).where(F.contains(F.concat(F.lit(" "), "_blob", F.lit(" ")), F.concat(F.lit(" "), "_both", F.lit(" "))))
    return both.select("pair_id", "section", "first", "second", F.lit("Paragraph space missing in Staging").alias("title")).distinct()


def page_references_kept(elements: DataFrame) -> DataFrame:
    """References to pages that the candidate still prints, one row each: `phrase`."""
    words, leads = "|".join(X.PAGE_WORDS), "|".join(X.PAGE_LEADS)
    found = F.regexp_extract_all("text", F.lit(rf"(?iU)\b(?:{leads})\s+(?:{words})\.?\s*\d{{1,4}}\b"), F.lit(0))
    return elements.where("side = 'stage'").select("pair_id", "section", "ord", F.explode(found).alias("phrase"))


def line_spacing_changes(elements: DataFrame) -> DataFrame:
    """Notes that are set looser or tighter than the texts of their own page, where the baseline's are not.

    Elements have `leading`, the mean distance of their lines. The ratio to the median of the page's other texts is compared, so a template
    that is looser throughout is no difference.
    """
    body = elements.where("kind = 'text' and leading is not null").groupBy("pair_id", "side", "page").agg(F.median("leading").alias("body"))
    notes = elements.where("kind = 'note' and leading is not null").join(body, ["pair_id", "side", "page"]).withColumn("ratio", F.col("leading") / F.col("body"))
    key = F.lower(F.regexp_replace("text", r"\s+", " "))
    part = lambda side: notes.where(F.col("side") == side).groupBy("pair_id", "section", key.alias("key")).agg(F.avg("ratio").alias(side))
    both = part("prod").join(part("stage"), ["pair_id", "section", "key"])
    return both.where(F.abs(F.col("stage") - F.col("prod")) > SPACING * F.col("prod")).withColumn("summary", F.when(F.col("stage") > F.col("prod"), "looser").otherwise("tighter"))


def list_indent_changes(items: DataFrame) -> DataFrame:
    """Items whose level within their list changed; a list that is set elsewhere as a whole is none.

    Items: pair_id, side, list, item (text), x0. Levels are the distinct indents of a list, six points apart.
    """
    w = Window.partitionBy("pair_id", "side", "list").orderBy("x0")
    steps = items.withColumn("_new", F.when(F.col("x0") - F.lag("x0").over(w) > INDENT_STEP, 1).otherwise(0))
    levels = steps.withColumn("level", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)) + 1)
    part = lambda side: levels.where(F.col("side") == side).groupBy("pair_id", "list", "item").agg(F.min("level").alias(side))
    both = part("prod").join(part("stage"), ["pair_id", "list", "item"]).where("prod <> stage")
    return both.withColumn("summary", F.concat(F.lit("is at level "), F.col("stage").cast("string"), F.lit(" in Staging, level "), F.col("prod").cast("string"), F.lit(" in Production")))


def word_audit(lines: DataFrame) -> DataFrame:
    """Every word of a section counted on either side, words hyphenated at a line's end whole: those that one side has more often.

    Lines: pair_id, side, section, ord, text, ocr. `ocr` says whether a side's words were read from a picture. Wrapping is no difference.
    """
    w = Window.partitionBy("pair_id", "side", "section").orderBy("ord")
    own = F.regexp_replace("text", r"(\p{L})-\s*$", "$1")
    ends = F.rlike(F.lag("text").over(w), F.lit(r"\p{L}-\s*$"))
    glued = lines.withColumn("_t", F.concat(F.when(F.coalesce(ends, F.lit(False)), "").otherwise(" "), own))
    whole = glued.groupBy("pair_id", "side", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_t"))), lambda x: x["_t"]), "").alias("t"), F.bool_or("ocr").alias("ocr"))
    words = whole.select("pair_id", "side", "section", "ocr", F.explode(F.regexp_extract_all(F.lower(X.strip_page_references(F.col("t"))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    n = words.groupBy("pair_id", "section", "word").agg(F.count_if(F.col("side") == "prod").alias("a"), F.count_if(F.col("side") == "stage").alias("b"), F.bool_or(F.col("ocr") & (F.col("side") == "stage")).alias("ocr_stage"))
    return n.where("a <> b").select("pair_id", "section", "word", F.when(F.col("a") > F.col("b"), "missing").otherwise("added").alias("type"), F.abs(F.col("a") - F.col("b")).alias("n"), "ocr_stage")


def audit_not_named(audit: DataFrame, named: DataFrame) -> DataFrame:
    """What the audit found, less the words that other findings name already. Named: pair_id, section, word."""
    return audit.join(named.select("pair_id", "section", F.lower("word").alias("word")).distinct(), ["pair_id", "section", "word"], "left_anti")


def row_changes(tables: DataFrame, printed: DataFrame) -> DataFrame:
    """Rows of the baseline's table that the candidate's lacks, and rows whose cells were merged.

    Tables: pair_id, side, tbl, row, cells ARRAY<STRING>, spans (columns merged into others). A row is known by all its words; one whose
    words the candidate's section prints beyond its tables is not missing (printed: pair_id, word, n: how often, tables left out).
    """
    keyed = tables.withColumn("key", X.alnum_blob(F.array_join("cells", " "))).where("key <> ''")
    nth = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id", "side", "tbl", "key").orderBy("row")))
    part = lambda side: nth.where(F.col("side") == side).select("pair_id", "tbl", "key", "nth", F.struct("row", "cells", "spans").alias(side))
    both = part("prod").join(part("stage"), ["pair_id", "tbl", "key", "nth"], "full_outer")
    gone = both.where("stage is null")
    words = gone.select("pair_id", "tbl", "key", "nth", F.explode(F.split("key", " ")).alias("word")).groupBy("pair_id", "tbl", "key", "nth", "word").agg(F.count("*").alias("need"))
    lack = words.join(printed.select("pair_id", "word", "n"), ["pair_id", "word"], "left").where(F.coalesce("n", F.lit(0)) < F.col("need")).select("pair_id", "tbl", "key", "nth").distinct()
    missing = gone.join(lack, ["pair_id", "tbl", "key", "nth"], "left_semi").select("pair_id", "tbl", F.lit("table-row-missing").alias("type"), F.col("prod.row").alias("row"), "key")
    added = both.where("prod is null").select("pair_id", "tbl", F.lit("table-row-added").alias("type"), F.col("stage.row").alias("row"), "key")
    merged = both.where("prod is not null and stage is not null and prod.spans <> stage.spans").select("pair_id", "tbl", F.lit("table-merge").alias("type"), F.col("prod.row").alias("row"), "key")
    return missing.unionAll(added).unionAll(merged)


def headers_lost(parts: DataFrame) -> DataFrame:
    """Tables that go on on another page without their head row. Parts: pair_id, table, page, first_row ARRAY<STRING>."""
    w = Window.partitionBy("pair_id", "table").orderBy("page")
    later = parts.withColumn("_head", F.first("first_row").over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return later.where(X.alnum_blob(F.array_join("_head", " ")) != X.alnum_blob(F.array_join("first_row", " "))).select("pair_id", "table", "page", F.lit("table-header-repeat").alias("type"))


def emphasis_changes(pairs: DataFrame) -> DataFrame:
    """Words that lost or gained a style: one row each type. Structs prod and stage hold bold, italic, underlined (arrays of words)."""
    kinds = [("bold", "bold"), ("italic", "italic"), ("underlined", "underline")]
    found = F.flatten(F.array(*[F.array(F.struct(F.lit(f"{name}-missing").alias("type"), F.array_except(f"prod.{c}", f"stage.{c}").alias("words")), F.struct(F.lit(f"{name}-added").alias("type"), F.array_except(f"stage.{c}", f"prod.{c}").alias("words"))) for c, name in kinds]))
    each = pairs.select("*", F.explode(found).alias("f")).where(F.size("f.words") > 0)
    return each.select(*pairs.columns, F.col("f.type").alias("type"), F.col("f.words").alias("words")).where(~F.col("type").isin(NEVER_REPORTED))


def is_italic(flags: Column, font: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(2)) != 0, F.lit(False)) | F.coalesce(F.rlike(font, F.lit("(?i)italic|oblique")), F.lit(False))


def raised_marks(spans: DataFrame) -> DataFrame:
    """Spans in which a small raised TM (or SM, R, C) reads as its sign. Spans: pair_id, line, span, text, size, origin (the height of its base)."""
    w = Window.partitionBy("pair_id", "line").orderBy("span")
    near = lambda c: F.coalesce(F.lag(c).over(w), F.lead(c).over(w))
    raised = (F.col("size") <= 0.75 * near("size")) & (F.col("origin") < near("origin"))
    sign = F.when(F.trim("text") == "TM", "™").when(F.trim("text") == "SM", "℠").when(F.trim("text") == "R", "®").when(F.trim("text") == "C", "©")
    return spans.withColumn("text", F.when(F.coalesce(raised, F.lit(False)) & sign.isNotNull(), sign).otherwise(F.col("text")))


def alone_on_row(words: DataFrame) -> DataFrame:
    """Words with `alone`: nothing else stands at their height on the page. A number in a table's last row is no page number."""
    key = ["pair_id", "side", "page"]
    w = Window.partitionBy(*key).orderBy("y0", "x0")
    low = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(words, key, ["y0", "x0"], F.col("y0") < low - 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(w)), "_row")
    return rows.withColumn("alone", F.count("*").over(Window.partitionBy(*key, "_row")) == 1).drop("_row")


def is_fill_band(kind: Column, width: Column, height: Column, texts_inside: Column) -> Column:
    """A low, wide vector box with text on it is the bar of a table's head, no figure."""
    return (kind == "vector") & (height <= 40) & (width >= 5 * height) & (texts_inside > 0)


def note_members(elements: DataFrame) -> DataFrame:
    """Elements with `in_note`: those that go on, within a line's height, from one that an icon marks. Elements: has_icon, y0, y1."""
    w = Window.partitionBy("pair_id", "side", "page").orderBy("y0", "ord")
    close = (F.col("y0") - F.lag("y1").over(w) <= F.col("y1") - F.col("y0")) & ~F.col("has_icon")
    return islands(elements, ["pair_id", "side", "page"], ["y0", "ord"], close, "_note").withColumn("in_note", F.bool_or("has_icon").over(Window.partitionBy("pair_id", "side", "page", "_note"))).drop("_note")


def unused_share(own: Column, whole: Column, taken: Column) -> Column:
    """The share of a sentence's words that a text still has, once those of other sentences are taken from it. Arrays of words."""
    n = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    left = F.aggregate(F.array_distinct(own), F.lit(0), lambda s, w: s + F.least(n(own, w), F.greatest(n(whole, w) - n(taken, w), F.lit(0))))
    return F.when(F.size(own) > 0, left / F.size(own)).otherwise(0.0)


def text_scan(elements: DataFrame, pages: DataFrame, reported_texts: DataFrame) -> DataFrame:
    """The whole book once more, texts only: what a side lacks altogether, not repeating what was reported.

    Elements: pair_id, side, chapter, kind, text. What stands in another chapter is not missing; what is on the other side's pages in any
    form (pages: pair_id, side, text) is not extra. Reported: pair_id, text.
    """
    norm = lambda c: F.concat(F.lit(" "), X.alnum_blob(c), F.lit(" "))
    said = reported_texts.select("pair_id", X.alnum_blob(F.col("text")).alias("_k")).distinct()
    own = elements.where("kind = 'text'").withColumn("_k", X.alnum_blob(F.col("text"))).where("_k <> ''").join(said, ["pair_id", "_k"], "left_anti")
    books = elements.groupBy("pair_id", F.when(F.col("side") == "prod", "stage").otherwise("prod").alias("side")).agg(F.array_join(F.collect_list(norm(F.col("text"))), "").alias("_book"))
    other = pages.groupBy("pair_id", F.when(F.col("side") == "prod", "stage").otherwise("prod").alias("side")).agg(F.array_join(F.collect_list(norm(F.col("text"))), "").alias("_pages"))
    told = own.join(books, ["pair_id", "side"], "left").join(other, ["pair_id", "side"], "left")
    there = lambda blob: F.coalesce(F.contains(F.col(blob), F.concat(F.lit(" "), "_k", F.lit(" "))), F.lit(False))
    lacks = told.where(~there("_book") & ~there("_pages"))
    return lacks.select("pair_id", "side", "chapter", F.when(F.col("side") == "prod", "missing").otherwise("added").alias("type"), "text").distinct()


def icon_changes(words: DataFrame, icons: DataFrame) -> DataFrame:
    """Icons beside a word that the candidate lacks, adds, or prints in another colour.

    Words: pair_id, side, page, word, n (its occurrence), box. Icons: box, colour (0xRRGGBB). An icon belongs to the nearest word of its row,
    twelve points away at most; colours differ by a channel of a quarter.
    """
    key = ["pair_id", "side", "page"]
    i = icons.select(*key, *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")], "colour")
    gap = F.greatest(F.col("x0") - F.col("i_x1"), F.col("i_x0") - F.col("x1"))
    near = words.join(i, key).where((F.least("y1", "i_y1") > F.greatest("y0", "i_y0")) & gap.between(-1, 12))
    beside = near.groupBy(*key, "i_x0", "i_y0", "colour").agg(F.min_by(F.struct("word", "n"), gap).alias("w")).groupBy("pair_id", "side", "w").agg(F.first("colour").alias("colour"))
    sides = beside.groupBy("pair_id", "w").agg(F.max(F.when(F.col("side") == "prod", F.col("colour"))).alias("a"), F.max(F.when(F.col("side") == "stage", F.col("colour"))).alias("b"))
    # A word that a side does not print has no icon to lose.
    there = words.groupBy("pair_id", F.struct("word", "n").alias("w")).agg(F.countDistinct("side").alias("_sides"))
    far = F.greatest(*[F.abs(x - y) for x, y in zip(X.channels(F.col("a")), X.channels(F.col("b")), strict=True)])
    kind = F.when(F.col("b").isNull(), "icon-missing").when(F.col("a").isNull(), "icon-added").when(far >= 0.25, "icon-colour")
    return sides.join(there.where("_sides = 2"), ["pair_id", "w"]).withColumn("type", kind).where("type is not null").select("pair_id", F.col("w.word").alias("word"), F.col("w.n").alias("n"), "type", F.col("a").alias("prod_colour"), F.col("b").alias("stage_colour"))


def word_changes(pairs: DataFrame) -> DataFrame:
    """Pairs with `gone` and `extra`, the whole words that differ. Have `ops`, a word diff of whole words."""
    of = lambda kind: F.transform(F.filter("ops", lambda o: o["type"] == kind), lambda o: o["text"])
    return pairs.withColumn("gone", of("del")).withColumn("extra", of("ins"))


def anchors(matched_rows: DataFrame) -> DataFrame:
    """Waypoints for facing pages: where equal headings, texts or tables start on either side. Rows: pair_id, prod_page, prod_y, stage_page, stage_y."""
    return matched_rows.groupBy("pair_id", "prod_page").agg(F.min(F.struct("prod_y", "stage_page", "stage_y")).alias("m")).select("pair_id", "prod_page", F.col("m.stage_page").alias("stage_page"), F.col("m.stage_y").alias("stage_y"))
