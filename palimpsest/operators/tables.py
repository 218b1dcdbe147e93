"""Tables as relations of cells (pair_id, side, page, tbl, row, col, text, box)."""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.ordered import by_group, islands

# Points and shares.
EDGE_SLACK, EDGE_SHARE, BOTTOM_SHARE, TOP_SHARE = 4.0, 0.7, 0.8, 0.15
LAYOUT_SHIFT, OVERFLOW, ROW_OVERLAP = 0.03, 3.0, 0.6
TABLE = ["pair_id", "side", "page", "tbl"]


def column_edges(cells: DataFrame) -> DataFrame:
    """The distinct column edges of each table, to a tenth of a point, from left to right."""
    edges = cells.where("x0 is not null").select(*TABLE, F.explode(F.array(F.round("x0", 1), F.round("x1", 1))).alias("x"))
    return edges.groupBy(*TABLE).agg(F.array_sort(F.collect_set("x")).alias("edges"))


def edges_line_up(a: Column, b: Column) -> Column:
    """At least 70 % of the edges lie within four points of one of the other table."""
    near = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= EDGE_SLACK)))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (near / F.greatest(F.size(a), F.size(b)) >= EDGE_SHARE), F.lit(False))


def stitched(fragments: DataFrame) -> DataFrame:
    """Numbers the tables that fragments of following pages make up.

    Fragments: pair_id, side, page, tbl, n_cols, edges, top, bottom (as shares of the page), opens_with_text.
    """
    w = Window.partitionBy("pair_id", "side").orderBy("page", "tbl")
    before = lambda c: F.lag(c).over(w)
    alike = (F.col("n_cols") == before("n_cols")) | edges_line_up(before("edges"), F.col("edges"))
    goes_on = (F.col("page") == before("page") + 1) & (before("bottom") >= BOTTOM_SHARE) & (F.col("top") <= TOP_SHARE) & ~F.col("opens_with_text") & alike
    return islands(fragments, ["pair_id", "side"], ["page", "tbl"], goes_on, "table")


def headers_not_repeated(parts: DataFrame) -> DataFrame:
    """Later fragments of a stitched table whose first row shares less than 70 % of the first fragment's header words.

    Parts: pair_id, side, table, page, header (array of words); an empty header is repeated anywhere.
    """
    w = Window.partitionBy("pair_id", "side", "table").orderBy("page")
    first = parts.withColumn("wanted", F.first("header").over(w)).withColumn("part", F.row_number().over(w))
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    kept = F.aggregate(F.array_distinct("wanted"), F.lit(0), lambda s, t: s + F.least(count(F.col("wanted"), t), count(F.col("header"), t)))
    return first.where((F.col("part") > 1) & (F.size("wanted") > 0) & (kept / F.size("wanted") < 0.7)).drop("wanted")


def layout_shift(a: Column, b: Column) -> Column:
    """The largest shift of an edge as a share of the width, null where the numbers of edges differ."""
    share = lambda e: F.transform(e, lambda x: (x - F.element_at(e, 1)) / F.nullif(F.element_at(e, -1) - F.element_at(e, 1), F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(share(a), share(b), lambda x, y: F.abs(x - y))))


def compare_tables(pairs: DataFrame) -> DataFrame:
    """Findings of matched tables: prod and stage are structs of n_cols, fragments, edges."""
    p, s = F.col("prod"), F.col("stage")
    found = F.array_compact(F.array(F.when(s["fragments"] > p["fragments"], "Table split across more pages"), F.when(s["n_cols"] != p["n_cols"], "Table columns differ"), F.when(layout_shift(p["edges"], s["edges"]) > LAYOUT_SHIFT, "Table column layout differs")))
    return pairs.withColumn("message", F.explode(found))


def row_spans(cells: DataFrame) -> DataFrame:
    """Horizontal merges: each cell with how many columns it spans, cells without a box (merged away) counting for the one before."""
    w = Window.partitionBy(*TABLE, "row").orderBy("col")
    run = cells.withColumn("_at", F.sum(F.col("x0").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*TABLE, "row", "_at").agg(F.min("col").alias("col"), F.count("*").alias("span"), F.first("text", True).alias("text")).where("_at > 0").drop("_at")


def column_merges(cells: DataFrame) -> DataFrame:
    """Vertical merges: cells between which no rule is drawn form a group of so many rows."""
    w = Window.partitionBy(*TABLE, "col").orderBy("row")
    joined = ~F.coalesce(F.lag("border_bottom").over(w), F.lit(True)) & ~F.coalesce(F.col("border_top"), F.lit(True))
    return islands(cells, [*TABLE, "col"], ["row"], joined, "merge").groupBy(*TABLE, "col", "merge").agg(F.min("row").alias("row"), F.count("*").alias("rows"), F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))


def overflowing(tables: DataFrame, margins: DataFrame) -> DataFrame:
    """Tables more than three points outside the content margins (left, right) of their side."""
    m = tables.join(margins, ["pair_id", "side"])
    over = F.greatest(F.col("left") - F.col("x0"), F.col("x1") - F.col("right"))
    return m.withColumn("over", over).where(F.col("over") > OVERFLOW)


def without_repeated_below(cells: DataFrame) -> DataFrame:
    """A cell loses the text at its end that is the whole of the cell below."""
    below = F.trim(F.lead("text").over(Window.partitionBy(*TABLE, "col").orderBy("row")))
    own = F.rtrim("text")
    cut = (F.length(below) > 0) & (F.length(own) > F.length(below)) & F.endswith(own, below)
    return cells.withColumn("text", F.when(cut, F.rtrim(F.substring(own, F.lit(1), F.length(own) - F.length(below)))).otherwise(F.col("text")))


def row_barriers(cells: DataFrame) -> DataFrame:
    """The height between each cell and the next one of its column, where both have a box."""
    w = Window.partitionBy(*TABLE, "col").orderBy("row")
    return cells.withColumn("below", F.lead("y0").over(w)).where("x0 is not null and below is not null").withColumn("barrier", (F.col("y1") + F.col("below")) / 2).drop("below")


def is_table(cells: DataFrame) -> DataFrame:
    """Tables that count: no cell of more than five line breaks, some text, two columns, nothing above or left of the page; a tall grid of three rows, mostly filled in two columns, may break the first."""
    filled = cells.groupBy(*TABLE, "row").agg(F.count_if(F.trim("text") != "").alias("n"), F.max(F.length(F.regexp_replace("text", "[^\n]", ""))).alias("breaks"), F.max("col").alias("last"), F.min(F.least("x0", "y0")).alias("least"), F.max(F.when(F.trim("text") != "", F.col("col"))).alias("hi"), F.min(F.when(F.trim("text") != "", F.col("col"))).alias("lo"))
    whole = filled.groupBy(*TABLE).agg(F.sum("n").alias("n"), F.max("breaks").alias("breaks"), (F.max("hi") - F.min("lo") + 1).alias("columns"), F.min("least").alias("least"), F.count("*").alias("rows"), F.avg((F.col("n") >= 2).cast("double")).alias("grid"))
    tall = (F.col("rows") >= 3) & (F.col("grid") >= 0.8)
    return whole.withColumn("is_table", (F.col("n") > 0) & (F.col("columns") >= 2) & (F.coalesce("least", F.lit(0.0)) >= 0) & ((F.col("breaks") <= 5) | tall)).select(*TABLE, "is_table", "columns", "rows")


def words_to_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Each word in the cell that holds its centre (the leftmost, if several do): a join by page, not by all cells. Words of one id are one word."""
    c = cells.where("x0 is not null").select("pair_id", "side", "page", "tbl", "row", "col", *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = words.join(c, ["pair_id", "side", "page"]).where(x.between(F.col("c_x0"), F.col("c_x1")) & y.between(F.col("c_y0"), F.col("c_y1")))
    w = Window.partitionBy("pair_id", "side", "page", "word_id").orderBy("c_x0", "tbl", "row", "col")
    return held.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*words.columns, "tbl", "row", "col")


def dark_regions(tables: DataFrame, fills: DataFrame, least: float = 0.4) -> DataFrame:
    """Tables of which one dark fill (luminance under 0.35) covers 40 % or more: screens drawn as pictures."""
    r, g, b = X.channels(F.col("fill"))
    dark = fills.where(0.299 * r + 0.587 * g + 0.114 * b < 0.35).select("pair_id", "side", "page", *[F.col(k).alias(f"d_{k}") for k in ("x0", "y0", "x1", "y1")])
    width = F.greatest(F.least("x1", "d_x1") - F.greatest("x0", "d_x0"), F.lit(0.0))
    height = F.greatest(F.least("y1", "d_y1") - F.greatest("y0", "d_y0"), F.lit(0.0))
    covers = width * height / F.nullif((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(0.0)) >= least
    t, key = tables.alias("t"), ["pair_id", "side", "page"]
    same = [F.col(f"t.{k}") == F.col(f"d_{k}") for k in key]
    # Each table by its own box, also where tables share a number.
    return t.join(dark.withColumnsRenamed({k: f"d_{k}" for k in key}), [*same, covers], "left_semi")


def closest_rows(prod: DataFrame, stage: DataFrame) -> DataFrame:
    """Rows left over by their keys, paired by the share of common words from 0.6 on, best first (ties by row). Sides: tbl, row, token.

    Rows of the same words are compared as one; a table's rows, and the pairs of unlike ones from 0.6 on, must fit into a task.
    """
    kinds = dict(prod.dtypes) | {"stage_row": dict(stage.dtypes)["row"]}
    bag = lambda df, side: df.where("tbl is not null and row is not null").groupBy("tbl", F.lit(side).alias("side"), "row").agg(F.count("*").alias("total"), F.array_sort(F.collect_list("token")).alias("tokens"))

    def pairs(rows: list[tuple]) -> list[tuple]:
        # Rows of the same words are one class, its rows in order; a word's copies are told apart by their number.
        a, b = ({}, {})
        for _, side, row, total, tokens in rows:
            (a if side == 0 else b).setdefault((total, tuple(tokens)), []).append(row)
        a, b = ({k: deque(sorted(r)) for k, r in x.items()} for x in (a, b))
        out = []
        # A similarity of one is that of the same words alone.
        for k in a.keys() & b.keys():
            while k[0] == len(k[1]) and a[k] and b[k]:
                out.append((rows[0][0], a[k].popleft(), b[k].popleft(), 1.0))
        left, right = ([(k, r) for k, r in x.items() if r] for x in (a, b))
        numbered = lambda k: {(t, n) for t, g in groupby(k) for n, _ in enumerate(g)}
        postings: dict = {}
        for j, ((_, tokens), _) in enumerate(right):
            for t in numbered(tokens):
                postings.setdefault(t, []).append(j)
        held = {t: np.array(j) for t, j in postings.items()}
        totals, steps = np.array([k[0] for k, _ in right]), {}
        for i, ((total, tokens), _) in enumerate(left):
            found = [held[t] for t in numbered(tokens) if t in held]
            if not found:
                continue
            score = np.bincount(np.concatenate(found), minlength=len(right)) / np.maximum(totals, total)
            for j in np.flatnonzero(score >= ROW_OVERLAP):
                steps.setdefault(float(score[j]), {}).setdefault(i, []).append(int(j))
        # Best first: of one score each row in order takes the first free row of all the classes that it has this score with.
        for score in sorted(steps, reverse=True):
            queue = [(left[i][1][0], i) for i in steps[score] if left[i][1]]
            heapify(queue)
            while queue:
                row, i = heappop(queue)
                free = [(right[j][1][0], j) for j in steps[score][i] if right[j][1]]
                if not free:
                    continue
                other, j = min(free)
                left[i][1].popleft()
                right[j][1].popleft()
                out.append((rows[0][0], row, other, score))
                if left[i][1]:
                    heappush(queue, (left[i][1][0], i))
        return out

    both = bag(prod, 0).unionByName(bag(stage, 1))
    return by_group(both, ["tbl"], ["side", "row"], pairs, f"tbl {kinds['tbl']}, prod_row {kinds['row']}, stage_row {kinds['stage_row']}, similarity double")


# Matching of tables and rows.
MATCH, SAME_COLUMNS, FALLBACK, PAGE_COST = 0.5, 0.05, 0.25, 1000.0
COMPARABLE, SURVIVES, TABLE_SURVIVES, LONG_HEADER, MOST_CELLS, LONG_TOKEN = 0.4, 0.75, 0.6, 24, 30, 6
REWORDED = 0.5


def matched_tables(scored: DataFrame, tables: DataFrame) -> DataFrame:
    """One-to-one tables of a section: by their words from 0.5 on, best first, equal numbers of columns counting 0.05 more; what is left by
    place, tables of as many columns first, a page counting a thousand points, if a quarter of the words agree.

    Scored: pair_id, section, prod, stage, similarity. Tables: pair_id, section, side, tbl, n_cols, page, y. A section's tables must fit into a task.
    """
    p = tables.where("side = 'prod'").select("pair_id", "section", F.col("tbl").alias("prod"), F.col("n_cols").alias("pc"), F.col("page").alias("pp"), F.col("y").alias("py"))
    s = tables.where("side = 'stage'").select("pair_id", "section", F.col("tbl").alias("stage"), F.col("n_cols").alias("sc"), F.col("page").alias("sp"), F.col("y").alias("sy"))
    rows = scored.where(F.col("similarity") >= FALLBACK).join(p, ["pair_id", "section", "prod"]).join(s, ["pair_id", "section", "stage"])
    far = F.abs(F.col("pp") - F.col("sp")) * PAGE_COST + F.abs(F.col("py") - F.col("sy"))
    same = F.col("pc") == F.col("sc")
    told = rows.select("pair_id", "section", "prod", "stage", "similarity", F.when(F.col("similarity") >= MATCH, 1).otherwise(2).alias("step"), F.when(F.col("similarity") >= MATCH, -(F.col("similarity") + F.when(same, SAME_COLUMNS).otherwise(0.0))).otherwise(far + F.when(same, 0.0).otherwise(1e9)).alias("cost"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, keep = set(), set(), []
        # The second step looks at all that the first left over, whatever their words came to.
        order = pdf.sort_values(["step", "cost", "prod", "stage"])
        for i, x, y in zip(order.index, order["prod"], order["stage"], strict=True):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                keep.append(i)
        return pdf.loc[keep, ["pair_id", "section", "prod", "stage", "similarity", "step"]]

    kinds = dict(told.dtypes)
    return told.groupBy("pair_id", "section").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("pair_id", "section", "prod", "stage", "similarity", "step")))


def tables_gone(tokens: DataFrame, words: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Unmatched tables of the baseline of whose words the candidate's section prints less than 60 %.

    Tokens: pair_id, section, tbl, token (as often as it stands there). Words: pair_id, section, token of all the section's text.
    """
    own = tokens.join(unmatched, ["pair_id", "section", "tbl"], "left_semi").groupBy("pair_id", "section", "tbl", "token").agg(F.count("*").alias("n"))
    there = words.groupBy("pair_id", "section", "token").agg(F.count("*").alias("m"))
    kept = own.join(there, ["pair_id", "section", "token"], "left").groupBy("pair_id", "section", "tbl").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("kept"))
    return kept.where(F.col("kept") < TABLE_SURVIVES)


def rows_missing(rows: DataFrame, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of the baseline without a partner, of whose fine tokens the candidate's table holds less than 75 %.

    Rows: pair_id, tbl, row, text. Pairs: pair_id, tbl, row of those that have a partner. Tokens: pair_id, tbl, token of the candidate's table. A
    first row of over 24 characters is no head that could be missing; a blank row is none.
    """
    lone = rows.where(F.trim("text") != "").join(pairs, ["pair_id", "tbl", "row"], "left_anti")
    own = lone.select("pair_id", "tbl", "row", "text", F.explode_outer(X.fine_tokens(F.col("text"))).alias("token")).groupBy("pair_id", "tbl", "row", "text", "token").agg(F.count("token").alias("n"))
    there = tokens.groupBy("pair_id", "tbl", "token").agg(F.count("*").alias("m"))
    kept = own.join(there, ["pair_id", "tbl", "token"], "left").groupBy("pair_id", "tbl", "row", "text").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("kept"), F.sum("n").alias("n"))
    gone = kept.where((F.col("kept") < SURVIVES * F.col("n")) & ~((F.col("row") == 0) & (F.length("text") > LONG_HEADER)))
    return gone.select("pair_id", "tbl", "row", F.when(F.col("row") == 0, "Table heading missing").otherwise("Table row missing").alias("message"), "text")


def cells_missing(pairs: DataFrame) -> DataFrame:
    """Cells of matched rows that lost words: two, or one of six letters, unless 75 % of the cell is elsewhere in the row; thirty a table.

    Pairs: pair_id, tbl, row, cells, stage_cells (arrays), rows that share 40 % of their words.
    """
    words = lambda c: F.filter(X.cell_tokens(c), lambda w: ~w.isin(X.STOP_WORDS))
    n = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    shared = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(n(a, w), n(b, w)))
    told = pairs.withColumn("_a", X.cell_tokens(F.array_join("cells", " "))).withColumn("_b", X.cell_tokens(F.array_join("stage_cells", " "))).withColumn("_fine", X.fine_tokens(F.array_join("stage_cells", " ")))
    alike = told.where(2.0 * shared(F.col("_a"), F.col("_b")) >= COMPARABLE * (F.size("_a") + F.size("_b")))
    each = alike.select("pair_id", "tbl", "row", "stage_cells", "_fine", F.posexplode("cells").alias("col", "cell")).withColumn("_own", words(F.col("cell"))).withColumn("_other", words(F.coalesce(F.get("stage_cells", F.col("col")), F.lit(""))))
    lost = F.array_sort(F.flatten(F.transform(F.array_distinct("_own"), lambda w: F.array_repeat(w, F.greatest(n(F.col("_own"), w) - n(F.col("_other"), w), F.lit(0))))))
    bad = each.withColumn("missing", lost).where((F.size("missing") >= 2) | F.exists("missing", lambda w: F.length(w) >= LONG_TOKEN))
    fine = F.filter(X.fine_tokens(F.col("cell")), lambda w: ~w.isin(X.STOP_WORDS))
    moved = (F.size(fine) > 0) & (shared(fine, F.col("_fine")) >= SURVIVES * F.size(fine))
    told = bad.where(~moved).withColumn("message", F.when(F.col("row") == 0, "Table heading missing").otherwise("Table cell missing"))
    w = Window.partitionBy("pair_id", "tbl").orderBy("row", "col")
    return told.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MOST_CELLS).select("pair_id", "tbl", "row", "col", "missing", "message")


def ruled_tables(cells: DataFrame) -> DataFrame:
    """(TABLE, row, key, text, box): the rows of tables of two rows or more that are drawn with rules, each with its box and key."""
    rows = cells.groupBy(*TABLE, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " ").alias("text"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.bool_or(F.coalesce("border_top", F.lit(False)) | F.coalesce("border_bottom", F.lit(False))).alias("ruled"))
    w = Window.partitionBy(*TABLE)
    kept = rows.withColumn("_n", F.count("*").over(w)).withColumn("_ruled", F.bool_or("ruled").over(w)).where("_n >= 2 and _ruled")
    return kept.withColumn("key", X.ruled_cell(F.col("text"))).drop("_n", "_ruled", "ruled")


def pooled_rows(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Rows of ruled tables that a topic of one side has and the other lacks, as often as it lacks them, wherever its tables hold them.

    Rows: pair_id, side, topic, row, key. What the other side's topic prints in so many words is not missing (printed: pair_id, side, topic,
    blob).
    """
    both = rows.where("key <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "side", "topic", "key").orderBy("row")))
    other = F.when(F.col("side") == "prod", "stage").otherwise("prod")
    there = both.select("pair_id", other.alias("side"), "topic", "key", "_n").withColumn("_there", F.lit(True))
    lone = both.join(there, ["pair_id", "side", "topic", "key", "_n"], "left").where(F.col("_there").isNull()).drop("_there")
    blobs = printed.select("pair_id", other.alias("side"), "topic", F.col("blob").alias("_blob"))
    held = F.contains(F.concat(F.lit(" "), "_blob", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" ")))
    left = lone.join(blobs, ["pair_id", "side", "topic"], "left").where(~F.coalesce(held, F.lit(False)))
    return left.select("pair_id", "topic", "row", "key", F.when(F.col("side") == "prod", "table-row-missing").otherwise("table-row-added").alias("type"))


def reworded_rows(lone: DataFrame) -> DataFrame:
    """Lone rows of either side paired by likeness from one half on, with the words lost and added; a difference of blanks alone is named as such.

    Lone: pair_id, topic, row, key, type (see pooled_rows). A topic's lone rows must fit into a task.
    """
    from difflib import SequenceMatcher

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.type == t].sort_values("row") for t in ("table-row-missing", "table-row-added"))
        free, out = list(zip(b.row, b.key, strict=True)), []
        for row, key in zip(a.row, a.key, strict=True):
            scored = [(SequenceMatcher(None, key, k).ratio(), -i) for i, (_, k) in enumerate(free)]
            if not scored or max(scored)[0] < REWORDED:
                continue
            other, text = free.pop(-max(scored)[1])
            x, y = key.split(), text.split()
            lost, added = list(x), []
            for w in y:
                lost.remove(w) if w in lost else added.append(w)
            spaced = bool(lost) and "".join(lost) == "".join(added)
            out.append((pdf.pair_id.iloc[0], pdf.topic.iloc[0], row, other, lost, added, ("space extra in Staging" if len(added) > len(lost) else "space missing in Staging") if spaced else None))
        return pd.DataFrame(out, columns=["pair_id", "topic", "row", "stage_row", "gone", "extra", "space"])

    kinds = dict(lone.dtypes)
    return lone.groupBy("pair_id", "topic").applyInPandas(run, f"pair_id {kinds['pair_id']}, topic {kinds['topic']}, row {kinds['row']}, stage_row {kinds['row']}, gone array<string>, extra array<string>, space string")


def tight_regions(cells: DataFrame) -> DataFrame:
    """(TABLE, x0, y0, x1, y1): the box of each detected region's cells that hold text; regions of one column or none are left out."""
    text = cells.where((F.trim("text") != "") & F.col("x0").isNotNull())
    box = text.groupBy(*TABLE).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.countDistinct("col").alias("_cols"))
    return box.where("_cols >= 2 and x0 >= 0 and y0 >= 0").drop("_cols")


def without_repeated_heads(rows: DataFrame) -> DataFrame:
    """The rows of stitched tables, without those of the first two of a later fragment that repeat the table's first rows. Rows: pair_id, side, table, fragment, row, key."""
    whole = Window.partitionBy("pair_id", "side", "table").orderBy("fragment", "row")
    own = Window.partitionBy("pair_id", "side", "table", "fragment").orderBy("row")
    told = rows.withColumn("_n", F.row_number().over(own)).withColumn("_f", F.min("fragment").over(Window.partitionBy("pair_id", "side", "table")))
    heads = F.collect_list(F.when((F.col("fragment") == F.col("_f")) & (F.col("_n") <= 2), F.col("key"))).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = told.withColumn("_heads", heads)
    # The second row repeats the head only where the first one did.
    first = (F.col("_n") == 1) & (F.col("key") == F.get("_heads", 0))
    second = (F.col("_n") == 2) & (F.col("key") == F.get("_heads", 1)) & F.coalesce(F.lag(first).over(own), F.lit(False))
    repeat = (F.col("fragment") != F.col("_f")) & (first | second)
    kept = marked.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where(~F.col("_repeat"))
    return kept.withColumn("row", F.row_number().over(whole) - 1).drop("_n", "_f", "_heads", "_repeat")
