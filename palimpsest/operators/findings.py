"""Findings about sentences: small differences, undecoded characters, lost styles, callouts, and where the evidence stands.

Pairs of sentences hold structs `prod` and `stage`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.compare import top_per

# Fixed values.
PRESENT, DROP, MOST_STYLE = 0.20, 0.20, 60
ICON_LEAST, ICON_MOST, ICON_GAP, STAGE_GAP, COLOURED, PALE = 10.0, 34.0, 60.0, 102.0, 0.18, 0.12
CALLOUT_MATCH, CALLOUT_WORDS, CALLOUT_KEYS = 0.7, 16, 3
EXTENSION = 260.0


def slice_message(strict_prod: Column, strict_stage: Column, lax_prod: Column, lax_stage: Column) -> Column:
    """What a slice of the alignment is: arrays of sentences that the presence tests left (strict) and that they began with (lax).

    Missing, added or changed text; a minor difference where the tests emptied both sides of what differed; else null.
    """
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    a, b = n(strict_prod) > 0, n(strict_stage) > 0
    return F.when(a & b, "Changed text").when(a, "Missing text").when(b, "Added text").when((n(lax_prod) > 0) & (n(lax_stage) > 0), "Minor text difference")


def slice_severity(message: Column) -> tuple[Column, Column]:
    """(severity, confidence) of a slice's message: a minor difference is for review only."""
    minor = message == "Minor text difference"
    return F.when(minor, "warning").otherwise("error"), F.when(minor, "review").otherwise("confirmed")


def encoding_issues(texts: DataFrame) -> DataFrame:
    """One row a section and side with undecoded characters: an error if a kind of them is new against the other side, else a warning.

    Texts: pair_id, section, side, text.
    """
    found = texts.select("pair_id", "section", "side", F.explode(X.encoding_artifacts(F.col("text"))).alias("a"))
    kinds = found.withColumn("a", F.when(F.startswith("a", F.lit("(cid:")), "(cid:N)").otherwise(F.col("a"))).groupBy("pair_id", "section", "side", "a").agg(F.count("*").alias("n"))
    there = F.size(F.collect_set("side").over(Window.partitionBy("pair_id", "section", "a"))) == 1
    told = kinds.withColumn("new", there).groupBy("pair_id", "section", "side").agg(F.sum("n").alias("occurrences"), F.count("*").alias("distinct"), F.count_if("new").alias("new"))
    return told.withColumn("severity", F.when(F.col("new") > 0, "error").otherwise("warning"))


def encoding_regressions(pairs: DataFrame) -> DataFrame:
    """Sentences that are the same on both sides, but for characters that only the candidate could not decode: an error. Structs hold text."""
    new = F.array_sort(F.array_except(X.artifact_set(F.col("stage.text")), X.artifact_set(F.col("prod.text"))))
    return pairs.withColumn("characters", new).where(F.size("characters") > 0).withColumn("message", F.lit("Text encoding regression in Staging"))


def emphasis_issues(pairs: DataFrame) -> DataFrame:
    """Bold or italics that a block lost: a fifth of its characters or more, and as much less now; one finding a block, sixty a pair. Structs hold block, bold, italic."""
    lost = lambda c: (F.col(f"prod.{c}") >= PRESENT) & (F.col(f"prod.{c}") - F.col(f"stage.{c}") >= DROP)
    told = pairs.withColumn("emphasis", F.concat_ws(" and ", F.when(lost("bold"), "bold"), F.when(lost("italic"), "italic"))).where("emphasis <> ''")
    once = top_per(told, ["pair_id", "prod.block"], ["ord"], 1)
    return top_per(once, ["pair_id"], ["ord"], MOST_STYLE)


def style_issues(pairs: DataFrame) -> DataFrame:
    """Sentences of the same words whose weight or slant changed, sixty a pair; another family or size alone is none. Structs hold font, bold, italic."""
    differs = lambda c: ~F.col(f"prod.{c}").eqNullSafe(F.col(f"stage.{c}"))
    changed = F.concat_ws(", ", F.when(differs("font"), "font family"), F.when(differs("bold"), "bold"), F.when(differs("italic"), "italic"))
    return top_per(pairs.where(differs("bold") | differs("italic")).withColumn("changed", changed), ["pair_id"], ["ord"], MOST_STYLE)


def callout_issues(pairs: DataFrame) -> DataFrame:
    """Sentences that carry a callout label on both sides, but another one. Structs hold text."""
    a, b = X.callout_label(F.col("prod.text")), X.callout_label(F.col("stage.text"))
    return pairs.withColumn("expected_label", a).withColumn("actual_label", b).where("expected_label <> actual_label")


def callout_key(text: Column) -> Column:
    """The first sixteen words of three letters or more."""
    return F.array_distinct(F.slice(F.filter(F.transform(X.words(X.strip_callout_label(text)), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), lambda w: F.length(w) >= 3), 1, CALLOUT_WORDS))


def icons_beside(blocks: DataFrame, images: DataFrame, gap: float) -> DataFrame:
    """Blocks with `colour`, the coloured share of the nearest small image to their left; null if there is none.

    Blocks: pair_id, side, page, block, x0, y0, y1. Images have a box and `colour`.
    """
    key = ["pair_id", "side", "page"]
    wide, high = F.col("i_x1") - F.col("i_x0"), F.col("i_y1") - F.col("i_y0")
    i = images.select(*key, *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")], F.col("colour").alias("_colour")).where(wide.between(ICON_LEAST, ICON_MOST) & high.between(ICON_LEAST, ICON_MOST))
    beside = (F.col("x0") - F.col("i_x1")).between(0, gap) & (F.least("y1", "i_y1") > F.greatest("y0", "i_y0"))
    near = blocks.join(i, key).where(beside).groupBy(*key, "block").agg(F.min_by("_colour", F.col("x0") - F.col("i_x1")).alias("colour"))
    return blocks.join(near, [*key, "block"], "left")


def callout_icon_issues(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Callouts that the baseline marks with a coloured icon and the candidate, in the most alike block, does not, or only with a pale one.

    Blocks: pair_id, side, page, block, text, box. Two blocks are the same callout if they share 70 % of its first words, three at least.
    """
    prod = icons_beside(blocks.where("side = 'prod'"), images, ICON_GAP).where(F.col("colour") >= COLOURED)
    stage = icons_beside(blocks.where("side = 'stage'"), images, STAGE_GAP)
    a = prod.select("pair_id", "page", "block", callout_key(F.col("text")).alias("own")).where(F.size("own") >= CALLOUT_KEYS)
    b = stage.select("pair_id", F.col("block").alias("s_block"), F.coalesce("colour", F.lit(0.0)).alias("s_colour"), callout_key(F.col("text")).alias("other"))
    # Blocks meet by a word that they share, not all with all.
    by_word = a.select("*", F.explode("own").alias("w")).join(b.select("pair_id", "s_block", F.explode("other").alias("w")), ["pair_id", "w"]).groupBy("pair_id", "page", "block", "s_block").agg(F.count("*").alias("shared"), F.first("own").alias("own"))
    alike = by_word.where(F.col("shared") >= CALLOUT_MATCH * F.size("own")).join(b.select("pair_id", "s_block", "s_colour"), ["pair_id", "s_block"])
    best = alike.groupBy("pair_id", "page", "block").agg(F.max(F.struct("shared", (-F.col("s_block")).alias("n"), "s_colour")).alias("m"))
    return best.where(F.col("m.s_colour") <= PALE).select("pair_id", "page", "block", (-F.col("m.n")).alias("stage_block"), F.col("m.s_colour").alias("stage_colour"))


def evidence(records: DataFrame) -> DataFrame:
    """(pair_id, slice, page, x0, y0, x1, y1): where a slice is shown: on the page that most of its records stand on, from the record before it to the one after it there, 260 points beyond it at most.

    Records: pair_id, slice, ord, page, x0, y0, x1, y1; a slice of -1 is what lies between slices.
    """
    w = Window.partitionBy("pair_id").orderBy("ord")
    around = records.withColumn("before", F.lag(F.struct("page", "y0")).over(w)).withColumn("after", F.lead(F.struct("page", "y1")).over(w)).where(F.col("slice") >= 0)
    n = around.groupBy("pair_id", "slice", "page").agg(F.count("*").alias("n"))
    modal = n.groupBy("pair_id", "slice").agg(F.max(F.struct("n", (-F.col("page")).alias("p"))).alias("m")).select("pair_id", "slice", (-F.col("m.p")).alias("page"))
    own = around.join(modal, ["pair_id", "slice", "page"]).groupBy("pair_id", "slice", "page").agg(
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.min(F.struct("ord", "before"))["before"].alias("before"), F.max(F.struct("ord", "after"))["after"].alias("after")
    )
    top = F.when(F.col("before.page") == F.col("page"), F.greatest(F.least(F.col("before.y0"), F.col("y0")), F.col("y0") - EXTENSION)).otherwise(F.col("y0"))
    foot = F.when(F.col("after.page") == F.col("page"), F.least(F.greatest(F.col("after.y1"), F.col("y1")), F.col("y1") + EXTENSION)).otherwise(F.col("y1"))
    return own.select("pair_id", "slice", "page", "x0", top.alias("y0"), "x1", foot.alias("y1"))


def slice_anchors(records: DataFrame, marks: DataFrame) -> DataFrame:
    """(pair_id, slice, heading): the heading above a slice's first record. Marks: pair_id, ord, title."""
    first = records.where("slice >= 0").groupBy("pair_id", "slice").agg(F.min("ord").alias("ord"))
    both = first.select("pair_id", "ord", F.lit(1).alias("k"), "slice", F.lit(None).cast("string").alias("title")).unionByName(marks.select("pair_id", "ord", F.lit(0).alias("k"), F.lit(None).cast("int").alias("slice"), "title"))
    w = Window.partitionBy("pair_id").orderBy("ord", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("title", True).over(w)).where("k = 1").select("pair_id", "slice", "heading")
