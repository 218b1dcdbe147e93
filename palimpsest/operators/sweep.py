"""The sweep over pages: inventories, page pairs, gaps; scanned pages and their words; headings' styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ordered import islands


def inventory(words: DataFrame, images: DataFrame, links: DataFrame, tables: DataFrame) -> DataFrame:
    """One row a page: words, pictures, icons (under 40 points a side), links, tables. Each relation is counted before the join."""
    key = ["pair_id", "side", "page"]
    small = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < 40
    parts = [
        words.groupBy(*key).agg(F.count("*").alias("n_words")),
        images.groupBy(*key).agg(F.count_if(~small).alias("n_images"), F.count_if(small).alias("n_icons"), F.sum(F.when(~small, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).otherwise(0.0)).alias("art_area")),
        links.groupBy(*key).agg(F.array_sort(F.collect_set("uri")).alias("uris")),
        tables.groupBy(*key).agg(F.count("*").alias("n_tables")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full_outer")
    return out.fillna(0).withColumn("uris", F.coalesce("uris", F.expr("cast(array() as array<string>)")))


def page_gaps(pairs: DataFrame) -> DataFrame:
    """What facing pages differ in: prod and stage are inventory structs."""
    p, s = F.col("prod"), F.col("stage")
    found = F.array_compact(
        F.array(
            F.when(F.abs(p["art_area"] - s["art_area"]) > 0.25 * F.greatest(p["art_area"], s["art_area"]), "artwork"),
            F.when(F.abs(p["n_icons"] - s["n_icons"]) > 3, "icons"),
            F.when(F.size(F.array_except(p["uris"], s["uris"])) > 0, "links lost"),
            F.when(F.size(F.array_except(s["uris"], p["uris"])) > 0, "links added"),
            F.when((p["n_tables"] > 0) != (s["n_tables"] > 0), "table"),
        )
    )
    return pairs.withColumn("gap", F.explode(found))


def page_pairs(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """The candidate page that faces each baseline page, interpolated between the waypoints before and after (half to even).

    Pages: pair_id, page. Marks: pair_id, prod_page, stage_page, one for each prod_page.
    """
    both = pages.select("pair_id", "page").join(marks.withColumnRenamed("prod_page", "page"), ["pair_id", "page"], "left")
    w = Window.partitionBy("pair_id").orderBy("page")
    at = F.when(F.col("stage_page").isNotNull(), F.struct("page", "stage_page"))
    a = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    known = both.withColumn("a", F.coalesce(a, b)).withColumn("b", F.coalesce(b, a))
    step = F.when(F.col("b.page") > F.col("a.page"), (F.col("page") - F.col("a.page")) / (F.col("b.page") - F.col("a.page")) * (F.col("b.stage_page") - F.col("a.stage_page"))).otherwise((F.col("page") - F.col("a.page")).cast("double"))
    return known.where("a is not null").select("pair_id", "page", F.greatest(F.bround(F.col("a.stage_page") + step, 0).cast("int"), F.lit(0)).alias("stage_page"))


def not_covered(gaps: DataFrame, findings: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """Gaps that no other finding speaks of, at most `most` a pair."""
    left = gaps.join(findings.select(*keys).distinct(), keys, "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy("page", "gap"))).where(F.col("_r") <= most).drop("_r")


def heading_style_changed(matched: DataFrame) -> DataFrame:
    """Pairs whose first forty headings, three at least, mostly (60 %) changed style; a size may drift by 0.75 points."""
    first = matched.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))).where("_r <= 40")
    differs = (F.col("prod_bold") != F.col("stage_bold")) | (F.abs(F.col("prod_size") - F.col("stage_size")) > 0.75)
    return first.groupBy("pair_id").agg(F.count("*").alias("n"), F.avg(differs.cast("double")).alias("share")).where("n >= 3 and share >= 0.6")


def scanned_pages(images: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that one image covers to 75 % and that hold eight native words at most."""
    key = ["pair_id", "side", "page"]
    large = images.groupBy(*key).agg(F.max((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    n = words.groupBy(*key).agg(F.count("*").alias("n"))
    return pages.join(large, key).join(n, key, "left").where((F.col("area") >= 0.75 * F.col("width") * F.col("height")) & (F.coalesce("n", F.lit(0)) <= 8)).select(*key)


def artwork_words(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """Recognised words that the page does not hold as text: those inside pictures."""
    return ocr.join(native.select("pair_id", "side", "page", "norm").distinct(), ["pair_id", "side", "page", "norm"], "left_anti")


def printed_lines(words: DataFrame) -> DataFrame:
    """Recognised words as lines: bands of words that share half their height, cut where a gap is three times that height."""
    key = ["pair_id", "side", "page"]
    # Words that start at one point: the narrower first, then the lower, so that the lines do not hang on the order of the rows.
    order, along = ["y0", "x0", "x1", "y1", "text"], ["x0", "x1", "y0", "y1", "text"]
    down = Window.partitionBy(*key).orderBy(*order)
    overlap = F.least("y1", F.lag("y1").over(down)) - F.greatest("y0", F.lag("y0").over(down))
    banded = islands(words, key, order, overlap >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(down)), "band")
    across = Window.partitionBy(*key, "band").orderBy(*along)
    height = F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy(*key, "band"))
    cut = islands(banded.withColumn("_h", height), [*key, "band"], along, F.col("x0") - F.lag("x1").over(across) <= 3 * F.col("_h"), "piece")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return cut.groupBy(*key, "band", "piece").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))


def page_text(spans: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """Spans, and for scanned pages recognised lines in their place (size 0.8 of the height, weight unknown)."""
    own = ocr_lines.withColumn("size", 0.8 * (F.col("y1") - F.col("y0"))).withColumn("ocr", F.lit(True))
    return spans.withColumn("ocr", F.lit(False)).unionByName(own, allowMissingColumns=True)


def gap_changed(prod: Column, stage: Column, least: float = 6.0, reach: float = 120.0) -> Column:
    """The gap between a marker and its text changed by six points or more, both within reach."""
    return (prod <= reach) & (stage <= reach) & (F.abs(stage - prod) >= least)


def font_changes(prod: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_in, font): fonts that one side alone uses."""
    a, b = (df.select(*keys, "font") for df in (prod, stage))
    return a.subtract(b).select(*keys, F.lit("prod").alias("only_in"), "font").unionAll(b.subtract(a).select(*keys, F.lit("stage").alias("only_in"), "font"))
