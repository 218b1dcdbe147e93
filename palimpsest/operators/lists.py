"""List items, indents, alignment and links."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.operators.compare import greedy_pairs
from palimpsest.operators.ordered import islands

MARKER = rf"^\s*(\(?[0-9]{{1,2}}\s?[.)]|\(?[A-Za-z]\s?[.)]|(?:{'|'.join(X.ROMAN)})[.)]|[{X.BULLETS}])\s+(\S.*)$"


def list_items(lines: DataFrame) -> DataFrame:
    """Lines that start with a marker: marker, kind and the text after it."""
    marker = F.regexp_extract("text", MARKER, 1)
    return lines.withColumn("marker", marker).where("marker <> ''").withColumn("kind", X.marker_kind(F.col("marker"))).withColumn("item", F.regexp_extract("text", MARKER, 2))


def detached_items(blocks: DataFrame) -> DataFrame:
    """Lone markers joined to the nearest text right of them on their row: over 40 % of the height shared, 48 points apart at most, one claim each."""
    marks = blocks.where(X.is_bare_marker(F.col("text"))).select("pair_id", "side", "page", F.col("block").alias("marker_block"), F.col("text").alias("marker"), *[F.col(c).alias(f"m_{c}") for c in ("x1", "y0", "y1")])
    texts = blocks.where(~X.is_bare_marker(F.col("text")))
    shared = F.least("y1", "m_y1") - F.greatest("y0", "m_y0")
    near = texts.join(marks, ["pair_id", "side", "page"]).withColumn("gap", F.col("x0") - F.col("m_x1")).where(F.col("gap").between(0, 48) & (shared > 0.4 * F.least(F.col("y1") - F.col("y0"), F.col("m_y1") - F.col("m_y0"))))
    scored = near.withColumn("score", -F.col("gap")).select("pair_id", "side", "page", "marker_block", "block", "marker", "text", "score")
    return greedy_pairs(scored, ["pair_id", "side", "page"], "marker_block", "block", "score").drop("score")


def marker_changes(prod: DataFrame, stage: DataFrame) -> DataFrame:
    """Items whose marker kind or number changed, matched by texts that stand once on either side, grouped into runs of one change on a page.

    Items: pair_id, page, y, item, marker, kind. A run ends where numbering restarts at 1, a or i.
    """
    once = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy("pair_id", "item"))).where("_n = 1").drop("_n")
    both = once(prod).join(once(stage).select("pair_id", "item", F.col("marker").alias("new_marker"), F.col("kind").alias("new_kind")), ["pair_id", "item"])
    norm = lambda c: F.regexp_replace(F.lower(c), r"[\s().]", "")
    changed = both.where((F.col("kind") != F.col("new_kind")) | ((F.col("kind") != "bullet") & (norm("marker") != norm("new_marker"))))
    w = Window.partitionBy("pair_id").orderBy("page", "y")
    same = (F.col("page") == F.lag("page").over(w)) & (F.col("kind") == F.lag("kind").over(w)) & (F.col("new_kind") == F.lag("new_kind").over(w)) & ~norm("marker").isin("1", "a", "i")
    runs = islands(changed, ["pair_id"], ["page", "y"], same & (F.col("y") - F.lag("y").over(w)).between(-8, 60), "run")
    first = F.min(F.struct("page", "y", "marker", "new_marker", "new_kind"))
    out = runs.groupBy("pair_id", "run").agg(first.alias("f"), F.count("*").alias("n"))
    new = F.when(F.col("f.new_kind") == "bullet", "bulleted").otherwise(F.concat(F.lit("item "), norm("f.new_marker")))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" (and "), (F.col("n") - 1).cast("string"), F.lit(" more like it)"))).otherwise("")
    return out.select("pair_id", "run", F.col("f.page").alias("page"), "n", F.concat(F.lit("is step "), norm("f.marker"), F.lit(" in the baseline but "), new, F.lit(" in the candidate"), more).alias("summary"))


def indent_changed(prod_indent: Column, stage_indent: Column, slack: float = 6.0) -> Column:
    """Indents are measured from the side's modal left edge."""
    return F.abs(stage_indent - prod_indent) > slack


def marker_size_changed(prod: Column, stage: Column, on: bool = False) -> Column:
    """A marker 15 % larger or smaller; off unless asked for."""
    return F.lit(on) & (F.abs(stage - prod) >= 0.15 * prod)


def alignment(lines: DataFrame, keys: list[str]) -> DataFrame:
    """left, right, center, justified or unknown, by how far the ends of three lines or more stray (three points; middles twelve)."""
    body = lines.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("x0") - F.min("x0")).alias("l"), (F.max("x1") - F.min("x1")).alias("r"), (F.max(F.col("x0") + F.col("x1")) - F.min(F.col("x0") + F.col("x1"))).alias("c"))
    kind = F.when(F.col("n") < 3, "unknown").when((F.col("l") <= 3) & (F.col("r") <= 3), "justified").when(F.col("l") <= 3, "left").when(F.col("r") <= 3, "right").when(F.col("c") / 2 <= 12, "center").otherwise("unknown")
    return body.select(*keys, kind.alias("alignment"))


def merged_labels(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Standalone bold labels of the baseline that start a longer block of the candidate."""
    b = blocks.select("pair_id", F.col("text").alias("block"))
    key = F.substring_index("label", " ", 1)
    return labels.withColumn("_k", key).join(b.withColumn("_k", F.substring_index("block", " ", 1)), ["pair_id", "_k"]).where(F.startswith("block", F.col("label")) & (F.length("block") > F.length("label") + 1)).drop("_k")


def link_status(links: DataFrame, known: DataFrame, n_pages: Column, names: DataFrame) -> DataFrame:
    """What is wrong with each link of the candidate, null if nothing: its box, its scheme, its page, its name."""
    n = names.select("pair_id", "dest_name").distinct().withColumn("_named", F.lit(True))
    k = known.select("pair_id", X.uri_authority(F.col("uri")).alias("_a")).distinct().withColumn("_known", F.lit(True))
    rows = links.withColumn("_a", X.uri_authority(F.col("uri"))).join(k, ["pair_id", "_a"], "left").join(n, ["pair_id", "dest_name"], "left")
    tiny = (F.col("x1") - F.col("x0") < 2) | (F.col("y1") - F.col("y0") < 2)
    usable = F.rlike("uri", F.lit(r"(?i)^(https?|mailto|tel|ftp):"))
    status = (
        F.when(tiny, "hotspot too small")
        .when((F.col("kind") == "uri") & ~F.coalesce(usable, F.lit(False)) & F.col("_known").isNull(), "address cannot be used")
        .when((F.col("kind") == "goto") & ~F.coalesce(F.col("target_page").between(0, n_pages - 1), F.lit(False)), "page does not exist")
        .when((F.col("kind") == "named") & F.col("_named").isNull(), "name does not exist")
    )
    return rows.withColumn("problem", status).drop("_a", "_known", "_named")


@F.pandas_udf(T.IntegerType())
def shared_run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The length of the longest run that two texts share: what ties a link's label to its sentence."""
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).find_longest_match(0, len(x or ""), 0, len(y or "")).size for x, y in zip(a, b, strict=True)])


def link_anchor(text: Column, label: Column) -> Column:
    """Where in a text, blanks apart, a link's label stands (from 1, 0 for nowhere)."""
    squash = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return F.coalesce(F.position(squash(label), squash(text)), F.lit(0))
