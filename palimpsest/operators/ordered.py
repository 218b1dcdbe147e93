"""Ordered operators: islands of adjacent rows, the last row before, the next bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 10_000


def islands(df: DataFrame, keys: list[str], order: list, goes_on: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of rows within `keys` in which each row but the first goes on from the one before (`goes_on` may use lag)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def by_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: StructType | str) -> DataFrame:
    """The rows that `run` makes of each group's rows, which come as tuples in `order`. Partitions are sorted and read as a stream, so that
    small groups cost little; a group must fit into a task."""
    columns, n = [*keys, *[c for c in df.columns if c not in keys]], len(keys)
    made = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

        each = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out: list[tuple] = []
        for _, group in groupby(each, itemgetter(*range(n))):
            out += run(list(group))
            if len(out) >= BATCH:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def before(keys: list[str], order: list, *columns: str) -> list[Column]:
    w = Window.partitionBy(*keys).orderBy(*order)
    return [F.lag(c).over(w) for c in columns]


def merge_wrapped(lines: DataFrame, terminated: Column, starts_low: Column) -> DataFrame:
    """Lines joined to paragraphs: a line goes on the one before if that is unfinished and this starts low; a hyphen joins without a blank."""
    w = Window.partitionBy("pair_id").orderBy("ord")
    flagged = lines.withColumn("_done", terminated).withColumn("_low", starts_low)
    grouped = islands(flagged, ["pair_id"], ["ord"], ~F.lag("_done").over(w) & F.col("_low"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    joined = F.aggregate(texts, F.lit(""), lambda s, t: F.when(s == "", t).when(F.endswith(s, F.lit("-")), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), t)).otherwise(F.concat(s, F.lit(" "), t)))
    return grouped.groupBy("pair_id", "island").agg(F.min("ord").alias("ord"), F.count("*").alias("n_lines"), joined.alias("text"))


def attach_markers(blocks: DataFrame, is_marker: Column) -> DataFrame:
    """A block that is only a list marker is put in front of the block after it; a last one is dropped."""
    w = Window.partitionBy("pair_id").orderBy("ord")
    flagged = blocks.withColumn("_marker", is_marker)
    own = flagged.withColumn("_before", F.when(F.lag("_marker").over(w), F.lag("text").over(w)))
    return own.where(~F.col("_marker")).withColumn("text", F.when(F.col("_before").isNotNull(), F.concat_ws(" ", F.trim("_before"), "text")).otherwise(F.col("text"))).drop("_marker", "_before")


def section_bounds(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Each heading's section ends where the next heading in (page, y) order starts; the last is open (null)."""
    w = Window.partitionBy(*keys).orderBy("page", "y", "ord")
    return headings.withColumn("_next", F.lead(F.struct("page", "y")).over(w)).select("*", F.col("_next.page").alias("end_page"), F.col("_next.y").alias("end_y")).drop("_next")


def in_section(items: DataFrame, sections: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """Items with the section whose half-open span holds them: one sort within `keys`, no pairs. Sections do not overlap."""
    # Sections follow each other, so the last one that starts before an item is the only one that can hold it.
    s = sections.select(*keys, "page", (F.col("y") - slack).alias("y"), F.struct(F.col("ord").alias("section"), F.struct("end_page", "end_y").alias("end")).alias("_held"))
    found = last_before(items, s, keys, ["page", "y"], "_held").where("_held is not null")
    there = F.struct(F.col("page").alias("end_page"), (F.col("y") + slack).alias("end_y"))
    inside = found.where(F.col("_held.end.end_page").isNull() | (there < F.col("_held.end")))
    return inside.select(*items.columns, F.col("_held.section").alias("section"))


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """As-of join: each point with the value of the last mark at or before it. One sort per key, no pairs."""
    marked = marks.select(*keys, *order, F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    others = [c for c in points.columns if c not in [*keys, *order]]
    asked = points.select(*keys, *order, F.lit(1).alias("_kind"), F.struct(*others).alias("_row"))
    both = marked.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").select(*keys, *order, *[F.col(f"_row.{c}").alias(c) for c in others], F.col("_value").alias(value))


def running_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with `why` they are page furniture, null if they are not: a page number, running (in the head's or foot's eighth of three
    pages or more, digits apart), or alone in the last six hundredths of its page.

    Only short ones: three lines or 22 points at most, sixteen words, not ending like a sentence. Lines: keys, page, y0, y1, text, n_lines,
    height (of the page).
    """
    t = F.col("text")
    band = F.when(F.col("y1") <= 0.12 * F.col("height"), "top").when(F.col("y0") >= 0.88 * F.col("height"), "foot")
    short = ((F.col("n_lines") <= 3) | (F.col("y1") - F.col("y0") <= 22)) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0)) <= 16) & ~F.rlike(t, F.lit(r"[.!?:;]\s*$"))
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, "[0-9]+", "#")), r"\s+", " "))
    own = lines.withColumn("_band", F.when(short, band)).withColumn("_key", key)
    often = own.where("_band is not null").groupBy(*keys, "_band", "_key").agg(F.countDistinct("page").alias("_pages"))
    number = F.rlike(F.trim(t), F.lit(r"^(?:[-–]\s*)?(?:[0-9]{1,4}|[ivxlc]{1,6})(?:\s*[-–])?$"))
    why = F.when(F.col("_band").isNull(), None).when(number, "page number").when(F.col("_pages") >= 3, "running").when(F.col("y0") >= 0.94 * F.col("height"), "foot")
    return own.join(often, [*keys, "_band", "_key"], "left").withColumn("why", why).select(*lines.columns, "why")
