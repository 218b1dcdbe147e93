"""From relations to a verdict: the comparison of all pairs as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import compare as C
from palimpsest.operators import headings as H
from palimpsest.operators import issues as I
from palimpsest.operators import sections as S
from palimpsest.operators.ordered import last_before
from palimpsest.sources import relations as R


def read_relations(spark: SparkSession, prod: str, stage: str) -> dict[str, DataFrame]:
    """The relations of two editions, each a folder that holds a Parquet table a relation; what a folder lacks is empty."""
    out = {}
    for name in R.SCHEMAS:
        parts = [R.read_relation(spark, f"{folder}/{name}", name).withColumn("side", F.lit(side)) for side, folder in (("prod", prod), ("stage", stage)) if R.exists(spark, f"{folder}/{name}")]
        out[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else spark.createDataFrame([], R.SCHEMAS[name])
    return out


def kept(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, where several results are made of them: in the shared folder, or, where none is named, in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def boxes_of_tables(grids: DataFrame) -> DataFrame:
    return grids.groupBy("pair_id", "side", "page", "tbl").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def compare(relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """entries, toc, rows, issues and report of all pairs.

    Headings are resolved for both sides, lines put under them, sections aligned, what one side lacks looked for in its section and in the
    whole document; pages, fonts and titles are counted. An issue is an error unless it is for review.
    """
    spans, pages = relations["spans"], relations["pages"]
    entries = kept(H.resolved(relations["outline"], spans, boxes_of_tables(relations["grids"]), relations["images"].where(F.lit(False)).select("pair_id", "side", "page", "x0", "y0", "x1", "y1"), pages))
    lines = H.printed_lines(spans)
    matched = kept(H.matched(entries.where("not excluded").drop("excluded")))
    # A section is the number of the last heading that both sides have.
    marks = [matched.where("prod is not null and stage is not null").select("pair_id", F.lit(side).alias("side"), F.col(f"{side}.page").alias("page"), F.col(f"{side}.y").alias("y"), F.col("n").cast("long").alias("section")) for side in ("prod", "stage")]
    placed = last_before(lines.select("pair_id", "side", "page", "y", "block", "line", "text"), marks[0].unionByName(marks[1]), ["pair_id", "side"], ["page", "y"], "section").withColumn("section", F.coalesce("section", F.lit(-1).cast("long")))
    heads = entries.select("pair_id", "side", "page", "y").distinct().withColumn("_head", F.lit(True))
    records = kept(placed.join(heads, ["pair_id", "side", "page", "y"], "left").where(~X.is_page_number(F.col("text"))).select("pair_id", "section", "side", (F.col("page") * 1_000_000 + F.col("block") * 1000 + F.col("line")).cast("long").alias("ord"), F.when(F.col("_head"), "heading").otherwise("prose").alias("kind"), "text"))
    blob = lambda keys: records.groupBy(*keys, "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: X.alnum_blob(t["text"])), " ").alias("blob"))
    rows = S.cross_present(S.aligned_rows(records), blob(["pair_id", "section"]))
    rows = kept(S.callouts_refiled(S.relocated(kept(rows), records.select("pair_id", "side", "text"))))
    found = rows.where("op <> 'equal' and kind in ('prose', 'heading')")
    message = F.when(F.col("op") == "prod", "Missing text").when(F.col("op") == "stage", "Added text").otherwise("Changed text")
    text = F.map_filter(F.create_map(F.lit("expected"), F.col("prod"), F.lit("actual"), F.col("stage")), lambda k, v: v.isNotNull())
    page = F.floor(F.coalesce("prod_ord", "stage_ord") / 1_000_000).cast("int")
    issue = lambda df, check, severity, confidence, page, section, category, message, details: df.select("pair_id", F.lit(check).alias("check"), severity.alias("severity"), confidence.alias("confidence"), page.cast("int").alias("page"), section.alias("section"), F.lit(category).alias("category"), message.alias("message"), details.alias("details"))
    title = matched.select("pair_id", F.col("n").cast("long").alias("section"), F.col("prod.title").alias("heading"))
    content = issue(found.join(title, ["pair_id", "section"], "left"), "Content", F.lit("error"), F.lit("confirmed"), page, F.col("heading"), "content", message, text)
    n = pages.groupBy("pair_id").agg(F.count_if(F.col("side") == "prod").alias("a"), F.count_if(F.col("side") == "stage").alias("b")).where("a <> b")
    counted = issue(n, "Pages", F.lit("warning"), F.lit("review"), F.lit(None), F.lit(None).cast("string"), "content", F.lit("Page count mismatch"), F.create_map(F.lit("expected"), F.col("a").cast("string"), F.lit("actual"), F.col("b").cast("string")))
    lone = H.one_sided_headings(entries)
    headed = issue(lone, "Headings", F.lit("error"), F.lit("confirmed"), F.lit(None), F.col("title"), "content", F.when(F.col("type") == "section-missing", "Section missing").otherwise("Section added"), F.create_map(F.lit("heading"), F.col("title")))
    uris = relations["links"].where("uri is not null").select("pair_id", "side", X.uri_authority(F.col("uri")).alias("uri"))
    lost = C.bag_difference(uris.where("side = 'prod'").select("pair_id", "uri").distinct(), uris.where("side = 'stage'").select("pair_id", "uri").distinct(), ["pair_id", "uri"])
    linked = issue(lost, "Links", F.lit("error"), F.lit("confirmed"), F.lit(None), F.lit(None).cast("string"), "links", F.when(F.col("lost") > 0, "Link missing").otherwise("Link added"), F.create_map(F.lit("uri"), F.col("uri")))
    issues = content.unionByName(counted).unionByName(headed).unionByName(linked)
    toc = matched.select("pair_id", F.coalesce("prod.title", "stage.title").alias("title"), F.when(F.col("stage").isNull(), "Missing").when(F.col("prod").isNull(), "Extra").otherwise("Matched").alias("status"))
    summary = S.counts(rows).join(title, ["pair_id", "section"], "left").groupBy("pair_id").agg(F.lit("Content").alias("name"), F.lit("Sections").alias("summary_title"), F.sort_array(F.collect_list(F.concat_ws(": ", F.coalesce("heading", F.lit("")), F.col("real_diff").cast("string")))).alias("summary_rows"))
    return {"entries": entries, "toc": toc, "rows": rows, "issues": issues, "report": I.report_rows(issues, toc, summary)}
