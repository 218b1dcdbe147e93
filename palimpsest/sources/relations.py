"""The relations that a comparison reads, keyed by pair_id and side ('prod' the baseline, 'stage' the candidate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOX = "x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "pages": "pair_id bigint, side string, page int, width double, height double",
    "spans": f"pair_id bigint, side string, page int, block int, line int, span int, text string, font string, size double, flags int, color int, {_BOX}",
    "draws": f"pair_id bigint, side string, page int, draw int, type string, closed boolean, items int, stroke int, fill int, {_BOX}",
    "images": f"pair_id bigint, side string, page int, xref bigint, px_w int, px_h int, {_BOX}, gray binary, gw int, gh int",
    "links": f"pair_id bigint, side string, page int, kind string, uri string, target_page int, dest_name string, {_BOX}",
    "outline": "pair_id bigint, side string, ord int, level int, title string, page int, dest_y double",
    "grids": f"pair_id bigint, side string, page int, tbl int, row int, col int, text string, {_BOX}, border_top boolean, border_bottom boolean",
}


def read_relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A relation from Parquet, with its columns and types; unknown columns are left out, missing ones are null."""
    schema = T._parse_datatype_string(SCHEMAS[name])
    df = spark.read.parquet(path)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def page_texts(spans: DataFrame) -> DataFrame:
    """(pair_id, side, page, text): each page's text, its lines in order."""
    line = spans.groupBy("pair_id", "side", "page", "block", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"))
    return line.groupBy("pair_id", "side", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda s: s["text"]), "\n").alias("text"))


#: Which language data a script is read with, besides English: fixed values.
SCRIPTS = [(r"[\u3040-\u30ff]", "jpn"), (r"[\uac00-\ud7af]", "kor"), (r"[\u4e00-\u9fff]", "chi_sim+chi_tra"), (r"\p{IsCyrillic}", "rus"), (r"\p{IsArabic}", "ara"), (r"\p{IsGreek}", "ell"), (r"\p{IsDevanagari}", "hin"), (r"\p{IsThai}", "tha")]
OCR_PAGES, OCR_DPI = 220, 200


def reading_plan(pages: DataFrame, most: int = OCR_PAGES) -> DataFrame:
    """Pages whose pictures are to be read, with the languages to read them in and the resolution: scanned ones first, `most` a pair.

    Pages: pair_id, side, page, scanned, sample (a text of the document). What reads them is not part of this package.
    """
    from pyspark.sql import Window

    language = F.concat(F.coalesce(*[F.when(F.rlike("sample", F.lit(r)), F.lit(f"{lang}+")) for r, lang in SCRIPTS], F.lit("")), F.lit("eng"))
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("scanned"), "side", "page"))
    return pages.withColumn("_r", order).where(F.col("_r") <= most).select("pair_id", "side", "page", language.alias("languages"), F.lit(OCR_DPI).alias("dpi"))


def crop_boxes(boxes: DataFrame, pages: DataFrame, margin: float = 24.0) -> DataFrame:
    """The boxes of evidence to be shown, 24 points wider on each side, within the page. Boxes: pair_id, side, page, box."""
    b = boxes.join(pages.select("pair_id", "side", "page", "width", "height"), ["pair_id", "side", "page"])
    return b.select(*boxes.columns[:3], F.greatest(F.col("x0") - margin, F.lit(0.0)).alias("x0"), F.greatest(F.col("y0") - margin, F.lit(0.0)).alias("y0"), F.least(F.col("x1") + margin, F.col("width")).alias("x1"), F.least(F.col("y1") + margin, F.col("height")).alias("y1"))


def lines(docs: DataFrame, per_page: int = 20) -> DataFrame:
    """(pair_id, ord, page, y, text): the non-blank lines of each text, twenty to a page."""
    each = docs.select(F.col("doc_id").alias("pair_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return each.where(F.trim("text") != "").select("pair_id", "ord", F.floor(F.col("ord") / per_page).cast("int").alias("page"), (F.col("ord") % per_page).alias("y"), "text")


def edited(prod: DataFrame) -> DataFrame:
    """A candidate edition with known edits: every eleventh line or so dropped, a word misspelt in every thirteenth."""
    kept = prod.where((F.col("pair_id") * 31 + F.col("ord")) % 11 != 0)
    wrong = F.when((F.col("pair_id") + F.col("ord")) % 13 == 0, F.replace("text", F.lit(" the "), F.lit(" teh "))).otherwise(F.col("text"))
    return kept.withColumn("text", wrong)


def editions(docs: DataFrame) -> DataFrame:
    prod = lines(docs)
    return prod.withColumn("side", F.lit("prod")).unionByName(edited(prod).withColumn("side", F.lit("stage")))


def html_elements(pages: DataFrame) -> DataFrame:
    """(pair_id, tag, ord, text, href) of the headings, links, list items and bold runs of raw pages."""
    out = None
    for tag, regex, text, href in (("h1", r"(?s)<h1[^>]*>(.*?)</h1>", 1, None), ("a", r"(?s)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", 2, 1), ("li", r"(?s)<li[^>]*>(.*?)</li>", 1, None), ("b", r"(?s)<b>(.*?)</b>", 1, None)):
        texts = F.regexp_extract_all("html", F.lit(regex), F.lit(text))
        links = F.regexp_extract_all("html", F.lit(regex), F.lit(href)) if href else F.transform(texts, lambda _: F.lit(None).cast("string"))
        part = pages.select(F.col("page_id").alias("pair_id"), F.lit(tag).alias("tag"), F.posexplode(F.arrays_zip(texts.alias("text"), links.alias("href"))).alias("ord", "e"))
        part = part.select("pair_id", "tag", "ord", F.col("e.text").alias("text"), F.col("e.href").alias("href"))
        out = part if out is None else out.unionAll(part)
    return out


def part_grids(part: DataFrame, side: str) -> DataFrame:
    """(tbl, row, col, text): the parts of each size as a table of name, brand and type; the candidate lost rows and changed cells."""
    from pyspark.sql import Window

    rows = part if side == "prod" else part.where("p_partkey % 17 <> 0")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    kind = F.col("p_type") if side == "prod" else F.when(F.col("p_partkey") % 19 == 0, F.lit("changed kind")).otherwise(F.col("p_type"))
    return rows.select(F.col("p_size").alias("tbl"), "row", F.posexplode(F.array(F.col("p_name"), F.col("p_brand"), kind)).alias("col", "text"))


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of document files: what a parser turns into the relations above."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
