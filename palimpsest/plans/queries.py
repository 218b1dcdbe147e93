"""The engine's queries over the test tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import text as X
from palimpsest.operators import compare as C
from palimpsest.operators import figures as P
from palimpsest.operators import issues as I
from palimpsest.operators import ordered as O
from palimpsest.operators import sweep as S
from palimpsest.operators import tables as T
from palimpsest.sources import relations as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prod = R.lines(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return prod, R.edited(prod)


_LINES = """prod AS (
  SELECT pair_id, ord, CAST(ord // 20 AS INT) AS page, CAST(ord % 20 AS INT) AS y, text FROM (
    SELECT doc_id AS pair_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS ord FROM documents
  ) WHERE trim(text) <> ''
), stage AS (
  SELECT pair_id, ord, page, y, CASE WHEN (pair_id + ord) % 13 = 0 THEN replace(text, ' the ', ' teh ') ELSE text END AS text
  FROM prod WHERE (pair_id * 31 + ord) % 11 <> 0
)"""
_SQUASH = "regexp_replace(lower(text), '\\s+', '', 'g')"
_KEYED = f"""{_LINES}, a AS (SELECT *, {_SQUASH} AS key, row_number() OVER (PARTITION BY pair_id, {_SQUASH} ORDER BY ord) AS nth FROM prod),
b AS (SELECT *, {_SQUASH} AS key, row_number() OVER (PARTITION BY pair_id, {_SQUASH} ORDER BY ord) AS nth FROM stage)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    prod, stage = (df.withColumn("key", X.squash_title(F.col("text"))) for df in _editions(spark, sf_dir))
    return C.match_by_key(prod, stage, ["pair_id", "key"], ["ord"])


@query(f"""WITH {_KEYED}
SELECT pair_id, count(*) FILTER (WHERE a.nth IS NOT NULL AND b.nth IS NOT NULL) AS same, count(*) FILTER (WHERE b.nth IS NULL) AS missing, count(*) FILTER (WHERE a.nth IS NULL) AS added
FROM a FULL JOIN b USING (pair_id, key, nth) GROUP BY pair_id""")
def text_missing_added(spark, sf_dir):
    """Bag-true full outer match of lines, counted by pair."""
    m = _matched(spark, sf_dir)
    return m.groupBy("pair_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "missing", "added")])


@query(f"""WITH {_KEYED} SELECT pair_id, a.ord AS ord, a.page AS page, a.text AS text FROM a LEFT JOIN b USING (pair_id, key, nth)
WHERE b.nth IS NULL AND length(key) >= 14 AND NOT EXISTS (SELECT 1 FROM stage s WHERE s.pair_id = a.pair_id AND s.page BETWEEN a.page - 1 AND a.page + 1 AND contains({_SQUASH.replace("text", "s.text")}, key))""")
def text_missing_not_near(spark, sf_dir):
    """Missing lines whose key is on no page of the candidate nearby."""
    missing = _matched(spark, sf_dir).where("status = 'missing'").select("pair_id", "key", F.col("prod.ord").alias("ord"), F.col("prod.page").alias("page"), F.col("prod.text").alias("text")).where(F.length("key") >= 14)
    _, stage = _editions(spark, sf_dir)
    near = C.present_near(missing, stage.select("pair_id", "page", X.squash_title(F.col("text")).alias("blob")), "key")
    return missing.join(near.select("pair_id", "ord"), ["pair_id", "ord"], "left_anti").select("pair_id", "ord", "page", "text")


@query()
def text_aligned(spark, sf_dir):
    """Order-true alignment of each pair's lines (no SQL form; tested against its definition)."""
    prod, stage = _editions(spark, sf_dir)
    rows = prod.withColumn("side", F.lit("prod")).unionByName(stage.withColumn("side", F.lit("stage"))).select("pair_id", "side", F.col("ord").cast("long").alias("ord"), X.squash_title(F.col("text")).alias("key"))
    return C.aligned(rows, ["pair_id"])


@query()
def text_word_diff(spark, sf_dir):
    """Word diffs of the changed lines at the same place."""
    prod, stage = _editions(spark, sf_dir)
    both = prod.select("pair_id", "ord", F.col("text").alias("a")).join(stage.select("pair_id", "ord", F.col("text").alias("b")), ["pair_id", "ord"]).where("a <> b")
    return both.select("pair_id", "ord", C.word_diff(X.diff_tokens(F.col("a")), X.diff_tokens(F.col("b"))).alias("ops"))


@query("""SELECT doc_id, translate(translate(text, '٠١٢٣٤٥٦٧٨٩０１２３４５６７８９', '01234567890123456789'), '，；：（）／％＆', ',;:()/%&') AS folded, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS title,
regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS blob FROM documents""")
def text_folded(spark, sf_dir):
    """Digits and widths folded, titles, blobs."""
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", X.fold_width(X.fold_digits(t)).alias("folded"), X.normalize_title(t).alias("title"), X.ascii_blob(t).alias("blob"))


@query()
def text_keys(spark, sf_dir):
    """Normal forms that need look-around or Unicode decomposition."""
    t = F.col("text")
    return R.lines(_t(spark, sf_dir, "documents")).select("pair_id", "ord", X.normalize_block_text(t).alias("block"), X.compare_key(t).alias("compare"), X.align_key(t).alias("align"), X.unicode_blob(t).alias("blob"), X.normalize_word(t).alias("word"))


@query(f"""WITH {_LINES} SELECT pair_id, ord, regexp_matches(text, '^[\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}\\p{{M}}]') AS low, regexp_matches(text, '[.!?。:;]\\s*(?:["''’”)\\]]\\s*)?$') AS done,
len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0)) BETWEEN 1 AND 5 AND NOT regexp_matches(text, '[.!?。:;]\\s*(?:["''’”)\\]]\\s*)?$') AS caption,
regexp_matches(text, '\\S.*[\\s.]\\d{{1,4}}$') AS index_line FROM prod""")
def text_predicates(spark, sf_dir):
    """How lines start and end, captions, index lines."""
    t = F.col("text")
    return R.lines(_t(spark, sf_dir, "documents")).select("pair_id", "ord", X.starts_lower_or_caseless(t).alias("low"), X.ends_with_terminator(t).alias("done"), X.is_caption_like(t).alias("caption"), X.is_index_line(t).alias("index_line"))


@query()
def text_sentences(spark, sf_dir):
    """Sentences with their place in the text."""
    each = R.lines(_t(spark, sf_dir, "documents"))
    return each.select("pair_id", "ord", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("""SELECT o_orderkey, nullif(upper(regexp_extract(s, '(?i)^\\s*(note|tip|warning|caution)\\s*:', 1)), '') AS label,
regexp_replace(s, '(?i)^\\s*(?:note|tip|warning|caution)\\s*:\\s*', '') AS bare, regexp_replace(s, '(?i)\\s*(?:\\bsee\\s+)?\\bpage\\s*\\d{1,4}\\b', '', 'g') AS without_pages
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Note: ' WHEN 1 THEN 'WARNING : ' WHEN 2 THEN '' ELSE 'tip' END || o_orderpriority || ' see page ' || (o_orderkey % 1000) || '.' AS s FROM orders)""")
def text_callouts_and_references(spark, sf_dir):
    """Callout labels and page references."""
    k = F.col("o_orderkey")
    lead = F.when(k % 4 == 0, "Note: ").when(k % 4 == 1, "WARNING : ").when(k % 4 == 2, "").otherwise("tip")
    s = F.concat(lead, F.col("o_orderpriority"), F.lit(" see page "), (k % 1000).cast("string"), F.lit("."))
    return _t(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", X.callout_label(F.col("s")).alias("label"), X.strip_callout_label(F.col("s")).alias("bare"), X.strip_page_references(F.col("s")).alias("without_pages"))


_STOPS, _COMMON = (", ".join(f"'{w}'" for w in words) for words in (X.STOP_WORDS, X.COMMON_WORDS))


@query(f"""SELECT doc_id, len(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({_COMMON}) AND NOT regexp_matches(x, '^[0-9]+$'))) AS content, len(list_filter(list_distinct(w), lambda x: length(x) >= 3 AND x NOT IN ({_STOPS}))) AS significant
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)""")
def text_words(spark, sf_dir):
    """Content words and distinct significant words."""
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(X.content_words(t)).cast("long").alias("content"), F.size(X.significant_words(t)).cast("long").alias("significant"))


@query("""SELECT p_partkey, list_transform(regexp_extract_all(p_name || ' ' || p_type, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS tokens, regexp_replace(regexp_replace('ABCDEF+' || p_brand || '-BoldItalic', '^[A-Z]{6}\\+', ''), '(?i)[-,](?:Bold|Italic|Oblique|Regular)+$', '') AS family,
CAST(nullif(regexp_extract(p_size || '.5 pt', '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS size FROM part""")
def text_cells_and_fonts(spark, sf_dir):
    """Cell tokens, font families and sizes."""
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        X.cell_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"),
        X.font_family(F.concat(F.lit("ABCDEF+"), "p_brand", F.lit("-BoldItalic"))).alias("family"),
        X.size_pt(F.concat(F.col("p_size").cast("string"), F.lit(".5 pt"))).alias("size"),
    )


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*:(?://)?', ''), '[/.]+$', '') AS authority FROM pages""")
def link_authorities(spark, sf_dir):
    """N22, CH21: addresses without scheme, case and trailing slash."""
    return _t(spark, sf_dir, "pages").select("page_id", X.uri_authority(F.col("url")).alias("authority"))


_RGB = "SELECT p_partkey, c, ((c >> 16) & 255) / 255.0 AS r, ((c >> 8) & 255) / 255.0 AS g, (c & 255) / 255.0 AS b FROM (SELECT p_partkey, CAST((p_partkey * 7919) % 16777216 AS BIGINT) AS c FROM part)"


@query(f"""SELECT p_partkey, 0.299 * r + 0.587 * g + 0.114 * b > 0.35 OR greatest(r, g, b) - least(r, g, b) >= 0.2 AS linkish, '#' || lower(lpad(printf('%x', c), 6, '0')) AS hex,
CAST(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS DOUBLE) AS saturation FROM ({_RGB})""")
def link_colours(spark, sf_dir):
    """Link colours, saturation, hex."""
    c = (F.col("p_partkey") * 7919) % 16777216
    return _t(spark, sf_dir, "part").select("p_partkey", X.looks_like_link_colour(c).alias("linkish"), X.hex_colour(c).alias("hex"), X.saturation(c).alias("saturation"))


@query("""SELECT n_nationkey, m, CASE WHEN regexp_matches(k, '^[0-9]{1,3}$') THEN 'number' WHEN k IN ('ii','iii','iv','vi','vii','viii','ix','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx') THEN 'roman' WHEN regexp_matches(k, '^[a-z]$') THEN 'letter' ELSE 'bullet' END AS kind
FROM (SELECT n_nationkey, m, regexp_replace(lower(trim(m)), '^\\(|\\s*[.)]$', '', 'g') AS k FROM (
SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN n_nationkey || '.' WHEN 1 THEN '(a)' WHEN 2 THEN 'iv)' WHEN 3 THEN '•' WHEN 4 THEN 'B .' ELSE n_name END AS m FROM nation))""")
def marker_kinds(spark, sf_dir):
    """Numbers, romans, letters and bullets."""
    k = F.col("n_nationkey")
    m = F.when(k % 6 == 0, F.concat(k.cast("string"), F.lit("."))).when(k % 6 == 1, "(a)").when(k % 6 == 2, "iv)").when(k % 6 == 3, "•").when(k % 6 == 4, "B .").otherwise(F.col("n_name"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", m.alias("m")).select("n_nationkey", "m", X.marker_kind(F.col("m")).alias("kind"))


@query("""SELECT artifact, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{fffd}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\(cid:\\s?[0-9]+\\)|#')) AS artifact FROM
(SELECT doc_id, replace(text, ' ed ', ' (cid:12) ') AS text FROM documents)) WHERE artifact <> '#' GROUP BY artifact""")
def encoding_artifacts(spark, sf_dir):
    """Artefacts by kind, and how many documents have them."""
    planted = _t(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(" ed "), F.lit(" (cid:12) ")))
    return planted.select("doc_id", F.explode(X.encoding_artifacts(F.col("text"))).alias("artifact")).groupBy("artifact").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_BOXES = "SELECT l_orderkey AS pair_id, l_linenumber AS n, l_quantity AS x0, l_discount * 1000 AS y0, l_quantity + l_suppkey % 50 AS x1, l_discount * 1000 + l_tax * 1000 AS y1 FROM lineitem"


def _boxes(spark, sf_dir):
    b = G.box(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_quantity") + F.col("l_suppkey") % 50, F.col("l_discount") * 1000 + F.col("l_tax") * 1000)
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("n"), b.alias("b"))


@query(f"""WITH x AS ({_BOXES}) SELECT a.pair_id, a.n AS n, b.n AS m, round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS share
FROM x a JOIN x b ON a.pair_id = b.pair_id AND a.n < b.n WHERE (a.x1 - a.x0) * (a.y1 - a.y0) > 0 AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0""")
def box_overlaps(spark, sf_dir):
    """A spatial join of a pair's boxes by shared area."""
    met = C.touching_pairs(_boxes(spark, sf_dir).where(G.area(F.col("b")) >= 0), ["pair_id"], "n")
    x, y = F.col("a.b"), F.col("b.b")
    return met.where((G.shared(x, y) > 0) & (G.area(x) > 0)).select("pair_id", F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.round(G.overlap_fraction(x, y), 6).alias("share"))


@query(f"""WITH {_LINES}, l AS (SELECT *, regexp_matches(text, '[.!?:;]\\s*$') AS done, regexp_matches(text, '^[\\p{{Ll}}]') AS low FROM prod),
g AS (SELECT *, sum(CASE WHEN coalesce(NOT pd AND low, false) THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY ord) AS island FROM (SELECT *, lag(done) OVER (PARTITION BY pair_id ORDER BY ord) AS pd FROM l))
SELECT pair_id, island, min(ord) AS ord, count(*) AS n_lines FROM g GROUP BY pair_id, island""")
def paragraphs_merged(spark, sf_dir):
    """L3, L4: wrapped lines joined to paragraphs (islands)."""
    t = F.col("text")
    merged = O.merge_wrapped(R.lines(_t(spark, sf_dir, "documents")), F.rlike(t, F.lit(r"[.!?:;]\s*$")), F.rlike(t, F.lit(r"^[\p{Ll}]")))
    return merged.select("pair_id", "island", "ord", "n_lines")


_FOOTED = f"""{_LINES}, footed AS (SELECT pair_id, page, CAST(36 * y + 90 AS DOUBLE) AS y0, CAST(36 * y + 102 AS DOUBLE) AS y1, text, 1 AS n_lines FROM prod UNION ALL SELECT DISTINCT pair_id, page, 850.0, 862.0, 'Manual ' || (pair_id % 7) || ' - ' || page, 1 FROM prod UNION ALL SELECT DISTINCT pair_id, page, 20.0, 32.0, CAST(page + 1 AS VARCHAR), 1 FROM prod)"""


@query(f"""WITH {_FOOTED}, b AS (SELECT *, CASE WHEN y1 <= 0.12 * 900 THEN 'top' WHEN y0 >= 0.88 * 900 THEN 'foot' END AS band, trim(regexp_replace(lower(regexp_replace(text, '[0-9]+', '#', 'g')), '\\s+', ' ', 'g')) AS key, (n_lines <= 3 OR y1 - y0 <= 22) AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0)) <= 16 AND NOT regexp_matches(text, '[.!?:;]\\s*$') AS short FROM footed),
n AS (SELECT pair_id, band, key, count(DISTINCT page) AS pages FROM b WHERE band IS NOT NULL AND short GROUP BY ALL) SELECT b.pair_id, b.page, b.y0, b.text, CASE WHEN regexp_matches(trim(text), '^(?:[-–]\\s*)?(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})(?:\\s*[-–])?$') THEN 'page number' WHEN pages >= 3 THEN 'running' WHEN b.y0 >= 0.94 * 900 THEN 'foot' END AS why FROM b LEFT JOIN n USING (pair_id, band, key)
WHERE b.band IS NOT NULL AND short AND (regexp_matches(trim(text), '^(?:[-–]\\s*)?(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})(?:\\s*[-–])?$') OR pages >= 3 OR b.y0 >= 0.94 * 900)""")
def running_lines(spark, sf_dir):
    """L1: page numbers and lines that run through the pages' heads and feet."""
    lines = R.lines(_t(spark, sf_dir, "documents"))
    k = F.col("pair_id")
    body = lines.select("pair_id", "page", (36.0 * F.col("y") + 90).alias("y0"), (36.0 * F.col("y") + 102).alias("y1"), "text")
    pages = lines.select("pair_id", "page").distinct()
    foot = pages.select("pair_id", "page", F.lit(850.0).alias("y0"), F.lit(862.0).alias("y1"), F.concat(F.lit("Manual "), (k % 7).cast("string"), F.lit(" - "), F.col("page").cast("string")).alias("text"))
    head = pages.select("pair_id", "page", F.lit(20.0).alias("y0"), F.lit(32.0).alias("y1"), (F.col("page") + 1).cast("string").alias("text"))
    found = O.running_lines(body.unionByName(foot).unionByName(head).withColumn("n_lines", F.lit(1)).withColumn("height", F.lit(900.0)), ["pair_id"])
    return found.where("why is not null").select("pair_id", "page", "y0", "text", "why")


@query("""WITH b AS (SELECT l_orderkey AS pair_id, floor(l_quantity / 5) * 5 AS bin, l_quantity AS x FROM lineitem),
n AS (SELECT pair_id, bin, count(*) AS n, avg(x) AS margin FROM b GROUP BY pair_id, bin)
SELECT pair_id, round(margin, 6) AS margin, n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, bin) AS r FROM n) WHERE r = 1""")
def content_margins(spark, sf_dir):
    """The mean of the fullest five-point bin (ties to the smaller)."""
    x = F.col("l_quantity")
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), (F.floor(x / 5) * 5).alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("margin"))
    best = n.groupBy("pair_id").agg(F.max_by(F.struct("margin", "n"), F.struct(F.col("n"), -F.col("bin"))).alias("m"))
    return best.select("pair_id", F.round("m.margin", 6).alias("margin"), F.col("m.n").alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS pair_id, l_returnflag AS font, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
SELECT pair_id, font, weight, round(weight / sum(weight) OVER (PARTITION BY pair_id), 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY weight DESC, font) = 1""")
def dominant_styles(spark, sf_dir):
    """The style that carries most characters, and its share."""
    s = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_returnflag").alias("font")).agg(F.sum("l_quantity").alias("weight"))
    whole = s.groupBy("pair_id").agg(F.sum("weight").alias("all"), F.min(F.struct((-F.col("weight")).alias("w"), "font")).alias("top"))
    return whole.select("pair_id", F.col("top.font").alias("font"), (-F.col("top.w")).alias("weight"), F.round(-F.col("top.w") / F.col("all"), 6).alias("share"))


_HEADS = f"""{_LINES}, heads AS (SELECT pair_id, ord, page, y, text AS title FROM prod WHERE ord % 7 = 0 OR length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.!?:;]\\s*$'))"""


def _heads(lines: DataFrame) -> DataFrame:
    # Every seventh line stands for one that is set as a heading.
    return lines.where((F.col("ord") % 7 == 0) | (F.length("text").between(3, 90) & ~F.rlike("text", F.lit(r"[.!?:;]\s*$")))).select("pair_id", "ord", "page", "y", F.col("text").alias("title"))


@query(f"""WITH {_HEADS} SELECT pair_id, ord, page, y, title, lead(page) OVER w AS end_page, lead(y) OVER w AS end_y FROM heads WINDOW w AS (PARTITION BY pair_id ORDER BY page, y, ord)""")
def section_bounds(spark, sf_dir):
    """H9, H3: heading candidates and where their sections end."""
    return O.section_bounds(_heads(R.lines(_t(spark, sf_dir, "documents"))), ["pair_id"])


@query(f"""WITH {_HEADS} SELECT p.pair_id, p.ord AS ord, h.title AS title FROM prod p ASOF LEFT JOIN heads h ON p.pair_id = h.pair_id AND p.ord >= h.ord""")
def heading_at(spark, sf_dir):
    """The heading above every line, as-of."""
    lines = R.lines(_t(spark, sf_dir, "documents"))
    return O.last_before(lines, _heads(lines), ["pair_id"], ["page", "y"], "title").select("pair_id", "ord", "title")


@query(f"""WITH {_HEADS}, s AS (SELECT pair_id, ord AS section, ord, lead(ord) OVER (PARTITION BY pair_id ORDER BY ord) AS until FROM heads)
SELECT p.pair_id, s.section, count(*) AS n_lines, CAST(sum(length(p.text)) AS BIGINT) AS n_chars FROM prod p JOIN s ON p.pair_id = s.pair_id AND p.ord >= s.ord AND (s.until IS NULL OR p.ord < s.until) GROUP BY p.pair_id, s.section""")
def section_contents(spark, sf_dir):
    """Lines by the section that holds them (range join)."""
    lines = R.lines(_t(spark, sf_dir, "documents"))
    sections = O.section_bounds(_heads(lines), ["pair_id"])
    found = O.in_section(lines, sections, ["pair_id"])
    return found.groupBy("pair_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {_LINES}, h AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS title FROM prod WHERE length(text) BETWEEN 3 AND 90), k AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS title FROM stage WHERE length(text) BETWEEN 3 AND 90),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, title ORDER BY ord) AS nth FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, title ORDER BY ord) AS nth FROM k)
SELECT pair_id, title, CASE WHEN b.nth IS NULL THEN 'Missing' WHEN a.nth IS NULL THEN 'Extra' WHEN a.page <> b.page THEN 'Changed' ELSE 'Matched' END AS status, b.page - a.page AS page_delta FROM a FULL JOIN b USING (pair_id, title, nth)""")
def toc_report(spark, sf_dir):
    """Headings matched, missing, extra, moved."""
    sides = [df.where(F.length("text").between(3, 90)).withColumn("title", X.normalize_title(F.col("text"))) for df in _editions(spark, sf_dir)]
    m = C.match_by_key(*sides, ["pair_id", "title"], ["ord"])
    delta = F.col("stage.page") - F.col("prod.page")
    status = F.when(F.col("status") == "missing", "Missing").when(F.col("status") == "added", "Extra").when(delta != 0, "Changed").otherwise("Matched")
    return m.select("pair_id", "title", status.alias("status"), delta.alias("page_delta"))


@query(f"""WITH {_LINES}, p AS (SELECT pair_id, page FROM prod GROUP BY ALL), s AS (SELECT pair_id, page FROM stage GROUP BY ALL)
SELECT pair_id, count(p.page) AS prod_pages, count(s.page) AS stage_pages, count(*) FILTER (WHERE s.pair_id IS NULL) AS missing FROM p LEFT JOIN s USING (pair_id, page) GROUP BY pair_id""".replace("count(s.page) AS stage_pages, count(*) FILTER (WHERE s.pair_id IS NULL)", "count(s.page) AS stage_pages, count(*) - count(s.page)"))
def page_counts(spark, sf_dir):
    """Pages of either side and those that are gone."""
    p, s = (df.select("pair_id", "page").distinct() for df in _editions(spark, sf_dir))
    return p.join(s.withColumn("there", F.lit(1)), ["pair_id", "page"], "left").groupBy("pair_id").agg(F.count("*").alias("prod_pages"), F.count("there").alias("stage_pages"), (F.count("*") - F.count("there")).alias("missing"))


_GRIDS = """p AS (SELECT p_partkey, p_size AS tbl, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS row, [p_name, p_brand, p_type] AS cells FROM part),
s AS (SELECT p_partkey, p_size AS tbl, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS row, [p_name, p_brand, CASE WHEN p_partkey % 19 = 0 THEN 'changed kind' ELSE p_type END] AS cells FROM part WHERE p_partkey % 17 <> 0),
pc AS (SELECT tbl, row, unnest(cells) AS text, unnest([0, 1, 2]) AS col FROM p), sc AS (SELECT tbl, row, unnest(cells) AS text, unnest([0, 1, 2]) AS col FROM s),
pt AS (SELECT tbl, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS token FROM pc), st AS (SELECT tbl, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS token FROM sc)"""


def _grids(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    return R.part_grids(part, "prod"), R.part_grids(part, "stage")


def _tokens(grid: DataFrame, *keys: str) -> DataFrame:
    return grid.select(*keys, F.explode(X.cell_tokens(F.col("text"))).alias("token"))


@query(f"""WITH {_GRIDS}, a AS (SELECT tbl, token, count(*) AS n FROM pt GROUP BY ALL), b AS (SELECT tbl, token, count(*) AS m FROM st GROUP BY ALL)
SELECT coalesce(a.tbl, b.tbl) AS tbl, coalesce(a.token, b.token) AS token, greatest(coalesce(n, 0) - coalesce(m, 0), 0) AS lost, greatest(coalesce(m, 0) - coalesce(n, 0), 0) AS gained FROM a FULL JOIN b ON a.tbl = b.tbl AND a.token = b.token WHERE coalesce(n, 0) <> coalesce(m, 0)""")
def table_words_lost(spark, sf_dir):
    """T7, T12, T13, R4, B3, CH18, CH23: words of each table that one side has more often (bag difference)."""
    p, s = _grids(spark, sf_dir)
    return C.bag_difference(_tokens(p, "tbl"), _tokens(s, "tbl"), ["tbl", "token"])


@query(f"""WITH {_GRIDS}, a AS (SELECT tbl % 10 AS pair_id, tbl, token, count(*) AS n FROM pt GROUP BY ALL), b AS (SELECT tbl % 10 AS pair_id, tbl, token, count(*) AS m FROM st GROUP BY ALL), ta AS (SELECT tbl, sum(n) AS total FROM a GROUP BY ALL), tb AS (SELECT tbl, sum(m) AS total FROM b GROUP BY ALL)
SELECT a.pair_id, a.tbl AS prod_tbl, b.tbl AS stage_tbl, round(sum(least(n, m)) / greatest(max(ta.total), max(tb.total)), 6) AS similarity FROM a JOIN b USING (pair_id, token) JOIN ta ON ta.tbl = a.tbl JOIN tb ON tb.tbl = b.tbl GROUP BY a.pair_id, a.tbl, b.tbl""")
def table_similarities(spark, sf_dir):
    """How alike two tables' bags of words are, within a pair of documents."""
    p, s = (_tokens(g, "tbl").withColumn("pair_id", F.col("tbl") % 10) for g in _grids(spark, sf_dir))
    sim = C.bag_similarity(p.withColumnRenamed("tbl", "prod_tbl"), s.withColumnRenamed("tbl", "stage_tbl"), ["pair_id", "prod_tbl"], ["pair_id", "stage_tbl"], "token")
    return sim.select("pair_id", "prod_tbl", "stage_tbl", F.round("similarity", 6).alias("similarity"))


@query()
def tables_matched(spark, sf_dir):
    """One-to-one tables of a pair, by words and then by place (greedy order has no SQL form; tested against brute force)."""
    sim = table_similarities(spark, sf_dir).select("pair_id", F.lit(0).alias("section"), F.col("prod_tbl").alias("prod"), F.col("stage_tbl").alias("stage"), "similarity")
    sides = [g.groupBy("tbl").agg((F.max("col") + 1 + F.col("tbl") % 2).alias("n_cols"), F.count("*").alias("n")).select((F.col("tbl") % 10).alias("pair_id"), F.lit(0).alias("section"), F.lit(side).alias("side"), "tbl", "n_cols", (F.col("tbl") % 4).alias("page"), F.col("n").cast("double").alias("y")) for side, g in zip(("prod", "stage"), _grids(spark, sf_dir), strict=True)]
    return T.matched_tables(sim, sides[0].unionByName(sides[1]))


_ROWS = "r1 AS (SELECT tbl, row, lower(cells[1]) AS key, row_number() OVER (PARTITION BY tbl, lower(cells[1]) ORDER BY row) AS nth, cells FROM p), r2 AS (SELECT tbl, row, lower(cells[1]) AS key, row_number() OVER (PARTITION BY tbl, lower(cells[1]) ORDER BY row) AS nth, cells FROM s)"


@query(f"""WITH {_GRIDS}, {_ROWS} SELECT tbl, key, CASE WHEN r2.nth IS NULL THEN 'missing' WHEN r1.nth IS NULL THEN 'added' WHEN r1.cells <> r2.cells THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM r1 FULL JOIN r2 USING (tbl, key, nth) GROUP BY ALL""")
def table_rows_matched(spark, sf_dir):
    """Rows matched by first cell and occurrence, changed where a cell differs."""
    sides = []
    for g in _grids(spark, sf_dir):
        rows = g.groupBy("tbl", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))
        sides.append(rows.withColumn("key", F.lower(F.get("cells", 0))))
    m = C.match_by_key(*sides, ["tbl", "key"], ["row"])
    status = F.when((F.col("status") == "same") & (F.col("prod.cells") != F.col("stage.cells")), "changed").otherwise(F.col("status"))
    return m.groupBy("tbl", "key", status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_size AS tbl, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS row FROM part), f AS (SELECT tbl, row // 27 AS page, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN page = prev + 1 AND before = 27 THEN 0 ELSE 1 END) OVER (PARTITION BY tbl ORDER BY page) AS stitched FROM (SELECT *, lag(page) OVER w AS prev, lag(n) OVER w AS before FROM f WINDOW w AS (PARTITION BY tbl ORDER BY page)))
SELECT tbl, stitched, min(page) AS first_page, count(*) AS fragments, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY tbl, stitched""")
def tables_stitched(spark, sf_dir):
    """Fragments of 27 rows that go on on the next page become one table."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").alias("tbl"), F.floor((F.row_number().over(w) - 1) / 27).alias("page"))
    parts = rows.groupBy("tbl", "page").agg(F.count("*").alias("n"))
    o = Window.partitionBy("tbl").orderBy("page")
    whole = O.islands(parts, ["tbl"], ["page"], (F.col("page") == F.lag("page").over(o) + 1) & (F.lag("n").over(o) == 27), "stitched")
    return whole.groupBy("tbl", "stitched").agg(F.min("page").alias("first_page"), F.count("*").alias("fragments"), F.sum("n").alias("n_rows"))


@query(f"""WITH {_GRIDS}, a AS (SELECT tbl, count(DISTINCT row) AS n FROM pc GROUP BY ALL), b AS (SELECT tbl, count(DISTINCT row) AS m FROM sc WHERE tbl % 9 <> 0 GROUP BY ALL)
SELECT tbl, n AS prod_rows, m AS stage_rows, CASE WHEN m IS NULL THEN 'Missing' WHEN n IS NULL THEN 'Stage only' WHEN n > m THEN 'Rows missing' ELSE 'OK' END AS status FROM a FULL JOIN b USING (tbl)""")
def table_summary(spark, sf_dir):
    """A row for each table of either side."""
    p, s = _grids(spark, sf_dir)
    n = p.groupBy("tbl").agg(F.countDistinct("row").alias("prod_rows"))
    m = s.where("tbl % 9 <> 0").groupBy("tbl").agg(F.countDistinct("row").alias("stage_rows"))
    status = F.when(F.col("stage_rows").isNull(), "Missing").when(F.col("prod_rows").isNull(), "Stage only").when(F.col("prod_rows") > F.col("stage_rows"), "Rows missing").otherwise("OK")
    return n.join(m, "tbl", "full_outer").withColumn("status", status)


@query("""WITH c AS (SELECT s_suppkey AS tbl, n_nationkey AS row, n_regionkey AS col, n_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey), e AS (SELECT tbl, min(col) AS lo, max(col) AS hi FROM c WHERE trim(text) <> '' AND col > 0 GROUP BY tbl)
SELECT c.tbl, row, col - lo AS col, lower(text) AS text FROM c JOIN e USING (tbl) WHERE col BETWEEN lo AND hi""")
def grid_edges_trimmed(spark, sf_dir):
    """Blank edge columns trimmed off."""
    c = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("tbl"), F.col("n_nationkey").alias("row"), F.col("n_regionkey").alias("col"), F.col("n_name").alias("text"))
    e = c.where("trim(text) <> '' and col > 0").groupBy("tbl").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    return c.join(e, "tbl").where("col between lo and hi").select("tbl", "row", (F.col("col") - F.col("lo")).alias("col"), F.lower("text").alias("text"))


_VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_FIG_VEC = "SELECT vec_id, CAST(floor(vec_id / 40) AS BIGINT) AS pair_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _figures(spark, sf_dir):
    """Figures with a fingerprint: the thumbnail of standard length, a bit for each positive component."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    bits = F.aggregate(F.sequence(F.lit(0), F.least(F.size("v"), F.lit(64)) - 1), F.lit(0).cast("long"), lambda h, k: h.bitwiseOR(F.when(F.get("v", k) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))))
    raw = _t(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("pair_id"), F.col("label").alias("section"), v.alias("v")).withColumn("_n", norm)
    return raw.select("vec_id", "pair_id", "section", "v", F.struct(bits.alias("dhash"), F.transform("v", lambda x: x / F.col("_n") * F.sqrt(F.size("v").cast("double"))).alias("thumb")).alias("f"))


def _similar(spark, sf_dir, stage_section):
    f = _figures(spark, sf_dir)
    p = f.where("vec_id % 2 = 0").select("pair_id", "section", F.col("vec_id").alias("prod"), F.col("f").alias("a"))
    s = f.where("vec_id % 2 = 1").select("pair_id", stage_section.alias("section"), F.col("vec_id").alias("stage"), F.col("f").alias("b"))
    return p.join(s, ["pair_id", "section"]).select("pair_id", "section", "prod", "stage", P.similarity(F.col("a"), F.col("b")).alias("score"))


@query(f"""WITH e AS ({_FIG_VEC}), p AS (SELECT * FROM e WHERE vec_id % 2 = 0), s AS (SELECT * FROM e WHERE vec_id % 2 = 1), j AS (SELECT p.pair_id, p.label AS section, p.vec_id AS prod, s.vec_id AS stage, p.v AS a, s.v AS b FROM p JOIN s ON p.pair_id = s.pair_id AND p.label = s.label)
SELECT pair_id, section, prod, stage, round(0.55 * (1 - len(list_filter(list_zip(a, b), lambda x: (x[1] > 0) <> (x[2] > 0))) / 64.0) + 0.45 * greatest(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 0), 5) AS similarity FROM j""")
def figure_similarities(spark, sf_dir):
    """Figures of one section by their hashes and the correlation of their thumbnails."""
    return _similar(spark, sf_dir, F.col("section")).select("pair_id", "section", "prod", "stage", F.round("score", 5).alias("similarity"))


@query()
def figures_matched(spark, sf_dir):
    """One-to-one figures of a section, then of the next one (greedy order has no SQL form; the steps are tested against their definition)."""
    direct, spilled = _similar(spark, sf_dir, F.col("section")), _similar(spark, sf_dir, F.col("section") - 1)
    unions = direct.where(F.lit(False)).withColumn("second", F.lit(None).cast("long")).withColumn("area_ratio", F.lit(1.0))
    slid = direct.withColumn("slide", F.col("score"))
    return P.matched_in_steps(direct, unions, slid, spilled).withColumnRenamed("stage", "stage_id").withColumnRenamed("prod", "prod_id")


@query(f"""WITH e AS ({_VEC}), m AS (SELECT *, list_avg(v) AS mean FROM e) SELECT label AS section, count(*) AS figures, count(*) FILTER (WHERE sqrt(list_avg(list_transform(v, lambda x: x * x)) - mean * mean) < 0.1) AS featureless FROM m GROUP BY label""")
def figure_summary(spark, sf_dir):
    """Figures of each section and how many show nothing (standard deviation)."""
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) / F.size("v")
    f = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("section"), F.col("embedding").cast("array<double>").alias("v")).select("section", F.sqrt(square - mean * mean).alias("sd"))
    return f.groupBy("section").agg(F.count("*").alias("figures"), F.count_if(F.col("sd") < 0.1).alias("featureless"))


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, text, min(ord) AS ord FROM prod GROUP BY pair_id, text HAVING count(*) = 1), b AS (SELECT pair_id, text, min(ord) AS ord FROM stage GROUP BY pair_id, text HAVING count(*) = 1)
SELECT pair_id, a.ord AS prod_ord, b.ord AS stage_ord FROM a JOIN b USING (pair_id, text)""")
def unique_pairs(spark, sf_dir):
    """A1: blocks paired by texts that stand once on either side."""
    a, b = (df.groupBy("pair_id", "text").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).where("n = 1").select("pair_id", "text", F.col("ord").alias(name)) for df, name in zip(_editions(spark, sf_dir), ("prod_ord", "stage_ord"), strict=True))
    return a.join(b, ["pair_id", "text"]).select("pair_id", "prod_ord", "stage_ord")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type AS kind FROM events), g AS (SELECT *, sum(CASE WHEN kind = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e))
SELECT user_id, run, kind, count(*) AS n FROM g GROUP BY ALL""")
def marker_runs(spark, sf_dir):
    """A3, B9, CH6: adjacent items of one kind as runs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("kind"))
    return O.islands(e, ["user_id"], ["ts", "event_id"], F.col("kind") == F.lag("kind").over(w), "run").groupBy("user_id", "run", "kind").agg(F.count("*").alias("n"))


@query("""SELECT page_id AS pair_id, 'a' AS tag, unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    """The links of raw pages."""
    return R.html_elements(_t(spark, sf_dir, "pages")).where("tag = 'a'").select("pair_id", "tag", "href")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages), k AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*:(?://)?', ''), '[/.]+$', '') AS authority FROM pages)
SELECT page_id, href, CASE WHEN trim(href) = '' THEN 'empty' WHEN NOT regexp_matches(href, '^(?i)(https?://|mailto:|tel:|/|#)') THEN 'unusable' WHEN regexp_replace(regexp_replace(lower(trim(href)), '^[a-z][a-z0-9+.-]*:(?://)?', ''), '[/.]+$', '') IN (SELECT authority FROM k) THEN 'known' ELSE 'unknown' END AS status FROM l""".replace("^(?i)(", "(?i)^("))
def link_checks(spark, sf_dir):
    """K1: links that are empty, of no usable scheme, or lead to an address that is (not) among the known ones."""
    links = R.html_elements(_t(spark, sf_dir, "pages")).where("tag = 'a'").select(F.col("pair_id").alias("page_id"), "href").withColumn("authority", X.uri_authority(F.col("href")))
    known = _t(spark, sf_dir, "pages").select(X.uri_authority(F.col("url")).alias("authority")).distinct().withColumn("known", F.lit(True))
    status = F.when(F.trim("href") == "", "empty").when(~F.rlike("href", F.lit("(?i)^(https?://|mailto:|tel:|/|#)")), "unusable").when(F.col("known"), "known").otherwise("unknown")
    return links.join(known, "authority", "left").select("page_id", "href", status.alias("status"))


@query("""SELECT 'prod' AS only_in, font FROM (SELECT DISTINCT p_brand || '-' || (p_partkey % 7) AS font FROM part WHERE p_size < 25 EXCEPT SELECT DISTINCT p_brand || '-' || (p_partkey % 5) FROM part WHERE p_size >= 25)
UNION ALL SELECT 'stage', font FROM (SELECT DISTINCT p_brand || '-' || (p_partkey % 5) AS font FROM part WHERE p_size >= 25 EXCEPT SELECT DISTINCT p_brand || '-' || (p_partkey % 7) FROM part WHERE p_size < 25)""")
def font_changes(spark, sf_dir):
    """Fonts that only one side uses (EXCEPT both ways)."""
    p = _t(spark, sf_dir, "part")
    font = lambda n: F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % n).cast("string")).alias("font")
    return S.font_changes(p.where("p_size < 25").select(font(7)), p.where("p_size >= 25").select(font(5)), [])


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, page, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{3,}}')) AS word FROM prod), b AS (SELECT pair_id, page, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{3,}}')) AS word FROM stage),
n AS (SELECT pair_id, page, word, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT pair_id, q AS page, word, count(*) AS m FROM (SELECT pair_id, word, unnest([page - 1, page, page + 1]) AS q FROM b) GROUP BY ALL)
SELECT n.pair_id, n.page, n.word, n - coalesce(m, 0) AS only_here FROM n LEFT JOIN m USING (pair_id, page, word) WHERE n > coalesce(m, 0)""")
def words_only_here(spark, sf_dir):
    """Words of a page that the facing page and its neighbours hold less often."""
    a, b = (df.select("pair_id", "page", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))).alias("word")) for df in _editions(spark, sf_dir))
    n = a.groupBy("pair_id", "page", "word").agg(F.count("*").alias("n"))
    # Counted before it is spread over the neighbours.
    m = b.groupBy("pair_id", "page", "word").agg(F.count("*").alias("m")).select("pair_id", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"), "word", "m").groupBy("pair_id", "page", "word").agg(F.sum("m").alias("m"))
    here = F.col("n") - F.coalesce("m", F.lit(0))
    return n.join(m, ["pair_id", "page", "word"], "left").where(here > 0).select("pair_id", "page", "word", here.alias("only_here"))


_ISSUES = """SELECT o_orderkey AS id, o_custkey AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN o_orderkey % 5 = 0 THEN 'review' ELSE 'confirmed' END AS confidence,
CAST(o_orderkey % 40 AS INT) AS page, 'section ' || (o_orderkey % 7) AS section, CASE o_orderkey % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'tables' WHEN 2 THEN 'links' ELSE 'lists' END AS category,
CASE o_orderkey % 4 WHEN 0 THEN 'Text missing in the candidate' WHEN 1 THEN 'Table row missing' WHEN 2 THEN 'Link leads nowhere' ELSE 'Something else' END AS message FROM orders"""


def _issues(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda *v: F.when(k % 4 == 0, v[0]).when(k % 4 == 1, v[1]).when(k % 4 == 2, v[2]).otherwise(v[3])
    return _t(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("pair_id"), F.when(k % 3 == 0, "error").otherwise("warning").alias("severity"), F.when(k % 5 == 0, "review").otherwise("confirmed").alias("confidence"), (k % 40).cast("int").alias("page"),
        F.concat(F.lit("section "), (k % 7).cast("string")).alias("section"), pick("content", "tables", "links", "lists").alias("category"), pick("Text missing in the candidate", "Table row missing", "Link leads nowhere", "Something else").alias("message"),
    )


@query(f"""SELECT pair_id, NOT bool_or(severity = 'error' AND confidence <> 'review') AS passed, count(*) AS n_issues, count(*) FILTER (WHERE severity = 'error' AND confidence <> 'review') AS n_failing FROM ({_ISSUES}) GROUP BY pair_id""")
def verdicts(spark, sf_dir):
    """X5, CH13: pass or fail; what is up for review fails nothing."""
    return I.verdicts(_issues(spark, sf_dir), ["pair_id"])


_HELPED = "(VALUES " + ", ".join(f"({n}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for n, (k, v) in enumerate(I.HELP.items())) + ") AS t(n, prefix, help)"


@query(f"""WITH h AS (SELECT * FROM {_HELPED}), i AS (SELECT DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN 'Something else' ELSE prefix || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' in continuation' ELSE ', see there' END END AS message FROM orders JOIN h ON o_orderkey % {len(I.HELP)} = n)
SELECT message, (SELECT help FROM h WHERE starts_with(message, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS help FROM i""")
def explanations(spark, sf_dir):
    """The help of the longest prefix of each message."""
    k = F.col("o_orderkey")
    message = F.get(F.array(*map(F.lit, I.HELP)), (k % len(I.HELP)).cast("int"))
    ending = F.when(k % 3 == 0, "").when(k % 3 == 1, " in continuation").otherwise(", see there")
    return I.explained(_t(spark, sf_dir, "orders").select(F.when(k % 50 == 0, "Something else").otherwise(F.concat(message, ending)).alias("message"))).select("message", "help").distinct()


@query(f"""SELECT category, severity, count(*) AS n FROM ({_ISSUES}) GROUP BY ROLLUP (category, severity)""")
def issue_totals(spark, sf_dir):
    """Counts by category and severity with totals (rollup)."""
    return I.totals(_issues(spark, sf_dir))


@query(f"""SELECT pair_id, category, section, n, critical, page, CASE WHEN n >= 2 THEN n || ' findings: ' || array_to_string(messages, '; ') ELSE messages[1] END AS title FROM
(SELECT pair_id, category, section, count(*) AS n, bool_or(severity = 'error') AS critical, min(page) AS page, list_sort(list(DISTINCT message)) AS messages FROM ({_ISSUES}) GROUP BY pair_id, category, section)""")
def issues_consolidated(spark, sf_dir):
    """Findings of one category and section as one."""
    return I.consolidated(_issues(spark, sf_dir)).select("pair_id", "category", "section", "n", "critical", "page", "title")


@query(f"""SELECT pair_id, id, category, row_number() OVER (PARTITION BY pair_id ORDER BY CASE category WHEN 'content' THEN 1 WHEN 'links' THEN 3 WHEN 'lists' THEN 4 ELSE 6 END, id) AS number FROM ({_ISSUES})""")
def issue_report(spark, sf_dir):
    """Issues numbered by category order, then id."""
    return I.report(_issues(spark, sf_dir), ["id"]).select("pair_id", "id", "category", "number")


@query(f"""SELECT id, category, section FROM (SELECT *, row_number() OVER (PARTITION BY section, category ORDER BY id) AS r FROM ({_ISSUES})) WHERE r <= 60""")
def issue_budget(spark, sf_dir):
    """At most sixty findings of a kind."""
    return C.top_per(_issues(spark, sf_dir), ["section", "category"], ["id"], 60).select("id", "category", "section")


@query()
def anchors_rising(spark, sf_dir):
    """Anchors whose candidate positions rise (a longest increasing subsequence)."""
    p = unique_pairs(spark, sf_dir).withColumn("stage_ord", (F.col("stage_ord") * 7 + F.col("pair_id")) % 23)
    return C.longest_rising(p, ["pair_id"], "prod_ord", "stage_ord")


@query("""WITH f AS (SELECT l_orderkey AS pair_id, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / sum(l_extendedprice) AS a, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') / sum(l_extendedprice) AS b FROM lineitem GROUP BY l_orderkey)
SELECT pair_id, round(a, 6) AS prod_share, round(b, 6) AS stage_share FROM (SELECT pair_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM f) WHERE a >= 0.2 AND a - b >= 0.2""")
def emphasis_lost(spark, sf_dir):
    """Shares of emphasised characters that fall."""
    part = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))) / F.sum("l_extendedprice"), F.lit(0.0))
    f = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(part("A").alias("prod_share"), part("R").alias("stage_share"))
    return f.where(C.lost_emphasis(f)).select("pair_id", F.round("prod_share", 6).alias("prod_share"), F.round("stage_share", 6).alias("stage_share"))


@query("""SELECT DISTINCT l_partkey AS xref, round_even(l_quantity, 0) AS x, round_even(l_discount * 100, 0) AS y FROM lineitem""")
def images_distinct(spark, sf_dir):
    """Images once for each rounded place."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("xref"), F.bround("l_quantity", 0).alias("x"), F.bround(F.col("l_discount") * 100, 0).alias("y")).distinct()


@query(f"""WITH {_LINES}, m AS (SELECT *, regexp_matches(trim(text), '(?i)^(?:\\(?[0-9]{{1,2}}[.)]|\\(?[a-z][.)])$') AS mark FROM (SELECT pair_id, ord, CASE WHEN ord % 5 = 0 THEN '1.' ELSE text END AS text FROM prod))
SELECT pair_id, ord, CASE WHEN before IS NOT NULL THEN trim(before) || ' ' || text ELSE text END AS text FROM (SELECT *, CASE WHEN lag(mark) OVER w THEN lag(text) OVER w END AS before FROM m WINDOW w AS (PARTITION BY pair_id ORDER BY ord)) WHERE NOT mark""")
def markers_attached(spark, sf_dir):
    """Lone list markers put in front of what follows."""
    b = R.lines(_t(spark, sf_dir, "documents")).select("pair_id", "ord", F.when(F.col("ord") % 5 == 0, "1.").otherwise(F.col("text")).alias("text"))
    return O.attach_markers(b, X.is_bare_marker(F.col("text"))).select("pair_id", "ord", "text")


@query("""SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def phrases_present(spark, sf_dir):
    """X1, CH10: where whole passages stand; passages meet only documents that share their rarest-placed word."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    # A passage can only stand in a text that holds all its inner words: one of them keys the join.
    words = F.regexp_extract_all("phrase", F.lit(r"(?<=[^\p{L}])\p{L}+(?=[^\p{L}])"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    wanted = items.select("item_id", "phrase", longest.alias("word"))
    may = terms.join(wanted, "word").select("doc_id", "item_id", "phrase")
    found = may.join(docs, "doc_id").where(F.contains("text", F.col("phrase"))).select("item_id", "doc_id")
    # Passages without an inner word are looked for in all texts.
    bare = docs.join(wanted.where("word is null"), F.contains("text", F.col("phrase"))).select("item_id", "doc_id")
    return found.unionAll(bare).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
