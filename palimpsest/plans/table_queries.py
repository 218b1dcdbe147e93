"""Queries of the table, figure, list, sweep and verification operators. Their inputs are relations in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import figures as P
from palimpsest.operators import lists as L
from palimpsest.operators import sweep as S
from palimpsest.operators import tables as T
from palimpsest.operators import verify as V
from palimpsest.plans.queries import _LINES, _t, query
from palimpsest.plans.section_queries import duck, rel
from palimpsest.sources import relations as R

# A line item as a box, a word and a cell; its number in the table makes it unique.
ITEM = "SELECT l_orderkey AS pair_id, CASE WHEN l_partkey % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, CAST(l_partkey % 3 AS INT) AS page, CAST(l_suppkey % 2 AS INT) AS tbl, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS row, CAST(l_suppkey % 3 AS INT) AS col, l_quantity * 4 AS x0, l_discount * 2000 AS y0, l_quantity * 4 + 20 + l_suppkey % 40 AS x1, l_discount * 2000 + 8 + l_tax * 200 AS y1, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE l_returnflag || ' ' || l_linestatus || ' lamp' || CAST(l_partkey % 5 AS STRING) END AS text FROM {lineitem}"


@query("""WITH p AS (SELECT c_nationkey AS pair_id, c_mktsegment AS tbl, CAST(c_custkey % 4 AS INT) AS page, min(CASE c_custkey % 3 WHEN 0 THEN 'item value item' WHEN 1 THEN 'item value' ELSE '' END) AS h FROM customer GROUP BY ALL), l AS (SELECT *, list_filter(string_split(h, ' '), lambda x: x <> '') AS w FROM p), k AS (SELECT *, first_value(w) OVER o AS f, row_number() OVER o AS n FROM l WINDOW o AS (PARTITION BY pair_id, tbl ORDER BY page))
SELECT pair_id, tbl, page FROM k WHERE n > 1 AND len(f) > 0 AND coalesce(list_sum(list_transform(list_distinct(f), lambda t: least(len(list_filter(f, lambda x: x = t)), len(list_filter(w, lambda x: x = t))))), 0) / len(f) < 0.7""")
def headers_not_repeated(spark, sf_dir):
    """T4, T5: later fragments that lack most of their table's head."""
    f = rel(spark, sf_dir, "SELECT c_nationkey AS pair_id, 'stage' AS side, c_mktsegment AS `table`, CAST(c_custkey % 4 AS INT) AS page, min(CASE c_custkey % 3 WHEN 0 THEN 'item value item' WHEN 1 THEN 'item value' ELSE '' END) AS h FROM {customer} GROUP BY 1, 2, 3, 4")
    parts = f.withColumn("header", F.filter(F.split("h", " "), lambda x: x != ""))
    return T.headers_not_repeated(parts).select("pair_id", F.col("table").alias("tbl"), "page")


SHAPES = "SELECT o_orderkey AS pair_id, CAST(o_custkey % 3 AS INT) AS pc, CAST(o_orderkey % 3 AS INT) AS sc, CAST(o_custkey % 2 AS INT) AS pf, CAST(o_orderkey % 4 AS INT) AS sf, CAST(o_custkey % 100 AS DOUBLE) AS pe, CAST(o_orderkey % 100 AS DOUBLE) AS se FROM {orders}"


@query(f"""WITH s AS ({duck(SHAPES)}) SELECT pair_id, 'Table split across more pages' AS message FROM s WHERE sf > pf UNION ALL SELECT pair_id, 'Table columns differ' FROM s WHERE sc <> pc UNION ALL SELECT pair_id, 'Table column layout differs' FROM s WHERE abs((pe + 50) / 200 - (se + 50) / 200) > 0.03""")
def tables_compared(spark, sf_dir):
    """Matched tables that are split further, or have other columns, or wider ones."""
    s = rel(spark, sf_dir, SHAPES)
    side = lambda c, n, e: F.struct(F.col(c).alias("n_cols"), F.col(n).alias("fragments"), F.array(F.lit(0.0), F.col(e) + 50, F.lit(200.0)).alias("edges"))
    return T.compare_tables(s.select("pair_id", side("pc", "pf", "pe").alias("prod"), side("sc", "sf", "se").alias("stage"))).select("pair_id", "message")


@query(f"""WITH c AS (SELECT *, row % 3 > 0 AS border_top, row % 2 > 0 AS border_bottom FROM ({duck(ITEM)})), g AS (SELECT *, CASE WHEN NOT lag(border_bottom) OVER w AND NOT border_top THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY pair_id, side, page, tbl, col ORDER BY row)), m AS (SELECT *, sum(starts) OVER (PARTITION BY pair_id, side, page, tbl, col ORDER BY row) AS merge FROM g)
SELECT pair_id, side, page, tbl, col, min(row) AS row, count(*) AS rows FROM m GROUP BY pair_id, side, page, tbl, col, merge""")
def cells_merged_down(spark, sf_dir):
    """Cells between which no rule is drawn."""
    c = rel(spark, sf_dir, ITEM).withColumn("border_top", F.col("row") % 3 > 0).withColumn("border_bottom", F.col("row") % 2 > 0)
    return T.column_merges(c).select("pair_id", "side", "page", "tbl", "col", "row", "rows")


@query(f"""WITH c AS ({duck(ITEM)}), w AS (SELECT pair_id, side, page, row AS word_id, (x0 + x1) / 2 + row % 7 AS x, (y0 + y1) / 2 AS y FROM c) SELECT word_id, c.tbl, c.row, c.col FROM w JOIN c USING (pair_id, side, page) WHERE x BETWEEN c.x0 AND c.x1 AND w.y BETWEEN c.y0 AND c.y1 QUALIFY row_number() OVER (PARTITION BY pair_id, side, page, word_id ORDER BY c.x0, c.tbl, c.row, c.col) = 1""")
def words_in_cells(spark, sf_dir):
    """Each word in the cell that holds its centre."""
    c = rel(spark, sf_dir, ITEM)
    words = c.select("pair_id", "side", "page", F.col("row").alias("word_id"), (F.col("x0") + F.col("row") % 7).alias("x0"), "y0", (F.col("x1") + F.col("row") % 7).alias("x1"), "y1")
    return T.words_to_cells(words, c).select("word_id", "tbl", "row", "col")


_FILLS = "SELECT l_orderkey AS pair_id, CASE WHEN l_partkey % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, CAST(l_partkey % 3 AS INT) AS page, CAST(l_suppkey * 7919 % 16777216 AS BIGINT) AS fill, l_quantity * 4 - 10 AS x0, l_discount * 2000 - 10 AS y0, l_quantity * 4 + 40 AS x1, l_discount * 2000 + 30 AS y1 FROM {lineitem}"


@query(f"""WITH t AS ({duck(ITEM)}), f AS (SELECT * FROM ({duck(_FILLS)}) WHERE 0.299 * ((fill >> 16) & 255) / 255 + 0.587 * ((fill >> 8) & 255) / 255 + 0.114 * (fill & 255) / 255 < 0.35)
SELECT t.row FROM t WHERE EXISTS (SELECT 1 FROM f WHERE f.pair_id = t.pair_id AND f.side = t.side AND f.page = t.page AND greatest(least(t.x1, f.x1) - greatest(t.x0, f.x0), 0) * greatest(least(t.y1, f.y1) - greatest(t.y0, f.y0), 0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.4)""")
def tables_dark(spark, sf_dir):
    """Regions that one dark fill covers."""
    t = rel(spark, sf_dir, ITEM).withColumn("tbl", F.col("row"))
    return T.dark_regions(t, rel(spark, sf_dir, _FILLS)).select("row")


_BANDS = f"""WITH w AS ({duck(ITEM)}), a AS (SELECT *, CASE WHEN least(y1, lag(y1) OVER o) - greatest(y0, lag(y0) OVER o) >= 0.5 * least(y1 - y0, lag(y1 - y0) OVER o) THEN 0 ELSE 1 END AS s FROM w WINDOW o AS (PARTITION BY pair_id, side, page ORDER BY y0, x0)), b AS (SELECT *, sum(s) OVER (PARTITION BY pair_id, side, page ORDER BY y0, x0) AS band FROM a)"""


@query(f"""{_BANDS}, h AS (SELECT *, avg(y1 - y0) OVER (PARTITION BY pair_id, side, page, band) AS h, lag(x1) OVER (PARTITION BY pair_id, side, page, band ORDER BY x0) AS px FROM b), c AS (SELECT *, sum(CASE WHEN x0 - px <= 3 * h THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id, side, page, band ORDER BY x0) AS piece FROM h)
SELECT pair_id, side, page, band, piece, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1 FROM c GROUP BY ALL""")
def lines_read(spark, sf_dir):
    """Recognised words put together to lines."""
    return S.printed_lines(rel(spark, sf_dir, ITEM)).select("pair_id", "side", "page", "band", "piece", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"))


@query(f"""WITH b AS ({duck(ITEM)}), l AS (SELECT *, CASE WHEN least(y1, lag(y1) OVER o) - greatest(y0, lag(y0) OVER o) > 0.5 * least(y1 - y0, lag(y1 - y0) OVER o) THEN 0 ELSE 1 END AS s FROM b WINDOW o AS (PARTITION BY pair_id, page ORDER BY y0, x0)), m AS (SELECT *, sum(s) OVER (PARTITION BY pair_id, page ORDER BY y0, x0) AS line FROM l),
r AS (SELECT *, max(x1) OVER (PARTITION BY pair_id, page, line ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), p AS (SELECT *, sum(CASE WHEN x0 - reach <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id, page, line ORDER BY x0) AS part FROM r) SELECT pair_id, page, line, part, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1, count(*) AS n FROM p GROUP BY pair_id, page, line, part""")
def boxes_clustered(spark, sf_dir):
    """Boxes of a line that are six points apart or closer, as one."""
    return V.box_clusters(rel(spark, sf_dir, ITEM)).select("pair_id", "page", "line", "part", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), "n")


@query(f"""SELECT pair_id, side, page, false AS ocr, text, CAST(10 AS DOUBLE) AS size FROM ({duck(ITEM)}) WHERE row % 3 > 0 UNION ALL SELECT pair_id, side, page, true, text, round(0.8 * (y1 - y0), 6) FROM ({duck(ITEM)}) WHERE row % 3 = 0""")
def pages_read(spark, sf_dir):
    """S21, CH28: spans and, for scanned pages, what was read, marked as such."""
    i = rel(spark, sf_dir, ITEM)
    spans = i.where("row % 3 > 0").select("pair_id", "side", "page", "text", F.lit(10.0).alias("size"))
    return S.page_text(spans, i.where("row % 3 = 0").select("pair_id", "side", "page", "text", "y0", "y1")).select("pair_id", "side", "page", "ocr", "text", F.round("size", 6).alias("size"))


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS pair_id, c_mktsegment AS label FROM customer), b AS (SELECT c_nationkey AS pair_id, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' of ' || c_custkey WHEN 1 THEN 'The ' || c_mktsegment ELSE c_mktsegment END AS block FROM customer) SELECT pair_id, label, block FROM l JOIN b USING (pair_id) WHERE starts_with(block, label) AND length(block) > length(label) + 1""")
def labels_merged(spark, sf_dir):
    """Bold labels that a longer block starts with."""
    c = rel(spark, sf_dir, "SELECT c_nationkey AS pair_id, c_mktsegment AS label, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' of ' || CAST(c_custkey AS STRING) WHEN 1 THEN 'The ' || c_mktsegment ELSE c_mktsegment END AS text FROM {customer}")
    return L.merged_labels(c.select("pair_id", "label").distinct(), c.select("pair_id", "text")).select("pair_id", "label", "block")


@query(f"""WITH {_LINES} SELECT pair_id, ord, CAST(strpos(regexp_replace(lower(text), '\\s+', '', 'g'), regexp_replace(lower(substr(text, 8, 14)), '\\s+', '', 'g')) AS INT) AS at FROM prod WHERE length(text) >= 30""")
def link_anchors(spark, sf_dir):
    """K3: where a link's words stand in a text, blanks apart."""
    lines = R.lines(_t(spark, sf_dir, "documents")).where(F.length("text") >= 30)
    return lines.select("pair_id", "ord", L.link_anchor(F.col("text"), F.substring("text", 8, 14)).alias("at"))


@query()
def link_runs(spark, sf_dir):
    """K2: the longest run that a link's label shares with a sentence (no SQL form; tested against brute force)."""
    lines = R.lines(_t(spark, sf_dir, "documents"))
    return lines.select("pair_id", "ord", L.shared_run("text", F.substring("text", 5, 24)).alias("n"))


_INV = f"""WITH i AS ({duck(ITEM)}), w AS (SELECT pair_id, side, page, count(*) AS n_words FROM i WHERE text <> '' GROUP BY ALL), m AS (SELECT pair_id, side, page, count(*) FILTER (WHERE greatest(x1 - x0, y1 - y0) >= 40) AS n_images, count(*) FILTER (WHERE greatest(x1 - x0, y1 - y0) < 40) AS n_icons, sum(CASE WHEN greatest(x1 - x0, y1 - y0) >= 40 THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS art_area FROM i WHERE tbl = 0 GROUP BY ALL),
l AS (SELECT pair_id, side, page, list_sort(list(DISTINCT 'http://' || text)) AS uris FROM i WHERE tbl = 1 GROUP BY ALL), t AS (SELECT pair_id, side, page, count(*) AS n_tables FROM i WHERE col = 2 GROUP BY ALL), inv AS (SELECT pair_id, side, page, coalesce(n_words, 0) AS n_words, coalesce(n_images, 0) AS n_images, coalesce(n_icons, 0) AS n_icons, coalesce(art_area, 0) AS art_area, coalesce(uris, []) AS uris, coalesce(n_tables, 0) AS n_tables FROM w FULL JOIN m USING (pair_id, side, page) FULL JOIN l USING (pair_id, side, page) FULL JOIN t USING (pair_id, side, page))"""


def _inventory(spark, sf_dir):
    i = rel(spark, sf_dir, ITEM)
    key = ["pair_id", "side", "page"]
    return S.inventory(i.where("text <> ''"), i.where("tbl = 0"), i.where("tbl = 1").select(*key, F.concat(F.lit("http://"), "text").alias("uri")), i.where("col = 2").select(*key))


@query(f"""{_INV} SELECT pair_id, side, page, n_words, n_images, n_icons, round(art_area, 4) AS art_area, array_to_string(uris, ',') AS uris, n_tables FROM inv""")
def page_inventory(spark, sf_dir):
    """What each page holds."""
    return _inventory(spark, sf_dir).select("pair_id", "side", "page", "n_words", "n_images", "n_icons", F.round("art_area", 4).alias("art_area"), F.array_join("uris", ",").alias("uris"), "n_tables")


@query(f"""{_INV}, j AS (SELECT pair_id, page, p.art_area AS pa, s.art_area AS sa, p.n_icons AS pi, s.n_icons AS si, p.uris AS pu, s.uris AS su, p.n_tables AS pt, s.n_tables AS st FROM inv p JOIN inv s USING (pair_id, page) WHERE p.side = 'prod' AND s.side = 'stage')
SELECT pair_id, page, 'artwork' AS gap FROM j WHERE abs(pa - sa) > 0.25 * greatest(pa, sa) UNION ALL SELECT pair_id, page, 'icons' FROM j WHERE abs(pi - si) > 3 UNION ALL SELECT pair_id, page, 'links lost' FROM j WHERE len(list_filter(pu, lambda x: NOT list_contains(su, x))) > 0
UNION ALL SELECT pair_id, page, 'links added' FROM j WHERE len(list_filter(su, lambda x: NOT list_contains(pu, x))) > 0 UNION ALL SELECT pair_id, page, 'table' FROM j WHERE (pt > 0) <> (st > 0)""")
def page_gaps(spark, sf_dir):
    """What facing pages differ in."""
    inv = _inventory(spark, sf_dir)
    side = lambda s: inv.where(F.col("side") == s).select("pair_id", "page", F.struct("n_words", "n_images", "n_icons", "art_area", "uris", "n_tables").alias(s))
    return S.page_gaps(side("prod").join(side("stage"), ["pair_id", "page"])).select("pair_id", "page", "gap")


@query(f"""WITH i AS ({duck(ITEM)}) SELECT row, x0 <= 120 AND y0 <= 120 AND abs(y0 - x0) >= 6 AS changed FROM i""")
def marker_gaps(spark, sf_dir):
    """Markers whose gap to their text changed."""
    return rel(spark, sf_dir, ITEM).select("row", S.gap_changed(F.col("x0"), F.col("y0")).alias("changed"))


JUDGED = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'review' ELSE 'confirmed' END AS verdict, CASE WHEN o_custkey % 2 = 0 THEN 'review' ELSE 'confirmed' END AS confidence, l.share AS share, CASE o_custkey % 4 WHEN 0 THEN 'Front' WHEN 1 THEN 'Turn the unit off now.' WHEN 2 THEN '12 mm 5' ELSE 'lamps glow brighter every single season' END AS text, CASE o_custkey % 3 WHEN 0 THEN 'one two three four' ELSE 'one' END AS other FROM {orders} o JOIN (SELECT l_orderkey, min(l_discount) * 8 AS share FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"


@query(f"""SELECT id, CASE WHEN confidence = 'review' THEN 'review' ELSE verdict END AS confidence FROM ({duck(JUDGED)}) WHERE verdict <> 'drop'""")
def verdicts_applied(spark, sf_dir):
    """Dropped findings go, a review is never promoted."""
    return V.applied(rel(spark, sf_dir, JUDGED)).select("id", "confidence")


@query(f"""SELECT id, share >= 0.5 OR text = '12 mm 5' OR (text = 'Front' AND other = 'one two three four') AS advisory FROM ({duck(JUDGED)})""")
def findings_advisory(spark, sf_dir):
    """Text mostly in tables, no prose, or a stub: only for review."""
    return rel(spark, sf_dir, JUDGED).select("id", V.advisory(F.col("share"), F.col("text"), F.col("other")).alias("advisory"))


# ------------------------------------------------------------------ what tables lost
WORDS = "SELECT l_orderkey AS pair_id, CAST(l_suppkey % 2 AS BIGINT) AS section, CAST(l_partkey % 3 AS INT) AS tbl, 'w' || CAST(l_partkey % 12 AS STRING) AS token FROM {lineitem}"
OTHER = "SELECT l_orderkey AS pair_id, CAST(l_suppkey % 2 AS BIGINT) AS section, 'w' || CAST((l_partkey + l_linenumber % 3) % 12 AS STRING) AS token FROM {lineitem} WHERE l_linenumber % 4 > 0"


@query(f"""WITH o AS (SELECT pair_id, section, tbl, token, count(*) AS n FROM ({duck(WORDS)}) WHERE pair_id % 3 > 0 GROUP BY ALL), t AS (SELECT pair_id, section, token, count(*) AS m FROM ({duck(OTHER)}) GROUP BY ALL) SELECT pair_id, section, tbl, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS kept FROM o LEFT JOIN t USING (pair_id, section, token) GROUP BY ALL HAVING sum(least(n, coalesce(m, 0))) / sum(n) < 0.6""")
def tables_gone(spark, sf_dir):
    """Tables of whose words the section keeps too few."""
    w = rel(spark, sf_dir, WORDS)
    unmatched = w.where("pair_id % 3 > 0").select("pair_id", "section", "tbl").distinct()
    return T.tables_gone(w, rel(spark, sf_dir, OTHER), unmatched).select("pair_id", "section", "tbl", F.round("kept", 6).alias("kept"))


ROWS = "SELECT CAST(p_size AS BIGINT) AS pair_id, CAST(p_partkey % 2 AS INT) AS tbl, p_partkey AS row, p_name || ' ' || p_brand AS text FROM {part}"


@query(f"""WITH r AS (SELECT * FROM ({duck(ROWS)}) WHERE row % 3 > 0), w AS (SELECT pair_id, tbl, row, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2) AS w FROM r), o AS (SELECT pair_id, tbl, row, text, token, count(*) AS n FROM (SELECT pair_id, tbl, row, text, unnest(w) AS token FROM w) GROUP BY ALL),
t AS (SELECT pair_id, tbl, token, count(*) AS m FROM (SELECT pair_id, tbl, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) AS token FROM ({duck(ROWS)}) WHERE row % 5 = 0) GROUP BY ALL) SELECT pair_id, tbl, row, CASE WHEN row = 0 THEN 'Table heading missing' ELSE 'Table row missing' END AS message FROM o LEFT JOIN t USING (pair_id, tbl, token) GROUP BY pair_id, tbl, row, text HAVING sum(least(n, coalesce(m, 0))) < 0.75 * sum(n) AND NOT (row = 0 AND length(text) > 24)""")
def rows_gone(spark, sf_dir):
    """Rows without a partner whose words the other table lacks."""
    from palimpsest.functions import text as X

    r = rel(spark, sf_dir, ROWS)
    tokens = r.where("row % 5 = 0").select("pair_id", "tbl", F.explode(X.fine_tokens(F.col("text"))).alias("token"))
    return T.rows_missing(r, r.where("row % 3 = 0").select("pair_id", "tbl", "row"), tokens).select("pair_id", "tbl", "row", "message")


@query()
def cells_gone(spark, sf_dir):
    """Cells of matched rows that lost words (tested against brute force)."""
    r = rel(spark, sf_dir, "SELECT CAST(p_size AS BIGINT) AS pair_id, CAST(p_partkey % 2 AS INT) AS tbl, p_partkey AS row, p_name, p_brand, p_type FROM {part}")
    return T.cells_missing(r.select("pair_id", "tbl", "row", F.array("p_name", "p_brand", "p_type").alias("cells"), F.array(F.when(F.col("row") % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name")), F.col("p_brand"), F.when(F.col("row") % 4 == 0, F.lit("")).otherwise(F.col("p_type"))).alias("stage_cells")))


POOL = " UNION ALL ".join(f"SELECT CAST(p_size AS BIGINT) AS pair_id, '{s}' AS side, CAST(p_partkey % 3 AS INT) AS topic, p_partkey AS row, lower(p_brand) || CASE WHEN p_partkey % 4 = {k} THEN ' x' ELSE '' END AS key FROM {{part}} WHERE p_partkey % {m} <> 0" for s, k, m in (("prod", 0, 5), ("stage", 1, 7)))
PRINTED = "SELECT DISTINCT CAST(p_size AS BIGINT) AS pair_id, CASE WHEN p_size % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, 1 AS topic, 'see brand x and brand y' AS blob FROM {part}"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, topic, key ORDER BY row) AS n FROM ({duck(POOL)})) SELECT r.pair_id, topic, r.row, key, CASE WHEN side = 'prod' THEN 'table-row-missing' ELSE 'table-row-added' END AS type FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.pair_id = r.pair_id AND o.side <> r.side AND o.topic = r.topic AND o.key = r.key AND o.n = r.n)
AND NOT EXISTS (SELECT 1 FROM ({duck(PRINTED)}) p WHERE p.pair_id = r.pair_id AND p.side <> r.side AND p.topic = r.topic AND contains(' ' || p.blob || ' ', ' ' || r.key || ' '))""")
def rows_pooled(spark, sf_dir):
    """Rows that a topic of one side has more often, wherever its tables hold them."""
    return T.pooled_rows(rel(spark, sf_dir, POOL), rel(spark, sf_dir, PRINTED)).select("pair_id", "topic", "row", "key", "type")


@query()
def rows_reworded(spark, sf_dir):
    """Lone rows paired by likeness, with what they lost and gained (ratios have no SQL form; tested case by case)."""
    return T.reworded_rows(rows_pooled(spark, sf_dir))


@query(f"""SELECT pair_id, side, page, tbl, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM ({duck(ITEM)}) WHERE trim(text) <> '' GROUP BY ALL HAVING count(DISTINCT col) >= 2 AND min(x0) >= 0 AND min(y0) >= 0""")
def regions_tight(spark, sf_dir):
    """The boxes of detected regions' cells that hold text."""
    t = T.tight_regions(rel(spark, sf_dir, ITEM))
    return t.select("pair_id", "side", "page", "tbl", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""WITH c AS (SELECT * FROM ({duck(ITEM)})), r AS (SELECT pair_id, side, page, tbl, row, array_to_string(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY col)), '[\\p{{L}}\\p{{N}}]+'), ' ') AS key, bool_or(row % 9 = 0) AS ruled FROM c GROUP BY ALL) SELECT pair_id, side, page, tbl, row, key FROM r QUALIFY count(*) OVER (PARTITION BY pair_id, side, page, tbl) >= 2 AND bool_or(ruled) OVER (PARTITION BY pair_id, side, page, tbl)""")
def rows_ruled(spark, sf_dir):
    """Rows of tables that are drawn with rules."""
    c = rel(spark, sf_dir, ITEM).withColumn("border_top", F.col("row") % 9 == 0).withColumn("border_bottom", F.lit(None).cast("boolean"))
    return T.ruled_tables(c).select("pair_id", "side", "page", "tbl", "row", "key")


HEADED = "SELECT l_orderkey AS pair_id, 'prod' AS side, CAST(l_suppkey % 2 AS INT) AS tbl, CAST(l_partkey % 3 AS INT) AS fragment, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS row, CASE WHEN l_linenumber <= 2 THEN 'head' ELSE l_returnflag END AS key FROM {lineitem}"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, tbl, fragment ORDER BY row) AS n, min(fragment) OVER (PARTITION BY pair_id, tbl) AS f FROM ({duck(HEADED)})), h AS (SELECT *, max(CASE WHEN fragment = f AND n = 1 THEN key END) OVER (PARTITION BY pair_id, tbl) AS h1, max(CASE WHEN fragment = f AND n = 2 THEN key END) OVER (PARTITION BY pair_id, tbl) AS h2 FROM r),
k AS (SELECT *, n = 1 AND key = h1 AS one FROM h), m AS (SELECT *, lag(one) OVER (PARTITION BY pair_id, tbl, fragment ORDER BY row) AS before FROM k), d AS (SELECT * FROM m WHERE NOT coalesce(fragment <> f AND (one OR (n = 2 AND key = h2 AND before)), false)) SELECT pair_id, tbl, fragment, key, row_number() OVER (PARTITION BY pair_id, tbl ORDER BY fragment, row) - 1 AS row FROM d""")
def heads_dropped(spark, sf_dir):
    """The rows of stitched tables, repeated heads left out."""
    h = rel(spark, sf_dir, HEADED).withColumnRenamed("tbl", "table")
    return T.without_repeated_heads(h).select("pair_id", F.col("table").alias("tbl"), "fragment", "key", "row")


# ------------------------------------------------------------------ figures
FIGURES = "SELECT l_orderkey AS pair_id, CASE WHEN l_partkey % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, CAST(l_partkey % 3 AS INT) AS page, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS fig, l_quantity * 4 AS x0, l_discount * 2000 AS y0, l_quantity * 4 + 100 AS x1, l_discount * 2000 + 80 AS y1 FROM {lineitem}"
DRAWS = "SELECT l_orderkey AS pair_id, CASE WHEN l_partkey % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, CAST(l_partkey % 3 AS INT) AS page, CASE l_suppkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'sf' ELSE 'f' END AS type, l_suppkey % 2 = 0 AS closed, CAST(1 + l_suppkey % 5 AS INT) AS items, CAST(l_partkey * 7919 % 16777216 AS BIGINT) AS stroke, l_quantity * 4 + 10 AS x0, l_discount * 2000 + 5 AS y0, l_quantity * 4 + 40 + l_suppkey % 30 AS x1, l_discount * 2000 + 40 AS y1 FROM {lineitem}"
_SAT = "CASE WHEN greatest((stroke >> 16) & 255, (stroke >> 8) & 255, stroke & 255) > 0 THEN (greatest((stroke >> 16) & 255, (stroke >> 8) & 255, stroke & 255) - least((stroke >> 16) & 255, (stroke >> 8) & 255, stroke & 255)) / greatest((stroke >> 16) & 255, (stroke >> 8) & 255, stroke & 255) ELSE 0 END"


@query(f"""WITH f AS ({duck(FIGURES)}), d AS (SELECT * FROM ({duck(DRAWS)}) WHERE type IN ('s', 'sf') AND (items = 1 OR (closed AND items = 4)) AND {_SAT} >= 0.45), j AS (SELECT f.*, d.x0 - f.x0 AS dx, d.y0 - f.y0 AS dy FROM f JOIN d USING (pair_id, side, page) WHERE least(f.x1, d.x1) > greatest(f.x0, d.x0) AND least(f.y1, d.y1) > greatest(f.y0, d.y0) AND d.x1 - d.x0 >= 16 AND d.y1 - d.y0 >= 16 AND NOT (d.x1 - d.x0 >= 98 AND d.y1 - d.y0 >= 0.98 * 80))
SELECT pair_id, side, page, fig, round(dx, 4) AS dx, round(dy, 4) AS dy FROM j QUALIFY count(*) OVER (PARTITION BY pair_id, side, page, fig) <= 4""")
def highlight_boxes(spark, sf_dir):
    """Coloured frames over figures."""
    return P.highlight_boxes(rel(spark, sf_dir, FIGURES), rel(spark, sf_dir, DRAWS)).select("pair_id", "side", "page", "fig", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query(f"""WITH f AS ({duck(FIGURES)}), l AS (SELECT pair_id, side, page, text, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM ({duck(ITEM)}) WHERE text <> ''), w AS (SELECT DISTINCT pair_id, side, page, fig, lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) AS word FROM f JOIN l USING (pair_id, side, page) WHERE least(x1, lx1) > greatest(x0, lx0) AND (ly0 - y1 BETWEEN 0 AND 30 OR y0 - ly1 BETWEEN 0 AND 30)) SELECT pair_id, side, page, fig, string_agg(word, ',' ORDER BY word) AS words FROM w WHERE length(word) >= 3 GROUP BY ALL""")
def caption_words(spark, sf_dir):
    """The words of a figure's caption."""
    c = P.caption_words(rel(spark, sf_dir, FIGURES), rel(spark, sf_dir, ITEM).where("text <> ''"))
    return c.select("pair_id", "side", "page", "fig", F.array_join("words", ",").alias("words"))


@query(f"""WITH f AS (SELECT *, page AS section FROM ({duck(FIGURES)})), n AS (SELECT *, lead(fig) OVER w AS n_fig, lead(page) OVER w AS n_page, lead(x0) OVER w AS nx0, lead(y1) OVER w AS ny1 FROM f WINDOW w AS (PARTITION BY pair_id, section ORDER BY fig)) SELECT pair_id, section, fig AS first, n_fig AS second, round(least(x0, nx0), 4) AS x0, round(greatest(y1, ny1), 4) AS y1 FROM n WHERE n_page = page""")
def figure_unions(spark, sf_dir):
    """Figures that follow each other, as one."""
    f = rel(spark, sf_dir, FIGURES).withColumn("section", F.col("page")).withColumn("ord", F.col("fig"))
    return P.union_candidates(f).select("pair_id", "section", "first", "second", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"))


STATUSES = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'differs' WHEN 2 THEN 'review' WHEN 3 THEN 'outside' ELSE 'missing' END AS status FROM {orders}"


@query(f"""SELECT id, CASE status WHEN 'differs' THEN 'Image content differs' WHEN 'review' THEN 'Image could not be confirmed identical' WHEN 'outside' THEN 'Image outside its section' ELSE 'Image missing' END AS message, CASE WHEN status IN ('differs', 'missing') THEN 'error' ELSE 'warning' END AS severity, CASE WHEN status = 'review' THEN 'review' ELSE 'confirmed' END AS confidence FROM ({duck(STATUSES)}) WHERE status <> 'same'""")
def figure_findings(spark, sf_dir):
    """What is said of figures that are not the same."""
    return P.status_findings(rel(spark, sf_dir, STATUSES)).select("id", "message", "severity", "confidence")


@query("""WITH n AS (SELECT l_orderkey AS pair_id, list(DISTINCT l_linenumber) AS a, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_orderkey % 2 = 0), []) AS b, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_linestatus = 'F'), []) AS c FROM lineitem GROUP BY l_orderkey)
SELECT pair_id FROM n WHERE len(a) >= 4 AND len(list_intersect(a, b)) = 0 AND len(list_intersect(a, c)) >= 0.7 * len(a)""")
def callouts_stripped(spark, sf_dir):
    """Drawings that lost all numbers that a list still names."""
    i = _t(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    g = i.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.collect_set(n).alias("prod"), F.collect_set(F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 2 == 0), n)).alias("stage"), F.collect_set(F.when(F.col("l_linestatus") == "F", n)).alias("legend"))
    return P.legend_stripped(g).select("pair_id")


@query()
def findings_judged(spark, sf_dir):
    """Findings against both documents' texts (tested rule by rule against plain Python)."""
    lines = rel(spark, sf_dir, "SELECT pair_id, ord, page, text, 'prod' AS side FROM {prod} UNION ALL SELECT pair_id, ord, page, text, 'stage' AS side FROM {stage}")
    k = F.col("ord")
    message = F.when(k % 4 == 0, "Missing text").when(k % 4 == 1, "Added text").when(k % 4 == 2, "Table row missing").otherwise("Text alignment changed")
    none = lambda t: F.lit(None).cast(t)
    f = lines.where("side = 'prod'").select("pair_id", F.col("ord").cast("long").alias("id"), message.alias("message"), F.lit("confirmed").alias("confidence"), F.col("page").alias("other_page"), F.array("text").alias("expected"), F.array("text").alias("actual"), none("array<struct<type:string,text:string>>").alias("word_diff"), none("array<string>").alias("labels"), none("array<string>").alias("tokens"), none("int").alias("expected_columns"), none("int").alias("actual_columns"), none("string").alias("expected_style"), none("string").alias("actual_style"), none("string").alias("changed"))
    images = lines.where("side = 'stage' and ord % 9 = 0").select("pair_id", "side", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(150.0).alias("y1"))
    cells = lines.where("side = 'stage' and ord % 5 = 0").select("pair_id", "side", "page", F.lit(0).alias("tbl"), "text")
    told = V.near_tables(V.near_images(f, images, "stage").withColumn("lines", F.col("expected")), cells, "stage").drop("lines")
    return V.judged(told, V.document_index(lines)).select("pair_id", "id", "message", "verdict")
