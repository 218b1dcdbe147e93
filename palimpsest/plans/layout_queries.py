"""Queries for the layout, figure, list, sweep and verification operators, fed from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import compare as C
from palimpsest.operators import figures as P
from palimpsest.operators import lists as L
from palimpsest.operators import sweep as S
from palimpsest.operators import tables as T
from palimpsest.operators import verify as V
from palimpsest.plans.queries import _ISSUES, _LINES, _SQUASH, _editions, _issues, _t, query
from palimpsest.sources import relations as R

# Cells, boxes and figures made of line items: an order is a pair, a line a row.
_CELLS = """SELECT l_orderkey AS pair_id, CASE WHEN l_returnflag = 'N' THEN 'stage' ELSE 'prod' END AS side, CAST(l_partkey % 3 AS INT) AS page, CAST(l_suppkey % 2 AS INT) AS tbl, CAST((l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS row, CAST(l_partkey % 4 AS INT) AS col,
CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus || l_returnflag END AS text, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS x0, l_discount * 1000 AS y0, l_quantity + l_suppkey % 50 AS x1, l_discount * 1000 + l_tax * 1000 AS y1 FROM lineitem"""


def _cells(spark, sf_dir) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_returnflag") == "N", "stage").otherwise("prod").alias("side"), (F.col("l_partkey") % 3).cast("int").alias("page"), (F.col("l_suppkey") % 2).cast("int").alias("tbl"),
        ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("row"), (F.col("l_partkey") % 4).cast("int").alias("col"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat("l_linestatus", "l_returnflag")).alias("text"),
        F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_quantity")).alias("x0"), (F.col("l_discount") * 1000).alias("y0"), (F.col("l_quantity") + F.col("l_suppkey") % 50).alias("x1"), (F.col("l_discount") * 1000 + F.col("l_tax") * 1000).alias("y1"),
    )


@query(f"""WITH e AS (SELECT pair_id, side, page, tbl, round(unnest([x0, x1]), 1) AS x FROM ({_CELLS}) WHERE x0 IS NOT NULL) SELECT pair_id, side, page, tbl, array_to_string(list_transform(list_sort(list(DISTINCT x)), lambda v: CAST(CAST(v AS INT) AS VARCHAR)), ',') AS edges FROM e GROUP BY ALL""")
def table_column_edges(spark, sf_dir):
    """The column edges of each table."""
    return T.column_edges(_cells(spark, sf_dir)).withColumn("edges", F.array_join(F.transform("edges", lambda v: v.cast("int").cast("string")), ","))


@query(f"""WITH c AS ({_CELLS}), r AS (SELECT pair_id, side, page, tbl, row, count(*) FILTER (WHERE trim(text) <> '') AS n, min(least(x0, y0)) AS lo0, max(CASE WHEN trim(text) <> '' THEN col END) AS hi, min(CASE WHEN trim(text) <> '' THEN col END) AS lo FROM c GROUP BY ALL),
w AS (SELECT pair_id, side, page, tbl, sum(n) AS n, max(hi) - min(lo) + 1 AS columns, min(lo0) AS l, count(*) AS rows FROM r GROUP BY ALL) SELECT pair_id, side, page, tbl, coalesce(n > 0 AND columns >= 2 AND coalesce(l, 0) >= 0, false) AS is_table, columns, rows FROM w""")
def tables_valid(spark, sf_dir):
    """Which grids are tables."""
    return T.is_table(_cells(spark, sf_dir)).withColumn("is_table", F.coalesce("is_table", F.lit(False)))


@query(f"""SELECT pair_id, side, page, tbl, row, col, round((y1 + below) / 2, 6) AS barrier FROM (SELECT *, lead(y0) OVER (PARTITION BY pair_id, side, page, tbl, col ORDER BY row) AS below FROM ({_CELLS})) WHERE x0 IS NOT NULL AND below IS NOT NULL""")
def table_row_barriers(spark, sf_dir):
    """Heights between the rows of a column."""
    return T.row_barriers(_cells(spark, sf_dir)).select("pair_id", "side", "page", "tbl", "row", "col", F.round("barrier", 6).alias("barrier"))


@query("""WITH c AS (SELECT c_nationkey AS tbl, c_custkey AS row, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' BUILDING' ELSE 'BUILDING' END AS text FROM customer), n AS (SELECT *, trim(lead(text) OVER (PARTITION BY tbl ORDER BY row)) AS below FROM c)
SELECT tbl, row, CASE WHEN length(below) > 0 AND length(rtrim(text)) > length(below) AND suffix(rtrim(text), below) THEN rtrim(substr(rtrim(text), 1, length(rtrim(text)) - length(below))) ELSE text END AS text FROM n""")
def cells_without_repeats(spark, sf_dir):
    """Text repeated from the cell below is cut off."""
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").select(F.lit(0).cast("long").alias("pair_id"), F.lit("prod").alias("side"), F.lit(0).alias("page"), F.col("c_nationkey").alias("tbl"), k.alias("row"), F.lit(0).alias("col"), F.when(k % 2 == 0, F.concat("c_mktsegment", F.lit(" BUILDING"))).otherwise("BUILDING").alias("text"))
    return T.without_repeated_below(c).select("tbl", "row", "text")


@query(f"""WITH c AS (SELECT *, sum(CASE WHEN x0 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id, side, page, tbl, row ORDER BY col) AS "at" FROM ({_CELLS})) SELECT pair_id, side, page, tbl, row, min(col) AS col, count(*) AS span FROM c WHERE c."at" > 0 GROUP BY pair_id, side, page, tbl, row, c."at" """)
def table_row_spans(spark, sf_dir):
    """How many columns a cell spans."""
    return T.row_spans(_cells(spark, sf_dir)).drop("text")


@query(f"""WITH c AS (SELECT * FROM ({_CELLS}) WHERE x0 IS NOT NULL), m AS (SELECT pair_id, side, min(x0) + 10 AS "left", max(x1) - 10 AS "right" FROM c GROUP BY ALL)
SELECT pair_id, side, page, tbl, row, round(greatest("left" - x0, x1 - "right"), 6) AS over FROM c JOIN m USING (pair_id, side) WHERE greatest("left" - x0, x1 - "right") > 3""")
def tables_overflowing(spark, sf_dir):
    """What lies more than three points outside the margins."""
    c = _cells(spark, sf_dir).where("x0 is not null")
    m = c.groupBy("pair_id", "side").agg((F.min("x0") + 10).alias("left"), (F.max("x1") - 10).alias("right"))
    return T.overflowing(c, m).select("pair_id", "side", "page", "tbl", "row", F.round("over", 6).alias("over"))


_FIG = """SELECT l_orderkey AS pair_id, l_linenumber AS n, l_quantity * 4 AS w0, l_quantity * 3 AS h0, l_quantity * 4 * (1 + l_discount * 5) AS w1, l_quantity * 3 * (1 + l_discount * 5) AS h1, l_extendedprice / 1000 AS x0, l_extendedprice / 1000 + l_quantity AS x1, l_tax * 12 AS score FROM lineitem"""


@query(f"""SELECT pair_id, n, abs(w1 / w0 - 1) >= 0.15 AND abs(w1 - w0) >= 12 AND w1 / w0 BETWEEN 1 AND 2 AS resized, CASE WHEN abs((x0 + x1) / 2 / 100 - 0.5) <= 0.08 THEN 'centre' WHEN (x0 + x1) / 2 / 100 < 0.5 THEN 'left' ELSE 'right' END AS place,
CASE WHEN score >= 0.85 THEN 'same' WHEN w0 * h0 > 14000 AND score >= 0.78 THEN 'same' WHEN w0 * h0 <= 14000 AND score < 0.55 THEN 'differs' ELSE 'review' END AS status, w0 >= 60 AND h0 >= 60 AND w0 * h0 >= 6000 AS meaningful FROM ({_FIG})""")
def figure_changes(spark, sf_dir):
    """Sizes, places and what became of figures."""
    q, d = F.col("l_quantity"), 1 + F.col("l_discount") * 5
    f = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("n"), (q * 4).alias("w0"), (q * 3).alias("h0"), (q * 4 * d).alias("w1"), (q * 3 * d).alias("h1"), (F.col("l_extendedprice") / 1000).alias("x0"), (F.col("l_extendedprice") / 1000 + q).alias("x1"), (F.col("l_tax") * 12).alias("score"))
    ratio = F.when(F.col("w0") * F.col("h0") > 14000, 2.0).otherwise(1.0)
    return f.select("pair_id", "n", P.is_resized(F.col("w0"), F.col("h0"), F.col("w1"), F.col("h1")).alias("resized"), P.place_class(F.col("x0"), F.col("x1"), F.lit(100.0)).alias("place"), P.leftover_status(F.col("score"), F.lit(0.0), ratio, F.lit(False)).alias("status"), P.meaningful(F.col("w0"), F.col("h0")).alias("meaningful"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'empty stream' WHEN o_orderkey % 5 = 0 THEN 'cannot be decoded' WHEN o_orderkey % 3 = 0 THEN 'outside the page' WHEN o_orderkey % 1000 = 0 THEN 'no pixels' WHEN o_orderkey % 1000 >= 100 AND o_totalprice / 100000 < 1 THEN 'blank' END AS reason,
0.1 >= 0.05 AND (o_totalprice / 1000000) / 0.1 < 0.65 AS blurred FROM orders""")
def figures_broken(spark, sf_dir):
    """I9, I11, CH30: images that show nothing, or less than they did."""
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", P.broken_reason(k % 7, k % 5 != 0, k % 3 == 0, k % 1000, F.col("o_totalprice") / 100000).alias("reason"), P.is_blurred(F.lit(0.1), F.col("o_totalprice") / 1000000).alias("blurred"))


@query("""WITH n AS (SELECT l_orderkey AS pair_id, list(DISTINCT l_linenumber) AS a, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R'), []) AS b FROM lineitem GROUP BY l_orderkey)
SELECT pair_id, CASE WHEN len(b) = 0 AND len(a) >= 4 THEN 'callouts stripped' WHEN len(b) > 0 THEN 'callout number missing' END AS message FROM n WHERE len(b) < len(a)""")
def figure_numbers_lost(spark, sf_dir):
    """Callout numbers that are gone."""
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("b"))
    return n.where("size(b) < size(a)").select("pair_id", P.numbers_lost(F.col("a"), F.col("b")).alias("message"))


@query(f"""WITH b AS (SELECT pair_id, side, count(*) AS n, max(x0) - min(x0) AS l, max(x1) - min(x1) AS r, max(x0 + x1) - min(x0 + x1) AS c FROM ({_CELLS}) WHERE x0 IS NOT NULL GROUP BY ALL)
SELECT pair_id, side, CASE WHEN n < 3 THEN 'unknown' WHEN l <= 3 AND r <= 3 THEN 'justified' WHEN l <= 3 THEN 'left' WHEN r <= 3 THEN 'right' WHEN c / 2 <= 12 THEN 'center' ELSE 'unknown' END AS alignment FROM b""")
def text_alignments(spark, sf_dir):
    """How lines are aligned."""
    return L.alignment(_cells(spark, sf_dir).where("x0 is not null"), ["pair_id", "side"])


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey AS pair_id, CASE o_orderkey % 3 WHEN 0 THEN 'uri' WHEN 1 THEN 'goto' ELSE 'named' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'http://a.com/' WHEN 1 THEN 'file:b' ELSE 'foo:' || o_orderpriority END AS uri, CAST(o_orderkey % 30 AS INT) AS target_page, o_orderstatus AS dest_name, o_totalprice / 10000 AS wide FROM orders)
SELECT id, CASE WHEN wide < 2 THEN 'hotspot too small' WHEN kind = 'uri' AND NOT regexp_matches(uri, '(?i)^(https?|mailto|tel|ftp):') AND uri <> 'file:b' THEN 'address cannot be used' WHEN kind = 'goto' AND NOT target_page BETWEEN 0 AND 19 THEN 'page does not exist' WHEN kind = 'named' AND dest_name <> 'O' THEN 'name does not exist' END AS problem FROM l""")
def link_problems(spark, sf_dir):
    """K1: links whose box, scheme, page or name is wrong."""
    k = F.col("o_orderkey")
    uri = F.when(k % 5 == 0, "http://a.com/").when(k % 5 == 1, "file:b").otherwise(F.concat(F.lit("foo:"), F.col("o_orderpriority")))
    links = _t(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("pair_id"), F.when(k % 3 == 0, "uri").when(k % 3 == 1, "goto").otherwise("named").alias("kind"), uri.alias("uri"), (k % 30).cast("int").alias("target_page"), F.col("o_orderstatus").alias("dest_name"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("o_totalprice") / 10000).alias("x1"), F.lit(9.0).alias("y1"))
    pairs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"))
    found = L.link_status(links, pairs.withColumn("uri", F.lit("FILE:b/")), F.lit(20), pairs.withColumn("dest_name", F.lit("O")))
    return found.select("id", "problem")


@query("""WITH p AS (SELECT l_orderkey AS pair_id, CAST(unnest(range(0, 12)) AS INT) AS page FROM (SELECT DISTINCT l_orderkey FROM lineitem)), m AS (SELECT DISTINCT l_orderkey AS pair_id, l_linenumber AS page, CAST(l_linenumber * 2 + l_orderkey % 3 AS INT) AS s FROM lineitem),
a AS (SELECT p.pair_id, p.page, m.page AS ap, m.s AS a_s FROM p ASOF LEFT JOIN m ON p.pair_id = m.pair_id AND p.page >= m.page), b AS (SELECT a.*, m.page AS bp, m.s AS bs FROM a ASOF LEFT JOIN m ON a.pair_id = m.pair_id AND a.page <= m.page),
k AS (SELECT pair_id, page, coalesce(ap, bp) AS ap, coalesce(a_s, bs) AS a_s, coalesce(bp, ap) AS bp, coalesce(bs, a_s) AS bs FROM b)
SELECT pair_id, page, CAST(greatest(round_even(a_s + CASE WHEN bp > ap THEN (page - ap) / (bp - ap) * (bs - a_s) ELSE page - ap END, 0), 0) AS INT) AS stage_page FROM k""")
def pages_paired(spark, sf_dir):
    """Y2: facing pages by interpolation between waypoints."""
    i = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), "l_linenumber")
    pages = i.select("pair_id").distinct().select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("page"))
    return S.page_pairs(pages, i.select("pair_id", F.col("l_linenumber").alias("prod_page"), (F.col("l_linenumber") * 2 + F.col("pair_id") % 3).cast("int").alias("stage_page")).distinct())


@query(f"""WITH c AS ({_CELLS}), i AS (SELECT pair_id, side, page, max((x1 - x0) * (y1 - y0)) AS area FROM c WHERE x0 IS NOT NULL GROUP BY ALL), w AS (SELECT pair_id, side, page, count(*) AS n FROM c GROUP BY ALL)
SELECT pair_id, side, page FROM i JOIN w USING (pair_id, side, page) WHERE area >= 0.75 * 20 * 20 AND n <= 8""")
def pages_scanned(spark, sf_dir):
    """Pages that are one picture."""
    c = _cells(spark, sf_dir)
    pages = c.select("pair_id", "side", "page").distinct().withColumn("width", F.lit(20.0)).withColumn("height", F.lit(20.0))
    return S.scanned_pages(c.where("x0 is not null"), c, pages)


@query("""SELECT DISTINCT a.pair_id, a.norm FROM (SELECT user_id AS pair_id, event_type || (event_id % 40) AS norm FROM events WHERE value > 50) a WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.pair_id AND e.event_type || (e.event_id % 40) = a.norm AND e.value <= 50)""")
def words_in_artwork(spark, sf_dir):
    """Recognised words that are no text of the page."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), F.lit("prod").alias("side"), F.lit(0).alias("page"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("norm"), "value")
    return S.artwork_words(e.where("value > 50").drop("value"), e.where("value <= 50").drop("value")).select("pair_id", "norm").distinct()


@query(f"""WITH {_LINES}, bp AS (SELECT pair_id, string_agg(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '' ORDER BY ord) AS blob FROM prod GROUP BY pair_id), bs AS (SELECT pair_id, string_agg(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '' ORDER BY ord) AS blob FROM stage GROUP BY pair_id),
q AS (SELECT pair_id, ord, CASE WHEN ord % 3 = 0 THEN 'Text added' WHEN ord % 3 = 1 THEN 'Text missing' ELSE 'List indent changed' END AS message, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM prod)
SELECT q.pair_id, ord, message, CASE WHEN message = 'Text missing' AND length(k) >= 14 AND coalesce(contains(bs.blob, k), false) THEN 'drop' WHEN message = 'Text added' AND length(k) >= 14 AND contains(bp.blob, k) THEN 'drop' WHEN message = 'List indent changed' THEN 'review' ELSE 'confirmed' END AS verdict FROM q JOIN bp USING (pair_id) LEFT JOIN bs ON bs.pair_id = q.pair_id""")
def verdicts_by_presence(spark, sf_dir):
    """Findings that the other side's text refutes are dropped, some are only for review."""
    prod, stage = _editions(spark, sf_dir)
    text = lambda df, side: df.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", X.ascii_blob(F.col("text")).alias("t")))), lambda s: s["t"]), "").alias("blob")).withColumn("side", F.lit(side))
    message = F.when(F.col("ord") % 3 == 0, "Text added").when(F.col("ord") % 3 == 1, "Text missing").otherwise("List indent changed")
    rows = prod.select("pair_id", "ord", message.alias("message"), F.col("text").alias("quote"), F.lit("confirmed").alias("confidence"))
    return V.verdict(rows, text(prod, "prod").unionByName(text(stage, "stage"))).select("pair_id", "ord", "message", "verdict")


@query(f"""WITH i AS ({_ISSUES}), near AS (SELECT DISTINCT c_custkey AS pair_id, CAST(unnest(range(c_nationkey - 3, c_nationkey + 4)) AS INT) AS page FROM customer WHERE c_acctbal > 3000)
SELECT i.id, CASE WHEN near.page IS NOT NULL THEN 'review' ELSE confidence END AS confidence FROM i LEFT JOIN near USING (pair_id, page)""")
def issues_softened(spark, sf_dir):
    """Short quotes near a large picture are only for review."""
    images = _t(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("pair_id"), F.col("c_nationkey").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(100.0).alias("y1"))
    return V.softened(_issues(spark, sf_dir).withColumn("quote", F.col("message")), images).select("id", "confidence")


@query(f"""WITH {_LINES}, f AS (SELECT *, ord % 7 < 5 AS i FROM prod), g AS (SELECT *, sum(CASE WHEN i = p THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY ord) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY pair_id ORDER BY ord) AS p FROM f)) SELECT pair_id, ord FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, run) AS n FROM g) WHERE NOT (i AND n >= 4)""")
def index_runs_stripped(spark, sf_dir):
    """Runs of index lines taken out."""
    rows = R.lines(_t(spark, sf_dir, "documents")).select("pair_id", "ord", F.when(F.col("ord") % 7 < 5, "Setup 12").otherwise("Some prose.").alias("text"))
    return V.index_runs(rows).select("pair_id", "ord")


@query(f"""SELECT pair_id, heading, min(id) AS ord, string_agg(title || 'x' || n, ';' ORDER BY id) AS notes FROM (SELECT pair_id, section AS heading, message AS title, min(id) AS id, count(*) AS n FROM ({_ISSUES}) GROUP BY ALL) GROUP BY pair_id, heading""")
def notes_by_heading(spark, sf_dir):
    """Notes by heading, repeats as a count."""
    n = V.grouped_by_heading(_issues(spark, sf_dir).select("pair_id", F.col("section").alias("heading"), F.col("message").alias("title"), F.col("id").alias("ord")))
    return n.select("pair_id", "heading", "ord", F.array_join(F.transform("notes", lambda x: F.concat(x["title"], F.lit("x"), x["n"].cast("string"))), ";").alias("notes"))


@query("""SELECT o_orderkey, CAST(round_even(o_custkey % 50 + (CASE WHEN 40 > 10 THEN (10 + o_orderkey % 31 - 10) / 30.0 ELSE 0 END) * (60 - o_custkey % 50), 0) AS INT) AS page FROM orders""")
def pages_in_proportion(spark, sf_dir):
    """A page in proportion to its chapter's range."""
    start = F.col("o_custkey") % 50
    return _t(spark, sf_dir, "orders").select("o_orderkey", V.proportional_page(10 + F.col("o_orderkey") % 31, F.lit(10), F.lit(40), start, F.lit(60)).alias("page"))


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, ord, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM prod), b AS (SELECT pair_id, ord, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM stage), j AS (SELECT a.pair_id, a.ord, a.w AS x, b.w AS y FROM a JOIN b USING (pair_id, ord)),
n AS (SELECT pair_id, ord, t, count(*) AS n FROM (SELECT pair_id, ord, unnest(x) AS t FROM j) GROUP BY ALL), m AS (SELECT pair_id, ord, t, count(*) AS m FROM (SELECT pair_id, ord, unnest(y) AS t FROM j) GROUP BY ALL), s AS (SELECT pair_id, ord, sum(least(n, m)) AS s FROM n JOIN m USING (pair_id, ord, t) GROUP BY ALL)
SELECT j.pair_id, j.ord, round(CASE WHEN len(x) + len(y) > 0 THEN 2.0 * coalesce(s, 0) / (len(x) + len(y)) ELSE 0 END, 6) AS f1 FROM j LEFT JOIN s USING (pair_id, ord)""")
def lines_by_f1(spark, sf_dir):
    """How alike facing lines are, by the words that they share."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    a, b = _editions(spark, sf_dir)
    j = a.select("pair_id", "ord", words(F.col("text")).alias("x")).join(b.select("pair_id", "ord", words(F.col("text")).alias("y")), ["pair_id", "ord"])
    return j.select("pair_id", "ord", F.round(V.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, page, lower(unnest(regexp_extract_all(text, '\\p{{L}}{{6,}}'))) AS token, ord FROM prod), b AS (SELECT pair_id, page, lower(unnest(regexp_extract_all(text, '\\p{{L}}{{6,}}'))) AS token FROM stage),
n AS (SELECT pair_id, page, token, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT pair_id, page, token, count(*) AS m FROM b GROUP BY ALL)
SELECT n.pair_id, n.page, CAST(sum(n - coalesce(m, 0)) AS BIGINT) AS lost FROM n LEFT JOIN m USING (pair_id, page, token) WHERE n > coalesce(m, 0) GROUP BY ALL""")
def pools_settled(spark, sf_dir):
    """B3, CH23: what a page's pool of words really lacks, repeats counted."""
    a, b = (df.select("pair_id", "page", F.col("ord").alias("row"), F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0)), F.lower)).alias("token")) for df in _editions(spark, sf_dir))
    return V.settled(a, b, ["pair_id", "page"]).groupBy("pair_id", "page").agg(F.sum(F.size("lost")).cast("long").alias("lost"))


@query(f"""WITH h AS (SELECT l_orderkey AS pair_id, l_linenumber AS ord, l_returnflag = 'A' AS pb, l_linestatus = 'F' AS sb, l_quantity AS ps, l_quantity + l_tax * 10 AS ss FROM lineitem) SELECT pair_id, count(*) AS n, round(avg(CASE WHEN pb <> sb OR abs(ps - ss) > 0.75 THEN 1.0 ELSE 0.0 END), 6) AS share FROM h WHERE ord <= 40 GROUP BY pair_id HAVING count(*) >= 3 AND avg(CASE WHEN pb <> sb OR abs(ps - ss) > 0.75 THEN 1.0 ELSE 0.0 END) >= 0.6""")
def heading_styles_changed(spark, sf_dir):
    """Pairs whose headings mostly changed style."""
    q = F.col("l_quantity")
    h = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("ord"), (F.col("l_returnflag") == "A").alias("prod_bold"), (F.col("l_linestatus") == "F").alias("stage_bold"), q.alias("prod_size"), (q + F.col("l_tax") * 10).alias("stage_size"))
    return S.heading_style_changed(h).withColumn("share", F.round("share", 6))


@query(f"""WITH g AS (SELECT id, pair_id, page, category AS gap FROM ({_ISSUES}) WHERE severity = 'warning'), f AS (SELECT DISTINCT pair_id, page FROM ({_ISSUES}) WHERE severity = 'error')
SELECT id, pair_id, page, gap FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY page, gap, id) AS r FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.pair_id = g.pair_id AND f.page = g.page)) WHERE r <= 100000""")
def gaps_not_covered(spark, sf_dir):
    """Gaps that no other finding speaks of."""
    i = _issues(spark, sf_dir)
    g = i.where("severity = 'warning'").select("id", "pair_id", "page", F.col("category").alias("gap"))
    return S.not_covered(g, i.where("severity = 'error'"), ["pair_id", "page"], most=100_000)


@query()
def shapes_clustered(spark, sf_dir):
    """Shapes grown into figures (fix-point per page; tested against its definition)."""
    c = _cells(spark, sf_dir).where("x0 is not null").select("pair_id", "side", "page", F.col("row").alias("shape"), "x0", "y0", "x1", "y1")
    return P.clusters(c)


@query()
def rows_closest(spark, sf_dir):
    """Left-over rows by their common words, best first."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    side = lambda name: R.part_grids(part, name).select("tbl", "row", F.explode(X.cell_tokens(F.col("text"))).alias("token"))
    return T.closest_rows(side("prod"), side("stage"))


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, {_SQUASH} AS key, count(*) AS n FROM prod GROUP BY ALL), b AS (SELECT pair_id, {_SQUASH} AS key, count(*) AS m FROM stage GROUP BY ALL) SELECT pair_id, CAST(coalesce(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)), 0) AS BIGINT) AS lost, CAST(coalesce(sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)), 0) AS BIGINT) AS gained FROM a FULL JOIN b USING (pair_id, key) WHERE coalesce(n, 0) <> coalesce(m, 0) GROUP BY pair_id""")
def text_bags(spark, sf_dir):
    """C15, CH15, CH18: the whole-book scan, lines as bags."""
    a, b = (df.select("pair_id", X.squash_title(F.col("text")).alias("key")) for df in _editions(spark, sf_dir))
    return C.bag_difference(a, b, ["pair_id", "key"]).groupBy("pair_id").agg(F.sum("lost").alias("lost"), F.sum("gained").alias("gained"))
