"""Queries of the heading, section, finding and chapter operators. Their inputs are relations in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import chapters as K
from palimpsest.operators import findings as N
from palimpsest.operators import headings as H
from palimpsest.operators import issues as I
from palimpsest.operators import sections as S
from palimpsest.plans.queries import _LINES, _editions, _t, query
from palimpsest.sources import relations as R


def rel(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation; {prod} and {stage} are the lines of the two editions, other names in braces tables."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    known = dict(zip(("prod", "stage"), _editions(spark, sf_dir), strict=True)) if names & {"prod", "stage"} else {}
    return spark.sql(sql, **{n: known[n] if n in known else _t(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


_SPAN = """SELECT pair_id, '%s' AS side, page, CAST(floor(y / 2) AS INT) AS block, CAST(y %% 2 AS INT) AS line, 0 AS span, CASE WHEN ord %% 7 = 0 THEN 'Part ' || CAST(ord AS STRING) ELSE text END AS text, 'Sans' AS font,
CAST(CASE WHEN ord %% 7 = 0 THEN 16 ELSE 10 END AS DOUBLE) AS size, CASE WHEN (pair_id + ord) %% 5 = 0 THEN 16 ELSE 0 END AS flags, CAST(72 AS DOUBLE) AS x0, CAST(y * 36 AS DOUBLE) AS y0, CAST(72 + 5 * length(text) AS DOUBLE) AS x1, CAST(y * 36 + 12 AS DOUBLE) AS y1, ord FROM {%s}"""
SPANS = " UNION ALL ".join(_SPAN % (s, s) for s in ("prod", "stage"))
ENTRIES = " UNION ALL ".join(f"SELECT pair_id, '{s}' AS side, CAST(floor(ord / 7) AS INT) AS ord, CASE WHEN ord % 21 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN (pair_id + ord) % 10 = 0 THEN 'Contents' ELSE 'Part ' || CAST(CAST(floor(ord / 21) AS INT) AS STRING) END AS title, page, CAST(y AS DOUBLE) AS y FROM {{{s}}} WHERE ord % 7 = 0" for s in ("prod", "stage"))
_WITH_LINES = f"WITH {_LINES}, spans AS ({duck(SPANS)}), entries AS ({duck(ENTRIES)})"
_CONTENTS = "lower(title) = 'contents'"


@query(f"""{_WITH_LINES}, w AS (SELECT pair_id, side, size, flags = 16 AS heavy, sum(length(trim(text))) AS n FROM spans WHERE page < 20 GROUP BY ALL)
SELECT pair_id, side, size AS body_size, heavy AS body_heavy FROM w QUALIFY row_number() OVER (PARTITION BY pair_id, side ORDER BY n DESC, size DESC, heavy DESC) = 1""")
def body_styles(spark, sf_dir):
    """H2: the style that most characters of the first twenty pages are set in."""
    return H.body_style(rel(spark, sf_dir, SPANS))


@query(f"""{_WITH_LINES} SELECT pair_id, side, page, md5(string_agg(text, chr(10) ORDER BY block, line)) AS digest, count(*) AS n FROM spans GROUP BY ALL""")
def page_texts(spark, sf_dir):
    """S3: every page's text, its lines in order."""
    t = R.page_texts(rel(spark, sf_dir, SPANS))
    return t.select("pair_id", "side", "page", F.md5("text").alias("digest"), F.size(F.split("text", "\n", -1)).cast("long").alias("n"))


_STYLED = f"""{_WITH_LINES}, clean AS (SELECT * EXCLUDE (text), trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM spans),
w AS (SELECT pair_id, side, size, flags = 16 AS heavy, sum(length(trim(text))) AS n FROM spans WHERE page < 20 GROUP BY ALL), body AS (SELECT pair_id, side, size AS bs, heavy AS bh FROM w QUALIFY row_number() OVER (PARTITION BY pair_id, side ORDER BY n DESC, size DESC, heavy DESC) = 1),
styled AS (SELECT c.*, size >= 1.3 * bs OR (flags = 16 AND NOT bh AND size >= 0.95 * bs) AS styled FROM clean c JOIN body USING (pair_id, side)), pages AS (SELECT pair_id, side, count(DISTINCT page) AS n_pages FROM spans GROUP BY ALL)"""


def _styled_lines(spark, sf_dir):
    spans = rel(spark, sf_dir, SPANS)
    return spans, H.styled(H.printed_lines(spans), H.body_style(spans))


@query(f"""{_STYLED}, fit AS (SELECT *, count(*) OVER (PARTITION BY pair_id, side, text) AS often FROM styled WHERE styled AND length(text) BETWEEN 3 AND 90 AND NOT regexp_matches(text, '[.!?;,]\\s*$') AND NOT regexp_matches(text, '^(?:[-–]\\s*)?(?:[0-9]{{1,4}}|[ivxlc]{{1,6}})(?:\\s*[-–])?$'))
SELECT pair_id, side, title, page, y FROM (SELECT f.pair_id, f.side, text AS title, page, y0 AS y FROM fit f JOIN pages USING (pair_id, side) WHERE often <= greatest(3, n_pages / 3))""")
def headings_by_style(spark, sf_dir):
    """H3: lines set larger or heavier than the body that can be headings."""
    spans, lines = _styled_lines(spark, sf_dir)
    none = spans.where(F.lit(False)).select("pair_id", "side", "page", "x0", "y0", "x1", "y1")
    return H.synthesized(lines, none, none, spans.select("pair_id", "side", "page").distinct()).select("pair_id", "side", "title", "page", "y")


@query(f"""{_STYLED}, lines AS (SELECT pair_id, side, page, y0 AS y, text AS title, styled FROM styled WHERE text <> ''), blocks AS (SELECT pair_id, side, page, min(y0) AS y, string_agg(text, ' ' ORDER BY line) AS title, bool_and(styled) AS styled FROM styled WHERE text <> '' GROUP BY pair_id, side, page, block HAVING count(*) BETWEEN 2 AND 3)
SELECT pair_id, side, lower(title) AS key, count(*) AS n, count(*) FILTER (WHERE styled) AS n_styled, min(page) AS page FROM (SELECT * FROM lines UNION ALL SELECT * FROM blocks) WHERE length(title) <= 90 AND NOT regexp_matches(title, '(?i)\\.{{4,}}|(?:\\.\\s){{4,}}|\\btable of contents\\b') GROUP BY ALL""")
def heading_line_index(spark, sf_dir):
    """H4: where short lines, and blocks of two or three, are printed."""
    _, lines = _styled_lines(spark, sf_dir)
    return H.line_index(lines).groupBy("pair_id", "side", "key").agg(F.count("*").alias("n"), F.count_if("styled").alias("n_styled"), F.min("page").alias("page"))


@query(f"""{_WITH_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, title ORDER BY page, y, ord) AS nth FROM entries), p AS (SELECT * FROM k WHERE side = 'prod'), s AS (SELECT * FROM k WHERE side = 'stage'),
f AS (SELECT p.pair_id, p.page AS pp, p.y AS py, s.page AS sp, s.y AS sy FROM p JOIN s USING (pair_id, title, nth) QUALIFY row_number() OVER (PARTITION BY p.pair_id ORDER BY p.page, p.y, s.page, s.y) = 1)
SELECT k.pair_id, side, ord, title, {_CONTENTS} OR coalesce(CASE WHEN side = 'prod' THEN page < pp OR (page = pp AND y < py) ELSE page < sp OR (page = sp AND y < sy) END, false) AS excluded FROM k LEFT JOIN f USING (pair_id)""")
def front_matter(spark, sf_dir):
    """H7: headings before the first that both sides share."""
    return H.front_matter(rel(spark, sf_dir, ENTRIES)).select("pair_id", "side", "ord", "title", "excluded")


@query(f"""{_WITH_LINES}, o AS (SELECT pair_id, regexp_replace(lower(title), '\\s+', '', 'g') AS k, min(side) AS side, count(DISTINCT side) AS n, min_by(title, page * 1000 + y) AS title FROM entries WHERE NOT {_CONTENTS} GROUP BY pair_id, k)
SELECT pair_id, side, CASE WHEN side = 'prod' THEN 'section-missing' ELSE 'section-added' END AS type, title FROM o WHERE n = 1""")
def headings_one_sided(spark, sf_dir):
    """CH8: headings that one side alone has, excluded ones among them."""
    return H.one_sided_headings(rel(spark, sf_dir, ENTRIES))


@query(f"""{_WITH_LINES}, e AS (SELECT *, (SELECT min(o.y) FROM entries o WHERE o.pair_id = e.pair_id AND o.side = e.side AND o.page = e.page AND o.y > e.y + 1) AS later FROM entries e), b AS (SELECT *, greatest(0, y - 4) AS y0, least(400, greatest(0, y - 4) + 320) AS whole FROM e)
SELECT pair_id, side, ord, title, page, CAST(y0 AS DOUBLE) AS y0, CAST(CASE WHEN least(whole, coalesce(later, 400)) - y0 < 8 THEN whole ELSE least(whole, coalesce(later, 400)) END AS DOUBLE) AS y1 FROM b""")
def heading_bands(spark, sf_dir):
    """Where each heading's section starts."""
    entries = rel(spark, sf_dir, ENTRIES)
    return H.bands(entries, entries.select("pair_id", "side", "page").distinct().withColumn("height", F.lit(400.0)))


@query(f"""{_WITH_LINES}, t AS (SELECT *, lead(page) OVER w AS end_page, lead(y) OVER w AS end_y FROM entries WHERE level = 1 WINDOW w AS (PARTITION BY pair_id, side ORDER BY page, y, ord)), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, title ORDER BY page, y, ord) AS nth FROM t WHERE NOT {_CONTENTS})
SELECT p.pair_id, p.title, p.page AS prod_page, p.end_page AS prod_end, s.page AS stage_page, s.end_page AS stage_end FROM n p JOIN n s ON p.side = 'prod' AND s.side = 'stage' AND p.pair_id = s.pair_id AND p.title = s.title AND p.nth = s.nth""")
def chapters_shared(spark, sf_dir):
    """CH1, CH4: the chapters that both sides have; contents in none."""
    c = H.chapters(rel(spark, sf_dir, ENTRIES).withColumn("excluded", X.is_excluded_heading(F.col("title"))))
    return c.select("pair_id", "title", F.col("prod.page").alias("prod_page"), F.col("prod.end_page").alias("prod_end"), F.col("stage.page").alias("stage_page"), F.col("stage.end_page").alias("stage_end"))


@query()
def headings_resolved(spark, sf_dir):
    """H1, H5, H6, H8: the headings that all comparisons go by (cross-seeding has no SQL form; tested against its definition)."""
    spans = rel(spark, sf_dir, SPANS)
    pages = spans.select("pair_id", "side", "page").distinct().withColumn("height", F.lit(792.0))
    # The candidate's outline names fewer headings than it prints.
    outline = rel(spark, sf_dir, ENTRIES).where("side = 'prod' or ord % 3 = 0").withColumn("dest_y", F.lit(700.0)).drop("y").withColumn("title", F.concat(F.lit("Part "), (F.col("ord") * 7).cast("string")))
    none = spans.where(F.lit(False)).select("pair_id", "side", "page", "x0", "y0", "x1", "y1")
    return H.resolved(outline, spans, none, none, pages)


@query(f"""{_WITH_LINES}, n AS (SELECT pair_id, side, page, round_even(x1, 0) AS "right", count(*) AS n FROM spans GROUP BY ALL) SELECT pair_id, side, page, "right" FROM n QUALIFY row_number() OVER (PARTITION BY pair_id, side, page ORDER BY n DESC, "right" DESC) = 1""")
def column_edges(spark, sf_dir):
    """L2: where most lines of a page end."""
    return H.column_right(H.printed_lines(rel(spark, sf_dir, SPANS)))


@query(f"""{_WITH_LINES}, b AS (SELECT pair_id, side, page, block, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(y1 - y0) AS lh, arg_min(size, line) AS size, arg_max(x1, line) AS last_x1, arg_min(text, line) AS first_text, bool_and(flags = 16) AS heavy FROM spans WHERE trim(text) <> '' GROUP BY ALL),
r AS (SELECT pair_id, side, page, "right" FROM (SELECT pair_id, side, page, round_even(x1, 0) AS "right", count(*) AS n FROM spans WHERE trim(text) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pair_id, side, page ORDER BY n DESC, "right" DESC) = 1),
g AS (SELECT b.*, CASE WHEN y0 - lag(y1) OVER w <= 1.4 * lag(lh) OVER w AND abs(x0 - lag(x0) OVER w) <= 8 AND abs(size - lag(size) OVER w) <= 1 AND lag(last_x1) OVER w >= "right" - 12 AND NOT regexp_matches(trim(regexp_replace(first_text, '\\s+', ' ', 'g')), '^\\s*(?:\\(?[0-9]{{1,3}}\\s?[.)]|\\(?[A-Za-z]\\s?[.)]|[•◦▪▸‣⁃·])(?:\\s|$)') AND size < 1.2 * lag(size) OVER w AND NOT (lag(heavy) OVER w AND lag(n_lines) OVER w = 1) THEN 0 ELSE 1 END AS starts
FROM b JOIN r USING (pair_id, side, page) WINDOW w AS (PARTITION BY pair_id, side, page ORDER BY y0, block))
SELECT pair_id, side, page, block, sum(starts) OVER (PARTITION BY pair_id, side, page ORDER BY y0, block) AS island FROM g""")
def paragraphs_wrapped(spark, sf_dir):
    """L2, L3: blocks of one paragraph, by their geometry. Lines lie 24 points apart here, so tall ones are made of the spans' boxes."""
    lines = H.printed_lines(rel(spark, sf_dir, SPANS))
    return H.wrapped_paragraphs(H.block_geometry(lines), H.column_right(lines)).select("pair_id", "side", "page", "block", "island")


BLOCKS = "SELECT l_orderkey AS pair_id, l_linenumber AS block, CASE l_partkey % 4 WHEN 0 THEN '12mm 5' WHEN 1 THEN 'Turn the unit off now.' WHEN 2 THEN '- 7 -' ELSE 'Front view' END AS text, l_discount * 8 AS in_table, l_tax * 8 AS in_figure, l_suppkey % 9 = 0 AS is_heading, l_suppkey % 11 = 0 AS is_furniture FROM {lineitem}"


@query(f"""SELECT pair_id, block, CASE WHEN is_furniture OR text = '- 7 -' THEN 'chrome' WHEN is_heading THEN 'heading' WHEN in_table >= 0.5 THEN 'table' WHEN in_figure >= 0.5 THEN 'figure' WHEN text = '12mm 5' THEN 'value' ELSE 'prose' END AS kind FROM ({duck(BLOCKS)})""")
def blocks_classified(spark, sf_dir):
    """Every block with what it is."""
    return S.classified(rel(spark, sf_dir, BLOCKS)).select("pair_id", "block", "kind")


_CJK = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ac00}-\\x{d7af}"
_TOKENS = f"regexp_extract_all(regexp_replace(lower(text), '([{_CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_SIG = f"list_filter(list_distinct(w), lambda x: (length(x) >= 3 OR regexp_matches(x, '[{_CJK}]')) AND x NOT IN ({_STOP}))"
# Every third line of the candidate is broken up, so that its words are there and its order is not.
ROWS = "SELECT pair_id, CAST(page AS BIGINT) AS section, ord, 'prose' AS kind, 'prod' AS op, text AS prod, CAST(NULL AS STRING) AS stage FROM {prod} WHERE (pair_id * 31 + ord) % 11 = 0 OR ord % 3 = 0"


def _blobs(spark, sf_dir, *keys):
    lines = rel(spark, sf_dir, "SELECT pair_id, CAST(page AS BIGINT) AS section, 'stage' AS side, ord, text FROM {stage}")
    return lines.groupBy(*keys, "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: X.alnum_blob(t["text"])), " ").alias("blob"))


def _held(scope: str, rule: str) -> str:
    return f"""WITH {_LINES}, l AS (SELECT pair_id, page, ord, text, {_TOKENS} AS w FROM prod WHERE (pair_id * 31 + ord) % 11 = 0 OR ord % 3 = 0), t AS (SELECT pair_id, {scope} AS scope, string_agg(array_to_string({_TOKENS}, ' '), ' ' ORDER BY ord) AS blob FROM stage GROUP BY ALL),
r AS (SELECT l.*, len(w) AS n, {_SIG} AS sig, blob, list_distinct(string_split(blob, ' ')) AS there FROM l LEFT JOIN t ON t.pair_id = l.pair_id AND t.scope = {"l.page" if scope == "page" else "0"}) SELECT pair_id, ord, {rule} FROM r"""


@query(_held("page", "CASE WHEN coalesce((len(sig) > 0 AND list_has_all(there, sig) AND (n <= 5 OR (n <= 14 AND len(sig) >= 3) OR (n <= 45 AND len(sig) >= 6))) OR (n > 0 AND contains(' ' || blob || ' ', ' ' || array_to_string(w, ' ') || ' ')), false) THEN 'equal' ELSE 'prod' END AS op"))
def rows_present(spark, sf_dir):
    """Rows of one side whose words the section of the other holds."""
    return S.cross_present(rel(spark, sf_dir, ROWS), _blobs(spark, sf_dir, "pair_id", "section")).select("pair_id", "ord", "op")


@query(_held("0", "CASE WHEN coalesce(len(sig) > 0 AND list_has_all(there, sig) AND (n <= 5 OR (n <= 14 AND len(sig) >= 3)), false) THEN text END AS content_match"))
def rows_present_anywhere(spark, sf_dir):
    """Rows of one side whose words the other document holds somewhere."""
    return S.whole_document_matches(rel(spark, sf_dir, ROWS), _blobs(spark, sf_dir, "pair_id")).select("pair_id", "ord", "content_match")


@query()
def rows_relocated(spark, sf_dir):
    """The best counterpart of a row anywhere in the other document (ratios have no SQL form; tested against brute force)."""
    rows = rel(spark, sf_dir, ROWS).where("(pair_id * 31 + ord) % 11 = 0")
    there = rel(spark, sf_dir, "SELECT pair_id, 'stage' AS side, text FROM {stage}")
    return S.relocated(rows, there)


@query()
def rows_aligned(spark, sf_dir):
    """B2: sections aligned kind by kind, unrelated lines kept apart (no SQL form; tested against its definition)."""
    return S.aligned_rows(rel(spark, sf_dir, " UNION ALL ".join(f"SELECT pair_id, CAST(page AS BIGINT) AS section, '{s}' AS side, ord, CASE WHEN ord % 7 = 0 THEN 'heading' ELSE 'prose' END AS kind, text FROM {{{s}}}" for s in ("prod", "stage"))))


OWN = "SELECT o_custkey AS pair_id, CAST(o_orderkey % 3 AS BIGINT) AS section, 'prose' AS kind, o_orderkey AS ord, o_orderpriority || ' for ' || CAST(o_orderkey % 5 AS STRING) || '.' AS text FROM {orders} WHERE o_orderkey % 2 = 0"
PARENT = "SELECT o_custkey AS pair_id, o_orderpriority || ' for ' || CAST(o_orderkey % 5 AS STRING) AS text FROM {orders} WHERE o_orderkey % 2 = 1"
_ONE_KEY = "replace(rtrim(text, '. '), '-', '')"


@query(f"""WITH o AS ({duck(OWN)}), p AS (SELECT pair_id, {_ONE_KEY} AS k, min(text) AS other FROM ({duck(PARENT)}) GROUP BY ALL) SELECT o.pair_id, section, ord, CASE WHEN other IS NULL THEN 'stage' ELSE 'equal' END AS op, text AS stage, other AS prod FROM o LEFT JOIN p ON o.pair_id = p.pair_id AND p.k = {_ONE_KEY.replace("text", "o.text")}""")
def rows_one_sided(spark, sf_dir):
    """A section that one side has, against the parent section of the other."""
    return S.one_sided(rel(spark, sf_dir, OWN), rel(spark, sf_dir, PARENT), "stage").select("pair_id", "section", "ord", "op", "stage", "prod")


OPS = "SELECT l_orderkey AS pair_id, CAST(l_partkey % 3 AS BIGINT) AS section, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, CASE l_suppkey % 4 WHEN 0 THEN 'equal' WHEN 1 THEN 'change' WHEN 2 THEN 'prod' ELSE 'stage' END AS op, CASE l_partkey % 6 WHEN 0 THEN 'prose' WHEN 1 THEN 'heading' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'value' ELSE 'chrome' END AS kind, CASE WHEN l_quantity > 30 THEN 'NOTE' WHEN l_quantity > 20 THEN 'Warning:' ELSE 'Note the lamp' END AS prod, CASE WHEN l_tax > 0.04 THEN '提示:' ELSE 'Lamp' END AS stage, CASE WHEN l_discount > 0.05 THEN CAST(l_linenumber AS INT) END AS page, l_tax AS y FROM {lineitem}"
_DIFFERS, _FIRST = "op <> 'equal'", "kind IN ('prose', 'heading')"


@query(f"""SELECT pair_id, section, {", ".join(f"count(*) FILTER (WHERE op = '{o}') AS {o}" for o in ("equal", "change", "prod", "stage"))}, count(*) FILTER (WHERE {_DIFFERS}) AS diff, count(*) FILTER (WHERE {_DIFFERS} AND {_FIRST}) AS primary_diff, count(*) FILTER (WHERE {_DIFFERS} AND NOT {_FIRST} AND kind <> 'chrome') AS other_diff, count(*) FILTER (WHERE {_DIFFERS} AND kind = 'chrome') AS chrome_diff,
count(*) FILTER (WHERE {_DIFFERS} AND kind <> 'chrome') AS real_diff, count(*) FILTER (WHERE kind = 'chrome') AS chrome, count(*) FILTER (WHERE op = 'equal' AND kind <> 'chrome') AS same, count(*) AS shown FROM ({duck(OPS)}) GROUP BY ALL""")
def section_counts(spark, sf_dir):
    """The numbers that a section is judged by."""
    return S.counts(rel(spark, sf_dir, OPS))


@query(f"""WITH r AS ({duck(OPS)}), c AS (SELECT pair_id, section, count(*) AS shown, count(*) FILTER (WHERE kind = 'chrome') AS chrome, count(*) FILTER (WHERE {_DIFFERS} AND kind <> 'chrome') AS real_diff, count(*) FILTER (WHERE kind = 'table') AS tables FROM r GROUP BY ALL), m AS (SELECT DISTINCT o_orderkey AS pair_id, CAST(o_custkey % 4 AS BIGINT) AS section, o_custkey % 5 <> 0 AS in_prod, o_custkey % 7 <> 0 AS in_stage, o_custkey % 13 = 0 AS excluded FROM orders)
SELECT m.pair_id, m.section, CASE WHEN excluded THEN 'excluded' WHEN NOT in_stage THEN 'missing' WHEN NOT in_prod THEN 'extra' WHEN coalesce(shown - chrome, 0) = 0 THEN 'container' WHEN tables = shown - chrome THEN 'table only' WHEN real_diff > 0 THEN 'differs' ELSE 'matched' END AS status FROM m LEFT JOIN c USING (pair_id, section)""")
def section_statuses(spark, sf_dir):
    """B1: what became of each section."""
    rows = rel(spark, sf_dir, OPS)
    tables = rows.groupBy("pair_id", "section").agg(F.count_if(F.col("kind") == "table").alias("tables"))
    matches = rel(spark, sf_dir, "SELECT DISTINCT o_orderkey AS pair_id, CAST(o_custkey % 4 AS BIGINT) AS section, o_custkey % 5 <> 0 AS in_prod, o_custkey % 7 <> 0 AS in_stage, o_custkey % 13 = 0 AS excluded FROM {orders}")
    return S.statuses(matches, S.counts(rows).join(tables, ["pair_id", "section"])).select("pair_id", "section", "status")


@query(f"""SELECT pair_id, section, ord, CASE WHEN op = 'prod' AND prod IN ('NOTE', 'Warning:') OR op = 'stage' AND stage = '提示:' THEN 'figure' ELSE kind END AS kind FROM ({duck(OPS)})""")
def callouts_refiled(spark, sf_dir):
    """Rows that are a bare callout label."""
    return S.callouts_refiled(rel(spark, sf_dir, OPS)).select("pair_id", "section", "ord", "kind")


@query(f"""WITH r AS (SELECT *, coalesce(last_value(CASE WHEN page IS NOT NULL THEN page * 1000 + CAST(y * 100 AS INT) END IGNORE NULLS) OVER (PARTITION BY pair_id, section ORDER BY ord ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN page IS NOT NULL THEN page * 1000 + CAST(y * 100 AS INT) END IGNORE NULLS) OVER (PARTITION BY pair_id, section ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS place FROM ({duck(OPS)}))
SELECT pair_id, section, ord, place // 1000 AS page, CASE WHEN place IS NOT NULL THEN dense_rank() OVER (PARTITION BY pair_id, section ORDER BY place NULLS FIRST) - CASE WHEN bool_or(place IS NULL) OVER (PARTITION BY pair_id, section) THEN 1 ELSE 0 END END AS number FROM r""".replace("- CASE WHEN bool_or(place IS NULL) OVER (PARTITION BY pair_id, section) THEN 1 ELSE 0 END", "- 0"))
def rows_located(spark, sf_dir):
    """Rows without a place have their neighbour's; places are numbered."""
    return S.located(rel(spark, sf_dir, OPS)).select("pair_id", "section", "ord", F.col("page").cast("long").alias("page"), F.col("number").cast("long").alias("number"))


@query(f"""SELECT r.pair_id, r.section, r.ord, CASE WHEN op = 'prod' AND len(w) > 0 AND list_has_all(there, w) THEN 'equal' ELSE op END AS op FROM (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(prod), '[\\p{{L}}\\p{{N}}]+')), lambda x: length(x) >= 3) AS w FROM ({duck(OPS)})) r
LEFT JOIN (SELECT DISTINCT o_orderkey AS pair_id, CAST(s AS BIGINT) AS section, CASE WHEN o_custkey % 2 = 0 THEN ['note', 'the', 'lamp'] ELSE ['warning'] END AS there FROM orders, (SELECT unnest([0, 1, 2]) AS s)) t ON t.pair_id = r.pair_id AND t.section = r.section AND r.op = 'prod'""")
def rows_read_in_pictures(spark, sf_dir):
    """Rows whose words are read in the other side's pictures."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.explode(F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("note"), F.lit("the"), F.lit("lamp"))).otherwise(F.array(F.lit("warning")))).alias("word"))
    words = o.select("pair_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("section"), F.lit("stage").alias("side"), "word")
    return S.read_in_pictures(rel(spark, sf_dir, OPS), words).select("pair_id", "section", "ord", "op")


# ------------------------------------------------------------------ findings
SLICES = "SELECT l_orderkey AS pair_id, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, l_partkey % 2 AS a, l_suppkey % 2 AS b, l_partkey % 3 AS la, l_suppkey % 3 AS lb FROM {lineitem}"


@query(f"""SELECT pair_id, ord, CASE WHEN a > 0 AND b > 0 THEN 'Changed text' WHEN a > 0 THEN 'Missing text' WHEN b > 0 THEN 'Added text' WHEN la > 0 AND lb > 0 THEN 'Minor text difference' END AS message, CASE WHEN a = 0 AND b = 0 AND la > 0 AND lb > 0 THEN 'review' ELSE 'confirmed' END AS confidence FROM ({duck(SLICES)})""")
def slice_messages(spark, sf_dir):
    """What a differing slice is, by what the presence tests left of it."""
    r = rel(spark, sf_dir, SLICES)
    some = lambda n: F.array_repeat(F.lit("x"), F.col(n).cast("int"))
    m = N.slice_message(some("a"), some("b"), some("la"), some("lb"))
    return r.select("pair_id", "ord", m.alias("message"), F.coalesce(N.slice_severity(m)[1], F.lit("confirmed")).alias("confidence"))


CODED = " UNION ALL ".join(f"SELECT pair_id, CAST(page AS BIGINT) AS section, '{s}' AS side, ord, CASE WHEN ord % {k} = 0 THEN replace(text, ' ', '(cid:' || CAST(ord AS STRING) || ')') WHEN ord % 5 = {m} THEN chr(7) || text ELSE text END AS text FROM {{{s}}}" for s, k, m in (("prod", 4, 1), ("stage", 3, 2)))
_BAD = "regexp_extract_all(text, '[\\x{fffd}\\x{fffe}\\x{ffff}\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\(cid:\\s?[0-9]+\\)')"


@query(f"""WITH {_LINES}, f AS (SELECT pair_id, section, side, unnest({_BAD}) AS a FROM ({duck(CODED)})), k AS (SELECT pair_id, section, side, CASE WHEN a LIKE '(cid:%' THEN '(cid:N)' ELSE a END AS a, count(*) AS n FROM f GROUP BY ALL), j AS (SELECT *, count(*) OVER (PARTITION BY pair_id, section, a) = 1 AS fresh FROM k)
SELECT pair_id, section, side, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS "distinct", count(*) FILTER (WHERE fresh) AS new, CASE WHEN count(*) FILTER (WHERE fresh) > 0 THEN 'error' ELSE 'warning' END AS severity FROM j GROUP BY ALL""")
def encoding_by_section(spark, sf_dir):
    """Undecoded characters of a section, an error if they are new."""
    return N.encoding_issues(rel(spark, sf_dir, CODED))


@query(f"""WITH {_LINES}, c AS (SELECT pair_id, ord, side, list_distinct(list_transform({_BAD}, lambda a: CASE WHEN a LIKE '(cid:%' THEN '(cid:N)' ELSE a END)) AS bad FROM ({duck(CODED)})), j AS (SELECT p.pair_id, p.ord, list_filter(s.bad, lambda x: NOT list_contains(p.bad, x)) AS new FROM c p JOIN c s ON p.side = 'prod' AND s.side = 'stage' AND p.pair_id = s.pair_id AND p.ord = s.ord) SELECT pair_id, ord, array_to_string(list_sort(new), ',') AS characters FROM j WHERE len(new) > 0""")
def encoding_regressed(spark, sf_dir):
    """C11: sentences with characters that only the candidate could not decode."""
    c = rel(spark, sf_dir, CODED)
    part = lambda side: c.where(F.col("side") == side).select("pair_id", "ord", F.struct("text").alias(side))
    return N.encoding_regressions(part("prod").join(part("stage"), ["pair_id", "ord"])).select("pair_id", "ord", F.array_join("characters", ",").alias("characters"))


STYLES = "SELECT l_orderkey AS pair_id, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, l_partkey % 3 AS block, l_discount * 8 AS pb, l_tax * 8 AS sb, l_quantity / 50 AS pi, l_tax * 4 AS si, l_returnflag AS pf, l_linestatus AS sf, l_partkey % 2 = 0 AS bold0, l_suppkey % 2 = 0 AS bold1, l_partkey % 5 = 0 AS ital0, l_suppkey % 5 = 0 AS ital1 FROM {lineitem}"


def _style_pairs(spark, sf_dir):
    r = rel(spark, sf_dir, STYLES)
    return r.select("pair_id", "ord", F.struct("block", F.col("pb").alias("bold"), F.col("pi").alias("italic")).alias("prod"), F.struct("block", F.col("sb").alias("bold"), F.col("si").alias("italic")).alias("stage")), r.select("pair_id", "ord", F.struct(F.col("pf").alias("font"), F.col("bold0").alias("bold"), F.col("ital0").alias("italic")).alias("prod"), F.struct(F.col("sf").alias("font"), F.col("bold1").alias("bold"), F.col("ital1").alias("italic")).alias("stage"))


@query(f"""WITH l AS (SELECT *, pb >= 0.2 AND pb - sb >= 0.2 AS b, pi >= 0.2 AND pi - si >= 0.2 AS i FROM ({duck(STYLES)})), o AS (SELECT *, concat_ws(' and ', CASE WHEN b THEN 'bold' END, CASE WHEN i THEN 'italic' END) AS emphasis FROM l WHERE b OR i QUALIFY row_number() OVER (PARTITION BY pair_id, block ORDER BY ord) = 1)
SELECT pair_id, ord, emphasis FROM o QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ord) <= 60""")
def emphasis_by_block(spark, sf_dir):
    """Bold or italics that blocks lost, one finding a block."""
    return N.emphasis_issues(_style_pairs(spark, sf_dir)[0]).select("pair_id", "ord", "emphasis")


@query(f"""SELECT pair_id, ord, concat_ws(', ', CASE WHEN pf <> sf THEN 'font family' END, CASE WHEN bold0 <> bold1 THEN 'bold' END, CASE WHEN ital0 <> ital1 THEN 'italic' END) AS changed FROM ({duck(STYLES)}) WHERE bold0 <> bold1 OR ital0 <> ital1 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ord) <= 60""")
def styles_changed(spark, sf_dir):
    """Sentences of the same words in another weight or slant."""
    return N.style_issues(_style_pairs(spark, sf_dir)[1]).select("pair_id", "ord", "changed")


LABELS = "SELECT o_orderkey AS pair_id, CASE o_orderkey % 4 WHEN 0 THEN 'Note: ' WHEN 1 THEN 'Hinweis: ' WHEN 2 THEN '注意：' ELSE '' END || o_orderpriority AS prod, CASE o_custkey % 3 WHEN 0 THEN 'NOTE : ' WHEN 1 THEN 'Warning: ' ELSE '' END || o_orderpriority AS stage FROM {orders}"


@query(f"""SELECT pair_id, a AS expected_label, b AS actual_label FROM (SELECT pair_id, CASE WHEN prod LIKE 'Note:%' THEN 'NOTE' WHEN prod LIKE 'Hinweis:%' THEN 'HINWEIS' WHEN prod LIKE '注意：%' THEN '注意' END AS a, CASE WHEN stage LIKE 'NOTE :%' THEN 'NOTE' WHEN stage LIKE 'Warning:%' THEN 'WARNING' END AS b FROM ({duck(LABELS)})) WHERE a <> b""")
def callouts_changed(spark, sf_dir):
    """Callout labels that both sides carry, but differ in."""
    r = rel(spark, sf_dir, LABELS).select("pair_id", F.struct(F.col("prod").alias("text")).alias("prod"), F.struct(F.col("stage").alias("text")).alias("stage"))
    return N.callout_issues(r).select("pair_id", "expected_label", "actual_label")


RECORDS = "SELECT l_orderkey AS pair_id, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE CAST(floor(l_linenumber / 3) AS INT) END AS slice, CAST(l_partkey % 2 AS INT) AS page, l_tax AS x0, CAST(l_linenumber * 20 AS DOUBLE) AS y0, l_tax + 100 AS x1, l_linenumber * 20 + l_quantity AS y1 FROM {lineitem}"


@query(f"""WITH r AS (SELECT *, lag(page) OVER w AS bp, lag(y0) OVER w AS by0, lead(page) OVER w AS np, lead(y1) OVER w AS ny1 FROM ({duck(RECORDS)}) WINDOW w AS (PARTITION BY pair_id ORDER BY ord)), k AS (SELECT * FROM r WHERE slice >= 0), m AS (SELECT pair_id, slice, page FROM (SELECT pair_id, slice, page, count(*) AS n FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pair_id, slice ORDER BY n DESC, page) = 1),
o AS (SELECT pair_id, slice, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min_null(bp, ord) AS bp, arg_min_null(by0, ord) AS by0, arg_max_null(np, ord) AS np, arg_max_null(ny1, ord) AS ny1 FROM k JOIN m USING (pair_id, slice, page) GROUP BY ALL)
SELECT pair_id, slice, page, round(CASE WHEN bp = page THEN greatest(least(by0, y0), y0 - 260) ELSE y0 END, 6) AS y0, round(CASE WHEN np = page THEN least(greatest(ny1, y1), y1 + 260) ELSE y1 END, 6) AS y1 FROM o""")
def evidence_regions(spark, sf_dir):
    """C17: where a slice's evidence stands."""
    return N.evidence(rel(spark, sf_dir, RECORDS)).select("pair_id", "slice", "page", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


# ------------------------------------------------------------------ chapters
_TYPES = sorted({t for kinds in K.CATEGORY.values() for t in kinds})
TYPES = "SELECT o_orderkey AS id, o_custkey AS pair_id, CASE o_orderkey % " + str(len(_TYPES)) + " " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(_TYPES)) + " END AS type, CASE o_custkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'text' END AS kind, o_custkey % 7 = 0 AS review_only FROM {orders}"


def _case(table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(t) for t in kinds)}) THEN {name!r}" for name, kinds in table.items()) + f" ELSE {other} END"


@query(f"""SELECT id, type, CASE WHEN type IN ('missing', 'added') AND kind = 'figure' THEN 'images' ELSE {_case(K.CATEGORY, "'content'")} END AS category, CASE WHEN review_only THEN 5 ELSE {_case(K.LEVEL, "4")} END AS level, NOT review_only AS fails, CASE WHEN type IN ({", ".join(map(repr, K.ORANGE))}) THEN 'orange' ELSE 'red' END AS colour, {_case(K.NOISE, "''")} AS noise FROM ({duck(TYPES)}) WHERE type <> 'underline-missing'""")
def differences_filed(spark, sf_dir):
    """CH2, CH12, CH13, CH22, G10: each difference with its category, level, colour and noise group."""
    return K.reported(rel(spark, sf_dir, TYPES)).select("id", "type", "category", "level", "fails", "colour", "noise")


@query(f"""SELECT id, CASE WHEN type IN ('missing', 'section-missing') THEN CASE WHEN kind = 'table' THEN 'Tables/content changes' ELSE 'Missing text' END WHEN type IN ('added', 'section-added') THEN CASE WHEN kind = 'table' THEN 'Tables/content changes' ELSE 'Added/removed text' END WHEN type = 'moved' THEN 'Different reading order' WHEN type LIKE 'table-%' THEN 'Tables/content changes'
WHEN type = 'page-ref-in-staging' THEN 'Added/removed text' WHEN type LIKE 'page-%' OR type = 'scanned-page' THEN 'Page-level differences' WHEN type = 'text' THEN CASE WHEN id % 13 + id % 3 > 8 THEN 'Changed paragraphs' WHEN id % 13 > 0 AND id % 3 > 0 THEN 'Changed words or numbers' WHEN id % 13 > 0 THEN 'Missing text' ELSE 'Added/removed text' END
WHEN type = 'paragraph-gap' THEN 'Changed paragraphs' WHEN type IN ('punctuation', 'symbol', 'numbering', 'text-encoding', 'glyph-render', 'text-space') THEN 'Changed words or numbers' ELSE '' END AS label FROM ({duck(TYPES)})""")
def content_labels(spark, sf_dir):
    """G1: which of the seven kinds of content change a difference is."""
    words = lambda k: F.array_repeat(F.lit("w"), (F.col("id") % k).cast("int"))
    return rel(spark, sf_dir, TYPES).select("id", K.content_label(F.col("type"), F.col("kind"), words(13), words(3)).alias("label"))


PHRASES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'heading' ELSE 'text' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'Copyright and Disclaimer' WHEN 1 THEN 'Deutsch' WHEN 2 THEN 'disclaimer' ELSE 'notice copyright' END AS text, CASE o_custkey % 3 WHEN 0 THEN 'This page carries a copyright notice and a separate disclaimer.' WHEN 1 THEN 'See the copyright and disclaimer section, in Deutsch.' ELSE 'nothing' END AS blob FROM {orders}"


@query(f"""WITH p AS (SELECT *, lower(text) AS t, ' ' || array_to_string(regexp_extract_all(lower(blob), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS b FROM ({duck(PHRASES)})) SELECT id, contains(b, ' ' || t || ' ') OR (kind <> 'heading' AND len(string_split(t, ' ')) <= 3 AND len(list_filter(string_split(t, ' '), lambda w: NOT contains(b, ' ' || w || ' '))) = 0) AS printed FROM p""")
def phrases_printed(spark, sf_dir):
    """CH10: headings are printed as one phrase or not at all, short texts also in pieces."""
    return rel(spark, sf_dir, PHRASES).select("id", K.printed_in(F.col("kind"), F.col("text"), F.col("blob")).alias("printed"))


REPEATS = "SELECT o_orderkey AS id, 'power energy' AS phrase, CASE o_orderkey % 3 WHEN 0 THEN 'go to power energy power energy auto' WHEN 1 THEN 'power energy' ELSE 'none' END AS own, CASE o_custkey % 3 WHEN 0 THEN 'power energy x power energy' WHEN 1 THEN 'powerless power energy' ELSE 'manpower energy' END AS other FROM {orders}"


@query(f"""SELECT id, len(regexp_extract_all(' ' || other || ' ', '[^a-z]power energy[^a-z]')) >= len(regexp_extract_all(' ' || replace(own, ' ', '  ') || ' ', '[^a-z]power  energy[^a-z]')) AS counted FROM ({duck(REPEATS)})""")
def repeats_counted(spark, sf_dir):
    """CH23: a repeat that went is not made up for by the copy that stayed."""
    return rel(spark, sf_dir, REPEATS).select("id", K.counted_elsewhere(F.col("phrase"), F.col("own"), F.col("other")).alias("counted"))


CELLS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'NOTE: The options vary (see \"Input\").' WHEN 1 THEN 'The options vary ( )' WHEN 2 THEN 'Take note of the value on page 12.' WHEN 3 THEN 'The options vary' ELSE o_orderpriority END AS text FROM {orders}"


@query(f"""SELECT id, array_to_string(list_sort(regexp_extract_all(lower(CASE id % 5 WHEN 0 THEN 'The options vary .' WHEN 1 THEN 'The options vary' WHEN 2 THEN 'Take note of the value.' ELSE text END), '[\\p{{L}}\\p{{N}}]+')), ' ') AS units FROM ({duck(CELLS)})""")
def cells_neutral(spark, sf_dir):
    """CH24, N19, N20: a cell's words without references and labels."""
    return rel(spark, sf_dir, CELLS).select("id", F.array_join(K.cell_units(F.col("text")), " ").alias("units"))


ELEMENTS = " UNION ALL ".join(f"SELECT l_orderkey AS pair_id, '{s}' AS side, CAST(l_partkey % 2 AS BIGINT) AS section, (l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, CASE WHEN l_suppkey % 3 = 0 THEN 'note' ELSE 'text' END AS kind, 'Line ' || CAST(l_linenumber AS STRING) || CASE WHEN l_partkey % 4 = {m} THEN ' on page 7.' ELSE ' stays.' END AS text, CAST(l_partkey % 3 AS INT) AS page, CAST(l_linenumber * 30 AS DOUBLE) AS y0, CAST(l_linenumber * 30 AS DOUBLE) + 30 - CAST(l_suppkey % 20 AS DOUBLE) AS y1, CAST(10 AS DOUBLE) AS size, CAST(14 + l_suppkey % {k} AS DOUBLE) AS lead_pt, l_quantity * {k} AS x0 FROM {{lineitem}}" for s, m, k in (("prod", 0, 5), ("stage", 1, 7)))


@query(f"""WITH e AS ({duck(ELEMENTS)}) SELECT pair_id, section, ord, 'on page 7' AS phrase FROM e WHERE side = 'stage' AND text LIKE '%on page 7.'""")
def page_references_kept(spark, sf_dir):
    """CH20: references to pages that the candidate still prints."""
    return K.page_references_kept(rel(spark, sf_dir, ELEMENTS))


@query(f"""WITH e AS ({duck(ELEMENTS)}), b AS (SELECT pair_id, side, page, median(lead_pt) AS body FROM e WHERE kind = 'text' GROUP BY ALL), n AS (SELECT e.pair_id, section, side, lower(text) AS key, avg(lead_pt / body) AS ratio FROM e JOIN b USING (pair_id, side, page) WHERE kind = 'note' GROUP BY ALL)
SELECT p.pair_id, p.section, p.key, CASE WHEN s.ratio > p.ratio THEN 'looser' ELSE 'tighter' END AS summary FROM n p JOIN n s ON p.side = 'prod' AND s.side = 'stage' AND p.pair_id = s.pair_id AND p.section = s.section AND p.key = s.key WHERE abs(s.ratio - p.ratio) > 0.15 * p.ratio""")
def line_spacing_changed(spark, sf_dir):
    """CH14: notes set looser or tighter than their own page."""
    return K.line_spacing_changes(rel(spark, sf_dir, ELEMENTS).withColumnRenamed("lead_pt", "leading")).select("pair_id", "section", "key", "summary")


@query(f"""WITH e AS ({duck(ELEMENTS)}), p AS (SELECT *, lag(text) OVER w AS pt, lag(page) OVER w AS pp, lag(y1) OVER w AS py FROM e WHERE side = 'prod' WINDOW w AS (PARTITION BY pair_id, section ORDER BY ord)) SELECT DISTINCT pair_id, section, pt AS first, text AS second FROM p WHERE pp = page AND y0 - py >= 0.8 * size""")
def paragraphs_joined(spark, sf_dir):
    """CH3, CH19: paragraphs apart in the baseline that the candidate prints as one (here it prints each section as one)."""
    e = rel(spark, sf_dir, ELEMENTS).where("side = 'prod'")
    one = e.groupBy("pair_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]), " ").alias("text")).withColumn("side", F.lit("stage"))
    return K.paragraph_gaps_lost(e.unionByName(one, allowMissingColumns=True)).select("pair_id", "section", "first", "second")


ITEMS = " UNION ALL ".join(f"SELECT l_orderkey AS pair_id, '{s}' AS side, CAST(l_suppkey % 2 AS INT) AS list, l_linenumber AS item, CAST(floor(l_quantity / {k}) AS DOUBLE) * 10 AS x0 FROM {{lineitem}}" for s, k in (("prod", 20), ("stage", 15)))


@query(f"""WITH i AS ({duck(ITEMS)}), l AS (SELECT *, dense_rank() OVER (PARTITION BY pair_id, side, list ORDER BY x0) AS level FROM i), m AS (SELECT pair_id, side, list, item, min(level) AS level FROM l GROUP BY ALL) SELECT p.pair_id, p.list, p.item, p.level AS prod, s.level AS stage FROM m p JOIN m s ON p.side = 'prod' AND s.side = 'stage' AND p.pair_id = s.pair_id AND p.list = s.list AND p.item = s.item WHERE p.level <> s.level""")
def list_levels_changed(spark, sf_dir):
    """CH11: items at another level of their list."""
    return K.list_indent_changes(rel(spark, sf_dir, ITEMS)).select("pair_id", "list", "item", "prod", "stage")


@query(f"""WITH {_LINES}, a AS (SELECT pair_id, page AS section, 'prod' AS side, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS word FROM prod WHERE NOT regexp_matches(text, '-\\s*$|[0-9]')), b AS (SELECT pair_id, page AS section, 'stage' AS side, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS word FROM stage WHERE NOT regexp_matches(text, '-\\s*$|[0-9]')),
n AS (SELECT pair_id, section, word, count(*) FILTER (WHERE side = 'prod') AS x, count(*) FILTER (WHERE side = 'stage') AS y FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT pair_id, section, word, CASE WHEN x > y THEN 'missing' ELSE 'added' END AS type, abs(x - y) AS n FROM n WHERE x <> y""")
def words_audited(spark, sf_dir):
    """CH18: every word of a section counted on either side. Lines with numbers, or broken by a hyphen, are left to the tests."""
    lines = rel(spark, sf_dir, " UNION ALL ".join(f"SELECT pair_id, '{s}' AS side, page AS section, ord, text, false AS ocr FROM {{{s}}}" for s in ("prod", "stage"))).where(~F.rlike("text", F.lit(r"-\s*$|[0-9]")))
    return K.word_audit(lines).select("pair_id", "section", "word", "type", "n")


TABLES = " UNION ALL ".join(f"SELECT CAST(p_size AS BIGINT) AS pair_id, '{s}' AS side, CAST(p_partkey % 2 AS INT) AS tbl, p_partkey AS row, p_name AS a, p_brand AS b, CASE WHEN p_partkey % 5 = 0 THEN {k} ELSE 0 END AS spans FROM {{part}} WHERE p_partkey % {m} <> 0" for s, k, m in (("prod", 0, 13), ("stage", 1, 7)))


@query(f"""WITH t AS (SELECT *, array_to_string(regexp_extract_all(lower(a || ' ' || b), '[\\p{{L}}\\p{{N}}]+'), ' ') AS key FROM ({duck(TABLES)})), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, tbl, key ORDER BY row) AS nth FROM t), p AS (SELECT * FROM n WHERE side = 'prod'), s AS (SELECT * FROM n WHERE side = 'stage')
SELECT pair_id, tbl, CASE WHEN s.row IS NULL THEN 'table-row-missing' WHEN p.row IS NULL THEN 'table-row-added' ELSE 'table-merge' END AS type, coalesce(p.row, s.row) AS row, key FROM p FULL JOIN s USING (pair_id, tbl, key, nth) WHERE s.row IS NULL OR p.row IS NULL OR p.spans <> s.spans""")
def table_row_changes(spark, sf_dir):
    """CH16: rows that one side alone has, and rows whose cells were merged."""
    t = rel(spark, sf_dir, TABLES).select("pair_id", "side", "tbl", "row", F.array("a", "b").alias("cells"), "spans")
    nothing = spark.createDataFrame([], "pair_id bigint, word string, n bigint")
    return K.row_changes(t, nothing)


@query("""WITH f AS (SELECT c_nationkey AS pair_id, c_mktsegment AS tbl, CAST(c_custkey % 5 AS INT) AS page, min(CASE WHEN c_custkey % 3 = 0 THEN 'Item Value' ELSE 'item  value' END || CASE WHEN c_custkey % 11 = 0 THEN ' x' ELSE '' END) AS head FROM customer GROUP BY ALL), k AS (SELECT *, array_to_string(regexp_extract_all(lower(head), '[a-z]+'), ' ') AS h FROM f), w AS (SELECT *, first_value(h) OVER (PARTITION BY pair_id, tbl ORDER BY page) AS f, row_number() OVER (PARTITION BY pair_id, tbl ORDER BY page) AS n FROM k)
SELECT pair_id, tbl, page, 'table-header-repeat' AS type FROM w WHERE n > 1 AND h <> f""")
def headers_lost(spark, sf_dir):
    """CH27: tables that go on without their head row."""
    f = rel(spark, sf_dir, "SELECT c_nationkey AS pair_id, c_mktsegment AS `table`, CAST(c_custkey % 5 AS INT) AS page, min(CASE WHEN c_custkey % 3 = 0 THEN 'Item Value' ELSE 'item  value' END || CASE WHEN c_custkey % 11 = 0 THEN ' x' ELSE '' END) AS head FROM {customer} GROUP BY 1, 2, 3")
    return K.headers_lost(f.withColumn("first_row", F.split("head", " "))).select("pair_id", F.col("table").alias("tbl"), "page", "type")


@query()
def marks_changed(spark, sf_dir):
    """CH17: marks and spaces that facing lines differ in (look-around has no SQL form; tested case by case)."""
    j = rel(spark, sf_dir, "SELECT p.pair_id, p.ord, p.text AS a, replace(s.text, ', ', ' ') AS b FROM {prod} p JOIN {stage} s ON p.pair_id = s.pair_id AND p.ord = s.ord")
    return j.select("pair_id", "ord", F.explode(K.mark_changes("a", "b")).alias("change"))


SUMMARIES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Figure oversized in Staging — the picture is larger. ' WHEN 1 THEN 'Text differs. ' ELSE 'Bold missing — “x”: 24 in Production' END AS summary, CASE o_orderkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'missing' WHEN 2 THEN 'bold-missing' WHEN 3 THEN 'figure-added' ELSE 'other' END AS type, o_orderpriority AS text FROM {orders}"
_TITLE = "regexp_replace(CASE WHEN position(' — ' IN summary) > 0 THEN string_split(summary, ' — ')[1] ELSE summary END, '[. ]+$', '')"
_REST = "trim(CASE WHEN position(' — ' IN summary) > 0 THEN string_split(summary, ' — ')[2] ELSE summary END)"


@query(f"""WITH d AS (SELECT *, {_TITLE} AS title, upper({_REST}[1]) || {_REST}[2:] AS description FROM ({duck(SUMMARIES)})), t AS (SELECT *, title || ': ' || CASE WHEN contains(description, '”: ') THEN string_split(description, '”: ')[2] ELSE description END AS rest FROM d)
SELECT id, title, description, CASE type WHEN 'text' THEN 'Missing in Staging: “' || text || '”' WHEN 'missing' THEN 'Missing in Staging: “' || text || '”' WHEN 'bold-missing' THEN 'Bold in Production' WHEN 'figure-added' THEN '' ELSE rest END AS comment_prod,
CASE type WHEN 'text' THEN 'Missing here: “' || text || '”' WHEN 'missing' THEN 'Missing in Staging: “' || text || '”' WHEN 'bold-missing' THEN 'Not bold in Staging' WHEN 'figure-added' THEN 'Picture not in Production' ELSE rest END AS comment_stage FROM t""")
def issues_commented(spark, sf_dir):
    """Titles, descriptions and the comments beside either box."""
    r = rel(spark, sf_dir, SUMMARIES).withColumn("gone", F.when(F.col("type") == "text", F.array("text"))).withColumn("extra", F.lit(None).cast("array<string>"))
    return I.commented(r).select("id", "title", "description", "comment_prod", "comment_stage")


@query("""SELECT c_custkey AS pair_id, 'page-count' AS type, 'Page count differs: ' || c_nationkey || ' and ' || (c_nationkey + c_custkey % 3) AS title, CAST(NULL AS INT) AS page, false AS minor FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'scanned-page', 'Scanned page ' || (c_nationkey + 1) || ' in ' || CASE WHEN c_custkey % 2 = 0 THEN 'Production' ELSE 'Staging' END, c_nationkey, true FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'font-set', 'Font only in Production: ' || c_mktsegment, NULL, true FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'heading-style', 'Headings are set otherwise: 75 % of them', NULL, true FROM customer WHERE c_custkey % 7 = 0""")
def page_level_issues(spark, sf_dir):
    """What concerns a document as a whole."""
    c = rel(spark, sf_dir, "SELECT c_custkey AS pair_id, c_nationkey AS n, c_mktsegment AS font FROM {customer}")
    k = F.col("pair_id")
    return I.page_level(
        c.select("pair_id", F.col("n").alias("prod_pages"), (F.col("n") + k % 3).alias("stage_pages")), c.where(k % 4 == 0).select("pair_id", F.when(k % 2 == 0, "prod").otherwise("stage").alias("side"), F.col("n").alias("page")),
        c.where(k % 5 == 0).select("pair_id", F.lit("prod").alias("only_in"), "font"), c.where(k % 7 == 0).select("pair_id", F.lit(0.75).alias("share")),
    )


@query("""WITH g AS (SELECT l_suppkey AS pair_id, CAST(l_linenumber AS INT) AS page, l_returnflag || l_orderkey AS gap, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_returnflag || l_orderkey) AS r FROM lineitem), s AS (SELECT l_suppkey AS pair_id, CAST(l_linenumber AS INT) AS page, l_orderkey || '.' AS marker, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey || '.') AS r FROM lineitem)
SELECT pair_id, 'page-sweep' AS type, page, gap AS title FROM g WHERE r <= 60 UNION ALL SELECT pair_id, 'marker-spacing', page, 'Space after the marker ' || marker FROM s WHERE r <= 40""")
def sweep_issues(spark, sf_dir):
    """The sweep's gaps and changed marker gaps, sixty and forty a pair (limits of the report)."""
    r = rel(spark, sf_dir, "SELECT l_suppkey AS pair_id, CAST(l_linenumber AS INT) AS page, l_returnflag || CAST(l_orderkey AS STRING) AS gap, CAST(l_orderkey AS STRING) || '.' AS marker FROM {lineitem}")
    return I.sweep_issues(r.select("pair_id", "page", "gap"), r.select("pair_id", "page", "marker"))


@query(f"""WITH i AS (SELECT o_orderkey AS id, o_custkey AS pair_id, CAST(o_orderkey % 4 AS INT) AS level, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 9 AS INT) END AS pp, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 8 AS INT) END AS sp, CASE WHEN o_custkey % 2 = 0 THEN 'orange' ELSE 'blue' END AS colour FROM orders)
SELECT pair_id, id, 'prod' AS side, pp AS page, CASE WHEN level = 1 THEN 'red' ELSE colour END AS colour FROM i WHERE pp IS NOT NULL UNION ALL SELECT pair_id, id, 'stage', sp, CASE WHEN level = 1 THEN 'red' ELSE colour END FROM i WHERE sp IS NOT NULL""")
def issue_spots(spark, sf_dir):
    """Where issues are shown on either document."""
    r = rel(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey AS pair_id, CAST(o_orderkey % 4 AS INT) AS level, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 9 AS INT) END AS prod_page, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 8 AS INT) END AS stage_page, CASE WHEN o_custkey % 2 = 0 THEN 'orange' ELSE 'blue' END AS colour FROM {orders}")
    return I.spots(r)
