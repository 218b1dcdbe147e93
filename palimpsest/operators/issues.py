"""Issues: explanations, verdicts, consolidation, the sorted report and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE = "pair_id bigint, check string, severity string, confidence string, page int, section string, category string, message string, details map<string,string>"
CATEGORIES = ["content", "images", "links", "lists", "bold", "tables", "formatting", "sweep"]
#: What a message means: fixed wording of this package, by message prefix.
HELP = {
    "Page count mismatch": "The editions have different numbers of pages.",
    "Missing page": "A page of the baseline is not in the candidate.",
    "Extra page": "The candidate has a page that the baseline has not.",
    "Missing text": "The baseline has this text, the candidate does not.",
    "Added text": "Only the candidate has this text.",
    "Changed text": "Both have the text, with other words.",
    "Minor text difference": "Both hold the wording; blanks, marks or a list's sign differ.",
    "Possible text encoding issue": "Characters could not be decoded; those that the other edition lacks came with this export.",
    "Text encoding regression": "The same sentence, with characters that only the candidate could not decode.",
    "Text formatting differs": "The same words in another weight or slant.",
    "Bold or italic emphasis removed": "What the baseline sets off, the candidate prints like the rest.",
    "Image alignment changed": "A figure stands at another side of the column.",
    "Diagram callout number missing": "A number that points into a drawing is gone.",
    "Diagram callouts stripped from figure": "All numbers of a drawing are gone, while a list still names them.",
    "Broken image": "An image has no data, cannot be decoded, or shows nothing.",
    "Image highlight box missing": "A coloured frame over a figure is gone.",
    "Table header row not repeated on continuation page": "The table goes on on another page without its head.",
    "Table split across pages": "The table is cut by more page breaks than it was.",
    "Table columns differ": "The table has another number of columns.",
    "Table column layout differs": "The columns are there, at other widths.",
    "Table cell layout differs": "A row holds the same words in other cells.",
    "Table breaking the margins": "The table reaches beyond the margins.",
    "Table heading missing": "Words of a head cell are gone.",
    "Table cell missing": "Words of a cell are gone.",
    "Table row missing": "A row of the baseline's table is not in the candidate's.",
    "Missing table": "No table of the section holds these words.",
    "List marker changed": "A list is numbered otherwise.",
    "List marker size changed": "A list's signs are larger or smaller.",
    "List alignment/indent changed": "An item moved to another level.",
    "List formatting differs": "An item has another kind of sign.",
    "Text alignment changed": "A text is set to another side.",
    "Paragraph merged with heading": "A description runs on on the line of its label.",
    "Hyperlink not highlighted in STAGE": "A link looks like any other text.",
    "Internal link target does not resolve": "A link leads to a page or name that is not there.",
    "Hyperlink has no usable scheme": "No program can open the address.",
    "Hyperlink hotspot cannot be clicked": "The area of the link is empty, too small or off the page.",
    "Callout label differs": "The same sentence is marked as another kind of note.",
    "Callout icon missing in Staging": "The coloured sign of a note is gone or pale.",
    "Image missing": "No figure of the section looks like this one.",
    "Image content differs": "Another picture stands in this one's place.",
    "Image could not be confirmed identical": "A picture stands here that could not be told to be the same.",
    "Image size changed": "The picture is larger or smaller both ways.",
    "Image width changed": "The picture is wider or narrower.",
    "Image outside its section": "The picture stands after the end of its section.",
    "Image label missing": "Words at a figure are gone.",
    "Underline missing in Staging": "A line under the words is gone.",
    "Underline added in Staging": "A line was drawn under the words.",
    # What this package's own queries say.
    "Text missing": "The baseline has this text, the candidate does not.",
    "Text added": "Only the candidate has this text.",
    "Text changed": "Both have the text, with other words.",
    "Table": "A table differs.",
    "Link": "A link of the candidate does not lead where it should.",
    "Figure": "A figure differs or is gone.",
}
#: What stands beside a difference's box on either side: fixed values, by type.
COMMENTS = {
    "figure-missing": ("Picture missing in Staging", ""), "figure-added": ("", "Picture not in Production"), "bold-missing": ("Bold in Production", "Not bold in Staging"), "bold-added": ("Regular in Production", "Bold added in Staging"),
    "italic-missing": ("Italic in Production", "Not italic in Staging"), "italic-added": ("Upright in Production", "Italic added in Staging"), "link-missing": ("Link in Production", "Link missing in Staging"), "link-added": ("No link in Production", "Extra link in Staging"),
    "link-broken": ("", "Link does not work in Staging"), "list-marker-missing": ("List item in Production", "Bullet / number missing in Staging"), "list-marker-added": ("Plain text in Production", "Bullet / number added in Staging"),
    "icon-missing": ("Icon in Production", "Icon missing in Staging"), "icon-added": ("No icon in Production", "Icon added in Staging"), "icon-colour": ("Icon colour in Production", "Icon colour changed in Staging"),
}
COMMENT_CHARS, QUOTED, QUOTE_CHARS, CONTEXT_WORDS, WHOLE_WORDS = 90, 3, 40, 8, 60
MOST_SWEEP, MOST_SPACING = 60, 40


def title_of(summary: Column) -> Column:
    """What a difference is called: its summary up to the dash."""
    return F.regexp_replace(F.substring_index(summary, " — ", 1), r"[. ]+$", "")


def description_of(summary: Column) -> Column:
    """The rest of the summary, its first letter large."""
    at = F.position(F.lit(" — "), summary)
    rest = F.trim(F.when(at > 0, F.substring(summary, at + 3, F.length(summary))).otherwise(summary))
    return F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))


def quoted(words: Column) -> Column:
    """The first three fragments in quotes, and a sign that there are more."""
    clip = lambda t, n: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)
    shown = F.array_join(F.transform(F.slice(words, 1, QUOTED), lambda w: F.concat(F.lit("“"), clip(F.trim(F.regexp_replace(w, r"\s+", " ")), QUOTE_CHARS), F.lit("”"))), ", ")
    return F.concat(shown, F.when(F.size(words) > QUOTED, " …").otherwise(""))


def commented(differences: DataFrame) -> DataFrame:
    """Differences with title, description and the comments of both sides. Have: type, summary, gone, extra (arrays, may be null), text."""
    none = F.expr("cast(array() as array<string>)")
    clip = lambda t: F.when(F.length(t) > COMMENT_CHARS, F.concat(F.substring(t, 1, COMMENT_CHARS - 1), F.lit("…"))).otherwise(t)
    gone, extra, kind = F.coalesce("gone", none), F.coalesce("extra", none), F.col("type")
    a, b = F.size(gone) > 0, F.size(extra) > 0
    lost = kind.isin("missing", "table-row-missing")
    whole = clip(F.concat(F.when(lost, "Missing in Staging: ").otherwise("Extra in Staging: "), quoted(F.array(F.coalesce("text", F.lit(""))))))
    fixed = lambda n: F.coalesce(*[F.when(kind == k, v[n]) for k, v in COMMENTS.items()])
    title, description = title_of(F.col("summary")), description_of(F.col("summary"))
    tail = F.when(F.contains(description, F.lit("”: ")), F.substring_index(description, "”: ", -1)).otherwise(description)
    rest = clip(F.concat(title, F.lit(": "), tail))
    prod = F.when(a | b, clip(F.when(a, F.concat(F.lit("Missing in Staging: "), quoted(gone))).otherwise("Staging adds words here"))).when(kind.isin("missing", "added", "table-row-missing", "table-row-added"), whole).otherwise(F.coalesce(fixed(0), rest))
    stage = F.when(a | b, clip(F.when(b, F.concat(F.lit("Extra in Staging: "), quoted(extra))).otherwise(F.concat(F.lit("Missing here: "), quoted(gone))))).when(kind.isin("missing", "added", "table-row-missing", "table-row-added"), whole).otherwise(F.coalesce(fixed(1), rest))
    return differences.select("*", title.alias("title"), description.alias("description"), prod.alias("comment_prod"), stage.alias("comment_stage"))


def page_level(counts: DataFrame, scanned: DataFrame, fonts: DataFrame, styles: DataFrame) -> DataFrame:
    """What concerns documents as a whole, as one relation: (pair_id, type, title, page, minor).

    Counts: pair_id, prod_pages, stage_pages. Scanned: pair_id, side, page. Fonts: pair_id, only_in, font. Styles: pair_id, share.
    """
    name = lambda c: F.when(F.col(c) == "prod", "Production").otherwise("Staging")
    none = F.lit(None).cast("int")
    out = counts.where("prod_pages <> stage_pages").select("pair_id", F.lit("page-count").alias("type"), F.concat(F.lit("Page count differs: "), F.col("prod_pages").cast("string"), F.lit(" and "), F.col("stage_pages").cast("string")).alias("title"), none.alias("page"), F.lit(False).alias("minor"))
    out = out.unionAll(scanned.select("pair_id", F.lit("scanned-page"), F.concat(F.lit("Scanned page "), (F.col("page") + 1).cast("string"), F.lit(" in "), name("side")), F.col("page").cast("int"), F.lit(True)))
    out = out.unionAll(fonts.select("pair_id", F.lit("font-set"), F.concat(F.lit("Font only in "), name("only_in"), F.lit(": "), F.col("font")), none, F.lit(True)))
    return out.unionAll(styles.select("pair_id", F.lit("heading-style"), F.concat(F.lit("Headings are set otherwise: "), F.round(F.col("share") * 100, 0).cast("int").cast("string"), F.lit(" % of them")), none, F.lit(True)))


def sweep_issues(gaps: DataFrame, spacing: DataFrame) -> DataFrame:
    """Gaps of the page sweep (sixty a pair) and markers whose gap changed (forty): (pair_id, type, page, title). Gaps: pair_id, page, gap. Spacing: pair_id, page, marker."""
    first = lambda df, order, most: df.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy("page", order))).where(F.col("_r") <= most)
    a = first(gaps, "gap", MOST_SWEEP).select("pair_id", F.lit("page-sweep").alias("type"), "page", F.col("gap").alias("title"))
    return a.unionAll(first(spacing, "marker", MOST_SPACING).select("pair_id", F.lit("marker-spacing"), "page", F.concat(F.lit("Space after the marker "), F.col("marker"))))


def spots(issues: DataFrame) -> DataFrame:
    """Where issues are shown on either document, a row each side: (pair_id, id, side, page, colour). Have: prod_page, stage_page, level, colour."""
    each = issues.select("pair_id", "id", "level", "colour", F.explode(F.array(F.struct(F.lit("prod").alias("side"), F.col("prod_page").alias("page")), F.struct(F.lit("stage").alias("side"), F.col("stage_page").alias("page")))).alias("s"))
    return each.where("s.page is not null").select("pair_id", "id", F.col("s.side").alias("side"), F.col("s.page").alias("page"), F.when(F.col("level") == 1, "red").otherwise(F.col("colour")).alias("colour"))


def snippet(ops: Column, side: str) -> Column:
    """One side's own words of a diff, its changed ones marked by [ ], others' places by ^; long unchanged stretches cut to eight words about a change."""
    mine, theirs = ("del", "ins") if side == "prod" else ("ins", "del")
    own = F.filter(ops, lambda o: (o["type"] != theirs) | (o["type"] == theirs))
    n = F.size(own)
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    first = lambda w: F.array_join(F.slice(w, 1, CONTEXT_WORDS), " ")
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS), " ")

    def part(o: Column, i: Column) -> Column:
        w = words(o["text"])
        beside = F.exists(F.array(i - 1, i + 1), lambda j: F.coalesce(F.get(own, j)["type"] == mine, F.lit(False)))
        plain = F.when((i > 0) & (i < n - 1) & (F.size(w) > 2 * CONTEXT_WORDS), F.concat(first(w), F.lit(" … "), last(w))).when((i > 0) & (i == n - 1) & (F.size(w) > CONTEXT_WORDS), F.concat(first(w), F.lit(" …"))).when((i == 0) & (n > 1) & (F.size(w) > CONTEXT_WORDS), F.concat(F.lit("… "), last(w))).otherwise(F.trim(o["text"]))
        return F.when(o["type"] == "equal", plain).when(o["type"] == mine, F.concat(F.lit("["), F.trim(o["text"]), F.lit("]"))).when(~beside, F.lit("^"))

    return F.array_join(F.array_compact(F.transform(own, part)), " ")


def whole_text(text: Column) -> Column:
    """A text that one side alone has, sixty words of it."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > WHOLE_WORDS, F.concat(F.array_join(F.slice(w, 1, WHOLE_WORDS), " "), F.lit(" …"))).otherwise(F.array_join(w, " "))


def _of_types(*types: str):
    return lambda o: o["type"].isin(*types)


def word_marks(diffs: DataFrame, words: DataFrame) -> DataFrame:
    """The boxes of the words that differ: (pair_id, id, side, n, word, box). Diffs: pair_id, id, ops. Words: pair_id, id, side, n (from 0), word, box.

    What is equal or a side's own, put together, is that side's text: so the place of a changed word is known by counting.
    """
    parts = []
    for side, mine in (("prod", "del"), ("stage", "ins")):
        own = diffs.select("pair_id", "id", F.posexplode(F.filter("ops", _of_types("equal", mine))).alias("k", "o"))
        # Pieces are cut at letters where a word changed in part: the word that a piece ends in goes on in the next one.
        glued = own.withColumn("_text", F.col("o.text")).withColumn("_type", F.col("o.type"))
        w = Window.partitionBy("pair_id", "id").orderBy("k")
        goes_on = F.rlike(F.lag("_text").over(w), F.lit(r"\S$")) & F.rlike("_text", F.lit(r"^\S"))
        n = F.size(F.filter(F.split("_text", r"\s+"), lambda x: x != ""))
        counted = glued.withColumn("_n", n - F.coalesce(goes_on, F.lit(False)).cast("int")).withColumn("_on", F.coalesce(goes_on, F.lit(False)))
        end = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        hit = counted.withColumn("_end", end).where((F.col("_type") == mine) & (F.trim("_text") != ""))
        start = F.col("_end") - F.size(F.filter(F.split("_text", r"\s+"), lambda x: x != ""))
        parts.append(hit.select("pair_id", "id", F.lit(side).alias("side"), F.explode(F.sequence(start, F.col("_end") - 1)).alias("n")).distinct())
    return parts[0].unionAll(parts[1]).join(words, ["pair_id", "id", "side", "n"])


def explained(issues: DataFrame) -> DataFrame:
    """Each issue with the help of the longest prefix of its message; unknown messages keep a null. HELP is of fixed size."""
    spark = issues.sparkSession
    known = spark.createDataFrame(list(HELP.items()), "prefix string, help string")
    wanted = issues.select("message").distinct().join(F.broadcast(known), F.startswith("message", F.col("prefix")))
    best = wanted.groupBy("message").agg(F.max_by("help", F.length("prefix")).alias("help"))
    return issues.join(best, "message", "left")


def verdicts(issues: DataFrame, by: list[str]) -> DataFrame:
    """passed: no error that is not up for review."""
    fails = (F.col("severity") == "error") & (F.coalesce(F.col("confidence"), F.lit("confirmed")) != "review")
    return issues.groupBy(*by).agg((~F.bool_or(fails)).alias("passed"), F.count("*").alias("n_issues"), F.count_if(fails).alias("n_failing"))


def consolidated(issues: DataFrame, least: int = 2) -> DataFrame:
    """Issues of one category and section, two or more of them, as one; it is an error if any is."""
    whole = issues.groupBy("pair_id", "category", "section").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "error").alias("critical"), F.min("page").alias("page"), F.array_sort(F.collect_set("message")).alias("messages"))
    return whole.withColumn("title", F.when(F.col("n") >= least, F.concat(F.col("n").cast("string"), F.lit(" findings: "), F.array_join("messages", "; "))).otherwise(F.element_at("messages", 1)))


def category_order(category: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), category)
    return F.when(place > 0, place).otherwise(len(CATEGORIES) + 1)


def report(issues: DataFrame, tie: list[str]) -> DataFrame:
    """The issues of each pair numbered by category order, then `tie`."""
    return issues.withColumn("number", F.row_number().over(Window.partitionBy("pair_id").orderBy(category_order(F.col("category")), *tie)))


def totals(issues: DataFrame) -> DataFrame:
    """Counts by category and severity with all totals (a rollup)."""
    return issues.rollup("category", "severity").agg(F.count("*").alias("n"))


def check_results(issues: DataFrame) -> DataFrame:
    """(pair_id, name, passed, issues, message_counts): one row a check, as the report shows it. Issues: ISSUE."""
    fails = (F.col("severity") == "error") & (F.coalesce(F.col("confidence"), F.lit("confirmed")) != "review")
    details = F.map_concat(F.coalesce("details", F.expr("map()").cast("map<string,string>")), F.create_map(F.lit("confidence"), F.coalesce("confidence", F.lit("confirmed"))))
    n = issues.groupBy("pair_id", "check", "message").agg(F.count("*").alias("n"))
    counts = n.groupBy("pair_id", "check").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "message"))), lambda x: F.struct(x["message"].alias("message"), (-x["m"]).alias("count"))).alias("message_counts"))
    plain = issues.withColumn("_d", F.to_json(details))
    rows = plain.groupBy("pair_id", "check").agg((~F.bool_or(fails)).alias("passed"), F.sort_array(F.collect_list(F.struct("message", "page", "severity", "section", F.col("_d").alias("details")))).alias("issues"))
    return rows.join(counts, ["pair_id", "check"]).withColumnRenamed("check", "name")


def report_rows(issues: DataFrame, toc: DataFrame, summaries: DataFrame) -> DataFrame:
    """(pair_id, passed, checks, toc_comparison): one row a pair. Summaries: pair_id, name, summary_title, summary_rows (array of texts)."""
    checks = check_results(issues).join(summaries, ["pair_id", "name"], "left")
    whole = checks.groupBy("pair_id").agg(F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(F.struct("name", "passed", "message_counts", "issues", "summary_title", "summary_rows"))).alias("checks"))
    rows = toc.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("title", "status"))).alias("toc_comparison"))
    return rows.join(whole, "pair_id", "full_outer").withColumn("passed", F.coalesce("passed", F.lit(True)))


def write_report(rows: DataFrame, path: str) -> None:
    """report_rows() as JSON, a document a pair."""
    rows.write.mode("overwrite").json(path)


def html_of(rows: DataFrame) -> DataFrame:
    """(pair_id, html): a page for each pair that lists its checks and their issues."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    issue = lambda i: F.concat(F.lit('<li class="'), esc(i["severity"]), F.lit('">'), esc(i["message"]), F.lit(" (page "), esc(i["page"] + 1), F.lit(")</li>"))
    check = lambda c: F.concat(F.lit("<h2>"), esc(c["name"]), F.lit(": "), F.when(c["passed"], "PASS").otherwise("FAIL"), F.lit("</h2><ul>"), F.array_join(F.transform(c["issues"], issue), ""), F.lit("</ul>"))
    body = F.array_join(F.transform("checks", check), "")
    return rows.select("pair_id", F.concat(F.lit("<!doctype html><meta charset=utf-8><h1>"), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("</h1>"), F.coalesce(body, F.lit(""))).alias("html"))


def write_json(issues: DataFrame, path: str) -> None:
    """One JSON document a pair, its issues in report order."""
    rows = issues.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("number", "category", "severity", "message"))).alias("issues"))
    rows.write.mode("overwrite").json(path)
