"""Chat formatting in Spark expressions: collect and sort turns, merge neighbours of one role, concatenate.

A formatted conversation is a row of turns

    ### <role>: <text>[ </part>\\n<text>]... </turn>\\n

where the parts are the texts of adjacent rows of one role. Control strings inside texts are escaped
by a backslash (a backslash by itself), a colon inside a role by \\c, so that read_back() finds the
very rows again: an escaped text never holds a control string with a blank before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import quoted, running_sums, text_of

#: Fixed values of the template.
HEAD, COLON, PART, TURN = "### ", ": ", " </part>\n", " </turn>\n"
CONTROL = ["###", "</part>", "</turn>"]


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        c = F.replace(c, F.lit(word), F.lit("\\" + word))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|" + "|".join(CONTROL) + ")", "$1")


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def _unescape_role(c: Column) -> Column:
    # Only \c maps to something else than what follows the backslash; doubled backslashes are set aside first.
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.regexp_replace(F.replace(p, F.lit("\\c"), F.lit(":")), r"\\(" + "|".join(CONTROL) + ")", "$1"))
    return F.array_join(plain, "\\")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted STRING, loss ARRAY<STRUCT<start, end>>): a row per conversation.

    Rows are ordered by turn, ties by role, then text; a null role or text is empty, a null turn comes
    first, rows with a null conv_id form one conversation. Repeated rows stay. `loss` has the code point
    spans in `formatted` of the escaped texts of `loss_role`, markers left out, in order. A conversation
    becomes one row, so it must fit into a task; an empty table gives no rows, other columns are ignored.
    """
    turn = F.struct(F.col(quoted(turn_col)).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    collected = rows.groupBy(F.col(quoted(conv_col)).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Where a run of one role starts; the turns of a run become one, with an array of texts. No step copies what came before it.
    told = collected.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: escape(t["text"])).alias("texts"))
    first = F.filter(F.sequence(F.lit(0), F.size("roles") - 1), lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1)))
    cut = told.select("conv_id", "roles", "texts", first.alias("first"))
    after = lambda k: F.coalesce(F.get("first", k + 1), F.size("roles"))
    run = lambda i, k: F.struct(F.get("roles", i).alias("role"), F.slice("texts", i + 1, after(k) - i).alias("texts"))
    merged = cut.select("conv_id", F.transform("first", run).alias("merged"))
    head = lambda m: F.concat(F.lit(HEAD), _escape_role(m["role"]), F.lit(COLON))
    formatted = F.array_join(F.transform("merged", lambda m: F.concat(head(m), F.array_join(m["texts"], PART), F.lit(TURN))), "")
    # Each text ends a marker before the running sum of all lengths up to it, of heads, texts and markers.
    long = lambda c: c.cast("long")
    lengths = lambda m: F.transform(m["texts"], lambda t, i: long(F.char_length(t) + F.when(i == 0, F.char_length(head(m))).otherwise(0) + F.when(i == F.size(m["texts"]) - 1, len(TURN)).otherwise(len(PART))))
    ends = running_sums(F.flatten(F.transform("merged", lengths)))
    flat = F.flatten(F.transform("merged", lambda m: F.transform(m["texts"], lambda t, i: F.struct((m["role"] == loss_role).alias("own"), long(F.char_length(t)).alias("n"), F.when(i == F.size(m["texts"]) - 1, len(TURN)).otherwise(len(PART)).alias("mark")))))
    placed = F.zip_with(flat, ends, lambda t, end: F.struct(t["own"].alias("own"), long(end - t["mark"] - t["n"]).alias("start"), long(end - t["mark"]).alias("end")))
    loss = F.transform(F.filter(placed, lambda t: t["own"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return merged.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `turns` ARRAY<STRUCT<role, text>>, the rows that were formatted, and `loss_text`, the unescaped text under the loss spans.

    Takes what format_chats() returns: empty texts and roles, repeated rows and ties come back as they were
    ordered, null ones as empty; columns of those two names are replaced; an empty table gives no rows.
    """
    turns = F.slice(F.split("formatted", TURN, -1), 1, F.size(F.split("formatted", TURN, -1)) - 1)
    colon = lambda c: F.locate(":", c, len(HEAD) + 1)
    role = lambda c: _unescape_role(F.substring(c, F.lit(len(HEAD) + 1), colon(c) - len(HEAD) - 1))
    texts = lambda c: F.split(F.substring(c, colon(c) + len(COLON), F.char_length(c)), PART, -1)
    rows = F.flatten(F.transform(turns, lambda c: F.transform(texts(c), lambda t: F.struct(role(c).alias("role"), unescape(t).alias("text")))))
    under = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumn("turns", rows).withColumn("loss_text", under)
