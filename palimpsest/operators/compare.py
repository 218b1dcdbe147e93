"""Comparing two sides: full outer matches by key and occurrence, presence tests, diffs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "text", "level")]))


def occurrences(df: DataFrame, keys: list[str], order: list[str], out: str = "nth") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def match_by_key(prod: DataFrame, stage: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Full outer match of the n-th occurrence of a key on either side: status same, missing or added; bags, not sets."""
    a = occurrences(prod, keys, order).select(*keys, "nth", F.struct(*prod.columns).alias("prod"))
    b = occurrences(stage, keys, order).select(*keys, "nth", F.struct(*stage.columns).alias("stage"))
    status = F.when(F.col("stage").isNull(), "missing").when(F.col("prod").isNull(), "added").otherwise("same")
    return a.join(b, [*keys, "nth"], "full_outer").withColumn("status", status)


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many more of each row `a` holds than `b`, and `b` than `a`: counts summed before anything is joined."""
    n = lambda df, x, y: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, (F.col("n") * x).alias("x"), (F.col("n") * y).alias("y"))
    both = n(a, 1, 0).unionAll(n(b, 0, 1)).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return both.select(*keys, F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("lost"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("gained")).where("lost > 0 or gained > 0")


def bag_similarity(a: DataFrame, b: DataFrame, left: list[str], right: list[str], token: str) -> DataFrame:
    """shared, larger total and share of common tokens for every pair of groups that have a token in common."""
    x = a.groupBy(*left, token).agg(F.count("*").alias("n"))
    y = b.groupBy(*right, token).agg(F.count("*").alias("m"))
    tx, ty = x.groupBy(*left).agg(F.sum("n").alias("total_a")), y.groupBy(*right).agg(F.sum("m").alias("total_b"))
    shared = x.join(y, [token, *[k for k in left if k in right]]).groupBy(*dict.fromkeys([*left, *right])).agg(F.sum(F.least("n", "m")).alias("shared"))
    return shared.join(tx, left).join(ty, right).withColumn("similarity", F.col("shared") / F.greatest("total_a", "total_b"))


def present_near(records: DataFrame, pages: DataFrame, key: str, least: int = 14, reach: int = 1) -> DataFrame:
    """Records whose key of at least `least` characters stands in the blob of a page at most `reach` pages away."""
    around = records.where(F.length(key) >= least).select("pair_id", "ord", key, F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)).alias("page"))
    blobs = pages.select("pair_id", "page", "blob")
    found = around.join(blobs, ["pair_id", "page"]).where(F.contains("blob", F.col(key))).select("pair_id", "ord").distinct()
    return records.join(found, ["pair_id", "ord"], "left_semi")


def aligned(rows: DataFrame, keys: list[str], cutoff: float = 0.6) -> DataFrame:
    """Order-true alignment per group, by longest matching runs: (keys, op, prod_ord, stage_ord). Rows are (keys, side, ord, key).

    Inside a replaced stretch, pairs are made by best ratio first, each side once, down to `cutoff`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {k: pdf[k].iloc[0] for k in keys}
        a, b = (pdf[pdf.side == s].sort_values("ord") for s in ("prod", "stage"))
        x, y, xo, yo = a.key.tolist(), b.key.tolist(), a.ord.tolist(), b.ord.tolist()
        out = []
        for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                out += [("same", xo[i + d], yo[k + d]) for d in range(j - i)]
                continue
            scored = []
            for q in range(k, m) if op == "replace" else ():
                other = SequenceMatcher(autojunk=False)
                other.set_seq2(y[q])
                for p in range(i, j):
                    other.set_seq1(x[p])
                    # Two upper bounds rule out most pairs before any run is looked for.
                    if other.real_quick_ratio() >= cutoff and other.quick_ratio() >= cutoff:
                        scored.append((-other.ratio(), p, q))
            scored.sort()
            left, right = set(range(i, j)), set(range(k, m))
            for r, p, q in scored:
                if -r < cutoff:
                    break
                if p in left and q in right:
                    left.remove(p)
                    right.remove(q)
                    out.append(("changed", xo[p], yo[q]))
            out += [("missing", xo[p], None) for p in sorted(left)] + [("added", None, yo[q]) for q in sorted(right)]
        frame = pd.DataFrame(out, columns=["op", "prod_ord", "stage_ord"]).astype({"prod_ord": "Int64", "stage_ord": "Int64"})
        return frame.assign(**own)[[*keys, "op", "prod_ord", "stage_ord"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", op string, prod_ord long, stage_ord long")


def _diff(a: list[str], b: list[str]) -> list[dict]:
    out: list[dict] = []

    def push(kind: str, text: str, level: str | None = None) -> None:
        if text and out and out[-1]["type"] == kind and out[-1]["level"] == level:
            out[-1]["text"] += text
        elif text:
            out.append({"type": kind, "text": text, "level": level})

    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x, y = "".join(a[i:j]), "".join(b[k:m])
        if op == "equal":
            push("equal", x)
        elif op == "replace" and j - i == m - k == 1 and min(len(x), len(y)) >= 3 and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.5:
            # One word for a similar one is shown letter by letter.
            for o, p, q, r, s in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                push("equal", x[p:q]) if o == "equal" else (push("del", x[p:q], "char"), push("ins", y[r:s], "char"))
        else:
            push("del", x)
            push("ins", y)
    return out


@F.pandas_udf(OPS)
def word_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Equal, deleted and inserted runs of two token arrays."""
    for a, b in batches:
        yield pd.Series([_diff(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def greedy_pairs(scored: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one matches, best score first (ties by left, then right), within `keys`; a group's candidates must fit into a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True])
        a, b, keep = set(), set(), []
        for i, (x, y) in enumerate(zip(pdf[left], pdf[right], strict=True)):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                keep.append(i)
        return pdf.iloc[keep]

    return scored.groupBy(*keys).applyInPandas(run, scored.schema)


def lost_emphasis(fractions: DataFrame, least: float = 0.20) -> Column:
    """Prod's share is at least `least` and falls by as much."""
    return (F.col("prod_share") >= least) & (F.col("prod_share") - F.col("stage_share") >= least)


def top_per(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows of each group: a budget for what is reported."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def longest_rising(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The rows of a longest strictly rising run of `value` in `order`, by patience sorting per group."""
    from bisect import bisect_left

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, value], ascending=[True, False])
        tops, last, back = [], [], []
        for i, v in enumerate(pdf[value]):
            k = bisect_left(tops, v)
            tops[k : k + 1], last[k : k + 1] = [v], [i]
            back.append(last[k - 1] if k else -1)
        at, keep = last[-1] if last else -1, []
        while at >= 0:
            keep.append(at)
            at = back[at]
        return pdf.iloc[keep[::-1]]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def touching_pairs(boxes: DataFrame, keys: list[str], order: str, cell: float = 50.0) -> DataFrame:
    """Pairs (a, b) of boxes of `keys` that share some area, each once, `order` rising: boxes meet in the cells of a grid that they lie in, and only
    in the one that holds the corner of what they share. Boxes: keys, `order`, b STRUCT<x0, y0, x1, y1>."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    row = F.struct(order, "b")
    dealt = boxes.select(*keys, row.alias("r"), F.explode(cells("b.x0", "b.x1")).alias("cx")).select(*keys, "r", "cx", F.explode(F.sequence(F.floor(F.col("r.b.y0") / cell), F.floor(F.col("r.b.y1") / cell))).alias("cy"))
    a, b = dealt.withColumnRenamed("r", "a"), dealt.withColumnRenamed("r", "c")
    corner = lambda axis: F.floor(F.greatest(f"a.b.{axis}", f"c.b.{axis}") / cell)
    met = a.join(b, [*keys, "cx", "cy"]).where((F.col(f"a.{order}") < F.col(f"c.{order}")) & (F.col("cx") == corner("x0")) & (F.col("cy") == corner("y0")))
    return met.select(*keys, F.col("a").alias("a"), F.col("c").alias("b"))
