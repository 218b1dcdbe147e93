"""Figures: clusters of shapes, fingerprints, matches, what became of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import geometry as G
from palimpsest.operators.ordered import by_group

# Fixed values.
SIDE, AREA, GAP = 60.0, 6000.0, 12.0
FEATURELESS, BLANK, BLUR_SHARE, BLUR_FLOOR = 2.0, 1.0, 0.65, 0.05
PAGE = ["pair_id", "side", "page"]
FINGERPRINT = T.StructType([T.StructField("dhash", T.LongType()), T.StructField("thumb", T.ArrayType(T.FloatType())), T.StructField("stddev", T.DoubleType())])


def clusters(shapes: DataFrame, gap: float = GAP) -> DataFrame:
    """Shapes of a page (pair_id, side, page, shape, x0..y1) with the number of the cluster they grow into: boxes that
    touch within `gap` are joined until none do. A page is one group; its shapes are swept by their left edges."""

    columns = [*PAGE, *[c for c in shapes.columns if c not in PAGE]]
    at = [columns.index(c) for c in ("x0", "y0", "x1", "y1")]

    def run(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [(*rows[0], 0)]
        boxes = [[*[math.nan if r[c] is None else r[c] for c in at], [i]] for i, r in enumerate(rows)]
        grown = True
        while grown:
            grown, out, near = False, [], []
            for b in sorted(boxes, key=lambda b: b[0]):
                # What ends left of this box ends left of all that follow.
                near = [o for o in near if not o[2] < b[0] - gap]
                for o in near:
                    if b[0] - gap <= o[2] and o[0] - gap <= b[2] and b[1] - gap <= o[3] and o[1] - gap <= b[3]:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4]]
                        grown = True
                        break
                else:
                    out.append(b)
                    near.append(b)
            boxes = out
        number = [0] * len(rows)
        for k, b in enumerate(sorted(boxes, key=lambda b: (b[1], b[0]))):
            for i in b[4]:
                number[i] = k
        return [(*r, k) for r, k in zip(rows, number, strict=True)]

    schema = T.StructType([*[shapes.schema[c] for c in columns], T.StructField("cluster", T.LongType())])
    return by_group(shapes, PAGE, ["x0", "shape"], run, schema).select(*shapes.columns, "cluster")


def vector_figures(clustered: DataFrame, least: int = 4) -> DataFrame:
    """Clusters large enough to be figures: four primitives, 60 points a side, 6000 square points."""
    f = clustered.groupBy(*PAGE, "cluster").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("primitives"))
    return f.where((F.col("primitives") >= least) & meaningful(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def meaningful(width: Column, height: Column) -> Column:
    return (width >= SIDE) & (height >= SIDE) & (width * height >= AREA)


def not_covered(figures: DataFrame, others: DataFrame, most: float = 0.6) -> DataFrame:
    """Figures of which no other box of their page covers more than `most`."""
    o = others.select(*PAGE, F.struct("x0", "y0", "x1", "y1").alias("_o"))
    own = F.struct("x0", "y0", "x1", "y1")
    covered = figures.join(o, PAGE).where(G.overlap_fraction(own, F.col("_o")) > most).select(*figures.columns)
    return figures.join(covered, figures.columns, "left_anti")


@F.pandas_udf(FINGERPRINT)
def fingerprint(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """A 32 x 32 standardised thumbnail, the 64 signs of horizontal differences of an 8 x 9 one, and the standard deviation."""

    def boxes(img: np.ndarray, rows: int, cols: int) -> np.ndarray:
        total = np.pad(img.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        y, x = (np.linspace(0, n, k + 1).round().astype(int) for n, k in zip(img.shape, (rows, cols), strict=True))
        y1, x1 = np.maximum(y[1:], y[:-1] + 1).clip(max=img.shape[0]), np.maximum(x[1:], x[:-1] + 1).clip(max=img.shape[1])
        y0, x0 = np.minimum(y[:-1], y1 - 1), np.minimum(x[:-1], x1 - 1)
        s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
        return s / np.outer(y1 - y0, x1 - x0)

    out = []
    for data, w, h in zip(gray, width, height, strict=True):
        if data is None or not w or not h or len(data) < w * h:
            out.append((None, None, None))
            continue
        img = np.frombuffer(data, np.uint8, int(w * h)).reshape(int(h), int(w)).astype(float)
        small, sd = boxes(img, 32, 32), float(img.std())
        thumb = (small - small.mean()) / (small.std() or 1.0)
        bits = np.diff(boxes(img, 8, 9), axis=1).ravel() > 0
        out.append((int(np.packbits(bits).view(">i8")[0]), thumb.ravel().astype(np.float32).tolist(), sd))
    return pd.DataFrame(out, columns=["dhash", "thumb", "stddev"])


def similarity(a: Column, b: Column) -> Column:
    """0.55 of the equal hash bits and 0.45 of the thumbnails' correlation, where that is positive."""
    hashes = 1 - F.bit_count(a["dhash"].bitwiseXOR(b["dhash"])) / 64.0
    dot = F.aggregate(F.zip_with(a["thumb"], b["thumb"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / F.size(a["thumb"])
    return 0.55 * hashes + 0.45 * F.greatest(dot, F.lit(0.0))


def leftover_status(score: Column, aspect_gap: Column, area_ratio: Column, missing: Column) -> Column:
    """What an unmatched figure's counterpart by position is: same, differs, review or missing."""
    comparable = (aspect_gap <= 0.08) & (area_ratio <= 1.4)
    return F.when(missing, "missing").when(score >= 0.85, "same").when(~comparable & (score >= 0.78), "same").when(comparable & (score < 0.55), "differs").otherwise("review")


def is_resized(w0: Column, h0: Column, w1: Column, h1: Column) -> Column:
    """Scaled by 15 % and 12 points or more, at most twofold and nearly alike both ways; counted, not raised."""
    x, y = w1 / w0, h1 / h0
    return ((F.abs(x - 1) >= 0.15) & (F.abs(w1 - w0) >= 12)) & F.greatest(x, 1 / x).between(1, 2) & (F.abs(x - y) <= 0.1 * F.greatest(x, y))


def place_class(x0: Column, x1: Column, page_width: Column) -> Column:
    """left, centre or right by the middle of a figure, eight hundredths about the page's middle being centre."""
    off = (x0 + x1) / 2 / page_width - 0.5
    return F.when(F.abs(off) <= 0.08, "centre").when(off < 0, "left").otherwise("right")


def broken_reason(length: Column, decodable: Column, off_page: Column, pixels: Column, stddev: Column) -> Column:
    """Why an image shows nothing, null if it does."""
    return F.when(F.coalesce(length, F.lit(0)) == 0, "empty stream").when(~decodable, "cannot be decoded").when(off_page, "outside the page").when(pixels == 0, "no pixels").when((pixels >= 100) & (stddev < BLANK), "blank")


def is_blurred(prod_sharpness: Column, stage_sharpness: Column) -> Column:
    """Edge energy by contrast fell under 65 % of what was sharp enough to tell."""
    return (prod_sharpness >= BLUR_FLOOR) & (stage_sharpness / prod_sharpness < BLUR_SHARE)


def numbers_lost(prod: Column, stage: Column) -> Column:
    """Callout numbers that the candidate lost: missing where some stay, stripped where none of four or more does."""
    gone = F.array_except(prod, stage)
    return F.when(F.size(gone) == 0, None).when((F.size(gone) == F.size(prod)) & (F.size(prod) >= 4), "callouts stripped").when(F.size(gone) < F.size(prod), "callout number missing")


def summary(pairs: DataFrame) -> DataFrame:
    """Counts of statuses and sizes by section."""
    return pairs.groupBy("pair_id", "section").agg(F.count("*").alias("figures"), *[F.count_if(F.col("status") == s).alias(s) for s in ("same", "differs", "review", "outside", "missing")], F.count_if("resized").alias("resized"))


#: What is said of each status, and how severe it is: fixed values.
STATUS = {"differs": ("Image content differs", "error"), "review": ("Image could not be confirmed identical", "warning"), "outside": ("Image outside its section", "warning"), "missing": ("Image missing", "error")}
SAME, SLIDE_SAME, INTEREST, UNION_AREA = 0.90, 0.84, 0.20, 2.5
SATURATED, LEAST_BOX, MOST_SIDE, MOST_BOXES, FAR = 0.45, 16.0, 0.98, 4, 60.0
CAPTION_WORDS, CAPTION_GAP, LEAST_WORD = 8, 30.0, 3


def status_findings(pairs: DataFrame) -> DataFrame:
    """What is reported of pairs that are not the same: message, severity, confidence (what is up for review fails nothing)."""
    status = F.col("status")
    message, severity = (F.coalesce(*[F.when(status == k, v[n]) for k, v in STATUS.items()]) for n in (0, 1))
    return pairs.where(status != "same").withColumn("message", message).withColumn("severity", severity).withColumn("confidence", F.when(status == "review", "review").otherwise("confirmed"))


def union_candidates(figures: DataFrame) -> DataFrame:
    """Two figures that follow each other in their section, as one box: (pair_id, section, first, second, box). What a figure cut in two makes.

    Figures: pair_id, section, fig, ord, page, box.
    """
    w = Window.partitionBy("pair_id", "section").orderBy("ord")
    both = figures.withColumn("_n", F.lead(F.struct("fig", "page", "x0", "y0", "x1", "y1")).over(w)).where(F.col("_n.page") == F.col("page"))
    box = [f(c, f"_n.{c}").alias(c) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))]
    return both.select("pair_id", "section", "page", F.col("fig").alias("first"), F.col("_n.fig").alias("second"), *box)


def matched_in_steps(direct: DataFrame, unions: DataFrame, slid: DataFrame, spilled: DataFrame) -> DataFrame:
    """One-to-one matches of a section's figures, step by step, each with what the steps before left over.

    Scores from 0.90 on; then a figure of one side with two that follow each other on the other, the union being at most two and a half
    times as large; then what is found inside another by sliding, from 0.84 on, if the two score 0.20 at all; then figures of the page
    after the section, which count as outside. Relations: pair_id, section, prod, stage, score; `unions` also second and area_ratio; `slid`
    also slide. A section's candidates must fit into a task.
    """
    none = F.lit(None)
    shape = lambda df, step, score="score", second=none, ratio=none, slide=none: df.select("pair_id", "section", "prod", "stage", second.cast("long").alias("second"), F.col(score).cast("double").alias("score"), ratio.cast("double").alias("ratio"), slide.cast("double").alias("slide"), F.lit(step).alias("step"))
    rows = shape(direct, 1).unionAll(shape(unions, 2, second=F.col("second"), ratio=F.col("area_ratio"))).unionAll(shape(slid, 3, slide=F.col("slide"))).unionAll(shape(spilled, 4))
    fit = ((F.col("step").isin(1, 4)) & (F.col("score") >= SAME)) | ((F.col("step") == 2) & (F.col("score") >= SAME) & (F.col("ratio") <= UNION_AREA)) | ((F.col("step") == 3) & (F.col("score") >= INTEREST) & (F.col("slide") >= SLIDE_SAME))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.slide.where(pdf.step == 3, pdf.score)
        pdf = pdf.assign(best=best).sort_values(["step", "best", "prod", "stage"], ascending=[True, False, True, True])
        a, b, out = set(), set(), []
        for r in pdf.itertuples():
            taken = {r.stage} | ({int(r.second)} if r.second == r.second and r.second is not None else set())
            if r.prod not in a and not taken & b:
                a.add(r.prod)
                b |= taken
                out.append((r.pair_id, r.section, r.prod, r.stage, int(r.second) if len(taken) == 2 else None, float(r.best), r.step, "outside" if r.step == 4 else "same"))
        frame = pd.DataFrame(out, columns=["pair_id", "section", "prod", "stage", "second", "score", "step", "status"])
        return frame.astype({"second": "Int64"})

    kinds = dict(direct.dtypes)
    return rows.where(fit).groupBy("pair_id", "section").applyInPandas(run, f"pair_id {kinds['pair_id']}, section {kinds['section']}, prod {kinds['prod']}, stage {kinds['stage']}, second long, score double, step int, status string")


def highlight_boxes(figures: DataFrame, draws: DataFrame) -> DataFrame:
    """(PAGE, fig, dx, dy, x0..y1): stroked, saturated rectangles over each figure, sixteen points a side, smaller than the figure, four at most (more are the artwork's own).

    Draws: type (s or sf), closed, items (1 for a rectangle, 4 for four lines), stroke. dx and dy count from the figure's corner.
    """
    # In whole channels: shares of 255 can fall short of a saturation that is met to the point.
    channels = [F.shiftright("stroke", n).bitwiseAND(F.lit(255)) for n in (16, 8, 0)]
    top = F.greatest(*channels)
    saturated = (top - F.least(*channels)) / F.when(top > 0, top) >= SATURATED
    d = draws.where(F.col("type").isin("s", "sf") & ((F.col("items") == 1) | (F.col("closed") & (F.col("items") == 4))) & saturated).select(*PAGE, *[F.col(c).alias(f"d_{c}") for c in ("x0", "y0", "x1", "y1")])
    w, h = F.col("d_x1") - F.col("d_x0"), F.col("d_y1") - F.col("d_y0")
    fw, fh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    over = (F.least("x1", "d_x1") > F.greatest("x0", "d_x0")) & (F.least("y1", "d_y1") > F.greatest("y0", "d_y0"))
    found = figures.join(d, PAGE).where(over & (w >= LEAST_BOX) & (h >= LEAST_BOX) & ~((w >= MOST_SIDE * fw) & (h >= MOST_SIDE * fh)))
    n = F.count("*").over(Window.partitionBy(*PAGE, "fig"))
    return found.withColumn("_n", n).where(F.col("_n") <= MOST_BOXES).select(*PAGE, "fig", (F.col("d_x0") - F.col("x0")).alias("dx"), (F.col("d_y0") - F.col("y0")).alias("dy"))


def highlights_missing(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Highlight boxes of baseline figures without one within sixty points, measured from the figure's corner, on the matched figure. Pairs: pair_id, prod, stage."""
    p = boxes.where("side = 'prod'").join(pairs, (boxes.pair_id == pairs.pair_id) & (F.col("fig") == F.col("prod"))).select(boxes.pair_id, "fig", "stage", "dx", "dy")
    s = boxes.where("side = 'stage'").select("pair_id", F.col("fig").alias("stage"), F.col("dx").alias("s_dx"), F.col("dy").alias("s_dy"))
    near = p.join(s, ["pair_id", "stage"]).where((F.abs(F.col("dx") - F.col("s_dx")) <= FAR) & (F.abs(F.col("dy") - F.col("s_dy")) <= FAR)).select("pair_id", "fig", "dx", "dy").distinct()
    return p.join(near, ["pair_id", "fig", "dx", "dy"], "left_anti").select("pair_id", "fig", "dx", "dy")


def caption_words(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """(PAGE, fig, words): the words of three letters or more of lines of eight words at most within thirty points above or below a figure."""
    short = lines.where(F.size(F.split(F.trim("text"), r"\s+")) <= CAPTION_WORDS).select(*PAGE, F.col("text"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    beside = (F.least("x1", "l_x1") > F.greatest("x0", "l_x0")) & ((F.col("l_y0") - F.col("y1")).between(0, CAPTION_GAP) | (F.col("y0") - F.col("l_y1")).between(0, CAPTION_GAP))
    word = F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= LEAST_WORD))
    return figures.join(short, PAGE).where(beside).select(*PAGE, "fig", word.alias("word")).groupBy(*PAGE, "fig").agg(F.array_sort(F.collect_set("word")).alias("words"))


def labels_missing(captions: DataFrame, pairs: DataFrame, read: DataFrame) -> DataFrame:
    """Caption words of a baseline figure that neither the matched figure's caption holds nor were read in its picture; only for figures that were read. Read: pair_id, stage, words."""
    p = captions.where("side = 'prod'").select("pair_id", F.col("fig").alias("prod"), F.col("words").alias("own"))
    s = captions.where("side = 'stage'").select("pair_id", F.col("fig").alias("stage"), F.col("words").alias("there"))
    both = pairs.join(p, ["pair_id", "prod"]).join(s, ["pair_id", "stage"], "left").join(read.select("pair_id", "stage", F.col("words").alias("seen")), ["pair_id", "stage"])
    none = F.expr("cast(array() as array<string>)")
    return both.withColumn("missing", F.array_except("own", F.concat(F.coalesce("there", none), "seen"))).where(F.size("missing") > 0).select("pair_id", "prod", "stage", "missing")


def legend_stripped(numbers: DataFrame) -> DataFrame:
    """Figures whose callout numbers all went although a list beside them still names them. Numbers: prod, stage, legend (arrays): four numbers, seven tenths in the list."""
    n = F.size("prod")
    return numbers.where((n >= 4) & (F.size(F.array_intersect("prod", "stage")) == 0) & (F.size(F.array_intersect("prod", "legend")) >= 0.7 * n))
