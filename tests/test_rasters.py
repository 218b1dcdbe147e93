import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import rasters as Z


def drawing(seed=0, h=120, w=160):
    rnd = np.random.default_rng(seed)
    img = np.full((h, w), 255.0)
    for _ in range(14):
        y, x = rnd.integers(0, h - 12), rnd.integers(0, w - 12)
        img[y : y + rnd.integers(3, 30), x : x + rnd.integers(3, 30)] = rnd.integers(0, 200)
    return img


def blur(img, k):
    out = img.copy()
    for _ in range(k):
        out = (np.roll(out, 1, 0) + np.roll(out, -1, 0) + np.roll(out, 1, 1) + np.roll(out, -1, 1) + out) / 5
    return out


def raw(img):
    return bytearray(img.astype(np.uint8).tobytes()), img.shape[1], img.shape[0]


def test_correlations_equal_a_plain_search():
    rnd = np.random.default_rng(1)
    small, large = rnd.normal(size=(6, 7)), rnd.normal(size=(15, 18))
    got = Z.correlations(small, large)
    for y in range(10):
        for x in range(12):
            assert abs(got[y, x] - np.corrcoef(small.ravel(), large[y : y + 6, x : x + 7].ravel())[0, 1]) < 1e-9
    assert Z.correlations(np.zeros((6, 6)), large) is None and Z.correlations(large, small) is None


def test_sliding_finds_a_part(spark):
    whole, part, other = drawing(2, 90, 100), drawing(2, 90, 100)[20:70, 30:90], drawing(9, 90, 100)
    rows = [(*raw(part), *raw(whole)), (*raw(other[20:70, 30:90]), *raw(whole)), (None, 0, 0, *raw(whole))]
    got = [r.s for r in spark.createDataFrame(rows, "a binary, aw int, ah int, b binary, bw int, bh int").select(Z.slide_score("a", "aw", "ah", "b", "bw", "bh").alias("s")).collect()]
    assert got[0] >= 0.95 and got[1] < 0.84 and got[2] is None


def test_sharpness_ink_and_colour(spark):
    sharp = np.random.default_rng(3).integers(0, 255, (60, 80)).astype(float)
    colour = np.zeros((4, 4, 3), np.uint8)
    colour[:2] = (200, 20, 20)
    rows = [(*raw(sharp),), (*raw(blur(sharp, 20)),), (*raw(np.full((40, 40), 9.0)),), (*raw(sharp[:10, :10]),)]
    df = spark.createDataFrame(rows, "d binary, w int, h int")
    got = [r.s for r in df.select(Z.sharpness("d", "w", "h").alias("s")).collect()]
    assert got[0] > 0.05 and got[1] < 0.65 * got[0] and got[2] is None and got[3] is None
    assert spark.createDataFrame([(bytearray(colour.tobytes()), 4, 4)], "d binary, w int, h int").select(Z.colour_share("d", "w", "h").alias("c")).first().c == 0.5
    light, bold = np.full((20, 60), 255.0), np.full((20, 60), 255.0)
    light[5:15, 10::8], bold[5:15, 10::8], bold[5:15, 11::8] = 0, 0, 0
    ink = [r.i for r in spark.createDataFrame([(*raw(light),), (*raw(bold),), (*raw(bold),)], "d binary, w int, h int").select(Z.ink("d", "w", "h").alias("i")).collect()]
    assert ink[1] > 1.5 * ink[0] and ink[1] == ink[2]


def test_tall_clusters_are_cut_where_nothing_is_drawn(spark):
    img = np.full((400, 100), 255.0)
    img[10:180, 10:90], img[220:390, 10:90] = 0, 0
    marks = [(10.0 + 40 * k, 45.0 + 40 * k) for k in range(4)] + [(220.0 + 40 * k, 255.0 + 40 * k) for k in range(4)]
    schema = "d binary, w int, h int, y0 double, y1 double, x0 double, x1 double, marks array<struct<y0:double,y1:double>>"
    cut = lambda rows: [[(round(p.y0), round(p.y1)) for p in r.p] for r in spark.createDataFrame(rows, schema).select(Z.split_tall("d", "w", "h", "y0", "y1", "x0", "x1", "marks").alias("p")).collect()]
    assert cut([(*raw(img), 0.0, 400.0, 0.0, 100.0, marks), (*raw(img), 0.0, 400.0, 0.0, 100.0, marks[:5]), (*raw(img), 0.0, 300.0, 0.0, 100.0, marks), (None, 0, 0, 0.0, 400.0, 0.0, 100.0, marks)]) == [[(0, 200), (200, 400)], [(0, 400)], [(0, 300)], [(0, 400)]]


def test_artwork_is_found_at_another_size_or_not_at_all(spark):
    art = drawing(4, 60, 80)
    page = np.full((300, 260), 255.0)
    big = Z.resized(art, 72, 96)
    page[100:172, 60:156] = big
    rows = [(*raw(art), *raw(page)), (*raw(art), *raw(drawing(8, 300, 260)))]
    hit, miss = [r.f for r in spark.createDataFrame(rows, "a binary, aw int, ah int, b binary, bw int, bh int").select(Z.find_artwork("a", "aw", "ah", "b", "bw", "bh").alias("f")).collect()]
    assert abs(hit.x0 - 60) < 12 and abs(hit.y0 - 100) < 12 and miss.x0 is None


def test_differing_regions_by_grey_and_by_hue(spark):
    base = np.repeat(drawing(5)[:, :, None], 3, axis=2)
    spot, badge, green = base.copy(), base.copy(), base.copy()
    spot[90:105, 20:35] = 255 - spot[90:105, 20:35]
    badge[10:26, 120:136], green[10:26, 120:136] = (217, 25, 25), (25, 119, 25)
    rows = [(*raw3(base), *raw3(spot)), (*raw3(base), *raw3(base)), (*raw3(badge), *raw3(green)), (*raw3(base), *raw3(255 - base)), (*raw3(base), *raw3(np.roll(base, 3, 1)))]
    got = [r.b for r in spark.createDataFrame(rows, "a binary, aw int, ah int, b binary, bw int, bh int").select(Z.differing_regions("a", "aw", "ah", "b", "bw", "bh").alias("b")).collect()]
    inside = lambda boxes, x, y: any(b.x0 <= x <= b.x1 and b.y0 <= y <= b.y1 for b in boxes)
    assert inside(got[0], 27, 97) and got[1] == [] and inside(got[2], 128, 18) and got[3] == [] and got[4] == []
    assert spark.range(1).select(F.lit(1)).count() == 1


def raw3(img):
    return bytearray(img.clip(0, 255).astype(np.uint8).tobytes()), img.shape[1], img.shape[0]
