import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, rep int"


def brute(rows, asked, k):
    ok = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            s = sorted((-(ok[q] * x).sum(), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))
            out[q] = [(i, -m) for m, i in s[:k]]
    return out


def vectors(n, d, rnd, norms=False):
    x = rnd.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x *= np.exp(rnd.normal(size=(n, 1))).astype(np.float32)
    return [(i, v.tolist(), 0.5, 1) for i, v in enumerate(x)]


def check(spark, rows, asked, k=5, least=0.9, **settings):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(frame, frame.where(frame.vec_id.isin(asked)), k=k, **settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = brute(rows, asked, k)
    assert set(got) == {q for q, w in want.items() if w}
    exact = {i: np.array(v, float) for i, v, *_ in rows if v and i is not None and None not in v}
    hit = 0
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for i, s, _ in found] == sorted((-s, i) for i, s, _ in found) and q not in [i for i, *_ in found]
        assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-12 for i, s, _ in found)
        hit += len({i for i, *_ in found} & {i for i, _ in want[q]})
    total = sum(map(len, want.values()))
    assert hit >= least * total
    return hit / max(1, total)


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(7, 16))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.turned(x, 3, 1), ann.rotated(x, 3, 1))


def odd_rows():
    rnd = np.random.default_rng(1)
    rows = vectors(120, 6, rnd, norms=True)
    rows += [(200, None, 0.0, 0), (201, [], 0.0, 0), (202, [0.0] * 6, 0.0, 0), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.0, 0), (204, [float("nan")] * 6, 0.0, 0), (205, [float("inf")] * 6, 0.0, 0), (None, [1.0] * 6, 0.0, 0), (206, [1.0, 2.0], 0.0, 0), (207, [3.0, 1.0], 0.0, 0)]
    return rows + [(300 + i, rows[7][1], 0.0, 0) for i in range(40)] + [rows[3], rows[3]]


ODD = [0, 7, 20, 200, 204, 206, 300, 310, 119]


def test_odd_rows_and_an_exact_search(spark):
    assert check(spark, odd_rows(), ODD, recall=1.0, least=1.0) == 1.0
    assert check(spark, odd_rows(), ODD) >= 0.9


def test_shards_lose_nothing(spark):
    rows = vectors(150, 4, np.random.default_rng(2))
    assert check(spark, rows, list(range(0, 150, 3)), least=1.0, recall=1.0, shard_bytes=500) == 1.0
    assert check(spark, rows, list(range(0, 150, 3)), shard_bytes=500) >= 0.9


def test_recall_of_the_hashed_search(spark):
    rnd = np.random.default_rng(3)
    assert check(spark, vectors(3000, 64, rnd), list(range(0, 3000, 60)), k=20) >= 0.9
    assert check(spark, vectors(1500, 16, rnd, norms=True), list(range(0, 1500, 60)), k=10) >= 0.9


def test_norms_beyond_doubles(spark):
    rows = [(i, [1e200 * (i + 1), 1e200]) for i in range(4)] + [(10 + i, [1e-200, 1e-200 * (i + 1)]) for i in range(4)] + [(20, [1.7e308, -1.7e308]), (21, [5e-324, 0.0]), (22, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, frame, k=3, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    with np.errstate(all="ignore"):
        for i, v in rows:
            s = [(-(p if not np.isnan(p := float((np.array(v) * np.array(x)).sum())) else -np.inf), j) for j, x in rows if j != i]
            assert got[i] == [(j, -m) for m, j in sorted(s)[:3]]
    assert len(ann.nearest(frame, frame, k=3).collect()) == 3 * len(rows)


def test_ranks_are_places_in_the_order_of_cells():
    rnd = np.random.default_rng(5)
    x, y = rnd.normal(size=(2, 40, 8))
    for axes in ([16], [16, 8], [16, 16, 4]):
        near, cell = ann.nearness(x, 1, axes, 3), ann.cells_of(ann.nearness(y, 1, axes, 3))
        order = ann.probes_of(near, int(np.prod(axes)))
        assert (np.sort(order, axis=1) == np.arange(np.prod(axes))).all()
        assert (ann.rank_of(near, cell) == (order == cell[:, None]).argmax(axis=1) + 1).all()
        few = ann.probes_of(near, 5)  # two cells may be equally near
        assert all((ann.rank_of(near, few[:, k]) <= k + 1).all() for k in range(5))


@pytest.mark.parametrize("norms", [False, True])
def test_a_part_of_many_vectors_is_looked_at(spark, tmp_path, norms):
    rnd = np.random.default_rng(6)
    n, d = 50_000, 64
    centres = rnd.normal(size=(n // 50, d))
    x = centres[rnd.integers(len(centres), size=n)] + rnd.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x *= np.exp(0.5 * rnd.normal(size=(n, 1)))
    x = x.astype(np.float32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), tmp_path / "v.parquet")
    frame = spark.read.parquet(str(tmp_path / "v.parquet"))
    asked = np.arange(0, n, 250)
    queries = frame.where("vec_id % 250 = 0")
    made = ann.build(frame, queries)
    looked = made.index.looked(made.distinct.where("asks"), made.held, 21).selectExpr("avg(looked)").first()[0]
    got = {}
    for r in ann.nearest(frame, queries).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[asked].astype(float) @ x.T.astype(float)
    s[np.arange(len(asked)), asked] = -np.inf
    hit = sum(len(got[q] & set(np.argsort(-row, kind="stable")[:20].tolist())) for q, row in zip(asked.tolist(), s, strict=True))
    print(f"norms {norms}: recall {hit / 20 / len(asked):.3f}, looked at {looked / n:.3f}")
    assert hit >= 0.9 * 20 * len(asked) and looked <= 0.1 * n


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(frame, frame).count() == 0


def odd_kinds():
    rnd = np.random.default_rng(4)
    made = lambda x: [(i, v.tolist(), 0.5, 1) for i, v in enumerate(x.astype(np.float32))]
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    some = unit(rnd.normal(size=(4000, 64)))
    yield "norms 0.3", made(some * np.exp(0.3 * rnd.normal(size=(4000, 1)))), range(0, 4000, 100)
    yield "norms 1", made(some * np.exp(rnd.normal(size=(4000, 1)))), range(0, 4000, 100)
    yield "wide", vectors(1500, 768, rnd), range(0, 1500, 75)
    # Ten tight clusters, and strangers to them that are the only ones to ask.
    near = rnd.normal(size=(10, 64))[np.arange(3000) % 10] + 0.05 * rnd.normal(size=(3000, 64))
    yield "outliers", made(unit(np.concatenate((near, rnd.normal(size=(30, 64)))))), range(3000, 3030)


def test_recall_holds_for_uneven_norms_wide_vectors_and_outliers(spark):
    got = {kind: check(spark, rows, list(asked), k=20, least=0) for kind, rows, asked in odd_kinds()}
    assert min(got.values()) >= 0.9, got


def test_hashing_is_good_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding, 0.0, 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert check(spark, rows, list(range(0, 500, 20)), k=20) >= 0.9
