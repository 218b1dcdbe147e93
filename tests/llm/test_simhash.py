import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_fp(text, shingle):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute(rows, shingle, radius):
    fps = [brute_fp(r[1], shingle) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "délta", "Ümlaut", "x", "İota", "z\x1cw"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 40, 300])))) for i in range(40)]
    for i in range(40, 90):
        t = rnd.choice(rows)[1].split(" ")
        if rnd.random() < 0.7:
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(t)))
    rows += [(95, None), (94, ""), (96, " \n\t"), (None, None), (None, "lone words here"), (3, rows[3][1]), (3, rows[3][1]), (97, "word " * 30000)]
    return [(*r, "clash", 1) for r in rows]


def test_components_equal_brute_force(spark):
    rows = corpus()
    for shingle, radius, cell_rows in ((3, 3, 4096), (5, 3, 2), (3, 6, 4096)):
        got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=shingle, radius=radius, cell_rows=cell_rows).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, shingle, radius)


def test_links_connect_all_that_is_within_the_radius(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:200]:
        for _ in range(4):
            y = x
            for _ in range(rnd.randrange(5)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    from palimpsest.llm.components import components

    for cell_rows, groups in ((4096, None), (3, 6), (4096, 9)):
        links = simhash.links(spark.createDataFrame(signed, "fp long"), cell_rows=cell_rows, n_groups=groups)
        assert links.where(F.expr("bit_count(a ^ b) > 3")).count() == 0
        root = {r.node: r.root for r in components(links).collect()}
        for i, j in near:
            assert root[signed[i][0]] == root[signed[j][0]]


def test_the_manhattan_distance_rules_out_most_pairs_and_no_link():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2**64, 20000, dtype=np.uint64)
    b = rnd.integers(0, 2**64, 20000, dtype=np.uint64)
    b[:4000] = a[:4000]
    for _ in range(3):
        b[:4000] ^= np.uint64(1) << rnd.integers(0, 64, 4000).astype(np.uint64)
    plain = lambda x, y: sum(abs((int(x) >> 4 * s & 15).bit_count() - (int(y) >> 4 * s & 15).bit_count()) for s in range(16))
    got = simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b))
    assert got.tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    hamming = np.bitwise_count(a ^ b)
    assert (got <= hamming).all() and (got[hamming <= 3] <= 3).all()
    # Of the pairs that share the counts of three groups of six, which is what meets in a cell, few pass.
    words = [sum(15 << 4 * s for s in range(16) if s % 6 < 3), sum(15 << 4 * s for s in range(16) if s % 6 >= 3)]
    c = (a & np.uint64(words[0])) | (b & np.uint64(words[1]))
    left = simhash.manhattan(simhash.popcounts(a[4000:]), simhash.popcounts(c[4000:])) <= 3
    assert left.mean() < 0.1
    assert (simhash.near(a, b, simhash.popcounts(a), simhash.popcounts(b), 3) == (hamming <= 3)).all()


def test_more_fingerprints_make_more_groups():
    sizes = [simhash.groups_for(n, 3) for n in (10, 10**5, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 4 < sizes[1] < sizes[-1] <= 16


def test_a_fingerprint_of_many_rows_is_joined_in_parts(spark):
    rows = corpus() + [(1000 + i, "the very same words again", "", 0) for i in range(50)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, share_rows=7).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == ["doc_id", "text", "fp", "root"]


def test_keep_one(spark):
    rows = [(5, "one two three four five six", "a", 1), (2, "One two three four five six", "b", 2), (9, "quite another text of some words", "c", 3), (9, "quite another text of some words", "c", 3), (None, "one two three four five six", "d", 4)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.fp) for r in kept) == [(False, 2, "b"), (False, 9, "c"), (False, 9, "c"), (True, None, "d")]
