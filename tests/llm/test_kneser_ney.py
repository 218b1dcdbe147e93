import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from palimpsest.llm import common
from palimpsest.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string, lm string"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Plain:
    def __init__(self, texts):
        self.uni, self.pairs = Counter(), Counter()
        for t in texts:
            seq = tokens(t)
            self.uni.update(seq)
            self.pairs.update(zip(["<begin>", *seq[:-1]], seq, strict=True))
        self.n = sum(self.uni.values())
        self.v = len(self.uni)
        self.after, self.before = defaultdict(Counter), Counter()
        for (a, b), c in self.pairs.items():
            self.after[a][b] = c
            self.before[b] += 1
        self.d = kn.discounts([sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.e = kn.discounts([sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)])
        self.spare = sum(self.e[min(c, 3) - 1] for c in self.before.values()) / max(1, len(self.pairs)) if self.pairs else 1.0
        self.left = {a: (sum(self.d[min(c, 3) - 1] for c in seen.values()), sum(seen.values())) for a, seen in self.after.items()}

    def lower(self, w):
        c = self.before[w]
        return (c - self.e[min(c, 3) - 1] if c else 0) / max(1, len(self.pairs)) + self.spare / (self.v + 1)

    def p(self, v, w):
        if v not in self.after:
            return self.lower(w)
        c = self.after[v][w]
        spare, total = self.left[v]
        return ((c - self.d[min(c, 3) - 1] if c else 0) + spare * self.lower(w)) / total

    def score(self, text):
        seq = tokens(text)
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in seq)
        return len(seq), sum(self.uni[w] > 0 for w in seq), base, sum(math.log10(self.p(v, w)) for v, w in zip(["<begin>", *seq[:-1]], seq, strict=True))


def corpus():
    rnd = random.Random(11)
    words = [f"W{i}" for i in range(80)] + ["Über", "the", "THE", "of\x1cx"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [rnd.choice([" ", "\n", " \t"]).join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 40, 200]))) for _ in range(150)]
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(500, None, ""), (501, "", ""), (502, "never seen words here", ""), (None, "the the", ""), (3, texts[3], ""), (503, "the of " * 30000, "")]


def check(spark, train, rows, **settings):
    plain = Plain([r[1] for r in train])
    model = kn.fit(spark.createDataFrame(train, SCHEMA), **settings)
    assert (model.n_tokens, model.n_words) == (plain.n, plain.v)
    got = kn.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain.score(r.text)
        assert (r.lm.n_tokens, r.lm.n_known) == want[:2]
        assert np.allclose([r.lm.base_score, r.lm.score], want[2:], rtol=1e-9)
    return plain


def test_equal_to_the_plain_formulas(spark):
    rows = corpus()
    plain = check(spark, rows[:120] + rows[-4:], rows)
    for v in ("<begin>", "the", "w3", "nowhere"):
        assert abs(sum(plain.p(v, w) for w in plain.uni) + plain.p(v, "unknown") - 1) < 1e-9


def test_many_shards(spark):
    rows = corpus()[:60]
    check(spark, rows, rows, shard_bytes=100)


def test_more_shards_than_are_mapped_at_once(spark):
    rows = corpus()[:60]
    size = sum(len((r[1] or "").encode()) for r in rows)
    check(spark, rows, rows, shard_bytes=size // 64)
    assert 64 * 7 > common.MOST_MAPPED  # arrays of 64 shards


def test_a_shard_is_a_partition(spark):
    model = kn.Model("", 8)
    rows = spark.createDataFrame([(s, bytearray(np.array([s], np.uint64).tobytes()), bytearray(b"\x01"), 1) for s in range(8) for _ in range(3)], kn.TALLY)

    def work(s, keys, counts):
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([int(counts.sum())])], ["s", "at", "n"])

    got = kn._by_shard(rows, model.shards, work, "s int, at int, n long").collect()
    assert sorted((r.s, r.at, r.n) for r in got) == [(s, s, 3) for s in range(8)]


def test_counts_beyond_32_bits_are_kept(tmp_path):
    counts = np.array([1, 2**40, 3], np.int64)
    common.write_array(str(tmp_path), "counts", kn.narrow(counts))
    common.write_array(str(tmp_path), "counts", kn.narrow(counts))  # a task that runs again
    assert common.read_array(str(tmp_path), "counts").tolist() == counts.tolist()
    assert kn.narrow(np.array([7])).itemsize == 1 and kn.narrow(np.array([], np.int64)).itemsize == 1


def test_no_training_text_and_empty_table(spark):
    rows = corpus()
    model = kn.fit(spark.createDataFrame([], SCHEMA))
    out = kn.score(spark.createDataFrame(rows[:5], SCHEMA), model).collect()
    assert all(r.lm.n_known == 0 and abs(r.lm.score) < 1e-9 for r in out)
    assert kn.score(spark.createDataFrame([], SCHEMA), model).count() == 0
