import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import toxicity as tx

DOCS = "doc_id long, text string, toxicity string, label int"


def test_terms_are_windows_of_each_text():
    texts = ["Ab\n cd", "", "x", "ünder the", "same same"]
    got = {}
    for h, owner in tx.terms_of(pa.array(texts, pa.large_string())):
        for a, b in zip(h.tolist(), owner.tolist(), strict=True):
            got.setdefault(b, []).append(a)
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()
        s = b" " + b" ".join(low.split()) + b" "
        n = sum(max(0, len(s) - k + 1) for k in tx.SIZES) if low.split() else 0
        assert len(got.get(i, [])) == n
    alone = {h for g in tx.terms_of(pa.array(["same"], pa.large_string())) for h in g[0].tolist()}
    assert alone <= set(got[4])


def test_pairs_are_learnt_that_a_sum_cannot_tell():
    # Term 0 with term 1 is positive, either alone is not.
    rnd = np.random.default_rng(1)
    bags = [([0, 1], 1), ([0], 0), ([1], 0), ([2], 0), ([0, 2], 0), ([1, 2], 0), ([0, 1, 2], 1)]
    pick = rnd.integers(0, len(bags), 600)
    doc = np.concatenate([[i] * len(bags[p][0]) for i, p in enumerate(pick)])
    term = np.concatenate([bags[p][0] for p in pick])
    label = np.array([bags[p][1] for p in pick], float)
    m = tx.train(doc, term, label, np.arange(1, dtype=np.uint64), epochs=800)
    assert ((m.score_bags(doc, term, 600) >= 0.5) == label).all()


def test_machine_equals_the_plain_formula():
    rnd = np.random.default_rng(2)
    m = tx.Machine(np.arange(5, dtype=np.uint64), rnd.normal(size=5), rnd.normal(size=(5, 3)), 0.3)
    for bag in ([0, 1, 4], [2], []):
        z = m.bias + sum(m.weight[i] for i in bag) + sum(m.factor[i] @ m.factor[j] for i in bag for j in bag if i < j)
        assert abs(m.score_bags(np.zeros(len(bag), int), np.array(bag, int), 1)[0] - 1 / (1 + np.exp(-z))) < 1e-12


def plain_score(machine, text):
    """The score of a text by the definition, window by window and pair by pair."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s, seen = b" " + b" ".join(words) + b" ", Counter()
    for size in tx.SIZES if words else ():
        for i in range(len(s) - size + 1):
            h = (int.from_bytes(s[i : i + size], "little") * int(tx.MIX) + size) % 2**64
            seen[h ^ h >> 29] += 1
    place = {int(t): k for k, t in enumerate(machine.terms)}
    bag = [place[h] * len(tx.TIMES) + k for h, n in seen.items() if h in place for k, least in enumerate(tx.TIMES) if n >= least]
    v = machine.factor[bag]
    z = machine.bias + machine.weight[bag].sum() + 0.5 * ((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def corpus():
    rnd = random.Random(3)
    plain = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = rnd.choices(plain, k=rnd.choice([20, 60, 200]))
        toxic = i % 6 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["Horrid", "vilewretch", "horridly"])
            words[rnd.randrange(len(words))] = "horrid"
        rows.append((i, " ".join(words), "clash", 1))
        if i < 700:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (701, None)]
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = tx.fit(docs, marked)
    odd = [(None, None, "", 0), (1000, "", "", 0), (1001, "\n", "", 0), (1001, "horrid " * 60000, "", 0)]
    out = tx.score(docs.union(spark.createDataFrame(odd, DOCS)), machine).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.toxicity <= 1 for r in out)
    right = [(r.toxicity >= 0.5) == (r.doc_id % 6 == 0) for r in out if r.doc_id is not None and 700 <= r.doc_id < 900]
    assert sum(right) >= 0.98 * len(right)
    kept = tx.without_toxic(docs, machine)
    assert kept.columns == docs.columns and 700 < kept.count() < 800


def test_no_labels_one_class_and_empty_table(spark):
    rows, _ = corpus()
    docs, none = spark.createDataFrame(rows[:20], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity < 0.01 for r in tx.score(docs, tx.fit(docs, none)).collect()} == {True}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.toxicity > 0.99 for r in tx.score(docs, tx.fit(docs, ones)).collect()} == {True}
    assert tx.score(docs.limit(0), tx.fit(docs, ones)).count() == 0


def test_rows_of_one_id_are_one_document_of_the_sample(spark):
    rows, labels = corpus()
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    once = tx.fit(docs, marked)
    again = tx.fit(docs.unionAll(docs).unionAll(docs.withColumn("text", F.concat(F.lit("~"), "text"))), marked)
    assert (once.terms == again.terms).all() and np.allclose(once.weight, again.weight) and once.bias == again.bias


def test_rare_terms_of_the_toxic_class_outdo_frequent_ones(spark):
    # Each insult stands in twenty of a hundred toxic texts, the common words in all texts.
    common = " ".join(f"{c}{c}word{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    insults = ["qxvjkt", "wyvern", "blorpa", "snidgy", "clodhop"]
    rows = [(i, f"{common} {insults[i // 3 % 5]}" if i % 3 == 0 else common, "", 0) for i in range(300)]
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    machine = tx.fit(spark.createDataFrame(rows, DOCS), marked, most_terms=5)
    rude = {h for hs, _ in tx.terms_of(pa.array([f"a {w}" for w in insults] + [f"zwordz {w}" for w in insults], pa.large_string())) for h in hs.tolist()}
    assert len(machine.terms) == 5 and set(machine.terms.tolist()) <= rude
