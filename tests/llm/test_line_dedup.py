import random

from pyspark.sql import functions as F

from palimpsest.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, key string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute(rows, least_chars=20, least_docs=3):
    low = lambda i: -(2**63) if i is None else i
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders.setdefault(key_of(line), set()).add(low(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < least_docs or max(holders[key_of(x)]) == low(r[0])]
        out.append((r[0], None if r[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(1)
    pool = [f"{'Common Line' if i % 2 else 'wéird LÉNGTH'} number {i} of the pool" for i in range(25)] + ["short", "", " ", "exactly twenty chars", "nineteen characters"]
    rows = []
    for i in range(60):
        lines = [rnd.choice([x, x.upper(), f" \t{x}\r", x.lower()]) for x in rnd.choices(pool, k=rnd.choice([1, 3, 12]))]
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n"), (73, "\n\n"), (None, pool[0] + "\n" + "alone here for sure, yes"), (None, pool[0]), (5, rows[5][1]), (5, pool[2]), (6, rows[6][1])]
    rows += [(80, "a line that three hold, long enough"), (81, "a line that three hold, long enough"), (82, "A line that three hold, long enough\nx\na line that three hold, long enough ")]
    rows += [(90, "\n".join([pool[1], "between them"] * 20000))]
    return [(*r, "clash", "x") for r in rows]


def test_equal_to_brute_force(spark):
    rows = corpus()
    for settings in ({}, {"batches": 7, "fanout": 3}, {"batches": 1}):
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), **settings)
        assert set(out.columns) == {"doc_id", "text", "n_lines", "key", "n_dropped"}
        assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == brute(rows)


BATCHES = [[(9, 10, 0), (8, 10, 0), (9, 11, 0), (9, 10, 0)], [(5, 10, 0), (5, 12, 0)], [(4, 12, 0), (4, 13, 0)]]


def runs_of(spark, batches):
    runs = line_dedup.LineRuns(fanout=2)
    for b in batches:
        runs.add(spark.createDataFrame(b, "id long, h1 long, h2 long"))
    return runs


def test_runs_are_levelled_and_hold_first_sightings(spark):
    runs = runs_of(spark, BATCHES)
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r.h1: (r.n_docs, r.keeper) for r in runs.sightings().collect()} == {10: (2, 9), 11: (1, 9), 12: (1, 5), 13: (1, 4)}
    assert sorted((r.h1, r.n_docs, r.keeper) for t in runs.tallies for r in t.rows().collect()) == [(10, 1, None), (12, 1, None)]
    assert {r.h1: r.keeper for r in runs.repeated(2).collect()} == {10: 9, 12: 5} and {r.h1: r.keeper for r in runs.repeated(3).collect()} == {10: 9}
    runs.drop()


def test_the_anti_join_decides_who_keeps_a_line(spark, monkeypatch):
    rows = corpus()
    whole = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text").collect()
    kind = type(spark.range(1))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
    broken = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text").collect()
    assert sorted(whole, key=str) != sorted(broken, key=str)


def test_runs_meet_as_they_lie(spark):
    runs = runs_of(spark, BATCHES)
    one, two = runs.runs()
    with line_dedup._buckets_in_order(spark):
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (two.rows().join(one.rows().select(*line_dedup.KEY).hint("merge"), line_dedup.KEY, "left_anti"), line_dedup._merged(one.rows(), two.rows()))]
    assert "SortMergeJoin" in plans[0] and not any("Exchange" in p for p in plans)
    runs.drop()


def test_plan_has_no_python_and_empty_table_works(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = line_dedup.dedup_lines(empty)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.select(F.sum("n_lines")).first()[0] is None
