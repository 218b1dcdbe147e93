import random

import corpus_pipeline
import test_decontaminate as plain_dc
import test_line_dedup as plain_lines
import test_simhash as plain_simhash


def make(spark, folder):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    shared = "this very line is held by many documents of the corpus"
    items = [(i, say(20)) for i in range(4)]
    rows = [(i, f"{say(60)}\n{shared if i % 4 == 0 else say(9)}\n{say(40)}") for i in range(120)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(5)]
    rows += [(300 + i, f"{say(30)} {items[i][1]} {say(30)}") for i in range(4)]
    rows += [(400 + i, f"{say(40)} vilewretch horrid {say(20)} horrid") for i in range(60)]
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(400 <= i < 460)) for i, _ in rows if i < 120 or 400 <= i < 460]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_each_stage_equals_its_plain_form(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = make(spark, folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontaminate", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    plain = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    one = steps["toxicity"](spark, docs, folder)
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in docs.collect()} - set(range(400, 460))

    two = steps["line_dedup"](spark, one, folder)
    assert {(r.doc_id, r.text) for r in two.collect()} == {(i, t) for i, t, *_ in plain_lines.brute(plain(one))}

    three = steps["near_duplicates"](spark, two, folder)
    groups = {i: c for i, _, c in plain_simhash.brute(plain(two), 3, 3)}
    assert {r.doc_id for r in three.collect()} == {i for i in groups if groups[i] == i}

    four = steps["decontaminate"](spark, three, folder)
    bad = {r[0] for r in plain_dc.brute(plain(three), items, 13) if r[2] and 20 * r[2] >= r[1]}
    assert bad == {300, 301, 302, 303} and {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - bad

    for df in (one, two, three, four):
        assert df.columns == docs.columns
    five = steps["packing"](spark, four, folder)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert pairs(corpus_pipeline.run(spark, folder).selectExpr("doc_id", "cast(start as string) text")) == pairs(five.selectExpr("doc_id", "cast(start as string) text"))
