"""Queries take all rows that belong to their job."""

from palimpsest.plans.registry import QUERIES


def test_every_odd_figure_may_be_matched(spark, tmp_path):
    rows = [(i, [1.0, i / 100.0], 3) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["figures_matched"](spark, str(tmp_path)).collect()
    assert sorted(r.stage_id for r in got) == [1, 3, 5, 7, 9, 11]


def test_passages_without_an_inner_word_are_found(spark, tmp_path):
    spark.createDataFrame([(1, "see 12 34 and the red cat sat"), (2, "red cat"), (3, "全文検索"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "red cat"), (2, "12 34"), (3, "文検"), (4, "and the red"), (5, "dog"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.n_docs, r.first_doc) for r in QUERIES["phrases_present"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (1, 3), 4: (1, 1)}
