import random

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, simhash


def batch():
    rnd = random.Random(0)
    texts = [" ".join(rnd.choices(["aa", "Bbb", "\tcccc", "é", "Ü\x0b"], k=rnd.randrange(50))) for _ in range(500)] + [None, "", "x" * 9000, None]
    return texts, pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])


@pytest.mark.parametrize("most", [1, 3000, 10**7])
def test_slices_give_every_text_once_and_its_own_words(most):
    texts, rows = batch()
    seen = []
    for at, part in common.slices(rows, "text", most):
        got = common.texts_of(part, "text")
        assert got.to_pylist() == [t or "" for t in texts[at : at + part.num_rows]]
        words, first = common.blank_split(got)
        buf, start, end = common.joined(words)
        for a, b in zip(first[:-1], first[1:], strict=True):
            seen.append([buf[i:j].decode() for i, j in zip(start[a:b], end[a:b], strict=True)])
    assert seen == [(t or "").replace("B", "b").split() for t in texts]


def test_fingerprints_do_not_depend_on_slices():
    _, rows = batch()
    whole = simhash.fingerprints_of(common.texts_of(rows, "text"), 3)
    parts = [simhash.fingerprints_of(common.texts_of(p, "text"), 3) for _, p in common.slices(rows, "text", 2000)]
    assert (np.concatenate(parts) == whole).all()


def test_running_sums(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 3, 4, 5, 8, 300, 1025])]
    df = spark.createDataFrame(rows, "i int, x array<bigint>")
    for part in (4, 256):
        got = {r.i: r.s for r in df.select("i", common.running_sums(F.col("x"), part).alias("s")).collect()}
        assert got == {i: np.cumsum(x).tolist() for i, x in rows}


def test_free_names_avoid_what_is_there():
    assert common.free_names(["a", "_ID", "_id_"], "id", "b") == ["_id__", "_b"]


def test_written_tables_are_read_back_and_dropped(spark):
    df = common.written(spark.range(5), "trial")
    assert df.count() == 5
    common.drop_written(df)
    fs, path = common.store_of(df._palimpsest_path)
    assert fs.get_file_info(path).type == pa.fs.FileType.NotFound
