"""The registered queries over the smallest tables: against DuckDB, or against plain Python where SQL cannot say it."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import test_kneser_ney as plain_lm
import test_pii as plain_pii
import test_simhash as plain_simhash
import test_toxicity as plain_toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import toxicity
from palimpsest.llm.common import table
from palimpsest.llm.queries import ORACLES, QUERIES

SF = os.environ.get("PALIMPSEST_SF_DIR", "/root/testdata/sf0.001")
MORE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_op2_equals_the_plain_model(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    plain = plain_lm.Plain([t for i, t in docs if not held(i)])
    text = dict(docs)
    got = QUERIES["op2_lm_score"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, base, score = plain.score(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, plain.n)
        assert np.allclose([r.base_score, r.score], [base, score], rtol=1e-9)


def test_op5_keeps_what_the_rules_find(spark, docs):
    text = dict(docs)
    names = [k for k, *_ in plain_pii.GIVEN]
    got = QUERIES["op5_pii"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = [(names[k], a, b) for k, a, b in plain_pii.given(text[r.doc_id] or "")]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in names] == [sum(x[0] == k for x in base) for k in names]
        assert set(said.split(",")) <= set(r.spans.split(",")) | {""}


def test_op6_finds_what_the_full_search_finds(spark, duck):
    rows = {i: np.array(v, float) for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    got = {}
    for r in QUERIES["op6_ann"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        best = sorted((-(rows[q] * x).sum(), i) for i, x in rows.items() if i != q)[:20]
        hit += len({i for i, _ in found} & {i for _, i in best})
        # What is found is scored and ordered exactly.
        assert np.allclose([s for _, s in found], [(rows[q] * rows[i]).sum() for i, _ in found], atol=1e-12)
        assert [i for i, _ in found] == [i for _, i in sorted((-s, i) for i, s in found)] and len(found) == len(best)
    assert hit >= 0.9 * 20 * len(got)


@pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")
def test_op7_equals_the_plain_formula(spark):
    machine = toxicity.fit(table(spark, MORE, "documents"), table(spark, MORE, "labels"), learn=toxicity.learnable())
    assert len(machine.terms)
    text = {r.doc_id: r.text for r in table(spark, MORE, "documents").select("doc_id", "text").collect()}
    got = QUERIES["op7_toxicity"](spark, MORE).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    toxic = [r for r in got if r.predicted][:20]
    for r in toxic + random.Random(1).sample(got, 40):
        assert abs(r.score - plain_toxicity.plain_score(machine, text[r.doc_id])) < 1e-9
    assert toxic


def test_op7_learns_from_the_other_folds_alone(spark, tmp_path):
    for name in ("documents", "labels"):
        rows = table(spark, MORE, name)
        if name == "labels":  # what is held out is told the other way round
            rows = rows.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    scores = lambda folder: {r.doc_id: r.score for r in QUERIES["op7_toxicity"](spark, folder).collect()}
    assert scores(MORE) == scores(str(tmp_path))


def test_op8_holds_every_id_once(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = {}, {}
    for r in QUERIES["op8_packing"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048


def test_op10_equals_brute_force(spark, docs):
    got = QUERIES["op10_simhash"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == plain_simhash.brute(docs, 3, 3)
