import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, offset int"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(2)
    bits = ["Hello", "WORLD's", "l’été", "é", "́x", "ﬁ", "İ", "ΑΣ", " ", " ", "<|endoftext|>", "a<|startoftext|>b", "123.45", "it'll", "'", "''s", "中文字", "👍🏽", "\x1c", "\x85", "ß", "‍", "don't", "$%^", "\x00"]
    return ["".join(rnd.choice(bits) + rnd.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", ""]) for _ in range(rnd.randrange(30))) for _ in range(400)]


def test_word_wise_ids_equal_those_of_whole_texts(whole):
    texts = [*odd_texts(), "", "   ", "long " * 5000]
    coder = packing.WordTokenizer(PATH)
    for _ in range(2):
        flat, at = coder.encode(pa.array(texts, pa.large_string()))
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_best_fit_decreasing_equals_a_plain_search():
    rnd = random.Random(4)
    for window in (8, 64, 2048):
        lengths = sorted((rnd.randrange(1, window + 1) for _ in range(500)), reverse=True)
        number, offset = packing.best_fit_decreasing(lengths, window)
        rooms = []
        for n, k, o in zip(lengths, number, offset, strict=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                assert window - o == min(fits)
            else:
                assert o == 0 and k == len(rooms)
                rooms.append(window)
            assert rooms[k] == window - o
            rooms[k] -= n


def test_every_id_is_in_one_piece_and_windows_are_gapless(spark, whole):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["alpha", "Beta", "gamma-ray", "délta"], k=rnd.choice([0, 1, 50, 700])))) for i in range(120)]
    rows += [(200, None), (201, "word " * 9000), (None, "no id"), (7, rows[7][1]), (7, "other")]
    got = packing.pack(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), PATH, keep_ids=True).toPandas()
    seen = {}
    for r in got.itertuples():
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        seen.setdefault((r.doc_id if r.doc_id == r.doc_id else None, r.doc_tokens), []).append((r.start, list(r.ids)))
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(seen[doc_id, len(ids)])
        assert [x for s in range(0, len(ids), 2048) for x in next(p for q, p in mine if q == s and p == ids[s : s + 2048])] == ids
    assert got.length.sum() == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_words_are_forgotten_and_learnt_again(whole, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 60)
    coder, texts = packing.WordTokenizer(PATH), odd_texts()
    for lo in range(0, 400, 40):
        flat, at = coder.encode(pa.array(texts[lo : lo + 40], pa.large_string()))
        for t, a, b in zip(texts[lo : lo + 40], at[:-1], at[1:], strict=True):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_plain_words_together_equal_words_alone(whole):
    rnd = random.Random(6)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if chr(c) not in "×÷"]
    words = ["".join(rnd.choices(letters, k=rnd.randrange(1, 14))) + rnd.choice(["", "", ".", ",", "?!", "..."]) for _ in range(20000)]
    coder = packing.WordTokenizer(PATH)
    assert coder.ends is not None
    flat, at = coder.encode(pa.array([" ".join(words)], pa.large_string()))
    assert flat.tolist() == [i for e in whole.encode_batch(words, add_special_tokens=False) for i in e.ids]


@pytest.fixture
def parted(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_little_padding_and_rows_without_an_id_spread(spark, parted):
    rnd = random.Random(10)
    rows = [(None if i % 2 else i, " ".join(rnd.choices(["alpha", "beta", "gamma"], k=rnd.randrange(20, 1500)))) for i in range(600)]
    parts = packing.pack(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), PATH).selectExpr("*", "shiftright(sequence_id, 40) part").toPandas()
    free = 2048 * parts.sequence_id.nunique() - parts.length.sum()
    assert free <= 0.03 * parts.length.sum()
    assert parts[parts.doc_id.isna()].part.nunique() == parts.part.nunique() > 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
