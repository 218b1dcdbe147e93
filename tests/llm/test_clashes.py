"""Every operator with columns that bear the names of its own, odd schemas, empty tables and very long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import ann, chat_format, decontaminate, kneser_ney, line_dedup, packing, pii, secrets, simhash, toxicity

NAMES = ["_id", "_ID_2", "_kinds", "_lost", "_hits", "_of", "_found", "_gone", "_toxicity", "_contamination", "_lines", "_stops", "_k1", "_k2", "id", "of", "fp", "root", "node", "h1", "h2", "pos", "batch", "a.b", "with blank", "start", "length", "label", "term"]
ODD = T.StructType([T.StructField("a blank", T.StringType()), T.StructField("b.c", T.ArrayType(T.IntegerType()))])
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    shared = "a line that is held by three documents"
    texts = [(1, f"{shared}\nsecret=abcdefgh and a.b@c.de"), (2, shared), (3, f"{shared}\nhorrid one two three four five"), (3, "repeated id"), (None, "no id " * 3), (4, None), (5, ""), (6, "word " * 50000)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.StringType()) for n in NAMES], T.StructField("odd struct", ODD)])
    return spark.createDataFrame([(*t, *[f"{n} {i}" for n in NAMES], ("x", [i, None])) for i, t in enumerate(texts)], schema)


def kept(df, docs):
    """Every column of the user's, as it was, row by row."""
    own = [c for c in docs.columns if c != "text"]
    rows = lambda d: sorted(map(str, d.select(*[F.col(f"`{c}`") for c in own]).collect()))
    assert rows(df) == rows(docs)


def run(spark, docs, benchmark, labels):
    """name -> (result, whether it keeps all columns and rows)."""
    model = kneser_ney.fit(docs)
    machine = toxicity.fit(docs, labels)
    yield "lm", kneser_ney.score(docs, model), True
    yield "contamination", decontaminate.find_contamination(docs, benchmark, window=4), True
    yield "contamination, in shards", decontaminate.find_contamination(docs, benchmark, window=4, shard_chars=5), True
    yield "secrets", secrets.find_secrets(docs), True
    yield "pii", pii.find_pii(docs, pii.Tagger()), True
    yield "toxicity", toxicity.score(docs, machine), True
    yield "lines", line_dedup.dedup_lines(docs), True
    yield "packing", packing.pack(docs, PATH), False
    yield "simhash", simhash.near_duplicates(docs), False
    yield "keep one", simhash.keep_one(docs), False
    yield "without toxic", toxicity.without_toxic(docs, machine), True
    yield "without contaminated", decontaminate.without_contaminated(docs, spark.createDataFrame([], benchmark.schema)), True
    vectors = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.array(F.lit(1.0), F.coalesce("doc_id", F.lit(0)).cast("double")).alias("embedding"))
    yield "vectors", ann.nearest(vectors, vectors, k=2, id_col="doc_id"), False
    chats = docs.withColumn("role", F.lit("user")).withColumn("conv_id", F.lit(1)).withColumn("turn", F.col("doc_id"))
    yield "chats", chat_format.read_back(chat_format.format_chats(chats)), False


def test_columns_of_the_same_names(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (2, "quite other words stand here")], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(1, 7)], "doc_id long, toxic int")
    for name, out, whole in run(spark, docs, benchmark, labels):
        assert out.count() > 0, name
        if whole:
            kept(out, docs)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for name, out, _ in run(spark, none, benchmark, labels):
        assert out.count() == 0, name
