"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, chat_format, decontaminate, kneser_ney, line_dedup, packing, pii, secrets, simhash, sql, toxicity
from palimpsest.llm.common import id_text, table


def packing_tokenizer() -> str:
    """The production tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    read = chat_format.read_back(chat_format.format_chats(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(id_text(F.col("doc_id")).cast("binary")) % 5 == 1
    model = kneser_ney.fit(docs.where(~held_out))
    scored = kneser_ney.score(docs, model, out="lm")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("lm.n_tokens").alias("n_tokens"), F.col("lm.n_known").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("lm.base_score").alias("base_score"), F.col("lm.score").alias("score"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=13, out="c")
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.col("c.n_hit").alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated("c").alias("contaminated"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.train(docs))
    names = F.array(*map(F.lit, pii.KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    rules = F.filter("pii", lambda s: s["rule"])
    of_kind = lambda k: F.filter(rules, lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(said(rules), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn=toxicity.learnable())
    scored = toxicity.score(docs, machine, out="score")
    return scored.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer(), window=2048, end_id=1)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, least_chars=20, least_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_score": op2_lm_score,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op1_chat_format": sql.OP1, "op4_secrets": sql.op4(secrets.RULES), "op3_decontaminate": sql.OP3, "op9_line_dedup": sql.OP9}
