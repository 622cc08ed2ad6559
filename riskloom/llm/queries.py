"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.unigram import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.lm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.topk import scaled, search

    return search(scaled(table(spark, sf_dir, "embeddings")), every=50, k=5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_lines.*", "text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.tokenfile import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BPE), end_id=2), digest=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.jaccard import near_groups

    return near_groups(table(spark, sf_dir, "documents"), k=4, num=85)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.chat import digests, format_turns

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_turns(rows))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.unigram import decoded, encoded

    path = tokenizer_path(PIECES)
    return decoded(encoded(table(spark, sf_dir, "documents"), path), path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), tokenizer_path(BPE), end_id=0)
    # the digest is made from the piece's ids before pieces are dealt by length, so ids aren't shuffled for it
    return pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
