"""Cases of the third round."""

import math

from pyspark.sql import functions as F

from riskloom.llm import quality


def test_every_trusted_document_counts(spark, tmp_path):
    """More labelled rows than the sample of old held: all take part in the counts and in the threshold."""
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(50)).cast("string")) for j in range(20)]).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 25 <> 0")
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == labels.count() > 20_000
    counted, held_out = F.pmod(F.xxhash64("_ql_id"), F.lit(10)) >= 4, F.pmod(F.xxhash64("_ql_id"), F.lit(10)) < 4
    for most in (6, quality.FILTER):  # a bit set that passes nearly all, and one that passes few others
        assert quality._chosen(docs, trusted.where(counted), most).select("_ql_id").exceptAll(trusted.where(counted)).isEmpty()
        assert quality._chosen(docs, trusted.where(counted), most).count() == trusted.where(counted).count()
    judged = quality.judge(docs, labels).select("doc_id", "quality.*").collect()
    held = {r._ql_id for r in trusted.where(held_out).collect()}
    scores = sorted(r.llr for r in judged if r.doc_id in held)
    threshold = scores[math.ceil(quality.TAIL * len(scores)) - 1]
    assert len(scores) > 8_000
    assert all(r.kept == (not r.base_failed and r.llr >= threshold) for r in judged)
