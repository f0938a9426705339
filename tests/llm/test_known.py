import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

FOREIGN = (
    "В начале было слово и слово было у людей в городе", "我们今天去市场买东西然后回家做饭", "Το πρωί πήγαμε στην αγορά και μετά γυρίσαμε στο σπίτι", "ذهبنا اليوم الى السوق ثم عدنا الى البيت",
    "Wczoraj poszliśmy na targ, a potem wróciliśmy do domu, gdzie czekała babcia", "xqzv kjwq zzxk qqwv bnmv xcvq kjzx wqpz",
)


@pytest.mark.parametrize("languages", [("de", "en", "es", "fr"), ("de", "en"), ("en",)])
def test_texts_in_no_learned_language_go(spark, small, languages):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter(F.col("lang").isin(*languages)).select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-k, t, None) for k, t in enumerate(FOREIGN, 1)], docs.schema)
    left = cp.keep_known_languages(spark, docs.unionByName(foreign), small).select("doc_id").collect()
    assert all(r["doc_id"] >= 0 for r in left) and len(left) >= 0.98 * docs.count()


def test_held_out_texts_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 1
    left = cp.keep_known_languages(spark, docs.withColumn("lang", F.when(~held, F.col("lang"))), small)
    assert left.filter(held).count() >= 0.9 * docs.filter(held).count()
