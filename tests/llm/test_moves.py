"""Texts that need not meet anything stay where they are read."""
import random

from pyspark.sql import functions as F

from fieldrounds.llm import jaccard, secrets
from fieldrounds.llm.common import parted


def sent(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def texts(spark, n: int, words: int, plant: dict):
    rng = random.Random(5)
    made = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(words)) for _ in range(n)]
    for i, f in plant.items():
        made[i] = f(made)
    return spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")


def test_parted_loses_no_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"))
    few = df.where("k is null or k % 50 = 1").select(F.col("k").alias("_k"))
    some, rest = parted(df, F.col("k"), few, F.col("_k"))
    assert some.select("id").union(rest.select("id")).distinct().count() == some.count() + rest.count() == 5000
    assert rest.where("k is null or k % 50 = 1").count() == 0
    assert rest.count() > 3500                  # about one in 16 of the others is with the few
    none = parted(df, F.col("k"), few.limit(0), F.col("_k"))
    assert none[0].count() == 0 and none[1].count() == 5000


def test_texts_without_secrets_are_not_shuffled(spark):
    docs = texts(spark, 120, 4000, {3: lambda t: t[0] + " password=hunter22"})
    before = sent(spark)
    ledger = secrets.scanned(docs)
    kept = secrets.redact(docs, ledger).collect()
    assert sent(spark) - before < 1_000_000         # of more than 4 MB
    assert ledger.count() == 360 and len(kept) == 120 and [r["doc_id"] for r in kept if "[secret]" in r["text"]] == [3]


def test_texts_without_candidates_are_not_shuffled(spark):
    docs = texts(spark, 120, 8000, {5: lambda t: t[4] + " more", 9: lambda t: t[8]})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")
    try:
        before = sent(spark)
        kept = jaccard.one_of_each(docs).collect()
        assert sent(spark) - before < 3_000_000         # of more than 9 MB
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(120) if i not in (5, 9)]
