"""Evaluation of outcomes against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.operators import keywords

CLASSES = ("SUPPORTED", "REFUTED", "UNVERIFIED")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(0.0)


def accuracy(cases: DataFrame) -> DataFrame:
    """total, correct and accuracy in percent of cases (truth, predicted)."""
    right = F.count_if(F.col("truth") == F.col("predicted"))
    return cases.agg(F.count("*").alias("total"), right.alias("correct")).withColumn("accuracy", percent(F.col("correct"), F.col("total")))


def confusion(cases: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """A row a true class, a column a predicted one, zeros kept."""
    spark = cases.sparkSession
    rows = spark.createDataFrame([(c,) for c in classes], "truth string")
    counts = cases.groupBy("truth").pivot("predicted", list(classes)).count()
    return rows.join(F.broadcast(counts), "truth", "left").na.fill(0).select("truth", *[F.col(c).cast("long") for c in classes])


def class_metrics(cases: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Precision, recall and F1 in percent of every class. F1 is that of the rounded percentages."""
    pairs = cases.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    per = pairs.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), "truth", "predicted", "n")
    is_true, is_pred = F.col("truth") == F.col("class"), F.col("predicted") == F.col("class")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    sums = per.groupBy("class").agg(of(is_true & is_pred).alias("true_positives"), of(~is_true & is_pred).alias("false_positives"), of(is_true & ~is_pred).alias("false_negatives"), of(is_true).alias("support"))
    every = cases.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(F.broadcast(sums), "class", "left").na.fill(0)
    tp = F.col("true_positives")
    rates = every.withColumn("precision", percent(tp, tp + F.col("false_positives"))).withColumn("recall", percent(tp, tp + F.col("false_negatives")))
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1_score", F.when(both > 0, F.round(2 * F.col("precision") * F.col("recall") / both, 2)).otherwise(0.0))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.round(F.avg(F.col("f1_score").cast("decimal(9,2)")).cast("double"), 2).alias("macro_f1"))


def hits(cases: DataFrame, retrieved: DataFrame, case: str) -> DataFrame:
    """(case, hit) of cases (case, keywords) that have keywords: whether any of them stands in the retrieved text (case, text)."""
    wanted = cases.where(F.size("keywords") > 0).select(case, "keywords")
    found = wanted.join(retrieved, case, "left").select(case, F.exists("keywords", lambda k: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(k))).alias("hit"))
    return found.groupBy(case).agg(F.bool_or("hit").alias("hit"))


def hits_anywhere(cases: DataFrame, texts: DataFrame, case: str) -> DataFrame:
    """(case, hit) of cases (case, keywords) that have keywords: whether any of them stands in any of the texts (text), in either
    case of letters. All keywords are searched for in one pass over the texts. An empty keyword stands in every text."""
    wanted = cases.where(F.size("keywords") > 0).select(case, F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    lowered = texts.select(F.lower("text").alias("text"))
    found = keywords.present(lowered, wanted.select("keyword"))
    anything = texts.select(F.lit("").alias("keyword")).limit(1)
    marked = wanted.join(found.unionByName(anything).withColumn("hit", F.lit(True)), "keyword", "left")
    return marked.groupBy(case).agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))


def retrieval_precision(hit: DataFrame) -> DataFrame:
    counts = hit.agg(F.count("*").alias("eligible"), F.count_if("hit").alias("hits"))
    return counts.withColumn("retrieval_precision", percent(F.col("hits"), F.col("eligible")))


def read_cases(spark, path: str) -> DataFrame:
    """Cases of a JSON file: claim_id, claim, truth, keywords, with the source's name and content."""
    schema = "dataset_name string, source_document string, source_content string, test_cases array<struct<claim_id:string,claim:string,ground_truth_verdict:string,expected_evidence_keywords:array<string>>>"
    one = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = one.select("source_document", "source_content", F.explode("test_cases").alias("t"))
    return rows.select("t.claim_id", "t.claim", F.col("t.ground_truth_verdict").alias("truth"), F.coalesce("t.expected_evidence_keywords", F.array().cast("array<string>")).alias("keywords"), "source_document", "source_content")
