"""Intent of a keyword: term weights and multinomial logistic regression, trained from labelled keywords."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.shared import in_order, pinned

#: Rows that the regression multiplies at once. Each block adds up a gradient as long as the model, so small ones cost more than their rows.
BLOCK_MB = 16.0


def train(labelled: DataFrame, vocabulary: int = 1 << 18) -> PipelineModel:
    """labelled: keyword, intent. vocabulary: terms that have a weight, the most frequent ones; it bounds the model."""
    rows = labelled.select(F.coalesce("keyword", F.lit("")).alias("keyword"), "intent")
    counter = _counter(rows, vocabulary)
    model = _regression(pinned(counter.transform(rows).select("intent", "counts"), "intent-counts"))
    return PipelineModel([*counter.stages, *model.stages])


def predict(model: PipelineModel, keywords: DataFrame) -> DataFrame:
    """Adds predicted and confidence (percent, two decimals); blank is unknown with 0."""
    clean = keywords.withColumn("_original", F.col("keyword")).withColumn("keyword", F.lower(F.trim(F.coalesce("keyword", F.lit("")))))
    kept = [F.col("_original").alias("keyword") if c == "keyword" else F.col(c) for c in keywords.columns]
    return model.transform(clean).select(*kept, *_told(F.col("keyword") == ""))


def train_predict(rows: DataFrame, learn: Column, vocabulary: int = 1 << 18) -> DataFrame:
    """As train on the rows where learn is true, and predict for all: rows has keyword and intent, in whose place come predicted and confidence. Words are counted once for both."""
    rows = rows.withColumn("keyword", F.coalesce("keyword", F.lit(""))).withColumn("_learn", F.coalesce(learn, F.lit(False)))
    kept = [c for c in rows.columns if c not in ("keyword", "intent", "_learn")]
    counter = _counter(rows.where("_learn"), vocabulary)
    counted = counter.transform(rows).select(*kept, "intent", "_learn", (F.trim("keyword") == "").alias("_blank"), "counts")
    counted = pinned(counted, "intent-counts")
    model = _regression(counted.where("_learn"))
    return model.transform(counted).select(*kept, *_told(F.col("_blank")))


def known_words(texts: DataFrame, most: int) -> DataFrame:
    """word, n: the most frequent ones of the texts' words, and how often they are found; of equally frequent ones, the first by hash."""
    found = texts.select(F.explode("words").alias("word")).groupBy("word").agg((-F.count("*")).alias("_less")).withColumn("_mixed", F.xxhash64("word"))
    # Placed by ranges, so the words left out never meet in one task or on the driver.
    placed, _ = in_order(found, ["_less", "_mixed", "word"])
    return placed.where(F.col("_n") < most).select("word", (-F.col("_less")).alias("n"))


def _counter(texts: DataFrame, vocabulary: int) -> PipelineModel:
    tokens = RegexTokenizer(inputCol="keyword", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False)
    # Given as often as its number has binary digits, a frequent word comes early in the model, where its neighbours are as frequent.
    known = known_words(tokens.transform(texts), vocabulary).select(F.array_repeat("word", F.length(F.bin("n"))).alias("words"))
    return PipelineModel([tokens, CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary).fit(known)])


def _regression(counted: DataFrame) -> PipelineModel:
    """counted: intent, counts, from a written table."""
    n = max(counted.count(), 1)
    label = StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc").fit(counted)
    stages = [
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features", p=2.0),
        LogisticRegression(maxIter=1000, family="multinomial", regParam=1 / n, elasticNetParam=0.0, maxBlockSizeInMB=BLOCK_MB),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=label.labels),
    ]
    # In each round every partition sends a gradient as long as the model, so there are as many as cores, not as the table has blocks.
    return Pipeline(stages=stages).fit(label.transform(counted).coalesce(counted.sparkSession.sparkContext.defaultParallelism))


def _told(blank: Column) -> list[Column]:
    confidence = F.round(F.array_max(vector_to_array("probability")) * 100, 2)
    return [F.when(blank, "unknown").otherwise(F.col("predicted")).alias("predicted"), F.when(blank, 0.0).otherwise(confidence).alias("confidence")]
