"""The intent classifier: what its training sends, and that one pass over the texts tells the same as two."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from pagelens import intent

WORDS = {"en": ["the", "and", "house", "word"], "de": ["der", "und", "haus", "wort"], "fr": ["le", "et", "maison", "mot"]}


def texts(spark, n=120):
    langs = sorted(WORDS)
    rows = [(i, " ".join([*(WORDS[langs[i % 3]][(i + j) % 4] for j in range(6)), f"x{i}"]), langs[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, keyword string, intent string")


def test_partitions_of_the_regression(spark, monkeypatch):
    """Every partition sends a gradient in every round: there are no more than cores, however the rows came."""
    seen, fit = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    intent.train(texts(spark).select("keyword", "intent").repartition(30))
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism


def test_cut_vocabulary(spark):
    """Of equally frequent words the same ones are known, however the rows came."""
    kept = {tuple(sorted(intent.train(texts(spark).repartition(n), 20).stages[1].vocabulary)) for n in (1, 5, 16)}
    assert len(kept) == 1 and {w for ws in WORDS.values() for w in ws} < set(*kept) and len(*kept) == 20


def test_train_predict(spark):
    """As train and predict, over the same rows; null and blank texts are unknown, and rows that aren't learned from need no intent."""
    odd = spark.createDataFrame([(900, None, None), (901, "  ", "xx"), (902, "DER und Haus", None), (903, None, "de"), (904, "a b", "en")], "id long, keyword string, intent string")
    rows = texts(spark).unionAll(odd).repartition(7)
    learn = (F.col("id") % 4 != 1) & (F.col("id") < 900)
    model = intent.train(rows.where(learn).select("keyword", "intent"))
    of = lambda df: {r.id: (r.predicted, r.confidence) for r in df.select("id", "predicted", "confidence").collect()}
    got, expected = of(intent.train_predict(rows, learn)), of(intent.predict(model, rows))
    assert set(got) == set(expected) and len(got) == 125
    assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) <= 0.02 for i in got)
    assert got[900] == got[901] == got[903] == ("unknown", 0.0) and got[902][0] == "de" and got[904][0] != "unknown"
