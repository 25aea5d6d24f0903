"""Training samples don't depend on how rows are dealt, also where an id has several texts."""

from __future__ import annotations

from skyloom.llm import op2_language, op6_secrets

SCHEMA = "doc_id long, text string, lang string"


def rows():
    texts = [(i % 3 if i % 2 else None, f"text number {'abcdefghij'[i % 10] * (i % 7 + 1)} {i}", "en" if i % 4 else "fr") for i in range(60)]
    return texts + texts[:20]


def test_language_sample(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = {op2_language.learn(df.repartition(n), most_docs=5) for n in (1, 3, 7)}
    assert len(found) == 1 and [lang for lang, _ in found.pop()] == ["en", "fr"]


def test_secret_sample(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(op6_secrets, "fit", lambda texts: tuple(texts))
    found = {op6_secrets.learn(df.repartition(n), most_docs=9) for n in (1, 3, 7)}
    assert len(found) == 1 and 1 <= len(found.pop()) <= 9
    assert len(op6_secrets.learn(df, most_docs=500)) == 60
