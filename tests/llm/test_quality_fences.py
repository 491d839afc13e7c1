"""Operator 2's fences come from the group's own documents, also where few of them have a signal."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def documents(spark, rows):
    return spark.createDataFrame([(k, text, lang, source) for k, (text, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def text(lines, repeated, k):
    """``lines`` different lines and ``repeated`` copies of the first of them."""
    own = [f"line {j} of text {k} has its own words w{k}x{j}a w{k}x{j}b w{k}x{j}c" for j in range(lines)]
    return "\n".join([*own, *[own[0]] * repeated])


@pytest.fixture(scope="module")
def judged(spark):
    rows = []
    for k in range(2000):
        rows.append((text(20, k % 2, k), "en", "plain"))  # half of them repeat one line
        rows.append((text(20, 6 * (k % 2), 10_000 + k), "en", "lists"))  # half of them repeat six
    rows += [(text(20, 5, 90_000), "en", "plain"), (text(20, 5, 90_001), "en", "lists")]
    found = quality.quality_rules(documents(spark, rows)).collect()
    return {r.doc_id: r for r in found}, len(rows)


def test_the_same_text_is_judged_by_its_source(judged):
    rows, n = judged
    assert not rows[n - 2].base_failed and not rows[n - 1].base_failed
    assert rows[n - 2].dup_line_rate == rows[n - 1].dup_line_rate == 200
    assert not rows[n - 2].kept and rows[n - 1].kept


def test_documents_without_the_signal_pass(judged):
    rows, n = judged
    assert all(r.kept for r in rows.values() if r.doc_id < n - 2)


def test_no_fence_is_a_constant(spark):
    """Sketches with other positive deciles have other fences, and a group without the signal has none."""
    bucket = {v: quality.bucket(F.lit(v).cast("long")) for v in (5, 10, 200, 300)}
    values = {name: spark.range(1).select(c.alias("b")).first()["b"] for name, c in bucket.items()}
    sketch = [("en", "low", "repeat_rate", values[5], 50_000), ("en", "low", "repeat_rate", values[10], 50_000), ("en", "high", "repeat_rate", values[200], 50_000), ("en", "high", "repeat_rate", values[300], 50_000), ("en", "none", "word_length", values[300], 10)]
    found = {r.source: r for r in quality.fences(spark.createDataFrame(sketch, "lang string, source string, signal string, bucket int, n long")).collect()}
    assert found["low"].repeat_rate_hi < 60 < 250 < found["high"].repeat_rate_hi
    assert found["none"].repeat_rate_hi is None and found["none"].word_length_hi is not None
