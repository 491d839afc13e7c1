"""Staged tables go with the scope that made them, and with no other."""

import corpus_pipeline
from tests.llm.test_small_cases import ROWS, tables
from tidemark.llm import catalogue
from tidemark.llm.common import Scope, drop_staged, file_system, staged


def there(spark, path):
    files, place = file_system(spark, path)
    return files.exists(place)


def test_a_scope_removes_its_own_tables_only(spark):
    before = staged(spark.range(3), "before")
    with Scope() as outer:
        first = staged(spark.range(4), "first")
        with Scope() as inner:
            second = staged(spark.range(5), "second")
        third = staged(spark.range(6), "third")
    inner.release(spark)
    assert not there(spark, second._staged_path) and (before.count(), first.count(), third.count()) == (3, 4, 6)
    outer.release(spark)
    assert not there(spark, first._staged_path) and not there(spark, third._staged_path) and before.count() == 3
    drop_staged(spark, before)
    assert not there(spark, before._staged_path)


def test_results_of_other_queries_outlive_a_pipeline(spark, tmp_path):
    folder = tables(spark, str(tmp_path), ROWS)
    held = {name: catalogue.QUERIES[name](spark, folder) for name in ("op1_line_dedup", "op9_simhash_near_dedup", "op4_decontamination")}
    counts = {name: rows.count() for name, rows in held.items()}
    one = corpus_pipeline.run(spark, folder)
    pieces = one.count()
    two = corpus_pipeline.run(spark, folder)
    assert two.count() == pieces and one.count() == pieces
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.STAGES[0][1](spark, docs, folder).count()
    corpus_pipeline.STAGES[2][1](spark, docs, folder).count()
    assert {name: rows.count() for name, rows in held.items()} == counts and one.count() == pieces
