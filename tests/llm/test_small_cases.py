"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalogue, chat

LONG = "alpha beta gamma delta epsilon " * 4000
ROWS = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "Same text of some words here.\nSecond line of it stays.", "en"), (4, "Same text of some words here.\nSecond line of it stays.", "en"), (5, "ça été où naïve 日本語のテキスト", "fr"), (6, LONG, "en"), (7, "12345 !!! ###", None), (None, "a row without an id", "en"), (8, "x", "en")]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, count long, _row long, hits int, node long"
LABELLED = 40


def documents(spark, path, rows):
    full = [(i, t, lang, "s" if k % 2 else None, len(t or ""), 1, 2, 3, 4, 5, 6) for k, (i, t, lang) in enumerate(rows)]
    full += [(100 + k, f"the words of number {k} and some more of the same kind", "en", "s", 10, 1, 2, 3, 4, 5, 6) for k in range(LABELLED if rows else 0)]
    full += [(300 + k, f"les mots été où ça numéro {k} et encore à déjà", "fr", "s", 10, 1, 2, 3, 4, 5, 6) for k in range(LABELLED if rows else 0)]
    spark.createDataFrame(full, EXTRA).repartition(2).write.parquet(f"{path}/documents.parquet")


def tables(spark, path, rows):
    documents(spark, path, rows)
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, "!!"), (1, "short item")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 1, "user", "again"), (1, 2, "assistant", "ok\\<turn>"), (2, None, None, None), (2, None, None, None), (None, 0, "assistant", "no id"), (3, 0, "assistant", LONG)] if rows else []
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("odd")), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), [])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = catalogue.QUERIES[name](spark, odd).collect()
    wanted = len(ROWS) + 2 * LABELLED
    if name.startswith("op6"):
        assert {r.conv_id for r in rows} == {1, 2, 3, None, -7}
    elif name.startswith("op7"):
        assert sum(r.start == 0 for r in rows) == wanted
    else:
        assert len(rows) == wanted


EMPTY = hashlib.sha256(b"").hexdigest()
#: query: {doc_id: what its rows hold, in any order}
VALUES = {
    "op1_line_dedup": (["n_lines", "n_removed", "removed_lines"], {1: [(1, 0, "")], 2: [(1, 0, "")], 3: [(2, 0, "")], 4: [(2, 0, ""), (2, 2, "0,1")], 6: [(1, 0, "")], 8: [(1, 0, "")], None: [(1, 0, "")]}),
    "op2_quality_rules": (["n_words", "word_chars", "n_symbols", "n_repeat_words", "base_failed", "kept"], {1: [(0, 0, 0, 0, True, False)], 2: [(0, 0, 0, 0, True, False)], 3: [(0, 0, 0, 0, True, False)], 4: [(11, 44, 0, 0, True, False)] * 2, 6: [(20000, 104000, 0, 20000, True, False)], 7: [(3, 11, 3, 0, True, False)], None: [(5, 15, 0, 0, True, False)]}),
    "op3_language_id": (["held_out", "lang_pred", "score"], {2: [(False, "und", 0.0)], 7: [(False, "und", 0.0)]}),
    "op4_decontamination": (["n_words", "n_hit", "n_items", "items_sha256", "contaminated"], {1: [(0, 0, 0, EMPTY, False)], 2: [(0, 0, 0, EMPTY, False)], 4: [(11, 0, 0, EMPTY, False)] * 2, 6: [(20000, 0, 0, EMPTY, False)], 7: [(1, 0, 0, EMPTY, False)], None: [(5, 0, 0, EMPTY, False)]}),
    "op5_token_counts": (["n_bytes", "n_tokens", "over_limit"], {1: [(0, 0, False)], 2: [(0, 0, False)], 3: [(4, 0, False)], 6: [(len(LONG), 20000, True)], 8: [(1, 1, False)]}),
    "op8_suffix_dedup": (["n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage"], {1: [(0, 0, 0, EMPTY, False)], 2: [(0, 0, 0, EMPTY, False)], 4: [(54, 0, 0, hashlib.sha256(ROWS[3][1].encode()).hexdigest(), False)] * 2, 6: [(len(LONG), len(LONG), 1, EMPTY, True)]}),
    "op9_simhash_near_dedup": (["fingerprint", "component_id"], {1: [("0" * 16, 1)], 2: [("0" * 16, 1)], 3: [("0" * 16, 1)]}),
    "op10_license_scan": (["canonical_chars", "license_id", "notice_ids"], {1: [(0, None, "")], 2: [(0, None, "")], 3: [(0, None, "")], 7: [(5, None, "")], 8: [(1, None, "")]}),
    "op11_secret_scan": (["n_assign", "n_access", "n_hex", "base_sha256", "spans"], {k: [(0, 0, 0, EMPTY, "")] for k in (1, 2, 3, 5, 6, 7, 8, None)} | {4: [(0, 0, 0, EMPTY, "")] * 2}),
    "op12_merkle_manifest": (["verified"], {1: [(True,)], 2: [(True,)], 4: [(False,)] * 2, 6: [(True,)], 7: [(True,)], None: [(True,)]}),
    "op13_importance_resampling": (["n_features", "rank"], {1: [(0, None)], 2: [(0, None)], 3: [(0, None)], 4: [(11, None)] * 2, 8: [(1, None)], None: [(5, None)]}),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_values_of_odd_rows(spark, odd, name):
    columns, want = VALUES[name]
    rows = catalogue.QUERIES[name](spark, odd).collect()
    for doc, values in want.items():
        assert sorted(tuple(r[c] for c in columns) for r in rows if r.doc_id == doc) == sorted(values), doc


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = catalogue.QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name.startswith("op6") else 0)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_stages(spark, odd, empty, which, tmp_path):
    folder = odd if which == "odd" else empty
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, folder)
        kept.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert (docs.count() > 0) == (which == "odd")
    assert corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").subtract(docs.select("doc_id", "start", "length", "ids_crc32")).isEmpty()


def test_repeated_rows_are_one_document(spark, odd):
    from tidemark.llm.simhash import keep_one

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert keep_one(spark, docs, odd).filter("doc_id = 4").count() == 1


def test_language_rejects_what_has_no_letter(spark, odd):
    from tidemark.llm.language import keep_identified

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = {r.doc_id for r in keep_identified(spark, docs, odd).collect()}
    assert not kept & {1, 2, 3, 7} and {4, 5, 6, None} <= kept


def test_chat_escapes_are_reversible():
    for text in ("", "\\", "<turn>x</turn>\n", "a\\<b\\\\", r"\### Assistant: </turn> ok", "\\n"):
        assert chat.unescaped(chat.escaped(text)) == text
        formatted = chat.rendered("ro\nle<\\", text)[0] * 2
        assert [(r, t) for r, t, _, _ in chat.parsed(formatted)] == [("ro\nle<\\", text)] * 2


def test_ids_survive_clashing_columns(spark, odd):
    rows = catalogue.QUERIES["op9_simhash_near_dedup"](spark, odd)
    assert rows.filter(F.col("doc_id").isNull()).count() == 1
