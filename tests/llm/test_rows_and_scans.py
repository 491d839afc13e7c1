"""Rows that share an id, repeated rows, and scans that are split in other ways from one to the next."""

import hashlib
import random

import pytest

from tests.llm.test_brute_force import repeats, suffix_result
from tidemark.llm import decontamination, line_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, source string"
WORDS = [f"word{k}" for k in range(400)]


def sentence(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Each read of a table is split in another way than the one before."""
    sizes = iter(range(1, 10_000))
    reader = type(spark.read)
    plain = reader.parquet

    def parquet(self, *paths, **options):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(2_000 + 7_919 * (next(sizes) % 13)))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + next(sizes) % 29))
        return plain(self, *paths, **options)

    monkeypatch.setattr(reader, "parquet", parquet)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_results_do_not_depend_on_splits(spark, tmp_path, other_splits):
    rng = random.Random(3)
    texts = [sentence(rng, 90) for _ in range(60)]
    docs = [(k, texts[k % 60] + "\n" + sentence(rng, 20)) for k in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(7).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/documents.parquet")
    assert suffix_result(suffix_dedup.op8_suffix_dedup(spark, str(tmp_path))) == repeats([(i, t.encode()) for i, t in docs], 400)
    lost = {r.doc_id: r.removed_lines for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: x for i, x in lost.items() if x} == {k: "0" for k in range(60, 90)}


def test_line_stage_by_row(spark):
    rng = random.Random(4)
    a, b, c = sentence(rng), sentence(rng), sentence(rng)
    rows = [(1, f"{a}\n{b}", "x"), (1, f"{c}\n{a}", "y"), (2, a, "z"), (2, c, "w"), (3, f"{b}\nown", "p"), (4, "twice\nand more", "q"), (4, "twice\nand more", "r"), (None, None, "s"), (5, " \n ", "t"), (5, " \n ", "u")]
    kept = line_dedup.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    by_source = {r.source: r.text for r in kept}
    # Of the texts under id 1, one is the first; what is new in the other stays with it.
    ones = {by_source.get("x"), by_source.get("y")}
    assert ones in ({f"{a}\n{b}", c}, {b, f"{c}\n{a}"})
    assert by_source["p"] == "own" and "z" not in by_source and "w" not in by_source
    assert sum(s in by_source for s in "qr") == 1 and by_source["s"] is None and {by_source["t"], by_source["u"]} == {" \n "}


def test_line_query_on_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(4, "twice\n\nand more")] * 3 + [(5, "own")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect())
    assert found == [(4, 3, ""), (4, 3, "0,2"), (4, 3, "0,2"), (5, 1, "")]


def test_simhash_stage_by_row(spark):
    rng = random.Random(5)
    a, b, c = sentence(rng), sentence(rng), sentence(rng)
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, c, "p"), (3, c, "q"), (None, b, "s"), (None, sentence(rng), "t"), (None, sentence(rng), "u")]
    kept = {r.source for r in simhash.keep_one(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept in ({"x", "y", "t", "u", "p"}, {"x", "y", "t", "u", "q"})


def test_decontamination_stage_by_row(spark, tmp_path):
    rng = random.Random(6)
    item, clean = sentence(rng, 20), sentence(rng, 40)
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item, "x"), (1, clean, "y"), (None, item, "z"), (None, clean, "w"), (2, None, "n"), (2, item, "m"), (2, item, "k")]
    kept = {r.source for r in decontamination.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert kept == {"y", "w", "n"}


def test_stages_keep_columns_that_have_their_names(spark, tmp_path):
    spark.createDataFrame([(9, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_row", "_removed", "_ROW_", "_gone", "_kept", "_again", "_number", "_first", "row", "node"]
    rows = [(1, "some text of one document", *range(10)), (1, "some text of one document", *range(10)), (2, "and another of a second one", *range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for stage in (line_dedup.drop_lines, simhash.keep_one, decontamination.drop_contaminated):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert all(tuple(r)[2:] == tuple(range(10)) for r in kept.collect())


def test_repeated_strings_of_rows_that_share_an_id(spark, tmp_path):
    rng = random.Random(7)
    a, b = sentence(rng, 120), sentence(rng, 120)
    docs = [(1, a), (1, b), (2, a), (3, sentence(rng, 120))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect())
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, len(a), whole("")), (1, 0, whole(b)), (2, len(a), whole("")), (3, 0, whole(docs[3][1]))])
