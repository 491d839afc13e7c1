"""The kept family of sorted suffix arrays, passages, and texts beyond one stretch."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute_force import repeats, suffix_result
from tidemark.llm import suffix_dedup as sd


def random_text(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def corpus(rng, n=60):
    shared = [random_text(rng, 300 + 150 * k) for k in range(6)]
    return [(k, random_text(rng, rng.randrange(0, 900)) + rng.choice(shared)[: rng.randrange(200, 1100)] + random_text(rng, rng.randrange(0, 500))) for k in range(n)]


def entries(spark, docs):
    texts = sd.numbered_bytes(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("batch", F.lit(0))
    return texts.select("row", "batch", "text").mapInArrow(sd._anchors, sd.ANCHORS).filter("suffix is not null").select("suffix", "n")


def test_levels_are_sorted_arrays_with_common_prefixes(spark, tmp_path):
    rng = random.Random(2)
    family = sd.SuffixFamily(spark, str(tmp_path / "family"))
    batches = [entries(spark, corpus(rng, 12)) for _ in range(7)]
    sizes = []
    for batch in batches:
        family.insert(batch)
        sizes.append(sorted(family.levels()))
    assert sizes == [[1], [2], [1, 2], [4], [1, 4], [2, 4], [1, 2, 4]]
    whole = Counter()
    for path in family.levels().values():
        for part in sorted((p for p in map(str, __import__("pathlib").Path(path).glob("part-*")))):
            rows = spark.read.parquet(part).collect()
            found = [bytes(r.suffix) for r in rows]
            assert found == sorted(set(found))
            for r, before, own in zip(rows[1:], found, found[1:]):
                assert r.lcp == next(k for k in range(sd.GRAM) if before[k] != own[k])
            whole.update({s: r.n for s, r in zip(found, rows)})
    want = Counter()
    for batch in batches:
        for r in batch.collect():
            want[bytes(r.suffix)] += r.n
    assert whole == want


def test_a_family_that_is_opened_again_takes_further_batches(spark, tmp_path):
    rng = random.Random(3)
    docs = corpus(rng)
    parts = [docs[:25], docs[25:40], docs[40:]]
    found = [sd.SuffixFamily(spark, str(tmp_path / "family")).insert(entries(spark, part)) for part in parts]
    got = [{r.gram for r in rows.collect()} for rows in found]

    def grams(part):
        texts = sd.numbered_bytes(spark.createDataFrame(part, "doc_id long, text string")).select("row", F.lit(0).cast("int").alias("batch"), "text")
        return Counter(r.gram for r in texts.mapInArrow(sd._anchors, sd.ANCHORS).select("gram").collect())

    before = Counter()
    for part, mine in zip(parts, got):
        own = grams(part)
        assert mine == {g for g in own if own[g] > 1 or g in before}
        before.update(own)


def test_an_unfinished_level_is_no_level(spark, tmp_path):
    folder = tmp_path / "family"
    (folder / "level-2-cutoff").mkdir(parents=True)
    family = sd.SuffixFamily(spark, str(folder))
    family.insert(entries(spark, corpus(random.Random(4), 8)))
    assert sorted(family.levels()) == [1]


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_any_number_of_batches_gives_the_same_result(spark, batches):
    docs = corpus(random.Random(5))
    rows = sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches)
    got = suffix_result(rows.withColumn("kept_sha256", F.sha2("kept", 256)))
    assert got == repeats([(i, t.encode()) for i, t in docs], sd.MATCH)


def passages(docs, size):
    seen = Counter(t[p : p + size] for _, t in docs for p in range(len(t) - size + 1))
    return {i for i, t in docs if any(seen[t[p : p + size]] > 1 for p in range(len(t) - size + 1))}


def test_passages_by_brute_force(spark):
    rng = random.Random(6)
    docs = corpus(rng, 90)
    passage = random_text(rng, 290)
    docs += [(100 + k, random_text(rng, 200) + passage + random_text(rng, 200)) for k in range(4)]
    docs += [(200, random_text(rng, 300)), (201, random_text(rng, 255)), (202, passage[:270]), (203, None)]
    found = sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = passages([(i, (t or "").encode()) for i, t in docs], sd.PASSAGE)
    assert {r.doc_id for r in found if r.has_passage} == want and {100, 202} <= want and 200 not in want
    assert any(r.has_passage and not r.n_removed for r in found)


def test_texts_beyond_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 1500)
    rng = random.Random(8)
    docs = corpus(rng, 25)
    long = random_text(rng, 6000)
    docs += [(300, long), (301, long[1400:1900] + random_text(rng, 4000)), (302, random_text(rng, 1480) + long[2900:3200]), (303, "ab" * 4000)]
    rows = sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = rows.withColumn("kept_sha256", F.sha2("kept", 256)).collect()
    plain = [(i, t.encode()) for i, t in docs]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in kept} == repeats(plain, sd.MATCH)
    assert {r.doc_id for r in kept if r.has_passage} == passages(plain, sd.PASSAGE)


def test_a_text_over_sixteen_megabytes(spark):
    rng = np.random.default_rng(9)
    text = rng.integers(33, 126, 17_500_000).astype(np.uint8).tobytes()
    edge = sd.STRETCH
    # One copy crosses the end of the first part, one lies within it, one is in another document.
    copy = text[edge - 300 : edge + 400]
    text = text[:1_000_000] + copy + text[1_000_000 + len(copy) :]
    other = rng.integers(33, 126, 3_000).astype(np.uint8).tobytes() + text[17_000_000:17_000_500]
    docs = spark.createDataFrame([(1, text.decode()), (2, other.decode())], "doc_id long, text string")
    found = {r.doc_id: r for r in sd.remove_repeats(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()}
    left = text[:1_000_000] + text[1_000_700 : edge - 300] + text[edge + 400 : 17_000_000] + text[17_000_500:]
    assert (found[1].n_removed, found[1].n_spans) == (700 + 700 + 500, 3)
    assert found[1].h == hashlib.sha256(left).hexdigest()
    assert (found[2].n_removed, found[2].n_spans) == (500, 1)
