"""Decontamination cuts and searches in whole batches: words as one text at a time gives them, the index read once, candidates a part at a time."""

import random

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from tests.llm.test_brute_force import near_truth
from tidemark.llm import decontamination


def test_words_of_a_batch():
    rng = random.Random(4)
    texts = [None, b"", b" ", b"  a  b\n", b"\xc3\xb1andu \xff\xfe X9\x00y", b"\xe2\x80\x83z", None]
    texts += [bytes(rng.choice(b"aB z9\n\t-\xc3\xb1\xff\x00\x0b") for _ in range(rng.randrange(60))) for _ in range(200)]
    whole = pa.array(texts, pa.binary())
    for part in (whole, whole[3:], whole[5:90], whole[:0], pa.array([None, None], pa.binary())):
        words, counts = decontamination.tokens_of(part)
        want = [decontamination.words_of(t) for t in part.to_pylist()]
        assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [w for own in want for w in own]


def test_the_index_is_read_once(spark, monkeypatch):
    """The rarest term of a window is the block's own, so no pass over the index counts terms before the search."""
    docs = spark.createDataFrame([(1, "one two three four"), (2, "four three")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    index, read, plain = decontamination.build_index(docs), [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: read.append("positions" in self.columns or "terms" in self.columns) or plain(self, *a, **k))
    rows = {r.doc_id: r for r in decontamination.find_passages(index, item).collect()}
    assert rows[1]["items"] == ["1"] and not rows[2]["items"] and sum(read) == 1


def test_candidates_a_part_at_a_time(spark, monkeypatch):
    rng = random.Random(15)
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for k in range(40)]
    phrases = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))) for k in range(12)]
    monkeypatch.setattr(decontamination, "CANDIDATES", 7)
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: r for r in decontamination.find_passages(index, spark.createDataFrame(phrases, "item_id long, text string"), 2).collect()}
    for k, text in docs:
        words, exact, near = text.split(), {}, {}
        for item, phrase in phrases:
            phrase = phrase.split()
            exact[item] = {p for s in range(len(words) - len(phrase) + 1) if words[s : s + len(phrase)] == phrase for p in range(s, s + len(phrase))}
            near[item] = near_truth(words, phrase, 2)
        for found, spans, want in ((rows[k]["items"], rows[k].spans, exact), (rows[k].near_items, rows[k].near_spans, near)):
            assert found == sorted(str(i) for i in want if want[i])
            assert {p for s in spans for p in range(s.a, s.b)} == set().union(*want.values())
