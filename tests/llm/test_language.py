"""The network against a plain one, position by position, and the bound of its training rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language


def plain_labels(net, window):
    """Probabilities for each byte of one window, by loops over single numbers."""
    size = net.state[0].shape[1]
    sigmoid = lambda x: 0.5 * math.tanh(x) + 0.5
    states = []
    for way in (0, 1):
        h, found = [0.0] * size, {}
        order = range(len(window)) if way == 0 else range(len(window) - 1, -1, -1)
        for t in order:
            given = [float(net.table[way][row, window[t]]) for row in range(3 * size)]
            inner = [sum(float(net.state[way][row, j]) * h[j] for j in range(size)) for row in range(3 * size)]
            reset = [sigmoid(given[k] + inner[k]) for k in range(size)]
            update = [sigmoid(given[size + k] + inner[size + k]) for k in range(size)]
            candidate = [math.tanh(given[2 * size + k] + reset[k] * inner[2 * size + k]) for k in range(size)]
            h = [update[k] * h[k] + (1 - update[k]) * candidate[k] for k in range(size)]
            found[t] = h
        states.append(found)
    out = []
    for t in range(len(window)):
        both = states[0][t] + states[1][t]
        scores = [float(net.bias[k, 0]) + sum(float(net.out[k, j]) * both[j] for j in range(2 * size)) for k in range(len(net.langs))]
        weights = [math.exp(s - max(scores)) for s in scores]
        out.append([w / sum(weights) for w in weights])
    return np.array(out)


def test_every_position_is_labelled_as_by_a_plain_network():
    rng = np.random.default_rng(4)
    net = language.fresh(["a", "b", "c"], rng, 4)
    net.bias[:] = rng.standard_normal((3, 1))
    lanes = rng.integers(0, 256, (19, 5)).astype(np.uint8)
    got = language.label_bytes(net, lanes)
    for lane in range(5):
        assert np.allclose(got[:, :, lane], plain_labels(net, lanes[:, lane].tolist()), atol=1e-5)


def test_documents_pool_all_their_bytes():
    rng = np.random.default_rng(5)
    net = language.fresh(["a", "b"], rng, 3)
    texts = [b"", b"x", bytes(rng.integers(0, 256, language.SPAN).astype(np.uint8)), bytes(rng.integers(0, 256, 3 * language.SPAN + 17).astype(np.uint8))]
    got = language.document_probabilities(net, texts)
    assert got[0].tolist() == [0, 0]
    for text, found in zip(texts[1:], got[1:]):
        labels = []
        for k in range(0, len(text), language.SPAN):
            part = text[k : k + language.SPAN].ljust(language.SPAN, b" ")
            labels.append(plain_labels(net, part)[: len(text) - k])
        assert np.allclose(found, np.concatenate(labels).mean(axis=0), atol=1e-5)


def test_training_rows_are_bounded_by_rows(spark):
    rows = [(7, f"text number {k} of one id", "en") for k in range(400)] + [(7, "the same row again", "en")] * 300
    rows += [(k, f"texte {k}", "fr") for k in range(60)] + [(k, "123", "de") for k in range(30)] + [(None, "no id", "en"), (3, None, "en"), (4, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.training_rows(docs, most=20).collect()
    by = {lang: [r.text for r in found if r.lang == lang] for lang in ("en", "fr", "de")}
    assert len(by["en"]) == len(set(by["en"])) == 20 and len(by["fr"]) == 20 and by["de"] == []
    held = {r.doc_id for r in docs.filter(language.fold(F.col("doc_id")) == 0).select("doc_id").distinct().collect()}
    assert not {int(t.split()[1]) for t in by["fr"]} & held


def test_windows_cover_whole_training_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "train", lambda windows, lengths, owners, labels, langs: seen.update(windows=windows, lengths=lengths, owners=owners, labels=labels, langs=langs))
    texts = ["short", "a" * language.TRAIN_SPAN, "b" * (3 * language.TRAIN_SPAN + 5)]
    docs = spark.createDataFrame([(11 + k, t, "xy"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string").filter(language.fold(F.col("doc_id")) != 0)
    kept = {r.text for r in docs.collect()}
    language.fit(docs)
    whole = {b"".join(bytes(w[:n]) for w, n, o in zip(seen["windows"], seen["lengths"], seen["owners"]) if o == k).decode() for k in range(len(kept))}
    assert whole == kept
