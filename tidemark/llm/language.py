"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

A forward and a backward GRU read windows of ``SPAN`` bytes that cover the whole text; each byte
gets a distribution over the learned languages from both states, and a document's distribution is
the mean over all its bytes. The network is trained on the driver in numpy, by backpropagation
through time and Adam, on at most ``TRAIN_DOCUMENTS`` labelled rows a language: a bounded sample, drawn
by the hash of id and text, never from the fold held out, in which rows that agree in both count once.
The driver holds those rows' whole texts, cut into windows; each step draws documents and then windows
of them, so every part of a text may be learned from. Weights are a few kilobytes and travel with the
tasks; prediction sees the text only.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null document id is
not held out and never trained on; without labelled documents every text is ``und``; repeated rows
get equal results; ties in probability go to the language that sorts first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load, row_key, sliced, staged

FOLDS = 5
TRAIN_DOCUMENTS = 300
TRAIN_SPAN = 48
STATE = 8
STEPS = 400
BATCH = 192
RATE = 0.02
SPAN = 128
LANES = 2048
UNKNOWN = "und"
#: Pipeline stage: a text whose best language has less than this of the probability is rejected.
LEAST_SCORE = 0.32


@dataclass
class Network:
    """Two GRUs and a linear layer. Gates are in the order reset, update, candidate; sigmoids are written as tanh of the half."""

    langs: list[str]
    table: list[np.ndarray]  # per direction: gates x 256
    state: list[np.ndarray]  # per direction: gates x STATE
    out: np.ndarray  # languages x 2 STATE
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.state, self.out, self.bias]


def fresh(langs: list[str], rng: np.random.Generator, size: int = STATE) -> Network:
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(langs, [draw(3 * size, 256) for _ in "fb"], [draw(3 * size, size) for _ in "fb"], draw(len(langs), 2 * size), np.zeros((len(langs), 1), np.float32))


def _step(given: np.ndarray, weights: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for all lanes: new state, gates, candidate and its recurrent part."""
    size = len(h)
    pre = weights @ h
    gates = np.tanh(given[: 2 * size] + pre[: 2 * size])
    gates *= 0.5
    gates += 0.5
    inner = pre[2 * size :]
    candidate = np.tanh(given[2 * size :] + gates[:size] * inner)
    new = candidate + gates[size:] * (h - candidate)
    return new, gates, candidate, inner


def label_bytes(net: Network, lanes: np.ndarray) -> np.ndarray:
    """Probabilities (position, language, lane) of windows given as (position, lane) bytes."""
    steps, width = lanes.shape
    size = net.state[0].shape[1]
    scores = np.empty((steps, len(net.langs), width), np.float32)
    for way, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        h = np.zeros((size, width), np.float32)
        head = np.ascontiguousarray(net.out[:, way * size : (way + 1) * size])
        for t in order:
            h = _step(net.table[way].take(lanes[t], axis=1), net.state[way], h)[0]
            if way:
                scores[t] += head @ h
            else:
                np.add(head @ h, net.bias, out=scores[t])
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, lanes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all weighted positions and its gradients, by backpropagation through time."""
    steps, width = lanes.shape
    size = net.state[0].shape[1]
    kept = [[None] * steps, [None] * steps]
    states = np.zeros((2, steps, size, width), np.float32)
    orders = (range(steps), range(steps - 1, -1, -1))
    for way, order in enumerate(orders):
        h = np.zeros((size, width), np.float32)
        for t in order:
            before = h
            h, gates, candidate, inner = _step(net.table[way].take(lanes[t], axis=1), net.state[way], h)
            kept[way][t] = (before, gates, candidate, inner)
            states[way, t] = h
    both = np.concatenate((states[0], states[1]), axis=1)  # position, 2 STATE, lane
    scores = net.out @ both + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    total = max(1.0, float(weight.sum()))
    picked = np.take_along_axis(scores, np.broadcast_to(target[None, None, :], (steps, 1, width)), axis=1)[:, 0]
    loss = float(-(np.log(picked + 1e-9) * weight).sum()) / total
    delta = scores.copy()
    delta -= np.arange(len(net.langs))[None, :, None] == target[None, None, :]
    delta *= (weight / total)[:, None, :]
    g_out = np.einsum("tlw,tsw->ls", delta, both, optimize=True)
    g_bias = delta.sum(axis=(0, 2))[:, None]
    into = net.out.T @ delta
    g_table, g_state = [np.zeros_like(x) for x in net.table], [np.zeros_like(x) for x in net.state]
    for way, order in enumerate(orders):
        carried = np.zeros((size, width), np.float32)
        deltas = np.empty((steps, 3 * size, width), np.float32)
        for t in reversed(order):
            before, gates, candidate, inner = kept[way][t]
            reset, update = gates[:size], gates[size:]
            dh = into[t, way * size : (way + 1) * size] + carried
            dc = dh * (1 - update) * (1 - candidate * candidate)
            d = deltas[t]
            d[:size] = dc * inner * 2 * reset * (1 - reset)
            d[size : 2 * size] = dh * (before - candidate) * 2 * update * (1 - update)
            d[2 * size :] = dc
            through = d.copy()
            through[2 * size :] *= reset
            g_state[way] += through @ before.T
            carried = dh * update + net.state[way].T @ through
        flat = deltas.transpose(1, 0, 2).reshape(3 * size, -1)
        for row in range(3 * size):
            g_table[way][row] = np.bincount(lanes.ravel(), weights=flat[row], minlength=256)
    return loss, [*g_table, *g_state, g_out, g_bias]


def train(windows: np.ndarray, lengths: np.ndarray, owners: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 11, steps: int = STEPS) -> Network:
    """Adam over balanced batches: a language's share of a batch is drawn from its documents, and a window of each.

    ``windows`` is (window, position), padded with spaces beyond ``lengths``; ``owners`` is the document
    of each window, in order, and ``labels`` the language of each document.
    """
    rng = np.random.default_rng(seed)
    net = fresh(langs, rng)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    rows = [np.flatnonzero(labels == k) for k in range(len(langs))]
    begins = np.searchsorted(owners, np.arange(len(labels)))
    sizes = np.searchsorted(owners, np.arange(len(labels)), side="right") - begins
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(own, max(1, BATCH // len(langs))) for own in rows])
        chosen = begins[docs] + rng.integers(0, sizes[docs])
        weight = (np.arange(windows.shape[1])[:, None] < lengths[chosen][None, :]).astype(np.float32)
        _, found = gradients(net, np.ascontiguousarray(windows[chosen].T), labels[docs], weight)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in found)))
        rate = RATE * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), found, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def cut(raw: bytes, span: int) -> np.ndarray:
    """(window, position) bytes of a whole text; the last window is padded with spaces."""
    count = max(1, -(-len(raw) // span))
    return np.frombuffer(raw.ljust(count * span, b" "), np.uint8).reshape(count, span)


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(document, language): means over all bytes. Texts with no byte get zeros."""
    pooled = np.zeros((len(texts), len(net.langs)))
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // SPAN))
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(owner):
        return pooled
    windows = np.concatenate([cut(t, SPAN) for t in texts])
    left = sizes[owner] - SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    for k in range(0, len(owner), LANES):
        part = slice(k, k + LANES)
        labels = label_bytes(net, np.ascontiguousarray(windows[part].T))
        short = np.flatnonzero(left[part] < SPAN)
        for lane in short.tolist():
            labels[max(0, left[part][lane]) :, :, lane] = 0
        np.add.at(pooled, owner[part], labels.sum(axis=0).T)
    return pooled / np.maximum(1, sizes)[:, None]


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield batch.filter(pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))


def training_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(lang, text) of at most ``most`` labelled rows a language that are not held out.

    Rows are thinned by the hash of id and text to a few times the bound, then ranked by it, so no
    language is gathered in one task, and however often an id or a row is repeated, what reaches the
    driver is bounded by languages.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), row_key(id_column, text_column).alias("row"))
    usable = rows.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = staged(counts.select("lang", F.expr(f"least({1 << 30}, {4 * most << 30} div n)").alias("share")), "shares")
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    thinned = usable.withColumn("draw", draw).join(share, "lang").filter("draw <= share").select("lang", "row", "draw", "text")
    lettered = thinned.mapInArrow(_lettered, thinned.schema).dropDuplicates(["lang", "row"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "row"))
    return lettered.withColumn("place", place).filter(F.col("place") <= most).select("lang", "text")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network | None:
    """Train on the whole texts of at most TRAIN_DOCUMENTS labelled rows a language."""
    found = sorted((r["lang"], r["text"].encode()) for r in training_rows(docs, id_column, text_column, lang_column).collect())
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    parts = [cut(text, TRAIN_SPAN) for _, text in found]
    owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sizes = np.array([len(text) for _, text in found])
    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
    lengths = np.minimum(TRAIN_SPAN, sizes[owners] - TRAIN_SPAN * place)
    return train(np.concatenate(parts), lengths, owners, np.array([langs.index(lang) for lang, _ in found]), langs)


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _predict(net: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            lettered = [k for k, t in enumerate(texts) if has_letter(t)] if net else []
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k, probabilities in zip(lettered, document_probabilities(net, [texts[k].encode() for k in lettered]) if lettered else []):
                best = int(probabilities.argmax())
                langs[k], scores[k] = net.langs[best], float(min(1.0, probabilities[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    doc_id = F.col(id_column).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs))


def _accept(net: Network | None, text_at: int):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(text_at).to_pylist()
            lettered = [k for k, t in enumerate(texts) if has_letter(t)] if net else []
            kept = np.zeros(len(texts), bool)
            if lettered:
                kept[lettered] = document_probabilities(net, [texts[k].encode() for k in lettered]).max(axis=1) >= LEAST_SCORE
            yield batch.filter(pa.array(kept))

    return accept


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without letters or without a clear language go. Rows pass through the model and are filtered there, so nothing is joined or shuffled.

    A null or empty text has no letter and goes; each row is judged by its own text, so repeated rows and
    rows that share an id stay or go by that; a text whose best languages tie stays if their probability is
    enough; without labelled rows there is no language and nothing stays; an empty table stays empty. All
    columns pass unchanged, whatever their names.
    """
    return docs.mapInArrow(_accept(fit(docs), docs.columns.index("text")), docs.schema)
