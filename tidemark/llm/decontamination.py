"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed in blocks of documents: one row holds a block's terms and, for each,
the sorted list of its positions in the block's token stream. Such an index is dealt by document, so
a frequent term is spread over all blocks and no list is gathered in one place. A phrase is found
from its rarest term: a block is asked only for windows of which it has all terms; the list of the
term that is rarest there, moved back by the term's offset, is narrowed by the lists of the other
terms, each moved by its own offset, from rare to frequent. All windows of a block are narrowed together.

A proximity match has all terms in order, each at most ``slop`` places from where the phrase would
have it. Its words are the terms' own positions, not the stretch between them.

Windows of the benchmark are a table of their own, keyed by digest. They are looked for in passes of
about ``WINDOWS``, whatever items they come from, so a huge item or many items of one id change
neither message nor memory; items join the hits afterwards.

Defined cases: a null text has no words; an item without words has no window; a null item id is the
empty string; items that share an id are one item with the windows of all of them; documents are told
apart by a digest of id and text, so repeated rows count one by one and rows that share an id keep
their own result; rarity ties are broken by offset; a text longer than ``BLOCK_TOKENS`` is a block of
its own; empty tables give an empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, load, row_key, sliced, stage_path, staged

WINDOW = 13
#: Tokens of an index block, about.
BLOCK_TOKENS = 400_000
#: Different windows of the benchmark that one pass looks for, about.
WINDOWS = 100_000
#: Places of rarest terms that are narrowed together, about.
CANDIDATES = 500_000
#: Windows of one item that leave a worker at once.
ITEM_WINDOWS = 20_000
#: Places that a term may be off in a proximity match of the query.
SLOP = 2
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
TABLE = bytes.maketrans(SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
INDEX = "block long, doc_ids array<long>, rows array<long>, starts array<int>, n_words array<int>, terms array<binary>, ends array<int>, positions binary"
SPANS = "array<struct<a:int,b:int>>"
HITS = f"row long, block long, ordinal int, doc_id long, n_words long, spans {SPANS}, windows array<long>, near_spans {SPANS}, near_windows array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def pack_positions(positions: np.ndarray) -> bytes:
    """Byte planes: the high ones hardly change along a sorted list and compress to little."""
    return np.ascontiguousarray(positions.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_positions(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` (binary) one after the other, and how many each text has; cut by Arrow over the whole batch."""
    texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    raw = texts.buffers()[2]
    plain = bytes(raw[offsets[0] : offsets[-1]] if raw else b"").translate(TABLE)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)))
    words = lists.values.view(pa.binary())
    # A blank at an end of a text gives an empty word there.
    full = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), np.diff(before[lists.offsets.to_numpy()])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "rows": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "n_words": pa.list_(pa.int32()), "terms": pa.list_(pa.binary()), "ends": pa.list_(pa.int32()), "positions": pa.binary()}
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, keys, starts, sizes, tokens, place = [], [], [], [], [], 0

    def row() -> pa.RecordBatch:
        nonlocal made, ids, keys, starts, sizes, tokens, place
        coded = pa.concat_arrays([pa.array([], pa.binary()), *tokens]).dictionary_encode()
        lengths, terms = np.array(sizes), coded.dictionary
        where = np.arange(lengths.sum()) + np.repeat(np.array(starts) - np.cumsum(lengths) + lengths, lengths)
        # Terms in the upper half, positions in the lower: one sort puts each term's positions in order.
        order = np.sort(coded.indices.to_numpy().astype(np.int64) << 32 | where)
        ends = np.cumsum(np.bincount(order >> 32, minlength=len(terms)))
        values = [base + made, ids, keys, starts, sizes, None, ends.astype(np.int32), pack_positions(order & 0xFFFFFFFF)]
        columns = {name: pa.array([v], t) for (name, t), v in zip(types.items(), values) if name != "terms"}
        columns["terms"] = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)
        made += 1
        ids, keys, starts, sizes, tokens, place = [], [], [], [], [], 0
        return pa.RecordBatch.from_arrays([columns[name] for name in types], names=list(types))

    for batch in sliced(batches):
        words, counts = tokens_of(batch.column("text"))
        first = last = 0
        for doc, key, n in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), counts.tolist()):
            if ids and place + n > BLOCK_TOKENS:
                tokens.append(words.slice(first, last - first))
                first = last
                yield row()
            ids.append(doc)
            keys.append(key)
            starts.append(place)
            sizes.append(n)
            last += n
            place += n + 1  # a gap, so that no phrase runs from one document into the next
        tokens.append(words.slice(first, last - first))
    if ids:
        yield row()


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the postings of all tokens of ``docs`` to the shared folder and open them as a table, a row for each block."""
    spark = docs.sparkSession
    path = stage_path(spark, "postings")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias("row"), F.col(text_column).cast("binary").alias("text"))
    rows.mapInArrow(_index, INDEX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            found = list(dict.fromkeys(tuple(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1) if words else 0)))
            for k in range(0, len(found), ITEM_WINDOWS):
                part = found[k : k + ITEM_WINDOWS]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(list(map(list, part)), pa.list_(pa.binary()))], names=["item", "words"])


def windows_of(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(window, item, words): the different windows of each item, keyed by a digest of their words."""
    texts = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).cast("binary").alias("text"))
    found = texts.mapInArrow(_windows, "item string, words array<binary>")
    return found.select(F.xxhash64("words").alias("window"), "item", "words")


def starts_of(postings: np.ndarray, phrases: np.ndarray, ranks: np.ndarray, window: np.ndarray, starts: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of the places where phrases may start in one block, of all windows at once, narrowed from rare terms to frequent ones:
    each term has an occurrence at most ``slop`` off its own place. ``postings`` are terms and positions in one sorted number."""
    for rank in range(1, phrases.shape[1]):
        offset = ranks[window, rank]
        wanted = (phrases[window, offset] << 32) + starts + offset
        at = np.minimum(np.searchsorted(postings, wanted - slop), len(postings) - 1)
        inside = (postings[at] >= wanted - slop) & (postings[at] <= wanted + slop)
        window, starts = window[inside], starts[inside]
    return window, starts


def in_order(postings: np.ndarray, phrases: np.ndarray, window: np.ndarray, starts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and (match, term) positions of the phrases at ``starts`` whose terms follow each other: each term takes its first occurrence after the one before it, which leaves the most room to the next."""
    places = np.zeros((len(starts), 0), np.int64)
    before = np.full(len(starts), -1)
    for offset in range(phrases.shape[1]):
        term = phrases[window, offset] << 32
        at = np.minimum(np.searchsorted(postings, term + np.maximum(before + 1, starts + offset - slop)), len(postings) - 1)
        found = postings[at] - term
        live = (found > before) & (found >= starts + offset - slop) & (found <= starts + offset + slop)
        window, starts, before = window[live], starts[live], found[live]
        places = np.concatenate([places[live], before[:, None]], axis=1)
    return window, places


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbours with CANDIDATES in all, about, at a time."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and total + n > CANDIDATES:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if len(sizes):
        yield slice(first, len(sizes))


def _hits(sent, slop: int, every: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, groups = sent.value
        spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in sliced(batches, 1):  # a row is a whole block
            get = lambda name: batch.column(name)[0]  # noqa: E731, B023
            starts, sizes = get("starts").values.to_numpy(), get("n_words").values.to_numpy()
            ends, places = get("ends").values.to_numpy().astype(np.int64), unpack_positions(get("positions").as_py())
            begins = np.concatenate([[0], ends])[:-1]
            # Where each term of the windows stands in the block, and how often.
            known = pc.index_in(get("terms").values, value_set=vocabulary)
            there = np.flatnonzero(known.is_valid())
            term = known.drop_null().to_numpy()
            there, term = there[np.argsort(term)], np.sort(term).astype(np.int64)
            lengths = (ends - begins)[there]
            counts = np.zeros(len(vocabulary), np.int64)
            counts[term] = lengths
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            postings = np.repeat(term << 32, lengths) + places[np.repeat(begins[there], lengths) + inner]
            begin = np.cumsum(counts) - counts
            size = int(starts[-1] + sizes[-1]) + 2
            marks, found = [np.zeros(size, np.int8), np.zeros(size, np.int8)], [{}, {}]

            def mark(kind: int, window: np.ndarray, matched: np.ndarray) -> None:
                docs = np.searchsorted(starts, matched[:, 0], side="right") - 1
                inside = (matched[:, 0] >= 0) & (docs >= 0) & (matched[:, -1] < starts[docs] + sizes[docs])
                marks[kind][matched[inside].ravel()] = 1
                for doc, own in np.unique(np.stack([docs[inside], window[inside]]), axis=1).T.tolist():
                    found[kind].setdefault(doc, set()).add(own)

            for windows, all_phrases in groups:
                often = counts[all_phrases]
                live = np.flatnonzero((often > 0).all(axis=1))
                # The block's own rarest term leads; ties are broken by offset.
                all_ranks = np.argsort(often[live], axis=1, kind="stable")
                least = often[live, all_ranks[:, 0]]
                for part in _chunks(least * (2 * slop + 1)):
                    own, phrases, ranks, n = live[part], all_phrases[live[part]], all_ranks[part], least[part]
                    window = np.repeat(np.arange(len(own)), n)
                    lead = begin[phrases[np.arange(len(own)), ranks[:, 0]]]
                    at = np.repeat(lead - np.cumsum(n) + n, n) + np.arange(n.sum())
                    first = (postings[at] & 0xFFFFFFFF) - ranks[window, 0]
                    exact, where = starts_of(postings, phrases, ranks, window, first)
                    if len(exact):
                        mark(0, windows[own[exact]], where[:, None] + np.arange(phrases.shape[1]))
                    if slop:
                        # Starts from -(WINDOW + slop) on; a window's starts are told apart in one sorted number.
                        near = np.unique(((window << 32)[:, None] + first[:, None] + np.arange(WINDOW, WINDOW + 2 * slop + 1)).ravel())
                        near, where = starts_of(postings, phrases, ranks, near >> 32, (near & 0xFFFFFFFF) - WINDOW - slop, slop)
                        near, matched = in_order(postings, phrases, near, where, slop)
                        if len(near):
                            mark(1, windows[own[near]], matched)

            def spans(kind: int) -> dict[int, list[dict]]:
                out: dict[int, list[dict]] = {}
                for a, b in np.flatnonzero(np.diff(marks[kind], prepend=np.int8(0))).reshape(-1, 2).tolist():
                    doc = int(np.searchsorted(starts, a, side="right")) - 1
                    out.setdefault(doc, []).append({"a": a - int(starts[doc]), "b": b - int(starts[doc])})
                return out

            own = range(len(starts)) if every else sorted(found[0].keys() | found[1].keys())
            cover = [spans(0), spans(1)]
            some = pa.array(list(own), pa.int32())
            columns = [get("rows").values.take(some), pa.array([get("block").as_py()] * len(own), pa.int64()), some, get("doc_ids").values.take(some), pc.cast(get("n_words").values.take(some), pa.int64())]
            for kind in (0, 1):
                columns += [pa.array([cover[kind].get(d, []) for d in own], spans_type), pa.array([sorted(found[kind].get(d, ())) for d in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "block", "ordinal", "doc_id", "n_words", "spans", "windows", "near_spans", "near_windows"])

    return search


def coded_windows(phrases: dict[int, list[bytes]]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The terms of a bounded number of windows, and for each length of window its digests and a matrix of term numbers."""
    numbers: dict[bytes, int] = {}
    lengths: dict[int, list[int]] = {}
    for window, words in phrases.items():
        lengths.setdefault(len(words), []).append(window)
        for w in words:
            numbers.setdefault(w, len(numbers))
    groups = [(np.array(own, np.int64), np.array([[numbers[w] for w in phrases[k]] for k in own], np.int64)) for own in lengths.values()]
    return pa.array(list(numbers), pa.binary()), groups  # at most WINDOWS * WINDOW terms


def _union_of(spans: str) -> Column:
    """Spans of several passes as disjoint ones in order."""
    start = F.array().cast(SPANS)
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]), grown(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(F.flatten(F.collect_list(spans))), start, step)


def find_passages(index: DataFrame, benchmark: DataFrame, slop: int = 0, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, n_words, spans, items, near_spans, near_items) for each indexed document: spans are word ranges [a, b) of exact phrases, or of the words of proximity matches."""
    spark = index.sparkSession
    windows = staged(windows_of(benchmark, id_column, text_column), "windows")
    different = staged(windows.groupBy("window").agg(F.first("words").alias("words")), "windows")
    passes = max(1, -(-different.count() // WINDOWS))
    found = None
    for k in range(passes):
        part = different.filter(F.pmod("window", F.lit(passes)) == k) if passes > 1 else different
        phrases = {r["window"]: [bytes(w) for w in r["words"]] for r in part.collect()}
        hits = index.mapInArrow(_hits(spark.sparkContext.broadcast(coded_windows(phrases)), slop, k == 0), HITS)
        found = hits if found is None else found.unionByName(hits)
    key = ["block", "ordinal"]
    if passes > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("windows", "near_windows")]
        found = found.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("row", "doc_id", "n_words")], *[_union_of(c).alias(c) for c in ("spans", "near_spans")], *lists)
    found = staged(found, "hits")
    # Only documents with a window go through the join with items; the different items of each come back as one list.
    marked = lambda c, near: F.transform(c, lambda w: F.struct(w.alias("window"), F.lit(near).alias("near")))
    wins = found.filter("size(windows) + size(near_windows) > 0").select(*key, F.explode(F.concat(marked("windows", False), marked("near_windows", True))).alias("w")).select(*key, "w.*")
    named = wins.join(windows.select("window", "item"), "window").groupBy(*key).agg(F.collect_set(F.when(~F.col("near"), F.col("item"))).alias("items"), F.collect_set(F.when(F.col("near"), F.col("item"))).alias("near_items"))
    none = F.array().cast("array<string>")
    joined = found.join(named, key, "left")
    return joined.select("row", "doc_id", "n_words", "spans", F.array_sort(F.coalesce("items", none)).alias("items"), "near_spans", F.array_sort(F.coalesce("near_items", none)).alias("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """Per document: words, words inside windows of items, the items, the verdict (a twentieth of the words or more), and with ``slop`` the items near which it comes."""
    found = find_passages(build_index(docs), benchmark, slop)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    rows = found.select("row", "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("near_items").cast("long").alias("n_near_items"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, each judged by its own text.

    Rows are told apart by a digest of id and text, so a clean text that shares its id with a contaminated
    one stays, and repeated rows stay or go together. A null text has no words and stays; an empty table
    stays empty; ties do not arise. All columns pass unchanged: the stage's own column takes a name that
    none of them has.
    """
    found = decontaminate(docs, load(spark, sf_dir, "benchmark"))
    gone = free_name(docs.columns, "_gone")
    contaminated = staged(found.filter("contaminated").select(F.col("row").alias(gone)).distinct(), "contaminated")
    return docs.join(contaminated, row_key() == F.col(gone), "left_anti")
