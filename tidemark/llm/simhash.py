"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks, components.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits
agree on at least three of the blocks, so each of the twenty choices of three blocks is a key and
close pairs meet under one of them. Equal fingerprints are one node from the start: a group of
copies is a single row here. Keys with many different fingerprints are dealt out as pairs of tiles,
so no task gets an unbounded group, and each tile gives a spanning forest of its close pairs instead
of all of them. Components come from distributed union-find.

Defined cases: a null or empty text, or one of blanks, has no words and fingerprint zero, linked
like any other; fewer than three words are one shingle; repeated rows get one result row each;
ties need no rule, since a component is named by its least document id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, load, row_key, sliced, staged
from tidemark.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SHARED_BLOCKS = 3
#: Fingerprints of one key that a tile holds at most, about.
TILE = 4096


def block_masks() -> list[int]:
    """One mask for each choice of blocks that close fingerprints may share, as signed 64-bit numbers."""
    single, shift = [], 0
    for bits in BLOCK_BITS:
        single.append(((1 << bits) - 1) << shift)
        shift += bits
    masks = [sum(choice) for choice in combinations(single, SHARED_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: str | bytes | None) -> int:
    """As a signed number. A bit is set if over half of the shingles' hashes have it."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints, pa.int64())], names=["doc_id", "row", "fp"])


def simhash(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, row, fp); ``row`` tells rows of one id apart."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias("row"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def close_pairs(values: np.ndarray, left: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most ``distance`` bits apart, one of them left and one not, or any two if all are left."""
    both = left.all()
    parent = np.arange(len(values))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    found = []
    for k in np.flatnonzero(left).tolist():
        others = slice(k + 1, None) if both else np.flatnonzero(~left)
        near = np.flatnonzero(np.bitwise_count(values[others] ^ values[k]) <= distance)
        for j in (near + k + 1 if both else others[near]).tolist():
            a, b = root(k), root(j)
            if a != b:
                parent[b] = a
                found.append((k, j))
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (choice, block, low tile, high tile); links within each such run."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: np.ndarray | None = None

    def runs(rows: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        starts = np.concatenate(([0], ends))
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        a, b = [], []
        for start in starts[sizes == 2].tolist() if len(rows) > 1 else []:
            a.append(start)
            b.append(start + 1)
        pairs = np.array([a, b], np.int64).reshape(2, -1)
        split = rows[pairs[0], 2] != rows[pairs[0], 3]
        crossing = rows[pairs[0], 5] != rows[pairs[1], 5]
        near = (np.bitwise_count((rows[pairs[0], 4] ^ rows[pairs[1], 4]).view(np.uint64)) <= DISTANCE) & (~split | crossing)
        links = [np.column_stack((rows[pairs[0][near], 4], rows[pairs[1][near], 4]))]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            run = rows[start : start + size]
            left = run[:, 5] == run[0, 2]
            found = close_pairs(run[:, 4].view(np.uint64), left)
            if found:
                k = np.array(found)
                links.append(np.column_stack((run[k[:, 0], 4], run[k[:, 1], 4])))
        every = np.concatenate(links)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], schema=schema)

    for batch in batches:
        rows = np.ascontiguousarray(np.column_stack([batch.column(k).to_numpy() for k in ("choice", "block", "low", "high", "fp", "tile")]))
        rows = rows if rest is None else np.concatenate((rest, rows))
        if not len(rows):
            continue
        cut = len(rows) - 1
        last = np.flatnonzero((rows[:, :4] != rows[cut, :4]).any(axis=1))
        keep = int(last[-1]) + 1 if len(last) else 0
        if keep:
            yield runs(rows[:keep])
        rest = rows[keep:]
    if rest is not None and len(rest):
        yield runs(rest)


def fingerprint_links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints that connect exactly the pairs at most three bits apart."""
    spark = prints.sparkSession
    keys = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(block_masks())]))
    rows = prints.select("fp").distinct().select("fp", keys.alias("key")).select("key.choice", "key.block", "fp")
    hot = rows.groupBy("choice", "block").count().filter(F.col("count") > tile)
    if hot.isEmpty():
        dealt = rows.select("choice", "block", *[F.lit(0).cast("long").alias(c) for c in ("low", "high")], "fp", F.lit(0).cast("long").alias("tile"))
    else:
        tiles = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / tile)
        own = rows.join(hot, ["choice", "block"], "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        dealt = own.select("*", other.alias("other")).select("choice", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "fp", "tile")
    by = ["choice", "block", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, row, fp, component, component_id): documents linked by fingerprints at most three bits apart share a component.

    ``component`` is its least fingerprint, which tells components apart even where ids repeat;
    ``component_id`` is its least id.
    """
    prints = staged(simhash(docs, id_column, text_column), "fingerprints")
    groups = connected_components(fingerprint_links(prints))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = least.join(groups, least["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # Written, so that a fingerprint or a component with a large share of the rows can be split in the joins.
    heads = staged(staged(named, "named").join(staged(ids, "ids"), "component").select("fp", "component", "component_id"), "heads")
    return prints.join(heads, "fp").select("doc_id", "row", "fp", "component", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the least id.

    A component is a group of rows: of rows that share the least id, the one with the least digest of id
    and text stays, and of rows that agree in both, one. A row with an id comes before one without. Null and empty
    texts have fingerprint zero and are one component with whatever is near it. An empty table stays empty.
    All columns pass unchanged: the stage's own columns take names that none of them has.
    """
    found = staged(near_duplicates(docs), "components")
    key, again = free_name(docs.columns, "_kept"), free_name(docs.columns, "_again")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    heads = found.groupBy("component").agg(first["row"].alias("row")).select("row")
    copies = found.groupBy("row").agg((F.count(F.lit(1)) > 1).alias(again))
    kept = staged(heads.join(copies, "row").select(F.col("row").alias(key), again), "kept")
    joined = docs.join(kept, row_key() == F.col(key))
    single = joined.filter(f"not {again}").drop(key, again)
    if kept.filter(again).isEmpty():
        return single
    return single.union(joined.filter(again).dropDuplicates([key]).drop(key, again))
