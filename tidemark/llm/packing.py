"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Each document becomes its token ids and one closing id. It is cut at multiples of the sequence
length: whole pieces fill a sequence alone, the rest is packed. Packing runs independently in
randomised groups of about ``GROUP_ROWS`` documents, so no task depends on the corpus' size, and
only (document, length, checksums) is shuffled, never ids or texts.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed one by one;
ties in length are broken by document id and checksum; an empty table gives an empty result; other
columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, sliced, worker_cache

SEQUENCE = 1024
GROUP_ROWS = 2048
CLOSING_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary as ranks: the same ids as the .json file gives, several times faster."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def document_ids(coder: tiktoken.Encoding, text: str | None, closing: int = CLOSING_ID) -> np.ndarray:
    """A special string inside a text becomes its id, as the library does by default."""
    ids = coder.encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(closing)).astype("<u4", copy=False)


class TournamentTree:
    """Leftmost bin with room for an item in O(log bins): each inner node knows the larger of its children's capacities."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the first bin that has it; gives the bin and the room it had."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        leaf = node
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf - self.leaves, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, in the items' order, and the number of bins used."""
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    tree = TournamentTree(len(lengths), capacity)
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found, had = tree.place(lengths[item])
        bins[item], offsets[item] = found, capacity - had
        used = max(used, found + 1)
    return bins, offsets, used


def _measure(ranks_path: str, sequence: int, id_column: str, text_column: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_cache(f"ranks {ranks_path}", lambda: encoder(ranks_path))
        for batch in sliced(batches):
            counts, sums = [], []
            for text in batch.column("text"):
                ids = document_ids(coder, text.as_py())
                counts.append(len(ids))
                sums.append([zlib.crc32(ids[k : k + sequence]) for k in range(0, len(ids), sequence)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "sums"])

    return measure


def _pack(sequence: int):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(tail=[int(s[-1]) for s in group["sums"]]).sort_values(["doc_id", "doc_tokens", "tail"], kind="stable", na_position="first")
        docs, tokens, sums = group["doc_id"].tolist(), group["doc_tokens"].tolist(), group["sums"].tolist()
        rests = [(k, n % sequence) for k, n in enumerate(tokens) if n % sequence]
        bins, offsets, used = first_fit_decreasing([n for _, n in rests], sequence) if rests else ([], [], 0)
        base, rows = key[0] << 32, []
        for (k, n), b, offset in zip(rests, bins, offsets, strict=True):
            rows.append((docs[k], tokens[k] - n, n, int(sums[k][-1]), tokens[k], base + b, offset))
        for k, n in enumerate(tokens):
            for piece in range(n // sequence):
                rows.append((docs[k], piece * sequence, sequence, int(sums[k][piece]), n, base + used, 0))
                used += 1
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return pack


def pack_documents(docs: DataFrame, ranks_path: str | None = None, sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document, its checksum, and its place in a sequence."""
    spark = docs.sparkSession
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    groups = max(1, -(-docs.count() // group_rows))
    measured = rows.mapInArrow(_measure(ranks_path, sequence, id_column, text_column), "doc_id long, doc_tokens long, sums array<long>")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    return measured.withColumn("pack_group", drawn).groupBy("pack_group").applyInPandas(_pack(sequence), PIECES)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
