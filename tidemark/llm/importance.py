"""Importance resampling towards a target: documents whose words are likelier in the target are drawn more often.

Words, and runs of words, fall into ``BUCKETS`` buckets by checksum. The first pass counts the buckets of each
partition with ``np.bincount``, one vector a partition of documents and of the target, and merges them by
``treeReduce``, so the driver meets two vectors. A bucket's gain is the logarithm of its smoothed shares in
the target and the documents, in thousandths. The second pass gathers the broadcast gains (80 kB) of all words
of a batch and sums them by document with ``np.bincount`` and weights. A document's score is its weight and
Gumbel noise drawn from its id, so the highest scores are a sample without replacement by importance; they are
ranked by a sort over ranges. Only (id, counts, weight, score) is shuffled.

Defined cases: a null or empty text has no word, weight 0, and is never drawn; repeated rows are scored one by
one and take ranks of their own; ties in score go to the smaller id, then (rows that share an id) to fewer
words, then to the smaller weight, a null id last, whose noise is that of an empty id; texts of any length
count whole; an empty target leaves the smoothed shares; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, sliced, staged, worker_cache
from tidemark.llm.ordering import numbered

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Most features that a worker remembers the bucket of.
REMEMBERED = 400_000
#: A-Z to lower case; what belongs to no word to a blank; digits, small letters and all bytes beyond ASCII stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a feature; forgets all when full."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a blank."""
    words = text.translate(WORD_BYTES).split()
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return runs


def bucketed(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a column, the number of features of each row, and that of its words."""
    place = worker_cache(f"buckets {buckets}", lambda: Buckets(buckets))
    found, sizes, words = [], [], []
    for text in texts.cast(pa.large_binary()):
        runs = features(text.as_py() or b"", longest)
        found.append(np.fromiter(map(place.__getitem__, runs), np.int32, len(runs)))
        sizes.append(len(runs))
        # m words give m + (m - 1) + ... runs
        words.append(len(runs) if longest == 1 else next((m for m in range(len(runs) + 1) if sum(max(0, m - n) for n in range(longest)) == len(runs)), 0))
    return np.concatenate([np.empty(0, np.int32), *found]), np.array(sizes, np.int64), np.array(words, np.int64)


def _vectors(buckets: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            total += np.bincount(bucketed(batch.column("text"), buckets, longest)[0], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    return count


def counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = 1, text_column: str = "text") -> np.ndarray:
    """Features in each bucket, of all rows: a vector a partition, merged pairwise in the cluster."""
    vectors = rows.select(F.col(text_column).alias("text")).mapInArrow(_vectors(buckets, longest), "counts binary").rdd
    if vectors.getNumPartitions() == 0:
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(of_documents: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over document share, each bucket counted once more, rounded down."""
    n, s_all, t_all = len(of_documents), int(of_documents.sum()), int(of_target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + float(n)) / ((s + 1.0) * (t_all + float(n)))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(of_documents.tolist(), of_target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def _weigh(sent, buckets: int, longest: int, seed: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value.astype(np.float64)
        for batch in sliced(batches):
            found, sizes, words = bucketed(batch.column("text"), buckets, longest)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            # Whole numbers below 2^53, so sums of doubles are exact.
            weight = np.bincount(owner, weights=gain[found], minlength=batch.num_rows).astype(np.int64)
            score = weight + np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (sizes, words, weight, score))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return weigh


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of all documents, written."""
    gain = gains(counts(docs, buckets, longest, text_column), counts(target, buckets, longest, text_column))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = staged(rows.mapInArrow(_weigh(sent, buckets, longest, seed), SCORED), "scored")
    sent.unpersist()
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """Every document with its weight, score and, if drawn, its rank from 1: the highest ``percent`` of those with ``min_words`` words."""
    rows = scored(docs, target, **options)
    fit = rows.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(fit.withColumn("grp", F.lit("all")), "grp", order, "place").drop("grp")
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The same on small tables: checksums by a table of 256 entries made from the polynomial.
SQL = f"""
WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT false, NULL, coalesce(text, '') FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
words AS (SELECT own, row, unnest(words) AS word FROM numbered),
known AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i::BIGINT + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
          FROM (SELECT DISTINCT word FROM words) CROSS JOIN crc_table),
placed AS (SELECT own, row, bucket FROM words JOIN known USING (word)),
totals AS (SELECT count(*) FILTER (own) AS s_all, count(*) FILTER (NOT own) AS t_all FROM placed),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + {BUCKETS}.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + {BUCKETS}.0::DOUBLE))))::BIGINT AS gain
          FROM (SELECT bucket, (count(*) FILTER (own))::DOUBLE AS s, (count(*) FILTER (NOT own))::DOUBLE AS t FROM placed GROUP BY bucket) CROSS JOIN totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE own GROUP BY row),
scores AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
           FROM numbered LEFT JOIN weights USING (row) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
