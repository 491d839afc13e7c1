"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of each window of ``PASSAGE`` bytes the place whose first ``GRAM``
bytes have the least hash is an anchor, so equal windows have anchors at equal places wherever they
lie, and about one suffix in 97 is kept. No repeated string of ``PASSAGE`` bytes is lost by that. (A
full suffix array in numpy costs around a microsecond a byte and several times the input on disk.)

A suffix array here is a table of the sampled suffixes in the order of their bytes, cut to ``GRAM``
bytes, each with its longest common prefix with the one before and the number of places it has. Two
equal windows leave at least ``GRAM`` common bytes from their anchor on, so a possible match is a pair
of neighbours in this order whose common prefix has ``GRAM`` bytes.

Arrays are kept in levels whose sizes are powers of two batches. A new batch is sorted into an array of
its own; it is merge-scanned against every level: both are read in order of bytes, and neighbours from
the two sides with a long common prefix are reported. Where a level has the size of the new array, the
merge that the scan makes is written as the next level, so an entry is rewritten once for each doubling.
Levels lie in a folder, and a family that is opened there again takes further batches.

The scan gives candidates; an exact check follows: equal contexts around the anchor settle all windows
of an anchor at once, and where contexts differ the windows' own digests decide. Everything is
aggregated by digest with map-side combining, and copies within a batch of rows enter the array once
with their number, so groups of copies never meet in a task.

Documents that lose nothing are also told apart by whether they hold a passage: a string of ``PASSAGE``
bytes, about fifty words, that also starts elsewhere. That needs no second index, only the windows
around anchors that such documents share.

Digests have 64 bits; different strings of n compared share one with probability n^2/2^65.

Defined cases: null and short texts have no window and lose nothing; matches never cross documents;
rows are told apart by a digest of id and text, so rows that share an id are documents of their own,
and repeated rows of ``MATCH`` bytes or more lose everything; a text beyond ``STRETCH`` bytes is taken
in overlapping parts; ties need no rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, file_system, load, row_key, sliced, stage_path, staged, worker_cache

MATCH = 400
PASSAGE = 256
GRAM = 64
HALF = MATCH // 2
#: Windows of an anchor are taken in groups of so many neighbours, which share all but STEP - 1 bytes.
STEP = 50
#: Batches follow the input: one for so many bytes of text, two at least. Beyond MOST_BATCHES they grow instead, which bounds the number of jobs.
BATCH_BYTES = 4 << 30
LEAST_BATCHES, MOST_BATCHES = 2, 32
#: Bytes that are hashed at once; places in such a stretch take PLACE_BITS bits.
STRETCH = 1 << 24
PLACE_BITS = 26
BITMAPS, BITS = 1024, 32768
ANCHORS = "row long, batch int, gram long, at int, first int, last int, context long, ahead long, behind long, suffix binary, n int"
ARRAY = "suffix binary, lcp int, n long, new long"
MATCHES = "gram long"


class Digests:
    """Digests of all substrings of a stretch of bytes from running sums of powers, modulo 2^64."""

    def __init__(self, size: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))))
            self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64))))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((sums[start + length] - sums[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def digests_for(size: int) -> Digests:
    """One table of powers per worker, as large as the largest stretch so far."""
    wanted = 1 << max(21, int(size).bit_length())
    kept = worker_cache("digests", dict)
    if wanted not in kept:
        kept.clear()
        kept[wanted] = Digests(wanted)
    return kept[wanted]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def sampled(ranked: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, place, first and last window) of the anchors of all windows of ``width`` bytes that lie in one of the documents [begin, end)."""
    fits = ends - begins >= width
    if not fits.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = sliding_least(ranked, width - GRAM + 1)
    counts = (ends - begins - width + 1)[fits]
    owner = np.repeat(np.flatnonzero(fits), counts)
    starts = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[new], at[new], starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]


def hashed(raw: np.ndarray) -> tuple[Digests, np.ndarray, np.ndarray, np.ndarray]:
    """The digests of a stretch: their table, running sums, grams, and grams ranked with their place as tie-break."""
    coder = digests_for(len(raw))
    sums = coder.sums(raw)
    grams = coder.of(sums, np.arange(len(raw) - GRAM + 1), GRAM)
    ranked = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    return coder, sums, grams, ranked


def anchors_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, short_ends: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all windows of PASSAGE bytes up to ``short_ends``, and of MATCH bytes up to ``ends``; the latter, which are among the former, are ``whole`` and have windows and contexts. Places count from the document's begin."""
    coder, sums, grams, ranked = hashed(raw)
    owner, at, *_ = sampled(ranked, begins, short_ends, PASSAGE)
    w_owner, w_at, first, last = sampled(ranked, begins, ends, MATCH)
    context = mixed(coder.of(sums, first, last - first + MATCH) + mixed(((w_at - first) * (1 << 20) + (last - first)).astype(np.uint64)))
    has_ahead, has_behind = last > w_at - HALF, first <= w_at - HALF
    ahead = coder.of(sums, np.where(has_ahead, w_at, 0), np.where(has_ahead, HALF, 0))
    behind = coder.of(sums, np.where(has_behind, w_at - HALF, 0), np.where(has_behind, HALF, 0))
    # A window of MATCH bytes near the end of a stretch's part may have an anchor that only the next part samples for PASSAGE.
    order = np.searchsorted(at, w_at)
    known = np.zeros(len(w_at), bool)
    known[order < len(at)] = at[order[order < len(at)]] == w_at[order < len(at)]
    extra = np.flatnonzero(~known)
    places = np.concatenate((at, w_at[extra]))
    owners = np.concatenate((owner, w_owner[extra]))
    order[extra] = len(at) + np.arange(len(extra))
    found = {"owner": owners, "place": places, "at": places - begins[owners], "gram": grams[places]}
    begin = begins[w_owner]
    for name, values in {"first": first - begin, "last": last - begin, "context": context, "ahead": ahead, "behind": behind}.items():
        found[name] = np.zeros(len(places), values.dtype)
        found[name][order] = values
    for name, flags in {"whole": np.ones(len(w_at), bool), "has_ahead": has_ahead, "has_behind": has_behind}.items():
        found[name] = np.zeros(len(places), bool)
        found[name][order] = flags
    return found


def stretches(texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of documents of about STRETCH bytes: (documents, bytes, begins, ends, ends for passages, shifts).

    A longer text comes in overlapping parts, shifted; each window of either length lies in one part only.
    """
    docs, parts, shifts, short, size = [], [], [], [], 0

    def out():
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        return docs, np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends, ends - sizes + np.array(short, np.int64), np.array(shifts, np.int64)

    for k, text in enumerate(texts):
        whole = text or b""
        for shift in range(0, max(1, len(whole) - PASSAGE + 1), STRETCH):
            part = whole[shift : shift + STRETCH + MATCH - 1]
            if len(part) < PASSAGE:
                continue
            if parts and size + len(part) > STRETCH:
                yield out()
                docs, parts, shifts, short, size = [], [], [], [], 0
            docs.append(k)
            parts.append(part)
            shifts.append(shift)
            short.append(min(len(part), STRETCH + PASSAGE - 1))
            size += len(part)
    if parts:
        yield out()


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def byte_matrix(column: pa.Array, width: int = GRAM) -> np.ndarray:
    """Binary values of one width as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    for batch in sliced(batches):
        rows, parts, texts = batch.column("row").to_numpy(), batch.column("batch").to_numpy(), batch.column("text").to_pylist()
        for docs, raw, begins, ends, short, shifts in stretches(texts):
            found = anchors_of(raw, begins, ends, short)
            number = np.array(docs)[found["owner"]]
            part, shift, whole = parts[number], shifts[found["owner"]], found["whole"]
            # Suffixes that begin alike enter the array once for a stretch, with their number.
            _, one, times = np.unique(found["gram"] ^ mixed(part.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
            counted = np.zeros(len(number), np.int32)
            counted[one] = times
            suffix = pa.nulls(len(number), pa.binary())
            if len(one):
                chosen = np.sort(one)
                beginnings = fixed_binary(raw[found["place"][chosen][:, None] + np.arange(GRAM)])
                taken = np.full(len(number), -1, np.int64)
                taken[chosen] = np.arange(len(chosen))
                suffix = beginnings.take(pa.array(taken, mask=taken < 0))
            signed = lambda name, has: pa.array(found[name].view(np.int64), mask=~has)  # noqa: E731, B023
            placed = lambda name, has: pa.array((found[name] + shift).astype(np.int32), mask=~has)  # noqa: E731, B023
            columns = [pa.array(rows[number]), pa.array(part), pa.array(found["gram"].view(np.int64)), pa.array((found["at"] + shift).astype(np.int32))]
            columns += [placed("first", whole), placed("last", whole), signed("context", whole), signed("ahead", found["has_ahead"]), signed("behind", found["has_behind"])]
            columns += [suffix, pa.array(counted, mask=counted == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def numbered_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(row_key(id_column, text_column).alias("row"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over suffixes (suffix, n, new) in order of their bytes: neighbours' common prefixes, equal ones folded into one entry with the sums of their numbers."""
    held: tuple[np.ndarray, ...] | None = None  # the last suffix so far, which may go on
    before: np.ndarray | None = None  # the one that was given out last

    def prefix(data: np.ndarray) -> np.ndarray:
        """Common prefix of each row with the one before it."""
        above = np.concatenate((data[:1] ^ 0xFF if before is None else before, data[:-1]))
        differ = above != data
        return np.where(differ.any(axis=1), differ.argmax(axis=1), GRAM).astype(np.int32)

    def entries(data: np.ndarray, n: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([fixed_binary(data), pa.array(prefix(data)), pa.array(n), pa.array(new)], names=["suffix", "lcp", "n", "new"])

    for batch in sliced(batches, 1 << 14):
        rows = byte_matrix(batch.column("suffix")), batch.column("n").to_numpy(), batch.column("new").to_numpy()
        data, n, new = rows if held is None else map(np.concatenate, zip(held, rows))
        heads = np.flatnonzero(np.concatenate(([True], (data[1:] != data[:-1]).any(axis=1))))
        data, n, new = data[heads], np.add.reduceat(n, heads), np.add.reduceat(new, heads)
        if len(data) > 1:
            yield entries(data[:-1], n[:-1], new[:-1])
            before = data[-2:-1].copy()
        held = data[-1:].copy(), n[-1:].copy(), new[-1:].copy()
    if held is not None:
        yield entries(*held)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of suffixes, as anchors have them."""
    coder = digests_for(GRAM)
    for batch in sliced(batches, 1 << 14):
        data = byte_matrix(batch.column("suffix"))
        grams = mixed((coder.values[data] * coder.powers[:GRAM]).sum(axis=1, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])


class SuffixFamily:
    """Levels of sorted suffix arrays whose sizes are powers of two batches, in a folder that may outlive the session.

    A family that is opened there again finds the levels that were written whole, so a run that was cut
    off between two inserts goes on. ``insert`` gives the grams of a new batch's matches.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or stage_path(spark, "family")

    def levels(self) -> dict[int, str]:
        """Path of each level by its size in batches."""
        files, place = file_system(self.spark, self.folder)
        names = [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []
        whole = [m for m in map(re.compile(r"level-(\d+)-\w+").fullmatch, names) if m and files.exists(file_system(self.spark, f"{self.folder}/{m[0]}/_SUCCESS")[1])]
        return {int(m[1]): f"{self.folder}/{m[0]}" for m in whole}

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ARRAY).parquet(path)

    def _sorted(self, *sides: DataFrame) -> DataFrame:
        """A pass over the entries of all sides in order of their bytes. Range partitions keep equal suffixes together."""
        rows = sides[0]
        for side in sides[1:]:
            rows = rows.union(side)
        return rows.repartitionByRange("suffix").sortWithinPartitions("suffix").mapInArrow(_folded, ARRAY)

    def _matches(self, scan: DataFrame) -> DataFrame:
        """(gram) of suffixes that the new side has in common with another place."""
        return scan.filter("new > 0 and n > 1").select("suffix").mapInArrow(_grams, "gram long")

    def insert(self, batch: DataFrame) -> DataFrame:
        """Take a batch of sampled suffixes (suffix, n): (gram) of those that begin like another of the batch or of a level."""
        levels, name = self.levels(), uuid.uuid4().hex
        n = F.col("n").cast("long")
        own = staged(self._sorted(batch.select("suffix", n.alias("n"), n.alias("new"))), "array", f"{self.folder}/array-{name}")
        side = lambda rows, new: rows.select("suffix", "n", F.col("n").alias("new") if new else F.lit(0).cast("long").alias("new"))
        size = 1
        while size in levels:
            size *= 2
        merged = {k: path for k, path in levels.items() if k < size}
        found = [staged(self._matches(self._sorted(side(own, True), side(self._read(path), False))), "matches") for k, path in levels.items() if k > size]
        level = f"{self.folder}/level-{size}-{name}"
        if merged:
            # The merge of the equal-sized levels is their scan.
            staged(self._sorted(side(own, True), *[side(self._read(path), False) for path in merged.values()]), "level", level)
        files, array = file_system(self.spark, f"{self.folder}/array-{name}")
        if merged:
            for path in [*merged.values(), f"{self.folder}/array-{name}"]:
                files.delete(file_system(self.spark, path)[1], True)
        else:
            files.rename(array, file_system(self.spark, level)[1])
        found.append(staged(self._matches(self._read(level)), "matches"))
        return reduce(DataFrame.union, found).distinct()


def few_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose number is in ``wanted`` (row), and a few others: a bitmap of fixed size holds the rest back."""
    digest = F.xxhash64("row")
    slot, bit = F.pmod(digest, F.lit(BITMAPS)), F.pmod(F.shiftrightunsigned(digest, 12), F.lit(BITS))
    maps = wanted.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("map"))
    # At most BITMAPS rows of 4 KB, whatever the corpus: safe to broadcast.
    marked = rows.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(maps), "slot", "left")
    octet = F.conv(F.hex(F.substring("map", F.expr("cast(bit div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("long")
    return marked.withColumn("near", F.coalesce(F.getbit(octet, F.pmod("bit", F.lit(8)).cast("int")) == 1, F.lit(False))).drop("slot", "bit", "map")


def _digests_at(text: bytes, low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from low to high and the digests of ``length`` bytes from each."""
    raw = np.frombuffer(text, np.uint8)[low : high + length]
    coder = digests_for(len(raw))
    at = np.arange(high - low + 1)
    return at + low, coder.of(coder.sums(raw), at, length).view(np.int64)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each group of STEP neighbouring windows has in common. Groups lie at multiples of STEP from the anchor, so equal windows are in equal groups."""
    for batch in sliced(batches):
        out: list[list] = [[], [], [], [], [], []]
        for row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "wanted"))):
            for item in wanted:
                first_group, last_group = (item["at"] - item["high"]) // STEP, (item["at"] - item["low"]) // STEP
                groups = np.arange(last_group, first_group - 1, -1)
                ends = item["at"] - groups * STEP  # windows that start in (end - STEP, end]
                raw = np.frombuffer(text, np.uint8)[ends[0] : ends[-1] + MATCH - STEP + 1]
                coder = digests_for(len(raw))
                found = coder.of(coder.sums(raw), ends - ends[0], MATCH - STEP + 1).view(np.int64) ^ groups
                lows, highs = np.maximum(item["low"], ends - STEP + 1), np.minimum(item["high"], ends)
                for column, values in zip(out, (found.tolist(), [item["context"]] * len(groups), [row] * len(groups), [item["first"]] * len(groups), lows.tolist(), highs.tolist())):
                    column.extend(values)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["core", "context", "row", "first", "low", "high"])


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        digests, contexts, shifts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            for item in wanted:
                at, found = _digests_at(text, item["low"], item["high"], MATCH)
                digests.append(found)
                contexts.append(np.full(len(found), item["context"]))
                shifts.append((at - item["first"]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (digests, contexts, shifts)], names=["digest", "context", "shift"])


def texts_with(texts: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(row, text, wanted) of the rows that something is wanted of, their wishes as a list."""
    lists = staged(wanted.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "wanted")
    return few_rows(texts, lists).filter("near").select("row", "text").join(lists, "row")


def shared_between(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that two contexts or more have."""
    return rows.groupBy(key).agg(F.min("context").alias("a"), F.max("context").alias("b")).filter("a <> b").select(key)


def batches_for(texts: DataFrame) -> int:
    """Batches of the family for these texts."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return max(LEAST_BATCHES, min(MOST_BATCHES, -(-size // BATCH_BYTES)))


def find_matches(texts: DataFrame, batches: int | None = None, family: SuffixFamily | None = None) -> tuple[DataFrame, DataFrame]:
    """(anchors, grams that two suffixes begin with) of texts (row, text), inserted into the family batch by batch."""
    spark = texts.sparkSession
    batches = batches or batches_for(texts)
    dealt = texts.select("row", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"), "text")
    anchors = staged(dealt.mapInArrow(_anchors, ANCHORS), "anchors")
    kept = family or SuffixFamily(spark)
    found = [kept.insert(anchors.filter((F.col("batch") == k) & F.col("suffix").isNotNull()).select("suffix", "n")) for k in range(batches)]
    matches = staged(reduce(DataFrame.union, found).distinct(), "matches")
    if family is None:  # nobody will insert into it again
        files, place = file_system(spark, kept.folder)
        files.delete(place, True)
    return anchors, matches


def repeated_starts(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(row, low, high): runs of places in a document where a repeated string of MATCH bytes starts. ``shared`` has the anchors whose gram is in several places."""
    contexts = staged(shared.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("row", "at", "first", "last", "ahead", "behind"), "row").alias("one")), "contexts")
    ones = contexts.select("context", "one.*")

    def both(side: str) -> DataFrame:
        present = ones.filter(F.col(side).isNotNull())
        return present.join(staged(shared_between(present, side), "halves"), side)

    # A window reaches HALF bytes or more to one side of its anchor: that half must be shared.
    low_half = both("behind").select("row", "context", "at", "first", F.col("first").alias("low"), F.least("last", F.col("at") - HALF).alias("high"))
    high_half = both("ahead").select("row", "context", "at", "first", F.greatest("first", F.col("at") - HALF + 1).alias("low"), F.col("last").alias("high")).filter("low <= high")
    halves = texts_with(texts, low_half.union(high_half), "context", "at", "first", "low", "high")
    cores = staged(halves.mapInArrow(_cores, "core long, context long, row long, first int, low int, high int"), "cores")
    # Written, so that a core that many contexts have can be split in the join.
    live = cores.join(staged(shared_between(cores, "core"), "live"), "core", "left_semi")
    fine = staged(texts_with(texts, live, "context", "first", "low", "high").mapInArrow(_window_digests, "digest long, context long, shift int"), "windows")
    drop_staged(texts.sparkSession, cores)
    again = fine.join(staged(shared_between(fine, "digest"), "again"), "digest", "left_semi").select("context", "shift").distinct()
    runs = again.withColumn("run", F.col("shift") - F.row_number().over(Window.partitionBy("context").orderBy("shift"))).groupBy("context", "run").agg(F.min("shift").alias("from"), F.max("shift").alias("to"))
    whole = contexts.filter("n > 1").select("context", F.lit(0).alias("from"), (F.col("one.last") - F.col("one.first")).alias("to"))
    spans = staged(whole.union(runs.select("context", "from", "to")), "spans")
    drop_staged(texts.sparkSession, fine)
    every = shared.select("row", "first", "context").join(spans, "context")
    return every.select("row", (F.col("first") + F.col("from")).alias("low"), (F.col("first") + F.col("to")).alias("high"))


def _passage_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of PASSAGE bytes around the wanted grams of each text, each with the number of its places."""
    for batch in sliced(batches):
        owners, digests, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "wanted"))):
            own = np.array([w["gram"] for w in wanted], np.int64)
            windows = [np.zeros(0, np.uint64)]
            for _, raw, begins, _, short, _ in stretches([text]):
                coder, sums, grams, ranked = hashed(raw)
                _, at, first, last = sampled(ranked, begins, short, PASSAGE)
                live = np.isin(grams[at].view(np.int64), own)
                first, sizes = first[live], (last - first + 1)[live]
                starts = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                windows.append(coder.of(sums, starts, PASSAGE))
            values, times = np.unique(np.concatenate(windows), return_counts=True)
            owners.append(np.full(len(values), row))
            digests.append(values)
            counts.append(times)
        columns = [np.concatenate(owners), np.concatenate(digests).view(np.int64), np.concatenate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "digest", "n"])


def passage_rows(texts: DataFrame, shared: DataFrame, starts: DataFrame) -> DataFrame:
    """(row): documents without removed bytes that hold a string of PASSAGE bytes which also starts elsewhere."""
    suspects = shared.select("row", "gram").join(starts.select("row"), "row", "left_anti")
    hot = staged(suspects.select("gram").distinct(), "hot")
    holders = staged(shared.join(hot, "gram", "left_semi").select("row", "gram").distinct(), "holders")
    found = staged(texts_with(texts, holders, "gram").mapInArrow(_passage_digests, "row long, digest long, n long"), "passages")
    twice = staged(found.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest"), "twice")
    return found.join(twice, "digest", "left_semi").select("row").distinct().join(starts.select("row"), "row", "left_anti")


def covered(size: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which bytes lie in a string of MATCH bytes that starts in one of the runs [low, high]."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, lows, 1)
    np.add.at(edges, highs + MATCH, -1)
    return np.cumsum(edges[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "has_passage": pa.bool_()}
    for batch in sliced(batches):
        out = []
        for doc, text, runs, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs", "passage"))):
            if not runs:
                out.append((doc, len(text), 0, 0, text, passage))
                continue
            gone = covered(len(text), np.array([r["low"] for r in runs]), np.array([r["high"] for r in runs]))
            spans = int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum())
            out.append((doc, len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes(), True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types)) if out else pa.RecordBatch.from_pylist([], schema=pa.schema(types))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batches: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, has_passage): each text's bytes without those in long repeated strings, and whether it holds a passage of PASSAGE bytes that also starts elsewhere."""
    spark = docs.sparkSession
    texts = numbered_bytes(docs, id_column, text_column)
    anchors, grams = find_matches(texts, batches)
    shared = staged(anchors.select("row", "gram", "at", "first", "last", "context", "ahead", "behind").join(grams, "gram", "left_semi"), "shared")
    drop_staged(spark, anchors, grams)
    runs = repeated_starts(texts, shared.filter("context is not null"))
    starts = staged(runs.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "starts")
    passages = passage_rows(texts, shared, starts).select("row", F.lit(None).cast("array<struct<low:int,high:int>>").alias("runs"))
    known = staged(starts.select("row", "runs").union(passages), "known")
    rows = docs.select(row_key(id_column, text_column).alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"))
    marked = few_rows(rows, known)
    clean = marked.filter("not near").select("doc_id", "text", F.lit(None).cast("array<struct<low:int,high:int>>").alias("runs"), F.lit(False).alias("passage"))
    struck = marked.filter("near").join(known.withColumn("passage", F.lit(True)), "row", "left").select("doc_id", "text", "runs", F.coalesce("passage", F.lit(False)).alias("passage"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, has_passage boolean"
    return clean.mapInArrow(_removed, out).unionByName(struck.mapInArrow(_removed, out))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "has_passage")
