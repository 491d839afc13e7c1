"""Secret scans: known forms of credentials, and strings that look drawn at random.

Three base kinds are found by their form: assignments to a telling name, access keys, long runs of
hexadecimal digits. Beside them every candidate string, a maximal run of credential characters, is read
once for each character class by a sliding window. The window keeps a count for each character and the sum
of ``c * log2(c)`` over them; a step changes two counts, and the window's Shannon entropy follows from the
sum, ``log2(w) - sum / w``. The sum is kept in whole numbers, so it does not drift. Windows at or above the
class's entropy that also mix enough kinds of characters are united to spans. A span whose candidate is on
the allow-list, or which a span of an earlier class covers, is not added; base spans are never suppressed, and
a base span that also looks random is reported by both.

Each document is read in its own task by itself: nothing is shuffled, and a hot source or a group of copies
only makes more rows. Most documents are cleared by searches over whole Arrow columns and never become
Python strings.

Defined cases: a null or empty text has no span; repeated rows are scanned one by one; a text of any length
is read whole; an empty table gives an empty result; other columns stay as they are in ``scan``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, load, sliced

# The contract's base kinds, in its order, and their forms.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
#: The least lengths stand in the patterns: a run too short holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

LOWER, UPPER, DIGIT, SIGN = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+/_=-"
#: One part in a million of c * log2(c).
SCALE = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """An alphabet, the window read over its runs, the least entropy in bits a character, and how many of each kind of character a window must hold."""

    name: str
    alphabet: bytes
    window: int
    bits: float
    needs: tuple[tuple[bytes, int], ...]


#: Prose, slugs and identifiers stay below: words have few digits, and a window of 24 letters of prose about 3.6 bits.
CLASSES = (
    CharacterClass("entropy_hex", DIGIT + b"abcdefABCDEF", 24, 3.2, ((DIGIT, 4), (b"abcdefABCDEF", 4))),
    CharacterClass("entropy_lower", LOWER + DIGIT, 24, 3.6, ((DIGIT, 3), (LOWER, 3))),
    CharacterClass("entropy_mixed", LOWER + UPPER + DIGIT + SIGN, 24, 3.9, ((DIGIT, 2), (LOWER, 2), (UPPER, 2))),
)

#: Parts of a candidate that say that it is no secret, in lower case.
ALLOWED_PARTS = ("example", "placeholder", "0123456789", "1234567890", "abcdefghijklmnop", "changeme", "your_", "your-")
#: What stands right before a candidate that is a digest or an address.
ALLOWED_BEFORE = r"(?:sha(?:1|224|256|384|512)|md5|blake2b|blake3)[:=]$|(?:https?|ftp|s3|gs):(?://[^\s\"'<>]*)?$"
#: Whole candidates: version 1 to 5 identifiers; digests that name themselves (integrity values of lock files).
ALLOWED_WHOLE = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"


@dataclass(frozen=True)
class AllowList:
    parts: tuple[str, ...] = ALLOWED_PARTS
    before: str = ALLOWED_BEFORE
    whole: str = ALLOWED_WHOLE
    #: Characters before a candidate that ``before`` sees.
    reach: int = 256

    def allows(self, text: str, start: int, end: int) -> bool:
        candidate = text[start:end]
        low = candidate.lower()
        if any(p in low for p in self.parts) or re.fullmatch(self.whole, candidate):
            return True
        return re.search(self.before, text[max(0, start - self.reach) : start]) is not None


def hot_spans(codes: bytes, kind: CharacterClass) -> list[tuple[int, int]]:
    """Unions of the windows of a run of the class that reach its entropy and hold its kinds of characters."""
    w, n = kind.window, len(codes)
    if n < w:
        return []
    weight = [0] + [round(SCALE * c * math.log2(c)) for c in range(1, w + 1)]
    most = math.floor(SCALE * w * (math.log2(w) - kind.bits) + 1e-6)
    group = [-1] * 256
    for g, (members, _) in enumerate(kind.needs):
        for c in members:
            group[c] = g
    held, least = [0] * (len(kind.needs) + 1), [n for _, n in kind.needs]  # the last place counts characters of no group
    counts, total, spans = [0] * 256, 0, []
    for k in range(n):
        if k >= w:
            c = codes[k - w]
            total += weight[counts[c] - 1] - weight[counts[c]]
            counts[c] -= 1
            held[group[c]] -= 1
        c = codes[k]
        total += weight[counts[c] + 1] - weight[counts[c]]
        counts[c] += 1
        held[group[c]] += 1
        if k >= w - 1 and total <= most and all(h >= x for h, x in zip(held, least)):
            start, end = k - w + 1, k + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches: leftmost, not overlapping within a kind; a match with a short value is dropped, not searched again."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)


def entropy_spans(text: str, candidates: list[tuple[int, int]], classes: tuple[CharacterClass, ...], allow: AllowList) -> list[tuple[str, int, int]]:
    """Spans of high entropy in the given candidates, those of the allow-list left out."""
    found = []
    for start, end in candidates:
        codes = text[start:end].encode("ascii")
        hot = []
        for kind in classes:
            for run in re.finditer(b"[" + re.escape(kind.alphabet) + b"]{%d,}" % kind.window, codes):
                own = [(start + run.start() + a, start + run.start() + b) for a, b in hot_spans(run.group(), kind)]
                hot += [(kind.name, a, b) for a, b in own if not any(x <= a and b <= y for _, x, y in hot)]
        if hot and not allow.allows(text, start, end):
            found += hot
    return found


def all_spans(text: str, candidates: list[tuple[int, int]], classes: tuple[CharacterClass, ...], allow: AllowList) -> list[tuple[str, int, int]]:
    """Base spans, and of the others those that no span of an earlier class covers; by start, then by kind as listed."""
    found = base_spans(text) + entropy_spans(text, candidates, classes, allow)
    order = {name: k for k, name in enumerate((*BASE_KINDS, *[c.name for c in classes]))}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def candidate_runs(texts: pa.Array, least: int) -> dict[int, list[tuple[int, int]]]:
    """Row number: byte spans of its maximal runs of credential characters, at least ``least`` long, from the column's own buffer."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return {}
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    member = np.zeros(256, bool)
    member[list(LOWER + UPPER + DIGIT + SIGN)] = True
    # A run ends before each other character, at each row's end and at the end of all.
    stops = np.union1d(np.flatnonzero(~member[data]), offsets[1:] - offsets[0])
    starts = np.concatenate(([0], np.where(stops < len(data), ~member[data[np.minimum(stops, len(data) - 1)]], False)[:-1] + stops[:-1]))
    found: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(stops - starts >= least):
        row = int(np.searchsorted(offsets - offsets[0], starts[k], side="right")) - 1
        base = int(offsets[row] - offsets[0])
        found.setdefault(row, []).append((int(starts[k]) - base, int(stops[k]) - base))
    return found


def _characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of ASCII runs as spans of code points."""
    if text.isascii():
        return spans
    raw, at, seen, out = text.encode(), 0, 0, []
    for start, end in spans:
        seen += len(raw[at:start].decode())
        out.append((seen, seen + end - start))
        seen, at = seen + end - start, end
    return out


def _scan(classes: tuple[CharacterClass, ...], allow: AllowList, column: str, schema: pa.DataType, name: str):
    least = min(c.window for c in classes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], 4096):
                texts = part.column(column)
                runs = candidate_runs(texts, least)
                formed = pc.or_(pc.match_substring_regex(texts, r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"), pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{32}")))
                chosen = set(runs) | set(np.flatnonzero(pc.fill_null(formed, False).to_numpy(zero_copy_only=False)).tolist())
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in chosen:
                    text = texts[k].as_py()
                    rows[k] = [{"kind": kind, "start": a, "end": b} for kind, a, b in all_spans(text, _characters(text, runs.get(k, [])), classes, allow)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, schema)], names=[*part.schema.names, name])

    return scan


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: AllowList = AllowList(), text_column: str = "text", into: str = "findings") -> DataFrame:
    """All rows and columns of ``docs``, and their findings in order: an array of (kind, start, end), code points, end exclusive.

    A column that is called like the new one, in any case, is left out.
    """
    held = [c for c in docs.columns if c.lower() != into.lower()]
    kinds = "array<struct<kind:string,start:bigint,end:bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    # Numbered names, since a name with a dot in it cannot pass through ``mapInArrow``.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(held)])
    schema = rows.select("*", F.lit(None).cast(kinds).alias("found")).schema
    return rows.mapInArrow(_scan(classes, allow, f"c{held.index(text_column)}", arrow, "found"), schema).toDF(*held, into)


def redacted(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: AllowList = AllowList(), text_column: str = "text") -> DataFrame:
    """The documents with every found span, overlapping ones united, replaced by ``[kind]`` of the span that begins first."""
    found = free_name(docs.columns, "findings")
    rows = scan(docs, classes, allow, text_column, found)
    joined = F.aggregate(
        F.col(found),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(F.concat(s["out"], F.substring(F.col(text_column), s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))),
        lambda s: F.concat(s["out"], F.substring(F.col(text_column), s["at"].cast("int") + 1, 2147483647)),
    )
    return rows.withColumn(text_column, F.when(F.size(found) > 0, joined).otherwise(F.col(text_column))).select(*[F.col(f"`{c}`") for c in docs.columns])


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: numbers of base findings, digest of them, and all spans as text."""
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "findings")
    number = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[number(kind) for kind in BASE_KINDS], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"), F.size(F.filter("findings", lambda x: ~x["kind"].isin(*BASE_KINDS))).cast("long").alias("n_entropy"))
