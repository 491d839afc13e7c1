"""Exact token counts of every prefix by dynamic programming over BPE.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token whose pair with the
token before it is what the merges would give. So for each end position the last token and the
count follow from shorter prefixes: ``count[i] = count[i - len(last)] + 1``. Words are independent
under the pre-tokenizer, so the recurrence runs once per distinct chunk of a worker.

A document keeps one number for each of its characters: by how much the count of tokens changes when
the prefix grows by that character, in a byte (four, if one document needs more). Running sums are the
exact counts of all prefixes, so "how many tokens has this prefix" and "where does the budget end" are
answered from what is stored and nothing is encoded again. A count may fall as a prefix grows, when a
word becomes a token.

Defined cases: a null text is an empty one; special strings inside a text count as one token each,
as the library does by default, and their own prefixes are ordinary text; repeated rows repeat; of
prefixes with equal counts the longest answers a budget; an empty table gives an empty result; other
columns are ignored, unless they are asked to be carried. Very long texts cost time and output in
proportion to their length, with or without white space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import load, sliced, worker_cache

LIMIT = 2048
#: Bytes of chunks that a worker remembers at most, about, in either of two generations; and pairs of tokens, and the longest word that is remembered.
REMEMBERED_BYTES = 128 << 20
REMEMBERED = 400_000
SHARED = 48
#: What an entry takes beside its text and counts.
ENTRY_BYTES = 200


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered:
    """A dictionary of bounded size: what is used stays, the rest goes with its generation."""

    def __init__(self, most: int = REMEMBERED_BYTES) -> None:
        self.new, self.old, self.size, self.most = {}, {}, 0, most

    def get(self, key: str, make: Callable[[str], object]) -> object:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = make(key)
            self.size += len(key) * 9 + ENTRY_BYTES
            if self.size > self.most:
                self.new, self.old, self.size = {}, self.new, len(key) * 9 + ENTRY_BYTES
            self.new[key] = found
        return found


def packed(counts: list[int]) -> bytes | np.ndarray:
    """Changes from count to count: a signed byte each, or numbers if one does not fit."""
    changes = list(map(sub, counts, [0, *counts]))
    if min(changes) < -128 or max(changes) > 127:
        return np.array(changes, np.int32)
    return bytes([x & 255 for x in changes])


def unpacked(changes: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(changes, np.int8).astype(np.int32) if type(changes) is bytes else changes


class Endings:
    """An Aho-Corasick automaton over the vocabulary: which tokens end at a place, longest first.

    Tokens are numbers. ``inner`` has the numbers of tokens by their text, ``closing`` of those that end a word by
    their text without the mark; both kinds are found by one state.
    """

    def __init__(self, inner: dict[str, int], closing: dict[str, int]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        texts, above = [""], [(0, "")]
        for token in inner.keys() | closing.keys():
            at = 0
            for k, symbol in enumerate(token):
                after = self.goto[at].get(symbol)
                if after is None:
                    after = self.goto[at][symbol] = len(texts)
                    self.goto.append({})
                    texts.append(token[: k + 1])
                    above.append((at, symbol))
                at = after
        self.fail = [0] * len(texts)
        self.found: list[tuple[list, list]] = [([], [])] * len(texts)
        for node in sorted(range(1, len(texts)), key=lambda n: len(texts[n])):
            parent, symbol = above[node]
            if parent:
                self.fail[node] = self.step(self.fail[parent], symbol)
            # What ends in a shorter ending of the same text ends here too.
            ends, text = self.found[self.fail[node]], texts[node]
            own = [[(kind[text], len(text))] if text in kind else [] for kind in (inner, closing)]
            self.found[node] = (own[0] + ends[0], own[1] + ends[1]) if own[0] or own[1] else ends

    def step(self, state: int, symbol: str) -> int:
        """The state after one more symbol: the longest beginning of a token that the text now ends with."""
        while True:
            after = self.goto[state].get(symbol)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fail[state]


#: Bits of a token's number in the key of a pair.
TOKEN_BITS = 20
#: The states of a text's prefixes: last token, tokens, tokens of the prefix as a whole word.
States = tuple[list[int], list[int], list[int]]


class PrefixCounter:
    """Counts tokens of prefixes for one tokenizers file with word-end symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        #: Tokens that end a word, by their text without the mark.
        self.closing = {t.removesuffix(self.end): t for t in self.vocab if t.endswith(self.end)}
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), k in self.ranks.items():
            self.made.setdefault(a + b, (k, a, b))
        self.symbols = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)))
        self.hint = min(self.special, key=len)[:2]
        # The normaliser's white space; str.split() alone would also cut at four control characters.
        self.space = regex.compile(r"\s+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        #: Tokens by number; none is the empty text.
        self.tokens = ["", *sorted(self.vocab)]
        number = {t: k for k, t in enumerate(self.tokens) if t}
        self.endings = Endings(number, {text: number[t] for text, t in self.closing.items() if text})
        self.fits: dict[int, bool] = {}
        self.chunk_known, self.word_known = Remembered(), Remembered(REMEMBERED_BYTES // 2)
        self.joining: frozenset[str] | None = None

    def merged(self, first: str, second: str) -> list[str]:
        """The tokens that the merges make of the two tokens' symbols."""
        text = first + second
        parts = list(text.removesuffix(self.end))
        if text.endswith(self.end):
            parts[-1] += self.end
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def follows(self, pair: int) -> bool:
        """Whether the merges leave the second token of a pair apart from the first; from none, whether they make it at all."""
        first, second = self.tokens[pair >> TOKEN_BITS], self.tokens[pair & ((1 << TOKEN_BITS) - 1)]
        if len(self.fits) > REMEMBERED:
            self.fits.clear()  # no more than the work of finding them again
        found = self.fits[pair] = self.apart(first, second) if first else self.merged("", second) == [second]
        return found

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses from one token into the other.

        The merges that made the two tokens are undone, latest first; a crossing merge would have
        come first if it ranks before the merge undone last, with ties going to the left.
        """
        made, ranks = self.made, self.ranks
        before_left = before_right = 1 << 60
        while True:
            crossing = ranks.get((left, right))
            if crossing is not None and crossing < before_left and crossing <= before_right:
                return False
            l, r = made.get(left), made.get(right)
            if l is None and r is None:
                return True
            if r is None or (l is not None and l[0] > r[0]):
                before_left = l[0]
                left = l[2]
                before_right = min(before_right, l[0] - 1)
            else:
                before_right = r[0]
                right = r[1]
                before_left = min(before_left, r[0] + 1)

    def states(self, text: str, before: States | None = None, head: str = "") -> States:
        """The recurrence over a word, or over what follows ``head``, the last symbols of a word of the states ``before``.

        Of the tokens that end at a place, longest first, the one that the merges leave apart from the token
        before it is the last of the prefix.
        """
        last, counts, wholes = before or ([0], [0], [0])
        goto, found, known, at = self.endings.goto, self.endings.found, self.fits.get, 0
        add_last, add_count, add_whole = last.append, counts.append, wholes.append
        for symbol in head:
            at = self.endings.step(at, symbol)
        for symbol in text:
            after = goto[at].get(symbol)
            at = self.endings.step(at, symbol) if after is None else after
            inner, closing = found[at]
            for token, n in inner:
                pair = last[-n] << TOKEN_BITS | token
                ok = known(pair)
                if self.follows(pair) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends in {symbol!r}")
            for closed, m in closing:
                pair = last[-m] << TOKEN_BITS | closed
                ok = known(pair)
                if self.follows(pair) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends a word in {symbol!r}")
            whole = counts[-m] + 1
            add_count(counts[-n] + 1)
            add_last(token)
            add_whole(whole)
        return last, counts, wholes

    def symbol_text(self, word: str) -> str:
        """The word in the vocabulary's symbols, one for each byte."""
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.symbols[b] for b in word.encode()])

    def char_ends(self, word: str) -> list[int]:
        return list(accumulate(len(c.encode()) for c in word))

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ..., each taken as a whole word."""
        wholes = self.states(self.symbol_text(word))[2]
        return wholes[1:] if word.isascii() else [wholes[k] for k in self.char_ends(word)]

    def word_count(self, word: str) -> int:
        return self.states(self.symbol_text(word))[2][-1]

    def split(self, lower: str) -> list[str]:
        """Words of a normalised text without white space."""
        return [lower] if lower.isalpha() else self.words.findall(lower)

    def _word_changes(self, word: str) -> bytes | np.ndarray:
        """By how much the count changes with each character of a word."""
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():
            # A contraction is one word, but its prefixes are not.
            return packed([sum(map(self.word_count, self.split(word[: k + 1]))) for k in range(len(word))])
        return packed(self.word_prefixes(word))

    def _normal_changes(self, lower: str) -> bytes | np.ndarray:
        """The same for a normalised text: only the word that a prefix ends in can differ from the text's own, so words follow each other."""
        get, remember = self.word_known.new.get, self.word_known.get
        parts = [get(w) or remember(w, self._word_changes) if len(w) <= SHARED else self._word_changes(w) for w in self.split(lower)]
        if len(parts) == 1:
            return parts[0]
        if all(type(p) is bytes for p in parts):
            return b"".join(parts)
        return np.concatenate([unpacked(p) for p in parts])

    def _normal_prefixes(self, lower: str) -> list[int]:
        """Counts for each prefix of a normalised text."""
        return np.cumsum(unpacked(self._normal_changes(lower)), dtype=np.int64).tolist() if lower else []

    def _plain_prefixes(self, chunk: str) -> list[int]:
        """Counts for each prefix of a text without white space and special strings."""
        if chunk.isascii():
            return self._normal_prefixes(chunk.lower())
        if not unicodedata.is_normalized("NFC", chunk):
            return self._composing_prefixes(chunk)
        # Lower case by character, as the library does: no rule looks at a character's neighbours.
        parts = list(map(str.lower, chunk))
        counts = self._normal_prefixes("".join(parts))
        return counts if len(counts) == len(chunk) else [counts[k - 1] for k in np.cumsum([len(p) for p in parts]).tolist()]

    def joins(self, char: str) -> bool:
        """Whether a character may combine with what stands before it."""
        if self.joining is None:
            pairs = (unicodedata.decomposition(chr(k)).split() for k in range(0x110000))
            second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
            self.joining = frozenset(second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))
        return char in self.joining or unicodedata.combining(char) > 0

    def _composing_prefixes(self, chunk: str) -> list[int]:
        """As above where composing changes the text: a prefix may end before what its last characters combine with."""
        normal = lambda text: "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        starts = [k for k, c in enumerate(chunk) if not k or not self.joins(c)] + [len(chunk)]
        segments = [chunk[a:b] for a, b in zip(starts, starts[1:])]
        done = [normal(s) for s in segments]
        text = "".join(done)
        counts, words, at = self._normal_prefixes(text), [], 0
        for word in self.split(text):
            words.append((at, word))
            at += len(word)
        out, place, k = [], 0, 0
        kept: tuple[int, tuple] = (-1, ())
        for segment, whole in zip(segments, done):
            for size in range(1, len(segment) + 1):
                part = normal(segment[:size])
                if whole.startswith(part):
                    out.append(counts[place + len(part) - 1])
                    continue
                while k + 1 < len(words) and words[k + 1][0] < place:
                    k += 1
                begin, word = words[k] if place else (0, "")
                head = text[begin:place]
                pieces = self.split(head + part)
                total = counts[begin - 1] if begin else 0
                if pieces and len(pieces[0]) > self.longest and pieces[0].startswith(head) and head:
                    # A long run goes on from the states of its word, so the cost does not grow with it.
                    if kept[0] != k:
                        kept = (k, (self.symbol_text(word), self.char_ends(word), self.states(self.symbol_text(word))))
                    symbols, ends, held = kept[1]
                    end = ends[len(head) - 1]
                    low = max(0, end - 2 * self.longest)
                    near = tuple(x[low : end + 1] for x in held)
                    total += self.states(self.symbol_text(pieces[0][len(head) :]), near, symbols[low:end])[2][-1] + sum(map(self.word_count, pieces[1:]))
                else:
                    total += sum(map(self.word_count, pieces))
                out.append(total)
            place += len(whole)
        return out

    def prefixes(self, chunk: str) -> list[int]:
        """Tokens of chunk[:1], chunk[:2], ... of a text without white space."""
        if self.hint not in chunk:
            return self._plain_prefixes(chunk)
        out, base, k = [], 0, 0
        for found in self.special_split.finditer(chunk):
            # Until its last character is there, a special string is ordinary text after what stands before it.
            out += [base + x for x in self._plain_prefixes(chunk[k : found.end() - 1])]
            base = (out[found.start() - 1] if found.start() > k else base) + 1
            out.append(base)
            k = found.end()
        return out + [base + x for x in self._plain_prefixes(chunk[k:])] if k < len(chunk) else out

    def _changes(self, chunk: str) -> bytes | np.ndarray:
        """The same for a text without white space."""
        if self.hint not in chunk:
            if chunk.isascii():
                return self._normal_changes(chunk.lower())
            lower = "".join(map(str.lower, chunk))
            if len(lower) == len(chunk) and unicodedata.is_normalized("NFC", chunk):
                return self._normal_changes(lower)
        return packed(self.prefixes(chunk))

    def changes(self, text: str) -> np.ndarray:
        """For each character of a text, by how much it changes the number of tokens; white space does not."""
        odd = self.odd.search(text)
        chunks = [c for c in self.space.split(text) if c] if odd else text.split()
        known, get = self.chunk_known, self.chunk_known.new.get
        parts = [get(c) for c in chunks]
        if None in parts:
            parts = [known.get(c, self._changes) if p is None else p for c, p in zip(chunks, parts)]
        if all(type(p) is bytes for p in parts):
            joined = b"\0".join(parts)
            if len(joined) == len(text):
                return np.frombuffer(joined, np.int8)
        out, at = np.zeros(len(text), np.int32), 0
        for chunk, part in zip(chunks, parts):
            at = text.index(chunk, at)
            out[at : at + len(chunk)] = unpacked(part)
            at += len(chunk)
        small = out.astype(np.int8)
        return small if (small == out).all() else out


def stored(changes: np.ndarray) -> bytes:
    """The column's form: one signed byte a character after a zero, or four after a one."""
    return (b"\0" if changes.dtype == np.int8 else b"\1") + changes.tobytes()


def running(prefix_changes: bytes) -> np.ndarray:
    """Tokens of the prefixes of 0, 1, 2, ... characters."""
    changes = np.frombuffer(prefix_changes[1:], np.int8 if prefix_changes[:1] == b"\0" else np.int32)
    return np.concatenate(([0], np.cumsum(changes, dtype=np.int64)))


def _count(path: str, carry: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"prefix counter {path}", lambda: PrefixCounter(path))
        for batch in sliced(batches):
            changes = [counter.changes(text or "") for text in batch.column(0).to_pylist()]
            totals = pa.array([int(c.sum(dtype=np.int64)) for c in changes], pa.int64())
            prefixes = pa.array([stored(c) for c in changes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], totals, prefixes], names=["doc_id", "n_bytes", *carry, "n_tokens", "prefix_changes"])

    return count


def token_prefix_counts(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, carried columns, n_tokens, prefix_changes): the exact counts of all prefixes of each text, and the last of them."""
    carried = [docs.schema[c] for c in carry]
    rows = docs.select(F.col(text_column).alias("_text"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"), *carry)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), *carried, T.StructField("n_tokens", T.LongType()), T.StructField("prefix_changes", T.BinaryType())])
    return rows.mapInArrow(_count(path or public_tokenizers.path("word_bpe_49k.json"), list(carry)), schema)


def prefix_tokens(prefix_changes: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(running(prefix_changes)[chars])


def longest_prefix(prefix_changes: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(running(prefix_changes) <= budget)[-1]) if budget >= 0 else 0


def pieces_within(prefix_changes: bytes, budget: int) -> list[int]:
    """Ends of a text's pieces, cut so that the count grows by at most ``budget`` over each; a character that alone takes more is a piece."""
    sums, ends, at = running(prefix_changes), [], 0
    while at < len(sums) - 1:
        inside = np.flatnonzero(sums[at + 1 :] <= sums[at] + budget)
        at += int(inside[-1]) + 1 if len(inside) else 1
        ends.append(at)
    return ends


def _longest(budget: int):
    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            k = batch.schema.get_field_index("prefix_changes")
            ends = [longest_prefix(p, budget) for p in batch.column(k).to_pylist()]
            columns = [c for j, c in enumerate(batch.columns) if j != k]
            names = [n for j, n in enumerate(batch.schema.names) if j != k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.int64())], names=[*names, "kept_chars"])

    return longest


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """``counted`` (as ``token_prefix_counts`` gives it) with ``kept_chars`` in place of the counts: where each text ends under the budget. Nothing is encoded."""
    kept = [f for f in counted.schema.fields if f.name != "prefix_changes"]
    return counted.mapInArrow(_longest(budget), T.StructType([*kept, T.StructField("kept_chars", T.LongType())]))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefix_counts(load(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
