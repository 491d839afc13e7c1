"""Every operator against a plain version of itself on a small corpus with copies, edits, junk and shared passages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import chat, decontamination, language, licenses, line_dedup, packing, quality, simhash, suffix_dedup, token_counts
from tidemark.llm.components import connected_components

SYLLABLES = {"en": "the and ing tion er ou sh th an re in at".split(), "fr": "é è ou ai tre que eau ç ment ch les ê".split(), "de": "ung sch ü ä ein ver keit lich ß ge zu ö".split()}
BLANK = "[^\\x20\\x09-\\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    rng = random.Random(7)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5)))
    prose = lambda lang, n: " ".join(word(lang) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    items = [(k, prose("en", 8 if k == 3 else 40)) for k in range(6)] + [(9, None)]
    shared, docs = prose("en", 120), []
    for k in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = prose(lang, rng.choice([3, 15, 60, 200, 500]))
        if k % 9 == 1 and docs:
            text = docs[-1][1]
        elif k % 9 == 2 and docs:
            words = docs[-1][1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word(lang)
            text = " ".join(words)
        elif k % 9 == 4:
            text = f"{text} {shared} {prose(lang, 20)}"
        elif k % 9 == 5:
            text = f"{text} {rng.choice(items[:6])[1].upper()} {text[:40]}"
        elif k % 9 == 7:
            text = f"{text}\nReleased under the MIT license\n#*$ <|endoftext|> {text}"
        docs.append((k, text, lang, f"s{k % 3}"))
    docs += [(900, None, "en", None), (901, "", None, "s0"), (902, "1234 ?!", None, "s0"), (903, "Copyright 2020 Me\n" + licenses.KNOWN[0][1].upper(), "en", "s1"), (904, "  a  b   c 　d\n \n\te  ", "en", "s1")]
    return docs, items


DOCS, ITEMS = corpus()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs_of(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def union_find(n, pairs):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(0, k) for k in range(200, 260)] + [(k, k + 1) for k in range(400, 440)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = union_find(500, pairs)
    assert got == {k: roots[k] for k in got} and set(got) == {x for p in pairs if p[0] != p[1] for x in p}


def line_truth():
    spots, texts = [], {}
    for i, text, *_ in sorted(DOCS, key=lambda d: d[0]):
        for place, line in enumerate((text or "").split("\n")):
            key = line.lower().strip(" ")
            if key.strip():
                spots.append((i, place, key))
                texts.setdefault(key, len(texts))
    keys = list(texts)
    sets = [{k[j : j + 8] for j in range(max(1, len(k) - 7))} for k in keys]
    by = {}
    for n, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(n)
    pairs = []
    for n, s in enumerate(sets):
        for m, c in Counter(m for g in s for m in by[g] if m > n).items():
            if c / (len(s) + len(sets[m]) - c) >= 0.8:
                pairs.append((n, m))
    roots, first = union_find(len(keys), pairs), {}
    for i, place, key in spots:
        first.setdefault(roots[texts[key]], (i, place))
    return {(i, place) for i, place, key in spots if first[roots[texts[key]]] != (i, place)}, len(pairs)


def test_line_dedup(spark, tables):
    got = {(r.doc_id, int(p)) for r in line_dedup.op1_line_dedup(spark, tables).collect() for p in r.removed_lines.split(",") if p}
    want, pairs = line_truth()
    assert pairs > 20 and got <= want and len(got) >= 0.98 * len(want)


def test_line_stage_drops_those_lines(spark, tables):
    docs = docs_of(spark, tables)
    gone = {}
    for r in line_dedup.op1_line_dedup(spark, tables).collect():
        gone[r.doc_id] = {int(p) for p in r.removed_lines.split(",") if p}
    want = {}
    for i, text, *_ in DOCS:
        left = None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[i])
        if not gone[i] or left.strip(" \t\n\x0b\x0c\r"):
            want[i] = left
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(spark, docs, tables).collect()} == want


@pytest.mark.parametrize(("name", "sql"), [("op2_quality_rules", quality.SQL), ("op10_license_scan", licenses.SQL)])
def test_sql(spark, tables, name, sql):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    from tidemark.llm.catalogue import QUERIES

    rows = QUERIES[name](spark, tables)
    found = base.execute(f"SELECT {', '.join(rows.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, found))


def test_quality_counts(spark, tables):
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, tables).collect()}
    for i, text, *_ in DOCS:
        words = re.findall(BLANK, text or "")
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [line for line in (text or "").split("\n") if re.search(BLANK, line)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r.kept and r.base_failed)


def test_known_licences(spark, tables):
    got = {r.doc_id: r for r in licenses.op10_license_scan(spark, tables).collect()}
    assert got[903].license_id == "MIT" and got[900].license_id is None
    assert {i for i, r in got.items() if r.notice_ids == "MIT"} == {i for i, t, *_ in DOCS if "Released under the MIT license" in (t or "")}


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.fresh(["a", "b", "c"], rng, 3)
    net.table, net.state = [x.astype(float) for x in net.table], [x.astype(float) for x in net.state]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    lanes, target, weight = rng.integers(0, 256, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4), np.ones((6, 4))
    weight[4:, 1] = 0
    _, found = language.gradients(net, lanes, target, weight)
    for p, g in zip(net.parameters(), found):
        for _ in range(8):
            at = tuple(int(rng.integers(0, n)) for n in p.shape)
            at = (at[0], int(rng.choice(lanes.ravel()))) if p.shape[1] == 256 else at
            was, e = p[at], 1e-4
            p[at] = was + e
            high = language.gradients(net, lanes, target, weight)[0]
            p[at] = was - e
            low = language.gradients(net, lanes, target, weight)[0]
            p[at] = was
            assert abs((high - low) / (2 * e) - g[at]) < 1e-5


def test_language_on_held_out_documents(spark, tables):
    truth = {i: (t, lang) for i, t, lang, _ in DOCS}
    rows = language.op3_language_id(spark, tables).collect()
    held = [r for r in rows if r.held_out and truth[r.doc_id][1]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good = [r.lang_pred == truth[r.doc_id][1] for r in held if r.doc_id < 900 and r.doc_id % 9 in (0, 3, 6, 8) and len(truth[r.doc_id][0]) > 60]
    assert sum(good) >= 0.9 * len(good) and len(good) > 8
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {i for i, (t, _) in truth.items() if not any(map(str.isalpha, t or ""))}
    assert all(0 <= r.score <= 1 for r in rows)


def contamination():
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    windows = {}
    for i, text in ITEMS:
        words = word.findall(lower(text))
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(str(i))
    out = {}
    for i, text, *_ in DOCS:
        words, hit, items = word.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    items |= own
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out[i] = (len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize(("tokens", "windows"), [(400_000, 100_000), (700, 20)])
def test_decontamination(spark, tables, monkeypatch, tokens, windows):
    monkeypatch.setattr(decontamination, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(decontamination, "WINDOWS", windows)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.op4_decontamination(spark, tables).collect()}
    want = contamination()
    assert got == want and sum(x[4] for x in want.values()) > 10


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two gap three four y"), (2, "one two three four"), (3, "four three two one gone")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    index = decontamination.build_index(docs)
    for slop, near in ((0, {}), (1, {1: [(1, 3), (4, 6)], 2: [(0, 4)]})):
        rows = {r.doc_id: r for r in decontamination.find_passages(index, item, slop).collect()}
        assert {i for i, r in rows.items() if r["items"]} == {2} and [tuple(s) for s in rows[2].spans] == [(0, 4)]
        assert {i: [tuple(s) for s in r.near_spans] for i, r in rows.items() if r.near_items} == near


def near_truth(words, phrase, slop):
    """Positions of the words of all phrases whose terms stand in order near their places, by trying all starts."""
    out = set()
    for start in range(-slop, len(words) + slop):
        at, before = [], -1
        for k, term in enumerate(phrase):
            here = next((p for p in range(max(before + 1, start + k - slop), min(len(words), start + k + slop + 1)) if words[p] == term), None)
            if here is None:
                break
            at.append(here)
            before = here
        else:
            out.update(at)
    return out


def test_proximity_by_brute_force(spark):
    rng = random.Random(12)
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    phrases = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))) for k in range(8)]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.doc_id: r for r in decontamination.find_passages(index, spark.createDataFrame(phrases, "item_id long, text string"), 2).collect()}
    for k, text in docs:
        words = text.split()
        near = {str(i): near_truth(words, p.split(), 2) for i, p in phrases}
        assert rows[k].near_items == sorted(i for i, at in near.items() if at)
        assert {p for a, b in rows[k].near_spans for p in range(a, b)} == set().union(*near.values())


def test_token_counts(spark, tables):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op5_token_counts(spark, tables).collect()}
    for i, text, *_ in DOCS:
        n = len(coder.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 2048)


ODD_TEXTS = ["Hello'S world's  <|endoftext|>END\x1cx 12ab é İstanbul ﬁ 日本 😀👍🏽", "", "  a  b ", "don't 'tis o''re x'll!'s '", "cafe\u0301 A\u030angĝ\u0323 \u1112\u1161\u11ab", "!!<|endoftext|>'s <|startoftext|><|endoftext|>a<|endof", "か\u3099" * 40 + " \u3099か", "a\u0323\u0301b" * 30, "x" * 300, "İİ'ſ ǅ ß ẞ", "a​b c　d e\x85f\x0bg"]


def test_every_prefix_has_its_count():
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counter = token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda text: len(coder.encode(text, add_special_tokens=False).ids)
    rng = random.Random(3)
    pieces = ["a", "e", "\u0301", "\u0323", "\u3099", "か", " ", "'", "s", "<|endoftext|>", "<|", "É", "\n", "1", "😀", "\u1100", "\u1161", "\u11a8", "ſ", "İ"]
    odd = ODD_TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for text in [*odd, *[t for _, t, *_ in DOCS[:20]]]:
        want = [count(text[:k]) for k in range(len(text) + 1)]
        stored = token_counts.stored(counter.changes(text))
        assert token_counts.running(stored).tolist() == want
        for budget in (0, 1, 2, 5, 40):
            assert token_counts.longest_prefix(stored, budget) == max(k for k, n in enumerate(want) if n <= budget)
        for budget in (1, 7):
            ends = token_counts.pieces_within(stored, budget)
            assert [0, *ends] == sorted({0, *ends}) and (ends[-1] if ends else 0) == len(text)
            assert all(want[b] - want[a] <= budget or b == a + 1 for a, b in zip([0, *ends], ends))


def test_wide_changes():
    changes = np.array([300, -200, 5], np.int32)
    assert token_counts.running(token_counts.stored(changes)).tolist() == [0, 300, 100, 105]


def test_budgets_encode_nothing(spark, tables, monkeypatch):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counted = token_counts.token_prefix_counts(docs_of(spark, tables), carry=("text",))
    counted.write.parquet(f"{tables}/counted")
    monkeypatch.setattr(token_counts, "PrefixCounter", None)  # from here on nothing can be encoded
    kept = token_counts.within_budget(spark.read.parquet(f"{tables}/counted"), 12).collect()
    assert len(kept) == len(DOCS)
    for r in kept:
        text = r.text or ""
        fits = [k for k in range(min(len(text), 200) + 1) if len(coder.encode(text[:k], add_special_tokens=False).ids) <= 12]
        assert r.kept_chars >= fits[-1] and len(coder.encode(text[: r.kept_chars], add_special_tokens=False).ids) <= 12
        assert r.n_tokens == len(coder.encode(text, add_special_tokens=False).ids)


def test_memory_of_chunks_is_bounded():
    kept = token_counts.Remembered(10_000)
    for k in range(2_000):
        assert kept.get("x" * (k % 50) + str(k), len) == k % 50 + len(str(k))
    assert kept.size <= 10_000 and len(kept.new) + len(kept.old) < 120


def test_chat_round_trip(spark):
    rng = random.Random(5)
    pick = lambda: "".join(rng.choice(["<turn>", "</turn>", "\\", "\n", "word ", "é"]) for _ in range(rng.randrange(0, 60)))
    turns = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], None if c % 7 == 3 and t == 1 else pick()) for c in range(30) for t in range(rng.randrange(1, 12))]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(rows, budget=120, history=40)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        whole, loss = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in own), "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        parts = list(chat.parsed(w.formatted))
        if w.window and w.conv_id % 2:
            assert parts[0][0] == "system"
        assert w.n_tokens <= 120 or len(parts) - w.first_new == 1


def plain_windows(turns, count, budget, history):
    """Turn numbers of each window: (system or none, repeated, new), filled one turn at a time."""
    sizes, out, new = [count(t) for t in turns], [], []
    system = bool(turns) and turns[0][0] == "system"

    def before(first):
        """The longest run of turns before ``first`` within the history, the system turn aside."""
        k, total = first, 0
        while k > (1 if system else 0) and total + sizes[k - 1] <= history:
            k -= 1
            total += sizes[k]
        return list(range(k, first))

    def closed():
        first = new[0]
        head = [0] if system and first > 0 else []
        again = before(first)
        if sum(sizes[k] for k in head + again + new) > budget:
            again = []
        out.append((head, again, list(new)))

    for k in range(len(turns)):
        if new:
            fixed = sum(sizes[j] for j in ([0] if system and new[0] > 0 else []) + before(new[0]))
            if fixed + sum(sizes[j] for j in new) + sizes[k] > budget:
                closed()
                new = []
        new.append(k)
    if new:
        closed()
    return out


def test_chat_windows_are_those_of_a_plain_version(spark):
    rng = random.Random(21)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    convs = {}
    for c in range(40):
        turns = [("system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(rng.choice(["alpha", "<turn>", "beta", "\\", "gamma"]) for _ in range(rng.randrange(0, 45)))) for t in range(rng.randrange(1, 14))]
        convs[c] = turns
    rows = spark.createDataFrame([(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {}
    for w in chat.format_conversations(rows, budget=130, history=45).collect():
        got.setdefault(w.conv_id, {})[w.window] = w
    count = lambda turn: len(coder.encode(chat.rendered(*turn)[0], add_special_tokens=False).ids)
    for c, turns in convs.items():
        want = plain_windows(turns, count, 130, 45)
        assert sorted(got[c]) == list(range(len(want)))
        for k, (head, again, new) in enumerate(want):
            w = got[c][k]
            assert w.formatted == "".join(chat.rendered(*turns[j])[0] for j in head + again + new)
            assert w.first_new == len(head + again) and w.n_tokens == sum(count(turns[j]) for j in head + again + new)


def test_chat_query(spark, tmp_path):
    rng = random.Random(22)
    turns = [(c, t, ["system", "user", "assistant"][rng.randrange(3)], None if rng.random() < 0.1 else "word " * rng.randrange(0, 900) + "<turn>\\") for c in range(12) for t in range(rng.randrange(1, 9))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    probe = r"\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    got = {r.conv_id: r for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for c in {t[0] for t in turns}:
        own = sorted(t for t in ((t[1], t[2], t[3] or "") for t in turns if t[0] == c))
        whole, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha(whole), len(loss), sha(loss))
        assert r.formatted_chars >= len(whole)
    assert len(got) == 13 and got[-7].loss_chars == len(probe)


def test_packing(spark, tables):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in DOCS}
    pieces, bins = {}, {}
    for r in packing.op7_pack_sequences(spark, tables).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, total in [(p, len(ids[i])) for i, p in pieces.items()] + [(b, None) for b in bins.values()]:
        end = 0
        for start, length in sorted(found):
            assert start == end
            end += length
        assert end == total if total else end <= 1024
    assert set(pieces) == set(ids) and sum(map(len, ids.values())) >= 0.9 * 1024 * (len(bins) - 1)


def test_tournament_tree_is_first_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        bins, offsets, used = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
            if at is None:
                at = len(room)
                room.append(100)
            want[k] = (at, 100 - room[at])
            room[at] -= sizes[k]
        assert used == len(room) and all(want[k] == (bins[k], offsets[k]) for k in want)


def repeats(docs, size):
    seen = Counter(t[p : p + size] for _, t in docs for p in range(len(t) - size + 1))
    out = {}
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def suffix_result(rows):
    found = rows.collect()
    assert len(found) == len({r.doc_id for r in found})
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


def test_suffix_dedup(spark, tables):
    want = repeats([(i, (t or "").encode()) for i, t, *_ in DOCS], 400)
    assert suffix_result(suffix_dedup.op8_suffix_dedup(spark, tables)) == want and sum(x[1] > 0 for x in want.values()) > 20


def test_suffix_dedup_on_hard_texts(spark, tmp_path):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc ") for _ in range(2500)) for _ in range(3)]
    docs = []
    for i in range(40):
        text = list(rng.choice(base)[rng.randrange(0, 600) :][: rng.randrange(300, 1900)])
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "yz"])
        text = "".join(text)
        docs.append((i, text + text[: rng.randrange(0, 700)] if rng.random() < 0.3 else text))
    docs += [(100, "a" * 900), (101, "ab" * 500), (102, ""), (103, "z" * 399), (104, "q" * 401), (105, "w" * 400), (106, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert suffix_result(suffix_dedup.op8_suffix_dedup(spark, str(tmp_path))) == repeats([(i, (t or "").encode()) for i, t in docs], 400)


def plain_fingerprint(text):
    words = re.findall(BLANK, lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def near(prints):
    return [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3]


def test_simhash(spark, tables):
    prints = [plain_fingerprint(t) for _, t, *_ in DOCS]
    roots = union_find(len(DOCS), near(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, tables).collect()}
    assert got == {DOCS[k][0]: (f"{prints[k]:016x}", DOCS[roots[k]][0]) for k in range(len(DOCS))}
    assert len(set(roots)) < len(roots) - 20


@pytest.mark.parametrize("tile", [4096, 6])
def test_close_fingerprints(spark, tile):
    rng = random.Random(1)
    prints = set()
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(20):
            value = centre
            for _ in range(rng.randrange(0, 5)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile)
    got = {r.node: r.component for r in connected_components(links).collect()}
    roots = union_find(len(signed), near([v & (1 << 64) - 1 for v in signed]))
    assert all(got.get(v, v) == signed[r] for v, r in zip(signed, roots))


def test_pigeonhole_masks_cover_three_flips():
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks()]
    rng = random.Random(8)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flips == 0 for m in masks)
    assert len(masks) == math.comb(6, 3)


def test_pipeline_equals_plain_stages(spark, tables):
    docs = docs_of(spark, tables)
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, tables).collect()
        docs = spark.createDataFrame(rows, docs.schema).coalesce(1)
        steps.append({r.doc_id: r.text for r in rows})
    lettered = {i for i, t, *_ in DOCS if any(map(str.isalpha, t or ""))}
    assert set(steps[0]) <= lettered and len(steps[0]) >= 0.97 * len(lettered)
    after = steps[1]
    ids = sorted(after)
    roots = union_find(len(ids), near([plain_fingerprint(after[i]) for i in ids]))
    assert set(steps[2]) == {ids[r] for r in roots}
    marked = {i for i, x in contamination_of(steps[2]).items() if x}
    assert set(steps[3]) == set(steps[2]) - marked
    packed = corpus_pipeline.run(spark, tables).select("doc_id").distinct()
    assert {r.doc_id for r in packed.collect()} == set(steps[3])


def contamination_of(texts):
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    windows = set()
    for _, text in ITEMS:
        words = word.findall(lower(text))
        windows |= {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12) if words else 0)}
    out = {}
    for i, text in texts.items():
        words = word.findall(lower(text))
        hit = {p for n in {len(w) for w in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for p in range(k, k + n)}
        out[i] = bool(hit) and 20 * len(hit) >= len(words)
    return out
