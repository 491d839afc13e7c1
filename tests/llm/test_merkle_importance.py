"""Operators 12 and 13 against plain loops; places in an order."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, merkle
from tidemark.llm.ordering import numbered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Top, and for each leaf its siblings level by level."""
    proofs, owners, nodes = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), fanout):
            run, members = nodes[k : k + fanout], owners[k : k + fanout]
            for j, mine in enumerate(members):
                for leaf in mine:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            held.append([leaf for m in members for leaf in m])
        nodes, owners = up, held
    return nodes[0], proofs


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, fanout):
    leaf = lambda r, text: H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    sources = defaultdict(list)
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        shown = r["text"].replace("\n", "") if bad and r["text"] is not None else r["text"]
        sources["" if r["source"] is None else "=" + r["source"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, shown)))
    names = sorted(sources, key=str.encode)
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[name] = plain_tree([x[1] for x in sources[name]], fanout)
    root, upper = plain_tree([trees[n][0] for n in names], fanout)
    out = []
    for name, above in zip(names, upper):
        top, proofs = trees[name]
        for (doc, mine, shown), proof in zip(sources[name], proofs):
            path, node = proof + above, shown
            for a, b in path:
                node = H(a, node, b)
            out.append((doc, mine, top, root, H(*[a + b for a, b in path]), node, node == root))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, grp string, position int, digest string"


def documents(n, sources, seed=1):
    draw = random.Random(seed)
    rows = [{"doc_id": draw.choice([None, k, k, k, k // 2]), "source": draw.choice(sources), "lang": draw.choice([None, "en"]), "n_chars": draw.choice([None, k]), "text": draw.choice([None, "", f"a\nb{k}\né", f"plain {k}", "same"]), "grp": "x", "position": 1, "digest": None} for k in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "sources", "levels"), [(1, ["a"], 2), (9, ["a"], 2), (10, ["a"], 2), (400, ["a"], 2), (120, [None, "", "a", "é", "z" * 40], 1), (300, [f"s{k}" for k in range(60)], 2), (200, [None, "hot", "hot", "hot"], 8)])
def test_manifest_equals_a_plain_tree(spark, n, sources, levels):
    rows = documents(n, sources)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(3)
    got = merkle.manifest(docs.withColumn("presented_text", merkle.tampered_text()), levels=levels).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows, merkle.FANOUT), key=key)


def test_manifest_of_other_fanout_and_untampered_rows(spark):
    docs = spark.createDataFrame([tuple(r.values()) for r in documents(70, ["a", "b"])], COLUMNS)
    rows = merkle.manifest(docs, fanout=4, levels=2).collect()
    assert len(rows) == 77 and all(r.verified and r.folded_root == r.root for r in rows)


def test_no_rows_no_root(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_fold_and_matrix():
    leaves = [H(str(k)) for k in range(10)]
    top, proofs = plain_tree(leaves, 3)
    found = merkle.tower(np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, 64), 0, 3, 8)
    assert found[-1].tobytes().decode() == top
    for k, leaf in enumerate(leaves):
        path = [f"{a.decode()}|{b.decode()}" for a, b in merkle.siblings(found, k, 3)]
        assert path == [f"{a}|{b}" for a, b in proofs[k]] and merkle.fold(leaf, path) == top


def test_places_over_many_tasks(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["hot"] * 30 + [f"g{k}" for k in range(9)]), draw.randrange(10**6), k) for k in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(spark.createDataFrame(rows, "grp string, v long, k long"), "grp", [F.col("v").desc(), F.col("k")], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = {}, Counter()
    for g, v, k in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        want[k] = seen[g]
        seen[g] += 1
    assert {r.k: r.place for r in got} == want


# ---- operator 13


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or not c.isascii() else " " for c in low).split(" ")


def plain_resample(docs, target, longest=1, percent=10, least=20, buckets=10_000):
    def runs(text):
        words = [w for w in plain_words(text) if w]
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    mine, other = [(d, *runs(t)) for d, t in docs], [runs(t)[1] for t in target]
    s, t = Counter(b for _, _, r in mine for b in r), Counter(b for r in other for b in r)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets)))))
    rows = []
    for d, words, r in mine:
        weight = sum(map(gain, r))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(r), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    drawn = fit[: percent * len(fit) // 100]
    return [(*r, None) for r in rows if r[2] < least] + [(*r, k + 1 if k < len(drawn) else None) for k, r in enumerate(fit)]


def corpus():
    draw = random.Random(8)
    words = ["Alpha", "beta", "gämma", "日本", "x1", "ÄÖ", "NASA", "kKelvin"]
    sep = [" ", "\x00", "-", "\n", " ", "_", "{"]
    docs = [(draw.choice([None, k]), "".join(draw.choice(words) + draw.choice(sep) for _ in range(draw.randrange(60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, "--- !!"), *docs[:30], (7, docs[3][1])]
    return docs, [(k, "".join(draw.choice(words[:3]) + " " for _ in range(40))) for k in range(20)] + [(99, None)]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_a_plain_loop(spark, longest):
    docs, target = corpus()
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "item_id long, text string"), longest=longest)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()), key=key) == sorted(plain_resample(docs, [t for _, t in target], longest), key=key)


def test_empty_target_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, weight int, score int, rank int")
    docs = spark.createDataFrame([(k, "word " * 20, 1, 2, 3) for k in range(30)], "doc_id long, text string, weight int, score int, rank int")
    assert importance.resample(none, docs).collect() == []
    rows = importance.resample(docs, none).collect()
    assert len(rows) == 30 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]


def test_remembered_buckets_are_bounded(monkeypatch):
    monkeypatch.setattr(importance, "REMEMBERED", 10)
    place = importance.Buckets(100)
    assert [place[b"%d" % k] for k in range(35)] == [zlib.crc32(b"%d" % k) % 100 for k in range(35)]
    assert len(place) <= 10
