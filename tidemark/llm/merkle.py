"""Merkle manifest of a dataset: a digest for each row, source and the whole, and a proof for each row.

Rows of a source are numbered in order and dealt out in aligned blocks of ``fanout ** levels`` leaves. A
block is one matrix of 64-byte hexadecimal digests. Reshaped by the fanout, its rows are the inputs of the
next level, so a level is hashed row by row without any lookup, and a leaf's node at level k is its place
divided by the fanout k times; its siblings are the other nodes of that row. A block's top is the leaf of the
next, much smaller table, and so on up to the source's digest, then over the sources in the same way. Going
down again, each block gets the path above it, one row, and works out all its rows' proofs.

No task holds more than a block, so a source with a third of all rows is many tasks. What is shuffled are
digests, never texts.

Defined cases: null columns are hashed as ``-``; a null ``doc_id`` comes first in its source and is never
tampered with; repeated rows are leaves of their own; texts of any length are hashed whole in the JVM; an
empty table has no row and so no root; other columns are not part of a leaf, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, staged
from tidemark.llm.ordering import numbered

FANOUT = 3
LEVELS = 8
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, position long, digest string"
PATHS = "grp string, position long, path array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_input(fields: list[Column]) -> Column:
    """Each field as its UTF-8 length, a colon and itself; ``-`` where it is null."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Hexadecimal digests as a contiguous matrix of bytes, one row each."""
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(s.encode() for s in texts.to_pylist()), np.uint8).reshape(-1, WIDTH)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: every ``fanout`` consecutive rows, the last ones perhaps fewer, hashed together."""
    whole, n = len(nodes) // fanout, len(nodes)
    joined = nodes[: whole * fanout].reshape(whole, fanout * WIDTH)
    made = [hashlib.sha256(row).hexdigest() for row in joined]
    if whole * fanout < n:
        made.append(hashlib.sha256(nodes[whole * fanout :].tobytes()).hexdigest())
    return np.frombuffer("".join(made).encode(), np.uint8).reshape(-1, WIDTH)


def tower(leaves: np.ndarray, block: int, fanout: int, levels: int) -> list[np.ndarray]:
    """The block's levels from its leaves to its top. The first block, if not full, is alone and ends with its first single node; any other goes up all levels, a lone node too."""
    alone = block == 0 and len(leaves) < fanout**levels
    found = [leaves]
    while len(found[-1]) > 1 if alone else len(found) <= levels:
        found.append(parents(found[-1], fanout))
    return found


def siblings(found: list[np.ndarray], place: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """For each level below the top: what stands before and after the node in its row."""
    out = []
    for nodes in found[:-1]:
        row = place // fanout * fanout
        out.append((nodes[row:place].tobytes(), nodes[place + 1 : row + fanout].tobytes()))
        place //= fanout
    return out


def _in_order(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by("position")


def _tops(fanout: int, levels: int):
    def top(key: tuple, table: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        last = tower(matrix(_in_order(table)["digest"]), block, fanout, levels)[-1]
        return pa.table({"grp": [grp], "position": [block], "digest": [last.tobytes().decode()]}, schema=pa.schema([("grp", pa.string()), ("position", pa.int64()), ("digest", pa.string())]))

    return top


def _down(fanout: int, levels: int):
    def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        table, upper = _in_order(table), above["path"][0].as_py() if above.num_rows else []
        found = tower(matrix(table["digest"]), block, fanout, levels)
        paths = [[f"{a.decode()}|{b.decode()}" for a, b in siblings(found, k, fanout)] + upper for k in range(table.num_rows)]
        return pa.table({"grp": [grp] * len(paths), "position": table["position"], "path": paths}, schema=pa.schema([("grp", pa.string()), ("position", pa.int64()), ("path", pa.list_(pa.string()))]))

    return down


def _block(fanout: int, levels: int) -> Column:
    return F.floor(F.col("position") / fanout**levels).cast("long").alias("block")


def tree(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """The top of each group (grp, position 0, digest), and the tables of nodes from the given one upwards, one for each ``levels`` levels."""
    tables = [nodes]
    while len(tables) == 1 or not tables[-1].filter("position > 0").isEmpty():
        below = tables[-1].select("grp", "position", "digest")
        tables.append(staged(below.groupBy("grp", _block(fanout, levels)).applyInArrow(_tops(fanout, levels), NODES), "merkle"))
    return tables.pop(), tables


def descend(tables: list[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Paths (grp, position, path) of the lowest of ``tables``, given those of the groups' tops: per level ``before|after``, lowest first."""
    for nodes in reversed(tables):
        left = nodes.select("grp", "position", "digest").groupBy("grp", _block(fanout, levels))
        right = above.withColumnRenamed("position", "block").groupBy("grp", "block")
        above = staged(left.cogroup(right).applyInArrow(_down(fanout, levels), PATHS), "merkle_paths")
    return above


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for level in path:
        before, after = level.split("|")
        leaf = digest(before, leaf, after)
    return leaf


RESULT = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(fanout: int, levels: int):
    def prove(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        _, block = (k.as_py() for k in key)
        table, top = _in_order(table), above.to_pylist()[0]
        leaves = table["digest"].to_pylist()
        presented = table["presented"].to_pylist()
        found = tower(matrix(table["digest"]), block, fanout, levels)
        upper = [tuple(level.encode().split(b"|")) for level in top["path"]]
        proofs, folded = [], []
        for k, leaf in enumerate(presented):
            path = siblings(found, k, fanout) + upper
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path)).hexdigest())
            node = leaf.encode()
            for a, b in path:
                node = hashlib.sha256(a + node + b).hexdigest().encode()
            folded.append(node.decode())
        n = len(leaves)
        columns = [table["doc_id"], leaves, [top["subroot"]] * n, [top["root"]] * n, proofs, folded, [f == top["root"] for f in folded]]
        return pa.table({name: column for (name, _), column in zip(RESULT, columns, strict=True)}, schema=pa.schema(RESULT))

    return prove


def manifest(docs: DataFrame, tampered: DataFrame | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Leaf, digests of source and dataset, digest of the proof, and the root that the presented row gives.

    ``docs`` has the fields of a leaf and, where a row is presented in another form than the manifest was made
    of, that text in ``presented_text``.
    """
    text = F.col("presented_text") if "presented_text" in docs.columns else F.col("text")
    fields = [F.col(c) for c in FIELDS]
    hashed = lambda columns: F.sha2(leaf_input(columns).cast("binary"), 256)
    # A null source comes before all others, the empty one included.
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), hashed(fields).alias("digest"), hashed([*fields[:-1], text]).alias("presented"))
    placed = staged(numbered(staged(leaves, "leaves"), "grp", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("presented")]), "placed")
    subroots, tables = tree(placed, fanout, levels)
    sources = staged(numbered(subroots.select(F.col("grp").alias("name"), "digest").withColumn("grp", F.lit("all")), "grp", [F.col("name")]), "sources")
    root, upper = tree(sources, fanout, levels)
    whole = descend(upper, root.select("grp", "position", F.array().cast("array<string>").alias("path")), fanout, levels)
    found = root.first()  # the root of all, or nothing of an empty table
    named = sources.join(whole.select("position", "path"), "position").withColumn("root", F.lit(found and found["digest"]))
    tops = named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("position"), "path", F.col("digest").alias("subroot"), "root")
    paths = descend(tables[1:], tops.select("grp", "position", "path"), fanout, levels)
    blocks = paths.join(tops.select("grp", "subroot", "root"), "grp").withColumnRenamed("position", "block")
    left = placed.groupBy("grp", _block(fanout, levels))
    return left.cogroup(blocks.groupBy("grp", "block")).applyInArrow(_prove(fanout, levels), MANIFEST)


def tampered_text() -> Column:
    """The contract's tampering: rows with an even checksum of their id lose their line ends."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*FIELDS)
    return manifest(docs.withColumn("presented_text", tampered_text()))


def _sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"

    def level(name: str, base: str) -> str:
        """All nodes of all groups, level by level, and what stands beside each below the top."""
        return f"""
{name} AS (SELECT 0 AS level, grp, pos, digest FROM {base} UNION ALL
  SELECT level + 1, grp, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY level, grp, pos // {FANOUT}),
{name}_top AS (SELECT grp, max(level) AS top, arg_max(digest, level) AS digest FROM {name} GROUP BY grp),
{name}_beside AS (SELECT a.level, a.grp, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.grp = b.grp AND a.pos // {FANOUT} = b.pos // {FANOUT} JOIN {name}_top t ON t.grp = a.grp AND a.level < t.top GROUP BY ALL)"""

    return f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
checked AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents CROSS JOIN crc_table),
shown AS (SELECT * EXCLUDE (t, crc), CASE WHEN coalesce(crc % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END AS shown_text FROM checked),
hashed AS (SELECT coalesce('=' || source, '') AS grp, doc_id, {leaf('text')} AS digest, {leaf('shown_text')} AS shown FROM shown),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest, shown) - 1 AS pos FROM hashed),
{level('node', 'leaves')},
subroots AS (SELECT 'all' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos FROM node_top),
{level('high', 'subroots')},
steps AS (SELECT l.grp, l.pos, b.level AS step, before, after FROM leaves l JOIN node_beside b ON b.grp = l.grp AND b.pos = l.pos // ({FANOUT} ** b.level)::BIGINT
  UNION ALL SELECT l.grp, l.pos, t.top + b.level, before, after FROM leaves l JOIN node_top t ON t.grp = l.grp JOIN subroots s ON s.name = l.grp JOIN high_beside b ON b.pos = s.pos // ({FANOUT} ** b.level)::BIGINT),
walk AS (SELECT grp, pos, 0 AS step, shown AS digest FROM leaves UNION ALL SELECT w.grp, w.pos, w.step + 1, sha256(before || w.digest || after) FROM walk w JOIN steps s ON s.grp = w.grp AND s.pos = w.pos AND s.step = w.step),
folded AS (SELECT grp, pos, arg_max(digest, step) AS folded_root FROM walk GROUP BY ALL),
proofs AS (SELECT grp, pos, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY ALL)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM leaves l JOIN node_top t USING (grp) CROSS JOIN high_top r JOIN folded f ON f.grp = l.grp AND f.pos = l.pos LEFT JOIN proofs p ON p.grp = l.grp AND p.pos = l.pos
"""


SQL = _sql()
