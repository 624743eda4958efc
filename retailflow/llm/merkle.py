"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf, the SHA-256 of its fields. Leaves of a source ascend by ``doc_id``;
runs of ``FAN`` nodes are hashed into one until a single node, the source's subroot, is
left; subroots, in order of their sources, are hashed the same way into the root. A node
has the coordinates (tree, level, pos); the tree of subroots is number ``TOP``.

Levels are built with joins and hashes of the JVM, one small written table a level. For
proofs, leaves are cut into chunks of ``CHUNK`` neighbours in the global order. Each chunk

* computes the union of the coordinates its proofs need and cannot derive: level by level,
  the members of its nodes' runs that are neither its own nor computed from its own;
* fetches these nodes in one join for all chunks;
* derives the interiors its leaves share once, and expands each leaf's proof from them.

A chunk of neighbours misses at most ``2 * (FAN - 1)`` nodes a level and tree, so what is
fetched is a few hundred digests however large the table. Positions come from a
range-partitioned sort, so a source that holds most rows is many chunks, never one task.

Defined results
* null fields enter the leaf as ``-``; null sources are a source of their own, the first;
* equal ``doc_id`` s of a source are ordered by their leaf, null ids come first; repeated
  rows are leaves of their own;
* a row without ``doc_id`` is never tampered with in ``audit``;
* an empty table has no root and gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions.ranking import global_index
from retailflow.llm.common import small_side, staged, tune

FAN = 16
TOP = -1
CHUNK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree bigint, level int, pos bigint, size bigint, digest string"


def field(value: Column) -> Column:
    """A field of a leaf: its length in bytes, a colon and its text; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """Leaf of a row; ``other`` replaces fields."""
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def tree_levels(nodes: DataFrame, largest: int) -> DataFrame:
    """All levels above the leaves ``nodes`` (tree, level, pos, size, digest), and these."""
    spark = nodes.sparkSession
    out, level = nodes, nodes
    while largest > 1:
        runs = level.where("size > 1").groupBy("tree", "level", "size", F.floor(F.col("pos") / FAN).alias("up"))
        members = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        text = F.concat_ws("", F.transform(members, lambda m: m["digest"]))
        level = runs.agg(F.sha2(text, 256).alias("digest")).select(
            "tree", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), "digest"
        )
        level = staged(spark, level, "merkle-level")
        out = out.unionByName(level)
        largest = -(-largest // FAN)
    return out


@dataclass(frozen=True)
class Manifest:
    """``leaves``: doc_id, leaf, seen, tree, pos, size, chunk; ``nodes``: all levels of all trees."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    n_sources: int


def manifest(docs: DataFrame, seen: Column | None = None) -> Manifest:
    """Hash ``docs``; ``seen`` is the leaf a verifier meets where it is not the row's own."""
    spark = tune(docs.sparkSession)
    seen = F.lit(None).cast("string") if seen is None else seen
    rows = docs.select(*FIELDS).select("doc_id", "source", leaf().alias("leaf"), seen.alias("seen"))
    rows = staged(spark, rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    rows = global_index(rows, *order, name="idx")
    sources = rows.groupBy("source").agg(F.min("idx").alias("first"), F.count("*").alias("size"))
    sources = staged(spark, global_index(sources, F.asc_nulls_first("source"), name="tree"), "merkle-sources")
    n, largest = sources.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    mine = small_side(sources.withColumnRenamed("source", "_source"))
    leaves = rows.join(mine, rows["source"].eqNullSafe(mine["_source"])).select(
        "doc_id", "leaf", "seen", "tree", (F.col("idx") - F.col("first")).alias("pos"), "size",
        F.floor(F.col("idx") / CHUNK).alias("chunk"),
    )
    leaves = staged(spark, leaves, "merkle-positions")
    ground = leaves.select("tree", F.lit(0).alias("level"), "pos", "size", F.col("leaf").alias("digest"))
    nodes = tree_levels(ground, largest)
    subroots = nodes.where("size = 1").select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("size"), "digest"
    )
    return Manifest(leaves, nodes.unionByName(tree_levels(staged(spark, subroots, "merkle-subroots"), n)), sources, n)


def missing(pos, size: int):
    """(level, positions) that proofs of the leaves at ``pos`` need and cannot derive."""
    import numpy as np

    known, level = np.unique(pos), 0
    while size > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(members[members < size], known)
        known, size, level = runs, -(-size // FAN), level + 1


def requests(book: Manifest) -> DataFrame:
    """Coordinates each chunk has to fetch: (chunk, tree, level, pos)."""
    n = book.n_sources

    def ask(key, rows):
        import numpy as np

        trees, pos, sizes = (rows.column(c).to_numpy() for c in ("tree", "pos", "size"))
        out = [(TOP, level, at) for level, at in missing(trees, n)]
        for tree in np.unique(trees):
            mine = trees == tree
            out += [(tree, level, at) for level, at in missing(pos[mine], int(sizes[mine][0]))]
        flat = [(int(t), level, int(p)) for t, level, at in out for p in at]
        columns = list(zip(*flat)) or [(), (), ()]
        types = (pa.int64(), pa.int32(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        chunk = pa.array([key[0].as_py()] * len(flat), pa.int64())
        return pa.Table.from_arrays([chunk, *arrays], ["chunk", "tree", "level", "pos"])

    rows = book.leaves.select("chunk", "tree", "pos", "size")
    return rows.groupBy("chunk").applyInArrow(ask, "chunk bigint, tree bigint, level int, pos bigint")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Octopus:
    """One tree of a chunk: fetched and own nodes, shared interiors, proofs."""

    def __init__(self, own: dict, fetched: dict, size: int):
        """``own``: pos -> digest of leaves, ``fetched``: level -> {pos: digest}."""
        self.levels, level = [], 0
        while size > 1:
            nodes = own | fetched.get(level, {})
            runs = {}
            for up in {p // FAN for p in own}:
                runs[up] = [nodes[p] for p in range(up * FAN, min((up + 1) * FAN, size))]
            self.levels.append(runs)
            own = {up: _hash("".join(run)) for up, run in runs.items()}
            size, level = -(-size // FAN), level + 1
        (self.root,) = own.values()
        self._above: dict = {}

    def sides(self, pos: int):
        """(left, right) texts of a leaf's siblings, level by level."""
        for runs in self.levels:
            up, k = divmod(pos, FAN)
            run = runs[up]
            yield "".join(run[:k]), "".join(run[k + 1 :])
            pos = up

    def proof(self, pos: int, level: int = 0) -> str:
        """Siblings of a node from its level to the root; what leaves share is kept."""
        if level == len(self.levels):
            return ""
        up, k = divmod(pos, FAN)
        if (level + 1, up) not in self._above:
            self._above[level + 1, up] = self.proof(up, level + 1)
        run = self.levels[level][up]
        return "".join(run[:k]) + "".join(run[k + 1 :]) + self._above[level + 1, up]


PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof string"


def prove(book: Manifest, keep_proofs: bool = False) -> DataFrame:
    """A proof for every leaf and the root it folds to from the leaf that was seen.

    ``proof`` is the text of all siblings, level by level to the root, with ``keep_proofs``.
    """
    n = book.n_sources
    asked = requests(book)
    fetched = asked.join(book.nodes.drop("size"), ["tree", "level", "pos"])

    def expand(key, rows, nodes):
        got: dict = {}
        for tree, level, pos, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "pos", "digest"))):
            got.setdefault(tree, {}).setdefault(level, {})[pos] = digest
        leaves = list(zip(*(rows.column(c).to_pylist() for c in ("tree", "pos", "size", "leaf", "seen"))))
        own: dict = {}
        for tree, pos, size, digest, _ in leaves:
            own.setdefault((tree, size), {})[pos] = digest
        trees = {tree: Octopus(mine, got.get(tree, {}), size) for (tree, size), mine in own.items()}
        top = Octopus({t: o.root for t, o in trees.items()}, got.get(TOP, {}), n)
        out = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "proof")}
        for tree, pos, _, digest, seen in leaves:
            octopus = trees[tree]
            proof = octopus.proof(pos) + top.proof(tree)
            folded = seen or digest
            for side in (octopus.sides(pos), top.sides(tree)):
                for left, right in side:
                    folded = _hash(left + folded + right)
            values = (digest, octopus.root, top.root, _hash(proof), folded, proof if keep_proofs else None)
            for c, v in zip(out, values):
                out[c].append(v)
        arrays = [pa.array(v, pa.string()) for v in out.values()]
        return pa.Table.from_arrays([rows.column("doc_id"), *arrays], ["doc_id", *out])

    return book.leaves.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(expand, PROOF)


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """Prove every row; rows whose id's CRC-32 ``every`` divides are met in lower case."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    proofs = prove(manifest(docs, F.when(hit, leaf(text=lower)))).drop("proof")
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
