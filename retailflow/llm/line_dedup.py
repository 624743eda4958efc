"""Reversible line dedup: sharded cuckoo filters over an exact reference table.

``refs`` is the exact table: one row for each (line key, document). Counting it gives a
key's reference count and its largest document; keys in at least ``min_docs`` documents
are *repeated* and lose their lines everywhere but in that largest document. Over the
repeated keys stands one cuckoo filter a shard (16-bit fingerprints, four slots a
bucket, an exact stash for what finds no slot). To clean documents, their keys are
looked up in the filter of their shard; only hits, a small superset of the repeated
lines, are joined with the exact counts, so false positives never drop a line.

Inserting documents appends references, deleting removes them; either way only the keys
touched are counted again, and fingerprints enter or leave the filters as keys cross
``min_docs``. Deleting what was inserted restores the index, whatever came between.

Line keys are 128-bit hashes. A shard's keys meet its filter in blocks of about
``block_rows`` rows whatever the key, so a line that a third of all documents share is
spread over many tasks; counting combines before the shuffle.

Defined results
* null or empty text: one empty line, kept; repeated rows of a document count once and
  each lose the same lines; null ``doc_id`` is one document, smaller than all others;
* an empty table gives an empty table; other columns, whatever their names, are carried
  by ``clean`` and ignored by ``line_report``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import small_side, staged

WHITE_BYTES = b" \t\n\x0b\x0c\r"
SLOTS = 4
NULL_ID = -(2**63)  # stands for a null doc_id inside the index
SHARD_KEYS = 200_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key (stripped, A-Z lower-cased); None if the key is short."""
    import xxhash

    key = line.strip(WHITE_BYTES)
    if len(key) < min_chars:
        return None
    key = key.lower()
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _ids(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID))


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, hi, lo: the distinct line keys of every document row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            owners, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py()
                if not body:
                    continue
                own = {line_key(line, min_chars) for line in body.encode("utf-8", "surrogatepass").split(b"\n")}
                own.discard(None)
                keys.extend(own)
                owners.extend([doc] * len(own))
            pairs = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                names=["doc", "hi", "lo"],
            )

    rows = docs.select(_ids(docs).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, hi long, lo long")


# -- cuckoo filter -----------------------------------------------------------


def _spread(x):
    """Mix 64-bit integers (array of uint64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _addresses(hi, lo, n_buckets: int):
    """Fingerprints (1..65535) and first buckets of keys."""
    import numpy as np

    mixed = _spread(lo.astype(np.uint64) ^ _spread(hi.astype(np.uint64)))
    prints = (mixed & np.uint64(0xFFFF)).astype(np.uint16)
    prints[prints == 0] = 1
    return prints, ((mixed >> np.uint64(16)) & np.uint64(n_buckets - 1)).astype(np.int64)


def _other(bucket, prints, n_buckets: int):
    """The alternative bucket: the same step leads back."""
    import numpy as np

    step = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return (bucket ^ (step & np.uint64(n_buckets - 1)).astype(np.int64)).astype(np.int64)


class CuckooFilter:
    """Approximate set of keys with deletion; false positives only."""

    def __init__(self, n_buckets: int, table=None, stash=()):
        import numpy as np

        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table
        self.stash = list(stash)  # (print, bucket) pairs that found no slot

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 4
        while n * SLOTS * 0.8 < keys:
            n *= 2
        return cls(n)

    def _place(self, p: int, bucket: int) -> bool:
        row = self.table[bucket]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = p
                return True
        return False

    def add(self, hi, lo) -> None:
        import numpy as np

        prints, first = _addresses(np.asarray(hi), np.asarray(lo), self.n)
        second = _other(first, prints, self.n)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            if self._place(p, a) or self._place(p, b):
                continue
            at = b
            for kick in range(500):
                slot = (p + kick) % SLOTS
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at = int(_other(np.array([at]), np.array([p], np.uint16), self.n)[0])
                if self._place(p, at):
                    break
            else:
                self.stash.append((p, at))

    def remove(self, hi, lo) -> None:
        """Take out keys that were added before."""
        import numpy as np

        prints, first = _addresses(np.asarray(hi), np.asarray(lo), self.n)
        second = _other(first, prints, self.n)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == p)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
            else:
                self.stash.remove((p, a) if (p, a) in self.stash else (p, b))

    def has(self, hi, lo):
        import numpy as np

        prints, first = _addresses(hi, lo, self.n)
        second = _other(first, prints, self.n)
        found = (self.table[first] == prints[:, None]).any(axis=1) | (self.table[second] == prints[:, None]).any(axis=1)
        for p, at in self.stash:
            found |= (prints == p) & ((first == at) | (second == at))
        return found

    def row(self, shard: int) -> dict:
        return {
            "shard": shard,
            "n_buckets": self.n,
            "table": self.table.tobytes(),
            "stash": ",".join(f"{p}:{b}" for p, b in self.stash),
        }

    @classmethod
    def of(cls, row) -> CuckooFilter:
        import numpy as np

        n = int(row["n_buckets"])
        table = np.frombuffer(row["table"], dtype=np.uint16).reshape(n, SLOTS).copy()
        stash = [tuple(map(int, x.split(":"))) for x in row["stash"].split(",") if x]
        return cls(n, table, stash)


FILTER = "shard long, n_buckets long, table binary, stash string"


@dataclass
class LineIndex:
    """refs (doc, hi, lo), repeated (hi, lo, n_docs, max_doc), filters by shard."""

    refs: DataFrame
    repeated: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _shard(n: int):
    return F.pmod(F.col("hi"), F.lit(n)).alias("shard")


def _repeated(refs: DataFrame, min_docs: int) -> DataFrame:
    counts = refs.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("max_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


def _build_filter(key, frame):
    import pandas as pd

    own = CuckooFilter.sized(len(frame))
    own.add(frame["hi"].to_numpy(), frame["lo"].to_numpy())
    return pd.DataFrame([own.row(int(key[0]))])


def build_index(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
    spark = docs.sparkSession
    refs = staged(spark, references(docs, min_chars), "lines-refs")
    repeated = staged(spark, _repeated(refs, min_docs), "lines-repeated")
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    filters = repeated.select(_shard(shards), "hi", "lo").groupBy("shard").applyInPandas(_build_filter, FILTER)
    return LineIndex(refs, repeated, staged(spark, filters, "lines-filters"), shards, min_docs, min_chars)


def _change(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over ``refs``, given the keys whose references changed."""
    spark = refs.sparkSession
    touched = staged(spark, touched.select("hi", "lo").distinct(), "lines-touched")
    before = index.repeated.join(touched, ["hi", "lo"], "left_semi")
    after = staged(spark, _repeated(refs.join(touched, ["hi", "lo"], "left_semi"), index.min_docs), "lines-recounted")
    enter = after.join(before, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(1).alias("sign"))
    leave = before.join(after, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(-1).alias("sign"))
    moves = enter.unionByName(leave).select(_shard(index.shards), "hi", "lo", "sign")

    def update(key, moved, old):
        import pandas as pd

        shard = int((moved if len(moved) else old)["shard"].iloc[0])
        own = CuckooFilter.of(old.iloc[0]) if len(old) else CuckooFilter.sized(2 * len(moved))
        for sign, act in ((-1, own.remove), (1, own.add)):
            part = moved[moved["sign"] == sign]
            act(part["hi"].to_numpy(), part["lo"].to_numpy())
        return pd.DataFrame([own.row(shard)])

    filters = moves.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(update, FILTER)
    repeated = index.repeated.join(touched, ["hi", "lo"], "left_anti").unionByName(after)
    return LineIndex(
        refs,
        staged(spark, repeated, "lines-repeated"),
        staged(spark, filters, "lines-filters"),
        index.shards,
        index.min_docs,
        index.min_chars,
    )


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index after adding documents."""
    new = staged(docs.sparkSession, references(docs, index.min_chars), "lines-refs")
    return _change(index, index.refs.unionByName(new), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index after removing the documents of ``doc_ids`` (column doc_id)."""
    gone = doc_ids.select(_ids(doc_ids).alias("doc")).distinct()
    removed = index.refs.join(gone, "doc", "left_semi")
    left = staged(doc_ids.sparkSession, index.refs.join(gone, "doc", "left_anti"), "lines-refs")
    return _change(index, left, removed)


def dropped_keys(index: LineIndex, refs: DataFrame, block_rows: int = 500_000) -> DataFrame:
    """doc, keys: the line keys each document loses.

    References are looked up in their shard's filter first, in blocks of a shard; hits
    are then joined with the exact counts.
    """
    spark = refs.sparkSession
    rows = refs.select("doc", "hi", "lo", _shard(index.shards))
    blocks = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    blocks = staged(spark, blocks, "lines-blocks")
    dealt = rows.join(small_side(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).drop("blocks")
    copies = index.filters.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def probe(key, lines, filters):
        if not len(filters) or not len(lines):
            return lines[["doc", "hi", "lo"]].iloc[:0]
        hits = CuckooFilter.of(filters.iloc[0]).has(lines["hi"].to_numpy(), lines["lo"].to_numpy())
        return lines.loc[hits, ["doc", "hi", "lo"]]

    both = dealt.groupBy("shard", "block").cogroup(copies.drop("blocks").groupBy("shard", "block"))
    hits = both.applyInPandas(probe, "doc long, hi long, lo long")
    lost = hits.join(index.repeated, ["hi", "lo"]).where(F.col("doc") != F.col("max_doc"))
    return lost.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))


def _split(text: str | None, lost: set, min_chars: int):
    """(lines before, lines dropped, kept text as bytes)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if not lost:
        return len(lines), 0, b"\n".join(lines)
    kept = [x for x in lines if line_key(x, min_chars) not in lost]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _lost(keys) -> set:
    import struct

    return {struct.pack("<qq", k["hi"], k["lo"]) for k in keys or ()}


def _with_lost(index: LineIndex, docs: DataFrame) -> DataFrame:
    lost = dropped_keys(index, index.refs).withColumnsRenamed({"doc": "_lost_doc", "keys": "_lost_keys"})
    return docs.join(lost, _ids(docs) == F.col("_lost_doc"), "left").drop("_lost_doc")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    index = build_index(docs, **options)
    min_chars = index.min_chars

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            n, dropped, digests = [], [], []
            for text, keys in zip(batch.column(1), batch.column(2).to_pylist()):
                lines, gone, body = _split(text.as_py(), _lost(keys), min_chars)
                n.append(lines)
                dropped.append(gone)
                digests.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_lost(index, docs).select("doc_id", "text", "_lost_keys")
    return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated lines; ``n_chars``, if there, follows the text."""
    index = build_index(docs.select("doc_id", "text"), **options)
    min_chars = index.min_chars

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_pylist()
            texts = [
                t.as_py() if not k else _split(t.as_py(), _lost(k), min_chars)[2].decode("utf-8", "surrogatepass")
                for t, k in zip(batch.column("_text"), keys)
            ]
            columns = [batch.column(c) for c in range(batch.num_columns - 2)] + [pa.array(texts, pa.string())]
            names = [batch.schema.field(c).name for c in range(batch.num_columns - 2)] + ["_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    marked = _with_lost(index, docs.withColumn("_text", F.col("text").cast("string")))
    rest = [c for c in docs.columns if c != "text"]
    rows = marked.select(*rest, "_text", "_lost_keys")
    schema = rows.drop("_lost_keys").schema
    out = rows.mapInArrow(run, schema).withColumnRenamed("_text", "text").select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
