"""Removal of long repeated strings with a logarithmic family of suffix arrays.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else, in
the same document or another. Strings never cross documents.

*Suffixes.* Every ``length``-byte window has one anchor: the ``gram``-byte string in it
with the smallest hash, the leftmost of equals. Anchors depend on the window's bytes only,
so equal windows have equal anchors at equal places, and about two positions in
``length - gram`` are anchors: a sparse suffix array. Windows next to each other with the
same anchor form a *run*, the stretch of text around one anchor. An entry of the array is
(anchor, run, place): hashes of the gram and of the run's bytes, and where it stands.
Arrays are sorted by anchor, then run, and dealt to shards by anchor.

*Family.* ``insert`` builds the sorted array of a new batch and scans it, shard by shard,
together with the levels there are, one sorted pass over both:

* runs with equal bytes are repeated whole, old and new ones are marked;
* runs that share an anchor only may repeat in part; they are noted as *open*;
* levels up to one and a half times the batch's size merge with it in the same pass, so
  sizes grow geometrically and a batch is rewritten a logarithmic number of times.

*Open anchors.* ``long_matches`` compares the open runs of an anchor byte by byte: the
suffixes of their texts are ranked by prefix doubling up to ``length`` bytes, and equal
neighbours in that order are long matches. Where an anchor has more than ``HOT`` different
runs (the edges of a passage in a great many documents), each window becomes a row of its
128-bit hash instead, counted like any other key.

Copies collapse before the shuffle: of equal runs in one Arrow batch one entry leaves the
task and all are marked there; an anchor with many runs in one batch leaves as open runs,
dealt by run, and one notice. Joins of refs with texts go by document, so no key is hot.

Defined results
* null text: empty; texts shorter than ``length`` bytes lose nothing;
* repeated rows, also of one ``doc_id``, are documents of their own and repeat each other;
  null ``doc_id`` is an id like any other;
* an empty table gives an empty table; other columns, whatever their names, are carried by
  ``remove`` and take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm.common import forget, shuffle_parts, staged, tune, whole_groups
from retailflow.llm.hyperminhash import _mix

LENGTH, GRAM = 200, 24
NULL_ID = -(2**63)  # stands for a null doc_id inside the index
CHUNK = 1 << 18  # bytes hashed at once
HOT_BATCH = 32  # different runs of an anchor in an Arrow batch from which they leave as open
HOT = 16_384  # different runs of an anchor (6 MB of text) from which windows are compared by hash
SHARD_ENTRIES = 400_000
BLOCK_BYTES = 1 << 19  # bytes of runs ranked at once
NEW = 1000  # level number of the batch
ENTRY, MARK, OPEN, NOTE = 0, 1, 2, 3  # open runs: one row each, or noted by a scan

FLOW = "kind tinyint, shard int, doc bigint, tag int, place bigint, anchor bigint, run bigint, n tinyint"
LEVEL = "shard int, doc bigint, tag int, place bigint, anchor bigint, run bigint, n tinyint"


class Anchors:
    """Bytes of some documents -> their runs (start, width in windows, lead to the anchor, gram hash)."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, length: int, gram: int):
        import numpy as np

        self.length, self.gram = length, gram
        n = CHUNK + 2 * length
        inverse = pow(self.BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            steps = np.full(n, self.BASE, np.uint64), np.full(n, inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(s) for s in steps)

    def _chunk(self, data, starts):
        """``data``: uint8 bytes, ``starts``: sorted valid window starts in it."""
        import numpy as np

        n, k = len(data), self.gram
        window = self.length - k + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        grams = _mix((sums[k:] - sums[:-k]) * self.inverses[: n - k + 1])
        m = len(grams)
        # smallest (hash, position) of every window: minima of blocks from both ends
        blocks = -(-m // window)
        ranked = np.full(blocks * window, np.uint64(2**64 - 1))
        ranked[:m] = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
        ranked = ranked.reshape(blocks, window)
        ahead = np.minimum.accumulate(ranked, axis=1).ravel()
        back = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[starts], ahead[starts + window - 1])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        return first, last - first + 1, at[new] - first, grams[at[new]].view(np.int64)

    def __call__(self, texts):
        """``texts``: list of bytes -> (document, start, width, lead, anchor, run) arrays."""
        import numpy as np
        import xxhash

        parts, length = [], self.length
        group, spans, used = [], [], 0  # (document, offset in it, offset in the chunk, bytes)

        def flush():
            nonlocal group, spans, used
            if not group:
                return
            raw = b"".join(group)
            ranges = [np.arange(s[2], s[2] + s[3] - length + 1) for s in spans]
            first, width, lead, anchor = self._chunk(np.frombuffer(raw, np.uint8), np.concatenate(ranges))
            whose = np.searchsorted([s[2] for s in spans], first, "right") - 1
            view = memoryview(raw)
            ends = (first + width - 1 + length).tolist()
            digest = xxhash.xxh3_64_intdigest
            run = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), ends)], np.uint64).view(np.int64)
            document = np.array([s[0] for s in spans], np.int64)[whose]
            shift = np.array([s[1] - s[2] for s in spans], np.int64)[whose]
            parts.append((document, first + shift, width, lead, anchor, run))
            group, spans, used = [], [], 0

        for i, text in enumerate(texts):
            size = len(text)
            if size < length:
                continue
            # a long text goes in pieces that share length - 1 bytes: each window is in one
            for offset in range(0, size - length + 1, CHUNK - length + 1):
                piece = text[offset : offset + CHUNK]
                if used and used + len(piece) > CHUNK:
                    flush()
                group.append(piece)
                spans.append((i, offset, used, len(piece)))
                used += len(piece)
        flush()
        if not parts:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(c) for c in zip(*parts))


def _groups(*keys):
    """Order by keys (first is the major one) and the starts of groups of equal keys in it."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    if len(order):
        change[0] = True
        for k in keys:
            change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(change)


def _sizes(starts, total):
    import numpy as np

    return np.diff(np.append(starts, total))


def _pack(start, width, lead):
    return (start << 16) | (lead << 8) | (width - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key of their refs: id and a hash of the text, and the text's bytes."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.hash(body).alias("tag"),
        body.cast("binary").alias("body"),
    )


def entries(docs: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """The batch's array entries, with marks and open runs that need no meeting."""

    schema = pa.schema(
        [("kind", pa.int8()), ("shard", pa.int32()), ("doc", pa.int64()), ("tag", pa.int32())]
        + [(c, pa.int64()) for c in ("place", "anchor", "run")]
        + [("n", pa.int8())]
    )

    def run(batches):
        import numpy as np

        find = Anchors(length, gram)
        for batch in batches:
            which, start, width, lead, anchor, run_ = find(batch.column("body").to_pylist())
            if not len(which):
                continue
            doc, tag = (batch.column(c).to_numpy()[which] for c in ("doc", "tag"))
            place = _pack(start, width, lead)
            order, first = _groups(anchor, run_)
            sizes = _sizes(first, len(order))
            copies = order[np.repeat(sizes > 1, sizes)]
            top = order[first]  # one entry for each different run
            n = np.where(sizes > 1, 2, 1)
            # an anchor of many runs: they leave as open runs
            _, head = _groups(anchor[top])
            many = np.repeat(_sizes(head, len(top)) >= HOT_BATCH, _sizes(head, len(top)))
            shard = _mix(anchor.view(np.uint64)) % np.uint64(shards)
            spread = _mix(run_.view(np.uint64) ^ start.astype(np.uint64)) % np.uint64(shards)
            notice = top[head][many[head]]
            out = [
                (ENTRY, top[~many], shard, n[~many]),
                (ENTRY, notice, shard, np.zeros(len(notice))),  # stands for all runs of its anchor
                (MARK, copies, spread, np.ones(len(copies))),
                (OPEN, top[many], spread, n[many]),
            ]
            rows = np.concatenate([o[1] for o in out])
            columns = {
                "kind": np.concatenate([np.full(len(o[1]), o[0]) for o in out]),
                "shard": np.concatenate([o[2][o[1]] for o in out]),
                "doc": doc[rows],
                "tag": tag[rows],
                "place": place[rows],
                "anchor": anchor[rows],
                "run": run_[rows],
                "n": np.concatenate([o[3] for o in out]),
            }
            columns["run"] = np.where(columns["n"] == 0, 0, columns["run"])
            arrays = [pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return _keyed(docs).mapInArrow(run, FLOW)


@dataclass(frozen=True)
class SuffixFamily:
    """Levels (bytes of text they cover, folder), and what the scans found."""

    spark: SparkSession
    shards: int
    length: int = LENGTH
    gram: int = GRAM
    levels: list = field(default_factory=list)
    found: list = field(default_factory=list)
    docs: list = field(default_factory=list)

    def flow(self, *kinds: int) -> DataFrame:
        """Marks or open runs of all scans."""
        out = self.spark.createDataFrame([], FLOW)
        for folder in self.found:
            out = out.unionByName(self.spark.read.schema(FLOW).parquet(folder).where(F.col("kind").isin(*kinds)))
        return out


def family(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> SuffixFamily:
    """An empty family with shards for about as much text as ``docs`` hold."""
    spark = tune(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries_ = size * 2 // (length - gram + 2)
    return SuffixFamily(spark, max(shuffle_parts(spark), entries_ // SHARD_ENTRIES + 1), length, gram)


def _scan(merging: int):
    """Shard scan: batch flow and the levels' rows -> marks, open runs and the new level.

    Levels numbered ``merging`` and up become one with the batch.
    """

    def scan(key, batch, old):
        import numpy as np

        kind = batch.column("kind").to_numpy()
        entry = np.flatnonzero(kind == ENTRY)
        through = batch.filter(pa.array(kind != ENTRY))
        names = ["shard", "doc", "tag", "place", "anchor", "run", "n"]
        rows = {c: np.concatenate([batch.column(c).to_numpy()[entry], old.column(c).to_numpy()]) for c in names}
        if not len(rows["n"]):
            return through
        level = np.concatenate([np.full(len(entry), NEW), old.column("level").to_numpy()])
        # one sorted pass over the batch's array and the levels'
        order, first = _groups(rows["anchor"], rows["run"])
        sizes = _sizes(first, len(order))
        group = np.repeat(np.arange(len(first)), sizes)
        total = np.bincount(group, rows["n"][order])
        marked = order[(total[group] > 1) & (rows["n"][order] == 1)]
        newest = np.maximum.reduceat(level[order], first)
        top = order[first]
        _, head = _groups(rows["anchor"][top])
        runs = _sizes(head, len(top))
        each = np.repeat(np.arange(len(head)), runs)
        met = np.bincount(each, newest == NEW) > 0
        differ = (runs > 1) & (np.bincount(each, total == 1) > 0)
        noticed = np.bincount(each, total == 0) > 0
        open_ = (met & (differ | noticed))[each] & (total > 0)
        stay = newest >= merging

        def table(kind, picked, n):
            columns = [pa.array(np.full(len(picked), kind, np.int8))]
            for c in names[:-1]:
                columns.append(pa.array(rows[c][picked], through.schema.field(c).type))
            columns.append(pa.array(np.minimum(n, 2).astype(np.int8)))
            return pa.Table.from_arrays(columns, schema=through.schema)

        parts = [
            through,
            table(ENTRY, top[stay], total[stay]),
            table(MARK, marked, np.ones(len(marked))),
            table(NOTE, top[open_], total[open_]),
        ]
        return pa.concat_tables(parts)

    return scan


def insert(index: SuffixFamily, docs: DataFrame) -> SuffixFamily:
    """Add a batch: its array is scanned with the levels and merged with those of like size."""
    spark = index.spark
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    merging, joined = len(index.levels), size
    while merging and index.levels[merging - 1][0] <= 1.5 * joined:
        merging -= 1
        joined += index.levels[merging][0]
    old = spark.createDataFrame([], LEVEL + ", level int")
    for number, (_, folder) in enumerate(index.levels):
        rows = spark.read.schema(FLOW).parquet(folder).where(F.col("kind") == ENTRY).drop("kind")
        old = old.unionByName(rows.withColumn("level", F.lit(number)))
    flow = entries(docs, index.length, index.gram, index.shards)
    met = flow.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_scan(merging), FLOW)
    written: list = []
    staged(spark, met, "suffixes", written, by="kind")
    levels = index.levels
    if size:
        levels = [*levels[:merging], (joined, written[0])]
        forget(spark, [f"{folder}/kind={ENTRY}" for _, folder in index.levels[merging:]])
    return replace(index, levels=levels, found=[*index.found, *written], docs=[*index.docs, docs])


def window_ranks(data, length: int):
    """Rank of the ``length`` bytes at every position of ``data``, by prefix doubling."""
    import numpy as np

    width = min(8, length)
    lead = np.lib.stride_tricks.sliding_window_view(data, width)
    key = np.zeros((len(lead), 8), np.uint8)
    key[:, :width] = lead
    rank = np.unique(key.view(">u8").ravel().astype(np.uint64), return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    return rank


def _compare(length: int):
    """Sorted open runs of whole anchors -> marks of the strings that repeat."""

    def blocks(batches):
        held, size = [], 0
        for anchor in whole_groups(batches, "anchor"):
            held.append(anchor)
            size += anchor.column("body").nbytes
            if size > BLOCK_BYTES:
                yield pa.concat_tables(held)
                held, size = [], 0
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        import numpy as np

        for block in blocks(batches):
            bodies = block.column("body").to_pylist()
            sizes = np.array([len(b) for b in bodies])
            offset = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            rank = window_ranks(np.frombuffer(b"".join(bodies), np.uint8), length)
            widths = sizes - length + 1
            row = np.repeat(np.arange(len(bodies)), widths)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(widths) - widths, widths)
            mine = rank[offset[row] + inner]
            n = block.column("n").to_numpy()
            weight = np.bincount(mine, n[row])
            hit = (weight[mine] > 1) & (n[row] == 1)
            # stretches of hits in a run
            joined = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
            first = np.flatnonzero(hit & ~np.concatenate(([False], joined)))
            last = np.flatnonzero(hit & ~np.concatenate((joined, [False])))
            if not len(first):
                continue
            start = (block.column("place").to_numpy() >> 16)[row[first]] + inner[first]
            columns = [
                pa.array(block.column("doc").to_numpy()[row[first]]),
                pa.array(block.column("tag").to_numpy()[row[first]].astype(np.int32)),
                pa.array(start),
                pa.array(start + (last - first) + length),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "tag", "start", "stop"])

    return run


def _cut(length: int):
    """Documents with their open refs -> the bytes of those runs."""

    types = [("anchor", pa.int64()), ("run", pa.int64()), ("n", pa.int8()), ("hot", pa.bool_())]
    types += [("doc", pa.int64()), ("tag", pa.int32()), ("place", pa.int64()), ("body", pa.binary())]
    schema = pa.schema(types)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for ref in r["refs"]:
                    start = ref["place"] >> 16
                    body = r["body"][start : start + (ref["place"] & 255) + length]
                    rows.append({**ref, "doc": r["doc"], "tag": r["tag"], "body": body})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def long_matches(index: SuffixFamily) -> DataFrame:
    """Repeated strings of all inserted documents: (doc, tag, start, stop), in bytes."""
    spark, length = index.spark, index.length
    start = F.shiftright("place", 16)
    whole = F.col("place").bitwiseAND(255) + length
    mark = lambda df: df.select("doc", "tag", start.alias("start"), (start + whole).alias("stop"))
    found = mark(index.flow(MARK))
    if not index.docs:
        return found
    # counts stand for "one" and "more"; rows add up, what several scans note does not
    count = lambda kind, of: F.coalesce(of(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    places = index.flow(OPEN, NOTE).groupBy("anchor", "run", "doc", "tag", "place")
    places = places.agg((count(OPEN, F.sum) + count(NOTE, F.max)).alias("n"))
    total = F.least(F.sum("n"), F.lit(2)).cast("tinyint")
    runs = places.groupBy("anchor", "run").agg(total.alias("n"), F.min(F.struct("doc", "tag", "place")).alias("ref"))
    runs = staged(spark, runs, "open-runs")
    again = places.join(runs.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
    per = runs.groupBy("anchor").agg(F.count("*").alias("runs"), F.sum((F.col("n") == 1).cast("int")).alias("single"))
    per = per.where("runs > 1 and single > 0").select("anchor", (F.col("runs") > HOT).alias("hot"))
    refs = runs.join(per, "anchor").select("ref.doc", "ref.tag", F.struct("anchor", "run", "n", "hot", "ref.place").alias("r"))
    refs = refs.groupBy("doc", "tag").agg(F.collect_list("r").alias("refs"))
    texts = _keyed(index.docs[0])
    for docs in index.docs[1:]:
        texts = texts.unionByName(_keyed(docs))
    cut = texts.join(refs, ["doc", "tag"]).mapInArrow(
        _cut(length), "anchor bigint, run bigint, n tinyint, hot boolean, doc bigint, tag int, place bigint, body binary"
    )
    cut = staged(spark, cut.dropDuplicates(["anchor", "run"]), "run-texts")
    cold = cut.where("not hot").drop("hot").repartition(shuffle_parts(spark), "anchor").sortWithinPartitions("anchor")
    marks = cold.mapInArrow(_compare(length), "doc bigint, tag int, start bigint, stop bigint")
    # hot anchors: a row for each window
    window = cut.where("hot").withColumn("i", F.explode(F.sequence(F.lit(1), F.octet_length("body") - length + 1)))
    piece = F.substring("body", F.col("i"), F.lit(length))
    window = window.select(
        "doc", "tag", "n", (start + F.col("i") - 1).alias("start"), F.xxhash64(piece).alias("h1"), F.xxhash64(F.lit(1), piece).alias("h2")
    )
    twice = window.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    hit = window.where("n = 1").join(twice, ["h1", "h2"], "left_semi")
    hit = hit.select("doc", "tag", "start", (F.col("start") + length).alias("stop"))
    return found.unionByName(mark(again)).unionByName(marks).unionByName(hit)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with what stays of them.

    Adds ``kept`` (the remaining bytes), ``spans`` (maximal removed runs: start, stop in
    bytes) and ``n_bytes``.
    """

    spans = found.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    added = ("kept", "spans", "n_bytes")
    plain = [c for c in docs.columns if c not in added]
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*plain).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(body).alias("tag")
    )
    rows = rows.join(spans, ["doc", "tag"], "left").select("row", "spans")

    def cut(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, marks in zip(bodies.to_pylist(), spans.to_pylist()):
            if marks is None:
                out.append(None)
                continue
            merged, kept, at = [], [], 0
            for m in marks:
                if merged and m["start"] <= merged[-1]["stop"]:
                    merged[-1]["stop"] = max(merged[-1]["stop"], m["stop"])
                else:
                    merged.append(m)
            for m in merged:
                kept.append(raw[at : m["start"]])
                at = m["stop"]
            out.append({"kept": b"".join([*kept, raw[at:]]), "spans": merged})
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array(out, pa.struct([("kept", pa.binary()), ("spans", span)]))

    udf = F.arrow_udf(cut, "struct<kept: binary, spans: array<struct<start: bigint, stop: bigint>>>")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    touched = F.when(F.col("spans").isNotNull(), text.cast("binary"))
    rows = rows.withColumn("cut", udf(touched, F.col("spans")))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return rows.select(
        "row.*",
        F.coalesce("cut.kept", text.cast("binary")).alias("kept"),
        F.coalesce("cut.spans", none).alias("spans"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 4) -> DataFrame:
    """``docs`` inserted in ``batches`` parts, without the strings that repeat."""
    index = family(docs, length, gram)
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(batches))
    for b in range(batches):
        index = insert(index, docs.where(part == b))
    return remove(docs, long_matches(index))


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: bytes, bytes removed, removed runs, digest of what stays."""
    out = dedup(docs.select("doc_id", "text"), **options)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
