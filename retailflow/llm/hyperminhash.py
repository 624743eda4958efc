"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the hashes of its distinct 5-word shingles. Each of 256 buckets
keeps one 16-bit register of its smallest hash: leading zeros (6 bits) and the mantissa
after them (10 bits). Runs of six registers (empty buckets borrow from a bucket chosen
by a fixed random order) make 42 band keys; two sets of similarity 0.8 share no band key
with probability below 3e-6, at 0.85 below 3e-9.

Copies (equal sets) collapse first. Members of a small band bucket are compared pair by
pair. Those of a large one first meet a few hubs, the documents standing in the largest
buckets, which unites most groups of near copies at one comparison a document. Buckets
that still hold different components are then compared in blocks of members, a pair of
blocks a task: the blocks' sets become a matrix over shared shingles and its product
counts every intersection; only the links that connect components leave the task. So no
pair of a bucket is left out and none is emitted beyond the small buckets and the hubs.
Pairs with hubs and in small buckets pass the collision-corrected estimate of their
registers (six standard errors of slack), then the full sets decide.

Defined results
* fewer words than a shingle: the whole sequence is the only one; no words or null text:
  an empty set, linked with nothing; repeated rows are copies of each other when they
  have distinct ids, one document when they share one, with the links of all its texts;
* null ``doc_id``: its own component, returned with null ``component_id``;
* an empty table gives an empty table; extra columns are ignored by ``near_duplicates``
  and kept by ``keep_representatives``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailflow.llm.common import meeting_blocks, shuffle_parts, staged, whole_groups
from retailflow.llm.components import components, over_ids, shared_ids

BUCKETS, LOG_BUCKETS = 256, 8
BAND = 6
BANDS = BUCKETS // BAND  # 42, of 252 registers
SHINGLE = 5
MANTISSA = 10
#: Factor of the expected share of chance collisions (fixed value from the sketch's analysis).
CHANCE = 0.169919487159739093975315012348
BROADCAST_PAIRS = 500_000  # pairs (16 bytes each) up to which they are broadcast
SLACK = 6  # standard errors of the estimate
SMALL = 16  # buckets up to this many members are compared pair by pair
HUBS = 4  # documents that all members of a larger bucket meet first
BLOCK = 256  # members of a block
COLUMNS = 8192  # shingles of a block that are counted at once


def _mix(x):
    """64-bit finalizer over an array of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its word shingles."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, width: int = SHINGLE):
        import numpy as np

        self.width = width
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.weights = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def _grow(self, n: int) -> None:
        import numpy as np

        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            steps = np.full(n, self.BASE, np.uint64), np.full(n, self.inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(s) for s in steps)

    def __call__(self, text: str | None):
        import numpy as np

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(words), np.uint8)
        n = len(data)
        if n > len(self.powers):
            self._grow(2 * n)
        # hash of a word: polynomial over its bytes, from prefix sums
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        gaps = np.flatnonzero(data == 32)
        start = np.concatenate(([0], gaps + 1))
        end = np.concatenate((gaps, [n]))
        hashes = _mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))
        k = min(self.width, len(words))
        m = len(words) - k + 1
        total = np.full(m, np.uint64(k))
        for j in range(k):
            total += hashes[j : j + m] * self.weights[j]
        return np.unique(_mix(total))


def registers(hashes):
    """HyperMinHash registers of a sorted set of hashes; 0 marks an empty bucket."""
    import numpy as np

    out = np.zeros(BUCKETS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (hashes[first] << np.uint64(LOG_BUCKETS)) >> np.uint64(LOG_BUCKETS)  # smallest of each bucket
    part, exponent = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))
    zeros = 64 - LOG_BUCKETS + 1 - exponent  # leading zeros + 1
    mantissa = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out[bucket[first]] = np.clip(zeros, 1, 63).astype(np.uint16) << np.uint16(MANTISSA) | mantissa.astype(np.uint16)
    return out


def _borrow_order():
    """order[j, b]: how early empty bucket j would borrow from bucket b."""
    import numpy as np

    cell = np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS)
    return np.argsort(np.argsort(_mix(cell), axis=1), axis=1).astype(np.uint16)


def band_keys(regs, order):
    """One 64-bit key a band; empty buckets borrow a full one's register."""
    import numpy as np

    full = np.flatnonzero(regs)
    filled = regs.astype(np.uint64)
    if len(full) < BUCKETS:
        empty = np.flatnonzero(regs == 0)
        source = full[np.argmin(order[np.ix_(empty, full)], axis=1)]
        filled[empty] = regs[source].astype(np.uint64) | (source.astype(np.uint64) << np.uint64(16)) | np.uint64(1 << 40)
    bands = filled[: BANDS * BAND].reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, j] + np.uint64(j + 1))
    return key.view(np.int64)


def estimate(a, b, n_a, n_b):
    """Collision-corrected Jaccard estimates and their standard errors.

    ``a`` and ``b`` are (pairs, BUCKETS) registers, ``n_a`` and ``n_b`` set sizes.
    """
    import numpy as np

    used = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = CHANCE * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * used
    value = np.clip((equal - chance) / np.maximum(used - chance, 1e-9), 0, 1)
    return value, np.sqrt(np.maximum(value * (1 - value), 1.0 / used) / used)


def sketches(docs: DataFrame) -> DataFrame:
    """id, n_shingles, digest (of the whole set), regs, bands for each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingles, order = Shingler(), _borrow_order()
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, digests, regs, bands = [], [], [], []
                for text in batch.column(1):
                    own = shingles(text.as_py())
                    r = registers(own)
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    regs.append(r.tobytes())
                    bands.append(band_keys(r, order) if len(own) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(regs, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "digest", "regs", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, regs binary, bands array<long>")


def _attach(pairs: DataFrame, count: int, side: DataFrame, key: str) -> DataFrame:
    """Join pairs with a table by id; few pairs are sent to where the table's rows are."""
    return side.join(F.broadcast(pairs) if count <= BROADCAST_PAIRS else pairs, key)


def _passing(pairs: DataFrame, count: int, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate does not rule a link out."""
    s = sketch.select("id", "regs", "n_shingles")
    left = s.withColumnsRenamed({"id": "a", "regs": "ra", "n_shingles": "na"})
    right = s.withColumnsRenamed({"id": "b", "regs": "rb", "n_shingles": "nb"})
    hubs = _attach(pairs.select("a").distinct(), count, left, "a")
    # sizes alone rule out a link when the smaller set is too small for the union
    small = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = _attach(pairs, count, right, "b").join(hubs, "a").where(small)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            table = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb")]
            value, error = estimate(*table, *(batch.column(c).to_numpy() for c in ("na", "nb")))
            keep = pa.array(value + SLACK * error >= percent / 100)
            yield batch.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, count: int, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), F.col("text").cast("string").alias("tb"))
    hubs = texts.withColumnsRenamed({"b": "a", "tb": "ta"})
    hubs = _attach(pairs.select("a").distinct(), count, hubs, "a")
    # rows of a hub arrive together, so a task shingles it once
    both = _attach(pairs, count, texts, "b").join(hubs.hint("merge"), "a")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles, last, hub = Shingler(), None, None
        with np.errstate(over="ignore"):
            for batch in batches:
                keep = []
                for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                    if a != last:
                        last, hub = a, shingles(ta.as_py())
                    own = shingles(tb.as_py())
                    common = len(np.intersect1d(hub, own, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(hub) + len(own) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the documents of ``sketch`` that are linked with others.

    ``sketch`` holds one row for each distinct set, ``docs`` at least their texts.
    """
    spark = docs.sparkSession
    bands = sketch.select("id", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = staged(spark, bands.join(sizes, "band"), "minhash-buckets")
    # documents that meet most others become hubs first
    weight = live.groupBy("id").agg(F.sum("size").alias("weight"))
    live = staged(spark, live.join(weight, "id").select("band", "id", "size", "weight"), "minhash-live")
    # first the small buckets whole, and the large ones around a few hubs
    order = W.partitionBy("band").orderBy(F.desc("weight"), "id")
    top = live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SMALL)
    top = top.where((F.col("size") <= SMALL) | (F.col("place") <= HUBS)).select("band", "id", "place")
    top = staged(spark, top, "minhash-hubs")
    # of two hubs the earlier one is the hub
    own = top.select("band", "id", F.col("place").alias("own"))
    member = live.join(own, ["band", "id"], "left").select("band", F.col("id").alias("b"), "own")
    pairs = member.join(top.withColumnRenamed("id", "a"), "band").where("own is null or own > place")
    pairs = staged(spark, pairs.select("a", "b").distinct(), "minhash-pairs")
    near = staged(spark, _passing(pairs, pairs.count(), sketch, percent), "minhash-near")
    links = staged(spark, _verified(near, near.count(), docs, percent), "minhash-links")
    labels = components(links)
    # then what large buckets still hold of different components
    rest = live.where(F.col("size") > SMALL).join(own.drop("own"), ["band", "id"], "left_anti")
    rest = rest.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("label"))
    open_ = rest.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size"))
    rest = staged(spark, rest.join(open_.where("l0 <> l1").select("band", "size"), "band"), "minhash-open")
    if not rest.limit(1).count():
        return labels
    more = staged(spark, _block_links(rest, docs, percent), "minhash-block-links")
    return components(links.unionByName(more))


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = ids.select("id").distinct()
    return _attach(ids, ids.count(), texts, "id").dropDuplicates(["id"])


def _block_links(rest: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside large buckets: compared exactly, in blocks.

    A block's sets become a matrix over the shingles that at least two of them share; its
    product with itself counts all intersections at once. Only links that connect
    components come back, fewer than a block has members.
    """
    spark = rest.sparkSession

    def hash_texts(batches):
        import numpy as np
        import pyarrow as pa

        shingles = Shingler()
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    sets = staged(spark, _texts_of(rest, docs).mapInArrow(hash_texts, "id long, set binary"), "minhash-open-sets")
    rows = meeting_blocks(rest, ["band"], "id", BLOCK).join(sets, "id")
    rows = rows.select("group", "band", "low", "high", "side", "id", "label", "set")
    dealt = rows.repartition(shuffle_parts(spark), "group").sortWithinPartitions("group", "band", "low", "high")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for part in whole_groups(batches, "group"):
            key = np.stack([part.column(c).to_numpy() for c in ("group", "band", "low", "high")], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            found = []
            for lo, hi in zip([0, *edges], [*edges, len(key)]):
                own = part.slice(lo, hi - lo)
                side = own.column("side").to_numpy()
                cross = own.column("low")[0] != own.column("high")[0]
                own_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("set")]
                ids, labels = own.column("id").to_numpy(), own.column("label").to_numpy()
                found.extend(connecting(own_sets, ids, labels, side if cross else None, percent))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def connecting(sets: list, ids, labels, side, percent: int) -> list[tuple[int, int]]:
    """Links that connect different labels among ``sets``; with ``side``, only across it."""
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    counts = np.diff(np.concatenate((starts, [len(flat)])))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    shared = np.repeat(counts > 1, counts)
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        k = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        has = np.zeros((n, min(COLUMNS, width - low)), np.float32)
        has[owner[k], column[k] - low] = 1
        common += has @ has.T
    linked = 100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None] - common.astype(np.int64))
    linked &= (common > 0) & (labels[:, None] != labels[None])
    if side is not None:
        linked &= side[:, None] != side[None]
    parent = {x: x for x in labels.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            parent[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row.

    Two documents are linked when 100 * common shingles >= ``percent`` * all shingles.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketch = staged(spark, sketches(docs), "minhash-sketches")
    # one document for each distinct set stands for its copies
    sets = sketch.where("id is not null and digest is not null")
    same = sets.groupBy("id").agg((F.min("digest") == F.max("digest")).alias("one"))
    if not same.where("not one").isEmpty():
        return _sharing_ids(docs, percent)
    copies = staged(spark, sets.groupBy("digest").agg(F.min("id").alias("first")), "minhash-copies")
    member = sets.select("id", "digest").join(copies, "digest").select("id", "first").distinct()
    member = staged(spark, member, "minhash-members")
    single = member.where("id = first").select("id").distinct()
    chosen = staged(spark, sets.join(single, "id", "left_semi").dropDuplicates(["id"]), "minhash-sets")
    labels = linked(docs, chosen, percent)
    # a document's component: that of its set, and its own id where nothing is linked
    joined = member.join(labels.withColumnRenamed("id", "first"), "first", "left")
    named = joined.select("id", F.coalesce("component", "first").alias("label"))
    result = sketch.select("id", "n_shingles").join(named, "id", "left")
    component = F.coalesce("label", "id")
    return result.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _sharing_ids(docs: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` where one id has different texts: each text is a node of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    content = F.xxhash64("text")
    nodes = shared_ids(rows, content)
    known = nodes.withColumnRenamed("id", "_id")
    own = (rows["id"] == known["_id"]) & (content == known["content"])
    apart = rows.join(known, own, "left").select(F.coalesce("node", "id").alias("doc_id"), "text")
    found = staged(docs.sparkSession, near_duplicates(apart, percent), "minhash-apart")
    named = over_ids(found.where("doc_id is not null").select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")), nodes)
    result = found.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("node"), "left")
    return result.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group: the one with the smallest id; all columns stay."""
    lost = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_lost_id")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == F.col("_lost_id"), "left_anti")
