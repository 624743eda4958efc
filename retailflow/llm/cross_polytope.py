"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and Hadamard transforms; its hash is
the nearest of the 2d signed axes. Two such hashes make a bucket code, and a vector enters
the four most likely codes of each of four tables. Two vectors with cosine 0.98 share no
bucket with probability about 1e-7 (64 dimensions, simulated); pairs above share one more
often. Members of a bucket with equal labels are compared in double precision.

Equal vectors collapse first and count with their multiplicity. A bucket is compared in
blocks of ``block`` members, so a hot bucket spreads over many tasks. No pair is ever
emitted: a task returns, for each vector, how many vectors it found linked, and one edge
to its group there. A pair that shares several buckets counts in the first of them only,
which both vectors' code lists tell.

``axes`` hashes a code give (2d)^axes buckets a table: two suit up to about 1e8 vectors a
label, beyond that raise ``axes`` and ``tables`` together.

Defined results
* null label, or a vector that is null, zero, empty or holds null or non-finite numbers:
  no links, its own component; vectors of different lengths are never compared;
* repeated rows link with each other; rows that share a ``vec_id`` are one node whose
  links add up; null ``vec_id``: no links, null component, kept;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from retailflow.llm.common import meeting_blocks, shuffle_parts, staged, whole_groups
from retailflow.llm.components import components, over_ids, shared_ids

ROUNDS = 3  # sign flips and transforms of a rotation
RUNNERS_UP = 4  # axes considered for probing, per hash


def hadamard(x):
    """Fast Hadamard transform of the rows of ``x`` (length a power of two)."""
    import numpy as np

    n, width, h = len(x), x.shape[1], 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def probe_codes(vectors, tables: int, axes: int, probes: int, seed: int = 20):
    """(rows, tables, probes) bucket codes, the likeliest first."""
    import itertools

    import numpy as np

    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, width])
    near = min(RUNNERS_UP, width)
    combos = np.array(list(itertools.product(range(near), repeat=axes)))
    out = np.empty((n, tables, min(probes, len(combos))), np.int64)
    for t in range(tables):
        cost = np.zeros((n, len(combos)))
        code = np.zeros((n, len(combos)), np.int64)
        for a in range(axes):
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=width)) / np.sqrt(width)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, best, 1)
            axis = best * 2 + (np.take_along_axis(y, best, 1) < 0)
            cost += ((top[:, :1] - top) ** 2)[:, combos[:, a]]
            code = code * (2 * width) + axis[:, combos[:, a]]
        order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, order, 1)
    return out


def narrow(codes):
    """Codes as 32-bit numbers; where they are larger, by hash (merged buckets compare more pairs, no fewer)."""
    import numpy as np

    if codes.size and codes.max() >= 1 << 31:
        codes = (codes * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> 33 & 0x7FFFFFFF
    return codes.astype(np.int32)


def _valid(rows: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad & some)


def _first_shared(codes, i, j, table, code):
    """Whether (table, code) is the first bucket that the pairs (i, j) share."""
    import numpy as np

    first = np.ones(len(i), bool)
    for t in range(codes.shape[1]):
        both = codes[i, t][:, :, None] == codes[j, t][:, None, :]
        met = both.any(axis=(1, 2))
        own = table == t
        first &= ~(met & (t < table))
        if own.any():
            shared = np.where(both.any(axis=2), codes[i, t], np.iinfo(np.int64).max).min(axis=1)
            first &= ~own | (shared == code)
    return first


class _Found:
    """What one task has found: links per node and one edge of each node to its group."""

    def __init__(self):
        self.parts: list = []

    def add(self, nodes, weights, i, j) -> None:
        """Pairs (i, j) of positions in ``nodes`` are linked."""
        import numpy as np

        if not len(i):
            return
        n = len(nodes)
        count = np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)
        label = np.arange(n)
        while True:  # smallest position reachable
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        hit = np.flatnonzero(count)
        self.parts.append((nodes[hit], nodes[label[hit]], count[hit].astype(np.int64)))

    def batch(self):
        import numpy as np
        import pyarrow as pa

        columns = [np.concatenate(c) if self.parts else np.empty(0, np.int64) for c in (zip(*self.parts) if self.parts else [()] * 3)]
        self.parts = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other", "n"])


def _compare(rows: dict, threshold: float, found: _Found, small: int) -> None:
    """Compare the members of the (whole) buckets in ``rows``, sorted by bucket."""
    import numpy as np

    key, v, codes = rows["key"], rows["v"], rows["codes"]
    n = len(v)
    norm = np.sqrt((v * v).sum(axis=1))
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
    sizes = np.diff(np.concatenate((starts, [n])))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    little = np.repeat(sizes <= small, sizes)
    ii, jj = [], []
    for step in range(1, min(small, int(sizes.max()))):
        i = np.flatnonzero((bucket[:-step] == bucket[step:]) & little[step:])
        if not len(i):
            continue
        for part in np.array_split(i, len(i) // 20_000 + 1):
            j = part + step
            near = np.einsum("ij,ij->i", v[part], v[j]) / (norm[part] * norm[j]) >= threshold
            ii.append(part[near])
            jj.append(j[near])
    for s, size in zip(starts[sizes > small], sizes[sizes > small]):
        own = slice(s, s + size)
        cos = v[own] @ v[own].T / (norm[own, None] * norm[None, own])
        i, j = np.nonzero(np.triu(cos >= threshold, 1))
        ii.append(i + s)
        jj.append(j + s)
    if not ii:
        return
    i, j = np.concatenate(ii), np.concatenate(jj)
    # in the meeting of two different blocks only pairs across them count
    side, cross = rows["side"], rows["cross"]
    ok = ~cross[i] | (side[i] != side[j])
    i, j = i[ok], j[ok]
    for part in np.array_split(np.arange(len(i)), len(i) // 100_000 + 1):
        pi, pj = i[part], j[part]
        first = _first_shared(codes, pi, pj, rows["table"][pi], rows["code"][pi])
        used = np.unique(np.concatenate((pi[first], pj[first])))
        place = np.searchsorted(used, pi[first]), np.searchsorted(used, pj[first])
        found.add(rows["node"][used], rows["mult"][used], *place)


def linked_counts(
    reps: DataFrame, threshold: float, tables: int, axes: int, probes: int, block: int
) -> DataFrame:
    """node, other, n: partial link counts and group edges of the vectors of ``reps``
    (node, label, mult, v)."""
    spark = reps.sparkSession
    # vectors travel in the type they came in; they are compared in double
    single = isinstance(reps.schema["v"].dataType.elementType, FloatType)
    precision = "float32" if single else "float64"

    def codes_of(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            label, node, mult = (batch.column(c) for c in ("label", "node", "mult"))
            values = batch.column("v")
            lengths = np.diff(np.asarray(values.offsets))
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                pick = pa.array(rows)
                v = np.asarray(values.take(pick).flatten(), dtype=np.float64).reshape(-1, d)
                codes = np.concatenate([probe_codes(p, tables, axes, probes) for p in np.array_split(v, len(v) // 4096 + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        node.take(pick),
                        label.take(pick),
                        mult.take(pick),
                        pa.array(np.full(len(rows), d, np.int32)),
                        pa.array([x.tobytes() for x in v.astype(precision)], pa.binary()),
                        pa.array(narrow(codes).reshape(len(rows), -1).tolist(), pa.list_(pa.int32())),
                    ],
                    names=["node", "label", "mult", "dim", "v", "codes"],
                )

    label_type = reps.schema["label"].dataType.simpleString()
    schema = f"node long, label {label_type}, mult long, dim int, v binary, codes array<int>"
    coded = staged(spark, reps.select("label", "node", "mult", "v").mapInArrow(codes_of, schema), "vectors-coded")
    bucket = ["label", "dim", "tab", "code"]
    own = ["node", "label", "dim"]
    each = coded.select(*own, (F.size("codes") / tables).alias("_per"), F.posexplode("codes").alias("_place", "code"))
    each = each.withColumn("tab", F.floor(F.col("_place") / F.col("_per")).cast("int")).drop("_place", "_per")
    # sizes and meetings are found on narrow rows; vectors only go where they meet another
    sizes = each.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = meeting_blocks(each.join(sizes, bucket), bucket, "node", block)
    rows = rows.join(coded, own)
    rows = rows.select("group", "dim", "tab", "code", "low", "high", "side", "node", "mult", "v", "codes", F.xxhash64("label").alias("label"))
    dealt = rows.repartition(shuffle_parts(spark), "group").sortWithinPartitions("dim", "group", "label", "tab", "code", "low", "high")

    def compare(batches):
        import numpy as np

        def unpack(part):
            get = lambda c: part.column(c).to_numpy()
            key = np.stack([get(c).astype(np.int64) for c in ("dim", "group", "label", "tab", "code", "low", "high")], axis=1)
            d = int(key[0, 0])
            vs, codes = part.column("v").combine_chunks(), part.column("codes").combine_chunks()
            return {
                "key": key,
                "v": np.frombuffer(b"".join(vs.to_pylist()), precision).astype(np.float64).reshape(-1, d),
                "codes": np.asarray(codes.flatten()).astype(np.int64).reshape(len(key), tables, -1),
                "table": get("tab"),
                "code": get("code"),
                "side": get("side"),
                "cross": get("low") != get("high"),
                "node": get("node"),
                "mult": get("mult"),
            }

        def flush(part):
            dims = part.column("dim").to_numpy()
            for lo, hi in zip(*_runs(dims)):
                _compare(unpack(part.slice(lo, hi - lo)), threshold, found, small=48)
            return found.batch()

        found = _Found()
        for part in whole_groups(batches, "group"):
            yield flush(part)

    return dealt.mapInArrow(compare, "node long, other long, n long")


def _runs(values):
    """Starts and ends of the runs of equal values."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.concatenate((starts[1:], [len(values)]))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, tables: int = 4, axes: int = 2, probes: int = 4, block: int = 1024
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("v"))
    keyed = _valid(rows).select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    light = staged(spark, keyed.select("id", "label", "h1", "h2"), "vectors-keys")
    # equal vectors: the smallest id stands for all of them
    same = ["label", "h1", "h2"]
    alike = light.groupBy("id").agg((F.min(F.struct(*same)) == F.max(F.struct(*same))).alias("one"))
    if not alike.where("not one and id is not null").isEmpty():
        return _sharing_ids(vectors, threshold, tables, axes, probes, block)
    groups = staged(spark, light.groupBy(*same).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult")), "vectors-groups")
    g = groups.withColumnsRenamed({c: f"_{c}" for c in same})
    match = [keyed["id"] == g["node"]] + [keyed[c] == g[f"_{c}"] for c in same]
    reps = keyed.join(g, match).select("node", "label", "mult", "v").dropDuplicates(["node", "label", "mult"])
    found = staged(spark, linked_counts(reps, threshold, tables, axes, probes, block), "vectors-found")
    labels = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    per_node = groups.join(counts, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    per_node = per_node.select(
        *same, (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    per_id = light.join(per_node, same).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    result = rows.select(F.col("id").alias("vec_id")).join(per_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _sharing_ids(vectors: DataFrame, *options) -> DataFrame:
    """``near_duplicates`` where one id has different vectors: each is a node of its own.

    An id's links are those of all its vectors together.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("embedding"))
    content = F.xxhash64("label", "embedding")
    nodes = shared_ids(rows, content)
    known = nodes.withColumnRenamed("id", "_id")
    own = (rows["id"] == known["_id"]) & (content == known["content"])
    apart = rows.join(known, own, "left").select(F.coalesce("node", "id").alias("vec_id"), "label", "embedding")
    found = staged(vectors.sparkSession, near_duplicates(apart, *options), "vectors-apart")
    each = found.where("vec_id is not null").select(F.col("vec_id").alias("node"), F.col("component_id").alias("component"), "n_links")
    named = staged(vectors.sparkSession, over_ids(each, nodes), "vectors-named")
    links = each.select("node", "n_links").distinct().join(named, "node").groupBy("id").agg(
        F.sum("n_links").alias("n_links"), F.min("component").alias("component")
    )
    result = rows.select(F.col("id").alias("vec_id")).join(links, F.col("vec_id") == F.col("id"), "left")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
