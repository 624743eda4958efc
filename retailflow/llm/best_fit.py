"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Lengths are integers up to the capacity, so best fit decreasing needs only how many
pieces there are of each length: that histogram (at most ``capacity`` numbers, however
large the corpus) is packed on the driver as runs. A segment tree over remaining
capacities finds the tightest open bin in logarithmic time; bins with equal remaining
capacity are kept as ranges, and a range takes pieces of one length in one step. The
outcome is that of best fit decreasing over the whole corpus, piece by piece.

The pieces then look up their place: the rank of a piece among those of its length
(task-local counters plus per-task offsets, no sort) falls into exactly one run.

Defined results
* null or empty text: the one end token; repeated rows are packed one by one;
* only documents longer than the capacity are cut, the remainder being the first piece;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailflow.llm.common import staged, worker_cache

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "task int, local_rank long"
)
CACHE_CHUNKS = 1_000_000  # tokenized chunks remembered per worker process


class _Chunks(dict):
    """Chunk of text -> its token ids as little-endian bytes, made when first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk):
        import numpy as np

        if len(self) >= CACHE_CHUNKS:
            self.clear()
        ids = self[chunk] = np.array(self.encode(chunk), dtype="<u4").tobytes()
        return ids


def make_encoder(path: str, added_tokens: bool = False):
    """text -> token ids (bytes of unsigned 32-bit) by the tokenizer file at ``path``.

    A byte-level BPE never merges across a space that starts a word, so a text is cut
    there and every chunk is looked up in a cache; chunks not met before are encoded
    over the vocabulary of the file, whose ids are its merge ranks. Texts with other
    white space around spaces go through the tokenizer whole. Ids are those of
    ``Tokenizer.encode``; with ``added_tokens`` at its default setting, where the string of an
    added token is its one id (such texts go through it whole), else that is ordinary text.
    """
    import re

    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added_tokens
    # bytes that are not printable stand in the vocabulary as characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = whole.get_added_tokens_decoder().values()
    special = {t.content for t in added}
    ranks = {bytes(byte_of[c] for c in s): i for s, i in whole.get_vocab().items() if s not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed for this vocabulary
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    chunks = _Chunks(fast.encode_ordinary)
    strings = [re.escape(t.content) for t in added if t.content and added_tokens]
    odd = re.compile("|".join([r" (?:\s|$)|\x00", *strings]))

    def encode(text: str) -> bytes:
        if odd.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(chunks.__getitem__, text.replace(" ", "\0 ").split("\0")))

    return encode


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the remainder comes first."""
    first = n_ids % capacity or capacity
    if n_ids <= capacity:
        return [(0, n_ids)]
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenize(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds the ids themselves (``ids`` binary)."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = worker_cache(f"encoder:{added_tokens}:{path}", lambda: make_encoder(path, added_tokens))
        end = np.array([end_id], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(own), task, int(seen[length]))
                    rows.append((*row, own) if with_ids else row)
                    seen[length] += 1
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
                types = [kinds[x.split()[1]] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity: is a bin open there?"""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.width)

    def set(self, remaining: int, value: bool) -> None:
        k = self.width + remaining
        self.open[k] = value
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity of at least ``least`` with an open bin."""
        k = self.width + least
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, pieces, first bin, pieces a bin, first offset):
    the pieces of a length with ranks from ``first rank`` on fill consecutive bins from
    ``first bin`` on, ``pieces a bin`` each, starting there at ``first offset``.
    """
    tree = RemainingTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list = []
    bins = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            ranges.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # new bins, as many as the rest needs
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = ranges[room].pop()
                if not ranges[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                # the last bin of this length takes what is left; it is fewer than ``each``
                runs.append((length, rank, left, first, left, capacity - room))
                put(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(room, first, n)
    return runs


def _with_rank(pieces: DataFrame) -> DataFrame:
    """Global rank of each piece among those of its length: task offset + local rank."""
    sizes = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return pieces.join(offsets, ["length", "task"]).withColumn("rank", F.col("_offset") + F.col("local_rank"))


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    pieces = staged(spark, tokenize(docs, path, capacity, end_id, with_ids, added_tokens), "pack-pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = best_fit_runs(counts, capacity)
    table: dict[int, list] = {}
    for run in runs:
        table.setdefault(run[0], []).append(run)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        known = {k: np.array(v, dtype=np.int64) for k, v in table.items()}
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                mine, r = length == value, known[int(value)]
                k = rank[mine]
                run = r[np.searchsorted(r[:, 1], k, side="right") - 1]
                inside = k - run[:, 1]
                seq[mine] = run[:, 3] + inside // run[:, 4]
                at[mine] = run[:, 5] + inside % run[:, 4] * value
            columns = [batch.column(c) for c in names] + [pa.array(seq), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = _with_rank(pieces).select(*names, "rank")
    schema = ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
