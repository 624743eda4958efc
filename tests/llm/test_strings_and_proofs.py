"""Long repeated strings, fill-in-the-middle and Merkle proofs: brute force, awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from retailflow.llm import fim_regex, merkle, suffix_family

SCHEMA = "doc_id long, text string"
EXTRA = ("doc", "tag", "body", "spans", "row", "n", "form", "_cut", "kind", "tree", "pos", "digest", "seen", "leaf")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def with_extra(df):
    for name in EXTRA:
        df = df.withColumn(name, F.lit("extra"))
    return df


def removed(rows, length):
    """(doc_id, bytes, bytes removed, runs, digest of the rest) by comparing all windows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if hit[k] and not (k and hit[k - 1]))
        out.append((i, len(b), sum(hit), runs, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return sorted(out, key=str)


def passages(seed, n):
    rnd = random.Random(seed)

    def word(a, b):
        return "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(a, b)))

    shared = [word(15, 60) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice([rnd.choice(shared), word(0, 30)]) for _ in range(rnd.randint(0, 5)))
        rows.append((i if rnd.random() < 0.9 else rnd.choice([None, 3]), text))
    twice = (5, "the same row twice in here, twice")
    return [*rows, (900, "a" * 100), (901, None), (902, ""), (903, "x"), twice, twice, (904, "abab" * 30)]


@pytest.mark.parametrize(
    "length,gram,hot_batch,hot,batches",
    [(20, 5, 32, 1024, 4), (20, 5, 2, 1024, 3), (20, 5, 3, 1, 4), (12, 4, 2, 0, 1), (33, 9, 32, 2, 5)],
)
def test_long_strings_equal_all_windows(spark, monkeypatch, length, gram, hot_batch, hot, batches):
    monkeypatch.setattr(suffix_family, "HOT_BATCH", hot_batch)
    monkeypatch.setattr(suffix_family, "HOT", hot)
    rows = passages(length + batches, 90)
    df = with_extra(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = suffix_family.removal_report(df, length=length, gram=gram, batches=batches).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, length)


def test_very_long_texts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_family, "CHUNK", 700)
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    rows = [(1, base), (2, "x" * 50 + base[1000:3000] + "y" * 50), (3, base[4000:] + base[:900])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = suffix_family.removal_report(df, length=200, gram=24, batches=2).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 200)


def test_family_levels_are_geometric_and_spans_are_given(spark):
    rows = passages(9, 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    index = suffix_family.family(df, 20, 5)
    sizes = []
    for k in range(6):
        index = suffix_family.insert(index, df.where(F.pmod(F.xxhash64("text"), F.lit(6)) == k))
        sizes.append([size for size, _ in index.levels])
    assert all(a > 1.5 * b for levels in sizes for a, b in zip(levels, levels[1:]))
    assert len(sizes[-1]) < 6
    out = suffix_family.remove(with_extra(df), suffix_family.long_matches(index)).collect()
    assert len(out) == len(rows) and out[0]["tag"] == "extra"
    for r in out:
        text, at, kept = (r["text"] or "").encode(), 0, b""
        for span in r["spans"] if r["spans"] else ():
            kept, at = kept + text[at : span["start"]], span["stop"]
        assert bytes(r["kept"]) == kept + text[at:]


def test_no_strings_in_an_empty_table(spark):
    assert suffix_family.removal_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_ranks_order_the_bytes():
    import numpy as np

    rnd = random.Random(1)
    data = bytes(rnd.choice(b"ab\0\xff") for _ in range(400))
    for length in (3, 8, 13, 20):
        windows = [data[k : k + length] for k in range(len(data) - length + 1)]
        order = {w: k for k, w in enumerate(sorted(set(windows)))}
        ranks = suffix_family.window_ranks(np.frombuffer(data, np.uint8), length)
        assert ranks.tolist() == [order[w] for w in windows]


# --- fill in the middle ---------------------------------------------------------

FIM = [(k, f"text {k} naïve 🦆 line\nnext \0 end " * (k % 4)) for k in range(60)]
FIM += [(None, "no id"), (None, None), (61, None), (62, ""), (63, "has <S> in it"), (64, "<P"), (64, "<P"), (65, "S>x<"), (66, "é" * 50_000)]


def middle_of(doc_id, text):
    """The contract, spelled out."""
    text, n = text or "", len(text or "")
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", lo, hi - lo, sha(out), sha(text))


def test_middles_follow_the_draws_and_restore(spark):
    df = with_extra(spark.createDataFrame(FIM, SCHEMA))
    got = sorted(map(tuple, fim_regex.fim_report(df).collect()), key=str)
    assert got == sorted((middle_of(*r) for r in FIM), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_units_other_than_code_points(spark):
    rows = [(k, "some words stand here and there " * 3) for k in range(40)] + [(99, " leading space")]
    out = fim_regex.transform(spark.createDataFrame(rows, SCHEMA), unit=r"\S+\s*", percent=100).collect()
    for r in out:
        if r["doc_id"] == 99:
            assert r["n"] is None and r["form"] == "plain"
            continue
        assert r["n"] == 18
        # cuts stand between words
        assert all(len(part) == 0 or r["text"][len(part) - 1 : len(part)] == " " for part in (r["text"][: r["prefix_chars"]],))
    restored = fim_regex.transform(spark.createDataFrame(rows, SCHEMA), percent=100).withColumn(
        "back", fim_regex.restore(F.col("output"), F.col("form"))
    )
    assert restored.where("back <> text").count() == 0


def test_middles_carry_columns_and_take_empty_tables(spark):
    df = with_extra(spark.createDataFrame(FIM[:3], SCHEMA))
    out = fim_regex.transform(df)
    assert out.columns.count("n") == 1 and {"digest", "tree"} <= set(out.columns)
    assert fim_regex.transform(df.limit(0)).count() == 0


# --- Merkle manifest -------------------------------------------------------------

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha("".join(field(v) for v in (r[0], r[3], r[2], r[4], text)))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def audited(rows):
    """The contract, spelled out for a small table."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(levels_of([leaf(r, r[1]) for r in sources[name]]))
    top = levels_of([t[-1][0] for t in trees])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for place, name in enumerate(names):
        for k, r in enumerate(sources[name]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest = leaf(r, None if r[1] is None else r[1].translate(lower) if bad else r[1])
            proof = ""
            for levels, pos in ((trees[place], k), (top, place)):
                for level in levels[:-1]:
                    low = pos // 16 * 16
                    run = level[low : low + 16]
                    proof += "".join(run[: pos - low] + run[pos - low + 1 :])
                    digest = sha("".join([*run[: pos - low], digest, *run[pos - low + 1 :]]))
                    pos //= 16
            root = top[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[place][-1][0], root, sha(proof), digest, digest == root))
    return sorted(out, key=str)


def documents(n, sources):
    rnd = random.Random(n)
    names = [None, "", "é", *[f"src{k}" for k in range(sources)]]
    rows = [
        (rnd.choice([k, k, k, None]), rnd.choice([None, "", f"Text {k} Ünï", "same"]), rnd.choice([None, "en"]),
         names[0] if rnd.random() < 0.4 else rnd.choice(names), rnd.choice([None, k]))
        for k in range(n)
    ]
    return rows + rows[:5]


@pytest.mark.parametrize("n,sources,chunk", [(700, 30, 1024), (700, 2, 7), (300, 300, 50), (1, 1, 8)])
def test_proofs_equal_whole_trees(spark, monkeypatch, n, sources, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = documents(n, sources)
    df = with_extra(spark.createDataFrame(rows, DOC).repartition(4))
    got = sorted(map(tuple, merkle.audit(df).collect()), key=str)
    assert got == audited(rows)


def test_one_source_and_one_row(spark):
    rows = [(3, "Abc", "en", "s", 3)]
    assert sorted(map(tuple, merkle.audit(spark.createDataFrame(rows, DOC)).collect())) == audited(rows)
    assert merkle.audit(spark.createDataFrame([], DOC)).count() == 0


def test_a_chunk_fetches_no_more_than_it_lacks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 64)
    rows = [(k, f"t{k}", "en", "one", k) for k in range(1000)]
    book = merkle.manifest(spark.createDataFrame(rows, DOC))
    asked = merkle.requests(book).collect()
    per_chunk = Counter(r["chunk"] for r in asked)
    # leaves of a chunk fill whole runs: nothing is asked of level 0, and 15 nodes of a level at most elsewhere
    assert {r["level"] for r in asked} == {1, 2} and max(per_chunk.values()) <= 2 * 15
    proof = merkle.prove(book, keep_proofs=True).select("doc_id", "proof", "proof_sha256").collect()
    assert all(sha(r["proof"]) == r["proof_sha256"] for r in proof)


def test_minimal_union():
    import numpy as np

    asked = {level: at.tolist() for level, at in merkle.missing(np.array([0, 17, 18]), 300)}
    assert asked[0] == [*range(1, 17), *range(19, 32)]
    # the first two nodes of level 1 are derived
    assert asked[1] == list(range(2, 16)) and asked[2] == [1]
