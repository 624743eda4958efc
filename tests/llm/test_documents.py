"""Operators on documents: brute force on the small tables, then awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from retailflow.llm import best_fit, cube_mix, hyperminhash, language_id, line_dedup, quality_mcd, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 977} tail{k % 89}" for k in range(60_000))

#: Awkward documents: nulls everywhere, empty, blank and very long texts, repeated rows,
#: ties, odd white space, and extra columns named like internal ones.
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b ", "en", None),
    (4, "one two three", None, "a"),
    (5, "One two  three", "de", "b"),
    (None, "no id but some words here", "en", "b"),
    (None, None, None, None),
    (6, "same row twice in the table, line\nsecond line is long enough", "en", "b"),
    (6, "same row twice in the table, line\nsecond line is long enough", "en", "b"),
    (7, "Second LINE is long enough \x0c\nother", "en", "c"),
    (8, "\tsecond line is long enough\n\nsecond line is long enough", "en", "c"),
    (9, LONG, "en", "c"),
    (10, LONG + " end", "en", None),
    (11, "naïve café  x #$% &|<> ünï", "fr", "a"),
    (12, "a  double  space and trailing ", "fr", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, schema)
    for name in ("size", "hi", "id", "grp", "prob", "n_words", "label", "band", "rank", "_words", "keys", "target"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def schema_of(df):
    return df.select("doc_id", "text", "lang", "source")


# -- quality rules -------------------------------------------------------------


def stats_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        n < 50 or 100 * len(repeated) > 50 * n,
    )


def test_quality_statistics_and_verdicts(spark, docs, texts):
    rows = queries.op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:7]) == stats_of(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    # labelled documents: good ones stay, bad ones go
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(quality[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(kept for q, kept in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(not kept for q, kept in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)


def test_quality_estimate_resists_contamination(spark):
    import random

    rng = random.Random(4)
    words = ["stone", "river", "and", "the", "of", "light", "walking", "a", "old", "house", "morning", "we"]
    rows = []
    for k in range(300):
        n = rng.randint(80, 300)
        text = " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
        if k % 5 == 0:  # a fifth of the group is symbol junk
            text = text.replace(" ", " ### ")
        rows.append((k, text, "en", "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_mcd.quality_verdicts(df).where("kept").collect()}
    assert kept == {k for k in range(300) if k % 5}


def test_repeated_words_with_colliding_hashes(spark, monkeypatch):
    # one hash for all windows: every text takes the path that compares the words
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_mcd.F, "xxhash64", lambda *c: F.lit(1 << 40).cast("long"))
    samples = ["a b c a b c", "a b c d e f g", "x x x x x", "a b c d a b c d a b", "a b", "a b c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(samples)], "doc_id long, text string")
    for r in quality_mcd.base_stats(df).collect():
        assert r["n_repeat_words"] == stats_of(samples[r["doc_id"]])[4]


def test_quality_odd_rows(odd):
    rows = quality_mcd.quality_verdicts(odd).collect()
    want = Counter((d, *stats_of(t)) for d, t, _, _ in ROWS)
    assert Counter(tuple(r[:7]) for r in rows) == want
    kept = quality_mcd.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {9, 10}
    assert quality_mcd.quality_verdicts(odd.limit(0)).count() == 0


# -- line dedup ----------------------------------------------------------------


def deduped(rows, min_docs=3, min_chars=20):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -(2**63) if doc is None else doc
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and own != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(rows):
    return Counter((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in rows)


def test_line_dedup_odd_rows(odd):
    want = digests(deduped([r[:2] for r in ROWS]))
    assert Counter(map(tuple, line_dedup.line_report(odd).collect())) == want
    cleaned = line_dedup.clean(odd)
    assert cleaned.columns == odd.columns
    assert Counter(r["text"] or "" for r in cleaned.collect()) == Counter(t for *_, t in deduped([r[:2] for r in ROWS]))
    assert line_dedup.line_report(odd.limit(0)).count() == 0


def state(index):
    """Counts and filter members of an index, for comparison."""
    repeated = {tuple(r) for r in index.repeated.select("hi", "lo", "n_docs", "max_doc").collect()}
    filters = {r["shard"]: line_dedup.CuckooFilter.of(r) for r in index.filters.collect()}
    import numpy as np

    for hi, lo, _, _ in repeated:
        assert filters[hi % index.shards].has(np.array([hi]), np.array([lo]))[0]
    return repeated, sum(int((f.table > 0).sum()) + len(f.stash) for f in filters.values())


def test_line_index_is_reversible(docs):
    docs = docs.select("doc_id", "text")
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = line_dedup.build_index(first)
    grown = line_dedup.insert(index, second)
    assert state(grown)[0] == state(line_dedup.build_index(docs))[0]
    back = line_dedup.delete(grown, second.select("doc_id"))
    assert state(back) == state(index)


def test_cuckoo_filter_overflow_and_removal():
    import numpy as np

    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    full = line_dedup.CuckooFilter(64)  # 256 slots for 3000 keys: most go to the stash
    full.add(hi, lo)
    assert full.has(hi, lo).all() and full.stash
    full.remove(hi, lo)
    assert not full.table.any() and not full.stash


# -- near-duplicates -----------------------------------------------------------


def shingle_sets(rows):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        out[doc] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    return out


def grouped(sets, percent):
    """Components by comparing all pairs that share a shingle."""
    holders, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        common = Counter(o for s in sets[d] for o in holders[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(docs, texts, percent):
    sets = shingle_sets(texts.items())
    want = grouped(sets, percent)
    rows = hyperminhash.near_duplicates(docs, percent).collect()
    assert {tuple(r) for r in rows} == {(d, len(sets[d]), want[d], want[d] == d) for d in texts}


def test_near_duplicates_large_group(spark):
    import random

    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for k in range(120):  # copies of one text, each with its own two words changed
        words = list(base)
        for _ in range(2):
            words[rng.randrange(200)] = f"own{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(k, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 7, 30])))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = grouped(shingle_sets(rows), 85)
    assert {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(df, 85).collect()} == want


def test_near_duplicates_odd_rows(odd):
    rows = hyperminhash.near_duplicates(odd).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert (by_id[5]["component_id"], by_id[5]["kept"]) == (4, False)  # three words, A-Z lower-cased
    assert (by_id[10]["component_id"], by_id[9]["kept"]) == (9, True)
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[k]["n_shingles"] == 0 and by_id[k]["component_id"] == k for k in (1, 2, 3))
    kept = hyperminhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in ROWS if r[0] not in (5, 10))
    assert hyperminhash.near_duplicates(odd.limit(0)).count() == 0


def test_registers_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for similarity in (0.3, 0.6, 0.9):
        union = rng.integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2)
        common = int(len(union) * similarity)
        half = (len(union) - common) // 2
        a, b = np.sort(union[: common + half]), np.sort(np.concatenate((union[:common], union[common + half :])))
        ra, rb = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
        value, error = hyperminhash.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))
        assert abs(value[0] - similarity) < 5 * error[0]


# -- language ------------------------------------------------------------------


def test_language_held_out_accuracy(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op3_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_unseen_words(spark):
    train = [(k, t, x) for k in range(40) for t, x in (("straße häuser möchte schön gehen", "de"), ("the houses which they thought", "en"))]
    rows = [(i, *r[1:]) for i, r in enumerate(train)]
    rows += [(900, "schöner größe", None), (901, "thinking thought", None), (902, "123 ...", None), (903, None, "en"), (None, "schön", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert (got[900], got[901], got[902], got[903], got[None]) == ("de", "en", "und", "und", "de")
    assert {r["lang_pred"] for r in language_id.identify(df.where("doc_id >= 900")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def grams_of(word, n):
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def test_language_of_text_without_letters(spark):
    rows = [(k, "some plain words", "en") for k in range(8)] + [(100, "½ ² ①", None), (101, "Ⅷ ⅷ 42 _ -", None), (102, "ª", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # numbers that look like letters are none, an ordinal indicator is one
    assert got[100] == ("und", 0.0) and got[101] == ("und", 0.0) and got[102][0] == "en"


def test_language_learns_from_text_without_spaces(spark):
    one, two = "天地玄黄宇宙洪荒" * 40, "いろはにほへとちりぬるを" * 40
    rows = [(k, one if k % 2 else two, "zh" if k % 2 else "ja") for k in range(40)]
    rows += [(1000, "宇宙洪荒" + "天地", None), (1001, "ちりぬるを" + "いろは", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[1000], got[1001]) == ("zh", "ja")


def test_near_duplicates_of_ids_with_several_texts(spark):
    def text(seed, *changes):
        words = [f"w{seed}x{k}" for k in range(60)]
        for k in changes:
            words[k] = "changed"
        return " ".join(words)

    rows = [(1, text("a")), (1, text("b")), (2, text("a", 59)), (3, text("b", 59)), (4, text("c")), (1, text("a"))]
    rows += [(9, text("d")), (9, text("e")), (7, text("d", 59)), (8, text("e", 59)), (None, text("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(df, 80).collect()]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 7: 7, 8: 7, 9: 7}
    assert sorted(got, key=str) == sorted(((i, want.get(i), i is None or want[i] == i) for i, _ in rows), key=str)
    kept = {r["doc_id"] for r in hyperminhash.keep_representatives(df, 80).collect()}
    assert kept == {1, 4, 7, None}


def test_language_uses_all_counts(spark, docs):
    import math

    letters = regex.compile(r"\p{L}+")
    some = docs.where("doc_id % 5 = 0").select("doc_id", "text", "lang").limit(120)
    rows = [tuple(r) for r in some.collect()] + [(10**9, "zzq qqqx 123", None), (10**9 + 1, "the the", None)]
    counts = defaultdict(Counter)  # (size, entry) -> language -> n
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            for word in letters.findall(text.lower()):
                counts[0, word][lang] += 1
                for size in range(1, 6):
                    for gram in grams_of(word, size):
                        counts[size, gram][lang] += 1
    totals = defaultdict(Counter)
    for (size, _), c in counts.items():
        totals[size].update(c)
    langs = sorted(totals[0])

    def vector(size, entry):
        return [math.log(counts[size, entry][x] + 0.5) - math.log(totals[size][x] + 1) for x in langs]

    def of(word):
        if (0, word) in counts:
            return vector(0, word)
        for size in range(5, 0, -1):
            hits = [vector(size, g) for g in grams_of(word, size) if (size, g) in counts]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits)]
        return [0.0] * len(langs)

    want = {}
    for doc, text, _ in rows:
        words = letters.findall(text.lower())
        total = [sum(x) for x in zip(*map(of, words))]
        best = max(range(len(langs)), key=lambda k: total[k])
        weight = min(len(words), 10) / len(words)
        want[doc] = langs[best], 1 / sum(math.exp((x - total[best]) * weight) for x in total)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for max_words in (100_000, 60):
        for r in language_id.identify(df, max_words=max_words).collect():
            assert r["lang_pred"] == want[r["doc_id"]][0]
            assert abs(r["score"] - want[r["doc_id"]][1]) < 1e-9


def test_added_tokens_inside_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    encode = best_fit.make_encoder(queries.tokenizer_path(), added_tokens=True)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for token in added:
        for text in (token, f"one {token} two", f"one{token}{token}two  three", f"{token} ", token[:-1], token.upper()):
            ids = plain.encode(text, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids)}I", encode(text))) == ids, text


# -- mixing --------------------------------------------------------------------


def waterfill(sizes, weights, most):
    goal, fixed = sum(sizes), set()
    while True:
        rest = goal - sum(most * sizes[k] for k in fixed)
        open_ = [k for k in range(len(sizes)) if k not in fixed]
        level = rest / sum(weights[k] for k in open_) if open_ else 0
        over = {k for k in open_ if weights[k] * level > most * sizes[k]}
        if not over:
            return [most * s if k in fixed else weights[k] * level for k, s in enumerate(sizes)]
        fixed |= over


def check_mix(result, rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    targets = waterfill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    source_of = {}
    for doc, text, source in rows:
        source_of.setdefault((doc, len(WORD.findall(text or ""))), []).append(source)
    taken, largest = Counter(), Counter()
    assert len(result) == len(rows)
    for r in result:
        source = next(s for s in source_of[r["doc_id"], r["size"]] if size[s] == r["source_size"])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(targets[order.index(source)], rel=1e-9)
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s, t in zip(order, targets):
        assert abs(taken[s] - t) <= largest[s]


def test_mix_meets_targets(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    result = queries.op6_mix_sources(spark, SF).collect()
    check_mix(result, rows)
    again = cube_mix.mix(docs.repartition(5), block=64)  # small blocks: several rounds
    check_mix(again.collect(), rows)
    assert sorted(map(tuple, cube_mix.mix(docs.repartition(3)).collect())) == sorted(map(tuple, result))


def test_mix_odd_rows(odd):
    check_mix(cube_mix.mix(odd).collect(), [(d, t, s) for d, t, _, s in ROWS])
    staged = cube_mix.sample_stage(odd)
    assert staged.columns == odd.columns
    assert max(Counter(r["doc_id"] for r in staged.collect()).values()) <= 6
    assert cube_mix.mix(odd.limit(0)).count() == 0


def test_flight_keeps_totals():
    import random

    rng = random.Random(5)
    size = [rng.randint(1, 3000) for _ in range(500)]
    prob = [0.37] * 500
    out = cube_mix.fly(size, list(prob), 9)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(prob))
    assert sum(s * p for s, p in zip(size, out)) == pytest.approx(sum(s * p for s, p in zip(size, prob)))


# -- packing -------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


def check_packing(rows, documents, capacity=1024):
    t = tokenizer()
    want = Counter()
    for doc, text in documents:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for piece, (start, n) in enumerate(best_fit.cut(len(ids), capacity)):
            want[doc, piece, start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(bins) if room >= n]
        if fitting:
            k = min(fitting, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_packing_is_best_fit_decreasing(spark, texts):
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    assert check_packing(rows, texts.items()) == plain_best_fit([r["length"] for r in rows], 1024)


def test_packing_runs_equal_item_by_item():
    import random

    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        runs = best_fit.best_fit_runs(dict(Counter(lengths)), capacity)
        fill = defaultdict(list)
        for length, _, n, first, each, offset in runs:
            for k in range(n):
                fill[first + k // each].append((offset + k % each * length, length))
        for members in fill.values():
            assert sum(n for _, n in members) <= capacity
            assert all(o == sum(n for _, n in sorted(members)[:k]) for k, (o, _) in enumerate(sorted(members)))
        assert len(fill) == plain_best_fit(lengths, capacity)


def test_packing_odd_rows(odd):
    extra = [(20, "tab\there  x"), (21, "<|endoftext|> it's 3 o'clock"), (22, "a b  c\x1cd  "), (23, "nul \x00 byte")]
    rows = odd.select("doc_id", "text", "size").unionByName(
        odd.sparkSession.createDataFrame([(*r, "") for r in extra], "doc_id long, text string, size string")
    )
    check_packing(best_fit.pack(rows, queries.tokenizer_path()).collect(), [r[:2] for r in ROWS] + extra)
    with_ids = best_fit.pack(rows, queries.tokenizer_path(), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)
    assert best_fit.pack(odd.limit(0), queries.tokenizer_path()).count() == 0
