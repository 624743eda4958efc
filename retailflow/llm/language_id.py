"""Language identification by words first, then ever shorter character n-grams.

Training counts every word of the labelled documents per language; n-grams are counted
on the distinct words, weighted by how often those occur. All counts are kept, in written
tables. The most frequent words, at most ``max_words`` over all languages, are sent to all
tasks and score most of a text there; its other words are joined with the tables, and
their scores are added per document. ``max_words`` moves work, not results.

A text's words are scored by their log frequency in each language; a word that no training
text holds by the mean log frequency of its longest known n-grams (5, 4, 3, 2, then 1
characters, word ends marked). The best sum wins; the score is the posterior after at
most ten words' worth of evidence, so short and doubtful texts score lower.

Defined results
* null text, or one without a letter: ``und`` with score 0; the same if there is nothing
  to learn from;
* documents with null ``lang`` or in the held-out fold teach nothing; null ``doc_id`` is
  not held out and teaches nothing; repeated rows count as often as they occur;
* an empty table gives an empty table; extra columns are ignored; ties go to the language
  that is first in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailflow.llm.common import small_side, staged

LONGEST = 5
EVIDENCE = 10  # words


#: A letter, in training (JVM) and prediction alike; words are runs of them.
LETTER = r"\p{L}"


def _grams(word: str, n: int, most: int = 10_000):
    """Lists of at most ``most`` n-grams of a word with marked ends."""
    marked = f"^{word}$"
    for low in range(0, len(marked) - n + 1, most):
        yield [marked[k : k + n] for k in range(low, min(low + most, len(marked) - n + 1))]


def count_words(docs: DataFrame) -> DataFrame:
    """lang, entry, n: how often each lower-case word occurs in each language."""
    words = F.explode(F.split(F.lower("text"), f"[^{LETTER}]+"))
    return docs.select("lang", words.alias("entry")).where("entry <> ''").groupBy("lang", "entry").agg(
        F.count(F.lit(1)).alias("n")
    )


def count_grams(words: DataFrame) -> DataFrame:
    """lang, size, entry, n: n-grams of the words, weighted by the words' counts."""

    def run(batches):
        from collections import defaultdict

        import pyarrow as pa

        def out():
            keys, n = zip(*total.items())
            lang, size, entry = zip(*keys)
            columns = [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(entry, pa.string())]
            total.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["lang", "size", "entry", "n"])

        total: dict = defaultdict(int)
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "entry", "n"))):
                for size in range(1, LONGEST + 1):
                    for grams in _grams(word, size):
                        for gram in grams:
                            total[lang, size, gram] += n
                        if len(total) > 500_000:
                            yield out()
        if total:
            yield out()

    rows = words.select("lang", "entry", "n").mapInArrow(run, "lang string, size int, entry string, n long")
    return rows.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Entries of each group down to the lowest count that leaves at most ``most``.

    The cut is found on how many entries have each count, so no group is sorted whole;
    entries of equal count stay or go together.
    """
    sizes = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_held"))
    down_to = F.sum("_held").over(W.partitionBy(*keys).orderBy(F.desc("n")))
    cuts = sizes.withColumn("_upto", down_to).where(F.col("_upto") <= most)
    cuts = cuts.groupBy(*keys).agg(F.min("n").alias("least"))
    return counts.join(cuts, keys).where("n >= least").drop("least")


class Model:
    """Counts of words and n-grams as written tables, and the most frequent words."""

    def __init__(self, words: DataFrame, grams: DataFrame, totals: dict, max_words: int):
        self.words, self.grams, self.totals = words, grams, totals
        self.languages = sorted({lang for _, lang in totals})
        top = _most_frequent(words, ["lang"], max_words // max(1, len(self.languages))).select("entry").distinct()
        # at most ``max_words`` entries, each with its counts in all languages
        self.frequent = _by_entry(words.join(top, "entry", "left_semi"), ["entry"])

    def vector(self, size: int):
        """Log frequencies by language of an entry with ``counts``; none counts as half an occurrence."""
        from math import log

        total = [F.lit(log(self.totals.get((size, x), 0) + 1)) for x in self.languages]
        n = [F.coalesce(F.try_element_at("counts", F.lit(x)), F.lit(0)) for x in self.languages]
        return F.array(*[F.log(k + F.lit(0.5)) - t for k, t in zip(n, total)])

    def broadcast(self):
        import numpy as np

        rows = self.frequent.select("entry", self.vector(0).alias("vector")).collect()
        table = np.array([r["vector"] for r in rows], float).reshape(len(rows), len(self.languages))
        return {r["entry"]: k for k, r in enumerate(rows)}, table


def _by_entry(counts: DataFrame, keys: list[str]) -> DataFrame:
    """An entry's counts in all languages as one map."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))


def train(labelled: DataFrame, max_words: int = 100_000) -> Model:
    """Count documents with text and lang; only totals come to the driver."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = staged(spark, count_words(rows), "language-words")
    grams = staged(spark, count_grams(words), "language-grams")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit(0).alias("size"), "lang", "n")
    totals = totals.unionByName(grams.groupBy("size", "lang").agg(F.sum("n").alias("n")))
    total = {(r["size"], r["lang"]): r["n"] for r in totals.collect()}  # a row for each language and size
    return Model(words, grams, total, max_words)


def back_off(words: DataFrame, model: Model) -> DataFrame:
    """word, vector: mean of the longest known n-grams of words without a count."""
    spark = words.sparkSession

    def cut(size):
        def run(batches):
            import pyarrow as pa

            def out():
                columns = [pa.array(x, pa.string()) for x in (names, grams)]
                names.clear()
                grams.clear()
                return pa.RecordBatch.from_arrays(columns, names=["word", "entry"])

            names: list = []
            grams: list = []
            for batch in batches:
                for word in batch.column(0):
                    # a very long word is not repeated with each of its n-grams at once
                    for found in _grams(word.as_py(), size, 1000):
                        grams.extend(found)
                        names.extend([word.as_py()] * len(found))
                        if len(names) > 50_000 or len(names) * len(word.as_py()) > 16_000_000:
                            yield out()
            yield out()

        return run

    parts, left = [], words
    for size in range(LONGEST, 0, -1):
        own = left.mapInArrow(cut(size), "word string, entry string")
        known = model.grams.where(F.col("size") == size).join(own.select("entry").distinct(), "entry", "left_semi")
        vectors = _by_entry(known, ["entry"]).select("entry", model.vector(size).alias("vector"))
        mean = [F.avg(F.col("vector")[k]) for k in range(len(model.languages))]
        found = own.join(vectors, "entry").groupBy("word").agg(F.array(*mean).alias("vector"))
        parts.append(staged(spark, found, "language-unseen"))
        left = staged(spark, left.join(parts[-1], "word", "left_anti"), "language-left")
        if left.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def held_out(doc_id):
    """The test fold: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents not held out."""
    spark = docs.sparkSession
    fold = held_out(F.col("doc_id"))
    model = train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold), **options)
    n_langs = len(model.languages)
    shared = spark.sparkContext.broadcast(model.broadcast())

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import regex
        from pyspark import TaskContext

        letters = regex.compile(f"{LETTER}+")
        index, table = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, sizes, sums, others = [], [], [], []
            for text in batch.column(2):
                words = letters.findall(text.as_py() or "") if n_langs else []
                at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
                sums.append(table[at[at >= 0]].sum(axis=0).tolist())
                others.append(list(Counter(words[k] for k in np.flatnonzero(at < 0)).items()))
                sizes.append(len(words))
                rows.append(row)
                row += 1
            columns = [batch.column(0), batch.column(1), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64())]
            columns.append(pa.array(sums, pa.list_(pa.float64())))
            columns.append(pa.array(others, pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "row", "n_words", "total", "others"])

    rows = docs.select("doc_id", fold.alias("held_out"), F.lower(F.col("text").cast("string")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_words long, total array<double>, others map<string,long>"
    scored = staged(spark, rows.mapInArrow(run, schema), "language-scored")
    if n_langs:
        scored = _with_others(scored, model)
    best = F.array_max("total")
    weight = F.least("n_words", F.lit(EVIDENCE)) / F.col("n_words")
    odds = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp((x - best) * weight))
    names = F.array(*[F.lit(x) for x in model.languages]).cast("array<string>")
    any_word = (F.col("n_words") > 0) & F.lit(n_langs > 0)
    return scored.select(
        "doc_id",
        "held_out",
        F.when(any_word, F.try_element_at(names, F.array_position("total", best).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(any_word, 1 / odds).otherwise(0.0).alias("score"),
    )


def _with_others(scored: DataFrame, model: Model) -> DataFrame:
    """Adds the scores of the words that were not sent to the tasks."""
    spark = scored.sparkSession
    others = scored.select("row", F.explode("others").alias("word", "times"))
    distinct = staged(spark, others.select("word").distinct(), "language-others")
    counted = _by_entry(model.words.join(distinct, F.col("entry") == F.col("word"), "left_semi"), ["entry"])
    counted = staged(spark, counted.select(F.col("entry").alias("word"), model.vector(0).alias("vector")), "language-counted")
    unseen = staged(spark, distinct.join(counted, "word", "left_anti"), "language-left")
    vectors = staged(spark, counted.unionByName(back_off(unseen, model)), "language-vectors")
    sums = [F.sum(F.col("times") * F.col("vector")[k]) for k in range(len(model.languages))]
    added = others.join(small_side(vectors), "word").groupBy("row").agg(F.array(*sums).alias("added"))
    total = F.when(F.col("added").isNull(), F.col("total")).otherwise(F.zip_with("total", "added", lambda x, y: x + y))
    return scored.drop("others").join(added, "row", "left").withColumn("total", total)
