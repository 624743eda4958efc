"""Fill-in-the-middle transformation by repeated-capture matching.

One ``regex.fullmatch`` of ``(unit)*`` on a text keeps every repetition of the group:
``match.ends(1)`` holds the end of each unit, its length is the number of units, and the
two cuts are looked up in it; no loop walks the text. Where the cuts stand and which form
a document takes comes from a hash of its ``doc_id``, so reruns agree and rows need no
order. Only the text goes to Python, and two offsets come back; pieces are cut and put
together in the JVM. A text's match takes some sixty bytes a unit, one text at a time.

Forms, with ``marks`` ``<P> <S> <M>``: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>``
middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text alone.
A text that holds a mark stays plain, so ``restore`` finds the right marks.

Defined results
* null and empty texts: no units, plain, empty output; a text that is no sequence of units
  (possible for other units than a code point): null ``n``, plain;
* null ``doc_id`` is drawn like an empty id; rows that share an id share the draws;
* an empty table gives an empty table; other columns are carried, those named like an
  added one are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import tune

MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"


def _cuts(unit: str):
    """(text, two draws) -> number of units and the code points before the two cuts."""

    def cut(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        import regex

        units = regex.compile(f"({unit})*")
        out = []
        for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
            match = units.fullmatch(text.as_py())
            if match is None:
                out.append(None)
                continue
            ends = match.ends(1)
            n = len(ends)
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out.append({"n": n, "low": ends[low - 1] if low else 0, "high": ends[high - 1] if high else 0})
        return pa.array(out, pa.struct([(c, pa.int64()) for c in ("n", "low", "high")]))

    return F.arrow_udf(cut, "struct<n: bigint, low: bigint, high: bigint>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, unit: str = CODE_POINT, percent: int = 90, spm_percent: int = 20, marks: tuple = MARKS, seed: int = 1
) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(text, F.lit(m))
    plain = (text == "") | marked | F.col("_cut").isNull() | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.col("_cut.low"), F.col("_cut.high")
    prefix = F.substring(text, F.lit(1), low.cast("int"))
    middle = F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))
    suffix = F.substring(text, (high + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in marks)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )
    cut = docs.withColumn("_cut", _cuts(unit)(text, h1, h2)).withColumn("form", form)
    cut = cut.withColumns(
        {
            "n": F.col("_cut.n"),
            "prefix_chars": F.when(F.col("form") != "plain", low),
            "middle_chars": F.when(F.col("form") != "plain", high - low),
            "output": output,
        }
    )
    return cut.drop("_cut")


def restore(output: Column, form: Column, marks: tuple = MARKS) -> Column:
    """The text that ``transform`` was given."""
    p, s, m = marks
    after = lambda of, mark: F.substring(of, F.locate(mark, of) + len(mark), F.lit(2**31 - 1))
    between = lambda a, b: F.substring_index(after(output, a), b, 1)
    middle = after(output, m)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: units, form, lengths, digests of the output and of its restored text."""
    out = transform(docs.select("doc_id", "text"), **options)
    return out.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
