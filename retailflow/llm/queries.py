"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailflow.llm import (
    best_fit,
    chat_format,
    cross_polytope,
    cube_mix,
    fim_regex,
    html_wrapper,
    hyperminhash,
    language_id,
    line_dedup,
    merkle,
    quality_mcd,
    suffix_family,
    warc,
)
from retailflow.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_wrapper(spark, sf_dir):
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2, added_tokens=True)


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), min_revisit=0, segment_bytes=16 << 10, chunk_bytes=4 << 10)


def op6_mix_sources(spark, sf_dir):
    return cube_mix.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_repeats=3.0, share=1.0)


def op7_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = turns.unionByName(planted).withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.digest(chat_format.read_back(chat_format.format_conversations(turns)))


def op8_cross_polytope(spark, sf_dir):
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_quality_rules(spark, sf_dir):
    return quality_mcd.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_hyperminhash(spark, sf_dir):
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_suffix_family(spark, sf_dir):
    return suffix_family.removal_report(table(spark, sf_dir, "documents"), length=200, batches=4)


def op12_fim_regex(spark, sf_dir):
    return fim_regex.fim_report(table(spark, sf_dir, "documents"), percent=90, spm_percent=20)


def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"), every=5)


QUERIES = {
    "op1_html_wrapper": op1_html_wrapper,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc": op5_warc,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_format": op7_chat_format,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_quality_rules": op9_quality_rules,
    "op10_hyperminhash": op10_hyperminhash,
    "op11_suffix_family": op11_suffix_family,
    "op12_fim_regex": op12_fim_regex,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LINES = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS lost
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS head,
         len(regexp_extract_all(text, '<~*(\||/?s>)|\[~*/?INST\]')) AS stuffed FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>' || head || chr(10) || '<|end|>' || chr(10)) + length(text) + stuffed
           + len(regexp_extract_all(head, '<~*(\||/?s>)|\[~*/?INST\]')))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string(flatten(list_transform(range(8), lambda j: list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(sha1(body), 5 * j + 1, 5))::BIGINT >> s) & 31)::BIGINT + 1, 1)))), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM payloads
"""

_LONG_STRINGS = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT r, unnest(range(0, length(h) // 2 - 199)) AS s, h FROM docs WHERE length(h) >= 400
), windows AS (
  SELECT r, s, md5(substr(h, (2 * s + 1)::BIGINT, 400)) AS w FROM starts
), hits AS (
  SELECT r, s, coalesce(s > 200 + lag(s) OVER (PARTITION BY r ORDER BY s), true) AS fresh
  FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), islands AS (
  SELECT r, s, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s) AS island FROM hits
), spans AS (
  SELECT r, min(s) AS a, max(s) + 200 AS b FROM islands GROUP BY r, island
), pieces AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT r, max(b), 2147483647 FROM spans GROUP BY r
), kept AS (
  SELECT p.r, string_agg(substr(d.h, (2 * p.a + 1)::BIGINT, (2 * (p.b - p.a))::BIGINT), '' ORDER BY p.a) AS h
  FROM pieces p JOIN docs d USING (r) GROUP BY p.r
), lost AS (
  SELECT r, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY r
)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN lost l USING (r) LEFT JOIN kept k USING (r)
"""

_MIDDLES = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS plain, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS spm FROM drawn
), formed AS (
  SELECT doc_id, text, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain >= 90 THEN 'plain'
              WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), cut AS (
  SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle, substr(text, hi + 1) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def _leaf_sql(text: str) -> str:
    value = lambda v: f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(value(v) for v in fields) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a short text of ASCII digits, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(d)), lambda i: ascii(substr(d, i + 1, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

_MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql(_LOWER)} AS lower, doc_id::VARCHAR AS d FROM documents
), trees AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM rows)
), leaves AS (
  SELECT r.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN lower ELSE leaf END AS seen
  FROM rows r JOIN trees t ON r.source IS NOT DISTINCT FROM t.source
), sub(tree, level, pos, digest) AS (
  SELECT tree, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, max(pos) OVER (PARTITION BY tree) AS last FROM sub) WHERE last > 0 GROUP BY tree, level, pos // 16
), subroots AS (
  SELECT tree, level, digest FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY level DESC) AS k FROM sub) WHERE k = 1
), top(level, pos, digest) AS (
  SELECT 0, tree, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, max(pos) OVER () AS last FROM top) WHERE last > 0 GROUP BY level, pos // 16
), crown AS (
  SELECT level, digest FROM top ORDER BY level DESC LIMIT 1
), nodes AS (
  SELECT tree, level, pos, digest FROM sub UNION ALL SELECT -1, level, pos, digest FROM top
), sides AS (
  SELECT tree, level, pos,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW run AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)
), walk(doc_id, home, leaf, tree, level, pos, depth, proof, digest) AS (
  SELECT doc_id, leaves.tree, leaf, leaves.tree, 0, leaves.pos, s.level, '', seen FROM leaves JOIN subroots s ON s.tree = leaves.tree
  UNION ALL
  SELECT w.doc_id, w.home, w.leaf,
         CASE WHEN w.level = w.depth THEN -1 ELSE w.tree END,
         CASE WHEN w.level = w.depth THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.level = w.depth THEN w.home ELSE w.pos // 16 END,
         CASE WHEN w.level = w.depth THEN (SELECT level FROM crown) ELSE w.depth END,
         CASE WHEN w.level = w.depth THEN w.proof ELSE w.proof || s.l || s.r END,
         CASE WHEN w.level = w.depth THEN w.digest ELSE sha256(s.l || w.digest || s.r) END
  FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos
  WHERE w.tree >= 0 OR w.level < w.depth
)
SELECT w.doc_id, w.leaf, s.digest AS subroot, c.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root,
       w.digest = c.digest AS verified
FROM walk w JOIN subroots s ON s.tree = w.home CROSS JOIN crown c WHERE w.tree = -1 AND w.level = w.depth
"""

#: DuckDB SQL of the queries that SQL can express.
STATEMENTS: dict[str, str] = {
    "op2_line_dedup": _LINES,
    "op5_warc": _WARC,
    "op7_chat_format": _CHAT,
    "op11_suffix_family": _LONG_STRINGS,
    "op12_fim_regex": _MIDDLES,
    "op13_merkle_manifest": _MERKLE,
}
