"""Registered queries of the llm operators: ``QUERIES[key] = (fn(spark, sf_dir), oracle SQL or None)``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexframe.llm import bpe, ctw, curriculum, debruijn, langid, lcp, linededup, pii, prefixtrie, repair, rules, simhash, warc
from lexframe.llm.common import is_training
from lexframe.plans.bindings import table
from lexframe.session import scratch_path

QUERIES: dict = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = (fn, sql)
        return fn
    return deco


@register("op1_byte_bpe")
def op1_byte_bpe(spark, d):
    return bpe.tokenised(table(spark, d, "documents"), RANKS, public_tokenizers.PATTERN, ["doc_id"], with_ids=False)


@register("op4_curriculum_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([3.0, 1.0, 2.0], turn + 1) AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS total,
             sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS caps,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS weights,
             sum(weight) OVER () AS all_weights FROM w),
-- Level if the sources before this one are capped; the first level not above its own ratio holds.
l AS (SELECT *, (1.5 * CAST(total AS DOUBLE) - (caps - cap)) / (all_weights - (weights - weight)) AS level FROM r),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, turn, least(cap, weight * (SELECT level FROM v)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.turn, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM c),
f AS (SELECT *, CAST((passes + CASE WHEN size > 0 AND 2 * (words - passes * source_size - start) >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
             CAST(start AS DOUBLE) / greatest(1.0, target) AS u FROM e),
g AS (SELECT *, CASE turn WHEN 0 THEN 3.0 * u WHEN 1 THEN 1.0 * u ELSE 2.0 * u END AS a FROM f)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN
    CASE turn WHEN 0 THEN 2.0 * a / (4.0 + sqrt(greatest(0.0, 16.0 - 4.0 * a)))
              WHEN 1 THEN 2.0 * a / (1.0 + sqrt(1.0))
              ELSE CASE WHEN a <= 0.75 THEN 2.0 * a / (1.0 + sqrt(1.0 + 4.0 * a))
                        ELSE 0.5 + 2.0 * (a - 0.75) / (2.0 + sqrt(4.0 + 4.0 * (a - 0.75))) END END END AS position
FROM g""")
def op4_curriculum_mix(spark, d):
    return curriculum.taken_words(table(spark, d, "documents"))


@register("op6_site_line_dedup", r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
g AS (SELECT DISTINCT source, text FROM d),
k AS (SELECT DISTINCT source, text, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS l FROM g)),
b AS (SELECT k.source, k.line FROM k JOIN (SELECT source, count(*) AS pages FROM g GROUP BY source) p
      ON p.source IS NOT DISTINCT FROM k.source WHERE k.line <> ''
      GROUP BY k.source, k.line, p.pages HAVING count(*) >= 3 AND count(*) > 0.1 * p.pages),
a AS (SELECT source, list(line) AS drop_lines FROM b GROUP BY source),
m AS (SELECT d.doc_id, d.text, d.ls, list_filter(d.ls, lambda x: NOT coalesce(list_contains(a.drop_lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS left_over
      FROM d LEFT JOIN a ON a.source IS NOT DISTINCT FROM d.source),
n AS (SELECT *, CASE WHEN length(array_to_string(left_over, '')) < 0.5 * length(array_to_string(ls, '')) THEN ls ELSE left_over END AS kept FROM m)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(kept, chr(10))) END AS kept_sha256
FROM n""")
def op6_site_line_dedup(spark, d):
    """`documents`, with the source as the site."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    out = linededup.drop_boilerplate(docs, F.col("source"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op10_rule_ledger", r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
                + 4 * (10 * n_symbols > n_words AND n_symbols > 0)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
                + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b""")
def op10_rule_ledger(spark, d):
    entries = rules.ledger(table(spark, d, "documents"))
    return rules.apply_policy(entries, 2).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(rules.mask(rules.POLICIES[1]))) != 0)


@register("op8_simhash_vp_tree")
def op8_simhash_vp_tree(spark, d):
    return simhash.grouped(table(spark, d, "documents").select("doc_id", "text"))


@register("op2_crf_langid")
def op2_crf_langid(spark, d):
    docs = table(spark, d, "documents")
    model = langid.fit(docs, is_training(F.col("doc_id"), 3, 1))
    out = langid.label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~is_training(F.col("doc_id"), 3, 1)).alias("held_out"), "lang_pred", "score")


@register("op3_lcp_fingerprint")
def op3_lcp_fingerprint(spark, d):
    return lcp.edits(table(spark, d, "documents"))


@register("op9_bootstrapped_pii")
def op9_bootstrapped_pii(spark, d):
    return pii.digests(pii.extract(table(spark, d, "documents").select("doc_id", "text")))


@register("op7_debruijn_dedup")
def op7_debruijn_dedup(spark, d):
    return debruijn.remove_repeats(table(spark, d, "documents"))


@register("op5_ctw_score")
def op5_ctw_score(spark, d):
    train = is_training(F.col("doc_id"), 7, 2)
    out = ctw.score(table(spark, d, "documents").select("doc_id", "text"), train)
    return out.withColumn("held_out", ~is_training(F.col("doc_id"), 7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@register("op12_conversation_repair", r"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS crc),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT d.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                                  lambda c, x: xor(c // 256, crc[CAST(xor(c, x) % 256 AS BIGINT) + 1]), 4294967295), 4294967295) % 20 AS kind FROM d, bits),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM m),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, left(role, 1) AS r FROM n),
-- One struct (cost, audit, repaired text) for each place of the pattern: p0 start, p1 after s, p2 after u, p3 after a.
w(conv_id, i, p0, p1, p2, p3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': CAST(0 AS BIGINT), 'a': '', 't': ''}, {'c': CAST(1000000 AS BIGINT), 'a': '', 't': ''},
         {'c': CAST(1000000 AS BIGINT), 'a': '', 't': ''}, {'c': CAST(1000000 AS BIGINT), 'a': '', 't': ''} FROM n
  UNION ALL
  SELECT conv_id, i, {'c': q0.c, 'a': q0.a, 't': q0.t}, q1, q2, q3 FROM (
    SELECT f.conv_id, f.i, {'c': p0.c + 2, 'a': p0.a || 'D', 't': p0.t} AS q0,
      list_min([{'c': p1.c + 2, 'a': p1.a || 'D', 't': p1.t},
                {'c': p0.c + CASE WHEN r = 's' AND fault NOT IN ('b', 'd') THEN CASE fault WHEN 't' THEN 5 ELSE 0 END ELSE 1000000 END, 'a': p0.a || 'K', 't': p0.t || chr(10) || role || ':' || text}]) AS q1,
      list_min(list_transform([p0, p1, p3], lambda p: {'c': p.c + CASE WHEN fault IN ('b', 'd') THEN 1000000 ELSE CASE WHEN fault = 't' THEN 5 ELSE 0 END + CASE WHEN r = 'u' THEN 0 ELSE 1 END END,
                'a': p.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END, 't': p.t || chr(10) || CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text}) || [{'c': p2.c + 2, 'a': p2.a || 'D', 't': p2.t}]) AS q2,
      list_min([{'c': p3.c + 2, 'a': p3.a || 'D', 't': p3.t},
                {'c': p2.c + CASE WHEN fault IN ('b', 'd') THEN 1000000 ELSE CASE WHEN fault = 't' THEN 5 ELSE 0 END + CASE WHEN r = 'a' THEN 0 ELSE 1 END END,
                 'a': p2.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END, 't': p2.t || chr(10) || CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text}]) AS q3
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
-- Deleting a turn (2) is always cheaper than inserting one (5), so no cheapest repair has an insert.
e AS (SELECT w.conv_id, list_min([p0, p3]) AS best FROM w JOIN (SELECT conv_id, max(i) AS i FROM n GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12_conversation_repair(spark, d):
    return repair.repair(repair.damaged(table(spark, d, "conversations")))


@register("op13_prefix_trie", r"""
WITH bits AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS crc),
t AS (SELECT conv_id, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn,
             md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': t.role, 'text': t.text} ORDER BY turn NULLS FIRST, h) AS ts FROM t GROUP BY conv_id),
k AS (SELECT o.*, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                                  lambda c, x: xor(c // 256, crc[CAST(xor(c, x) % 256 AS BIGINT) + 1]), 4294967295), 4294967295) % 4 AS h FROM o, bits),
r AS (SELECT k.conv_id, list_concat(coalesce(b.ts[1:CAST(k.h AS INT)], []), k.ts[CAST(k.h AS INT) + 1:]) AS ts FROM k LEFT JOIN o b ON b.conv_id = k.conv_id - k.conv_id % 20),
p AS (SELECT conv_id, ts[1:CAST(d AS INT)] AS path, d, d = len(ts) AS whole FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT path, CAST(min(d) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256 FROM p GROUP BY path),
c AS (SELECT path[1:CAST(depth AS INT) - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE
             (n_convs - 1) * len(regexp_extract_all(n.path[CAST(depth AS INT)].text, '[^ 	-
]+')) END AS saved FROM n LEFT JOIN c ON c.path = n.path),
a AS (SELECT path[1:CAST(up AS INT)] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.path = m.path LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[1:CAST(m.depth AS INT) - 1]""")
def op13_prefix_trie(spark, d):
    return prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turn_lists(table(spark, d, "conversations"))))


@register("op11_warc_chain", """
WITH p AS (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS place,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN least END AS refers_to FROM r""")
def op11_warc_chain(spark, d):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, d, "pages"), path, compression="gzip")
    return warc.Archives(spark, path).index().select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        warc.page_number(F.col("refers_to")).alias("refers_to"))
