"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, filter_audit, imatch, lm_score, packing, quality_rules, secret_scan, token_counts, token_files, trie_join, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality and not toxic. Two folds, so that no text is scored by counts of its own."""
    labels = _table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), labels, folds=2)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_duplicates(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings.
TRICKY = "SELECT -1L AS conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(TRICKY))
    return chat_format.digests(chat_format.format_conversations(turns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_score, op2_ngram_jaccard_join, op3_chat_format, op4_decontaminate, op5_best_fit_packing, op6_secret_scan, op7_quality_rules, op8_token_counts, op9_warc, op10_token_files, op11_filter_audit, op12_imatch, op13_whitening, pipeline)
    return {f.__name__: f for f in own}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
  length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 3 * (length(role) - length(replace(role, chr(10), ''))) AS role_chars,
  length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, CASE WHEN before IS NOT DISTINCT FROM role THEN 10 ELSE 13 + role_chars END + text_chars + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) >= 3),
f AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM f, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT d.k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters,
  length(text) - length(replace(text, '|', '')) AS pipes
  FROM d LEFT JOIN l ON l.k = d.k LEFT JOIN r ON r.k = d.k),
b AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT)
  + 8 * CAST(n_dup_lines >= 5 AND 12 * n_dup_lines > n_words AS BIGINT) + 16 * CAST(word_chars > 15 * n_words AS BIGINT)
  + 32 * CAST(word_chars < 2 * n_words AS BIGINT) + 64 * CAST(2 * upper > letters AS BIGINT) + 128 * CAST(10 * pipes > 3 * n_words AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(failed_bits AS BIGINT) AS failed_bits,
  failed_bits & 3 <> 0 AS base_failed, failed_bits & {quality_rules.POLICIES[quality_rules.LATEST] | quality_rules.BASE_MASK} = 0 AS kept FROM b
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha256(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q
"""

OP11 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
  + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit)
  JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN mask & (bit + before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

_TERMS = r"regexp_extract_all(translate({}, '" + _UPPER + "', '" + _UPPER.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
e AS (SELECT doc_id, next_id, n, text, left(text, n - n // 4) || left(after, n // 4) AS edited FROM x),
b AS (SELECT doc_id, 0 AS kind, list_distinct({_TERMS.format("text")}) AS terms FROM e UNION ALL SELECT doc_id, 1, list_distinct({_TERMS.format("edited")}) FROM e),
v AS (SELECT doc_id, kind, greatest(length(bin(len(terms))) - {imatch.SPARE + 1}, 0) AS level, terms FROM b),
t AS (SELECT doc_id, kind, level, unnest(terms) AS term FROM v),
lex AS (SELECT term FROM t WHERE kind = 0 GROUP BY term HAVING count(*) * {imatch.RARE} >= (SELECT count(*) FROM d) AND count(*) * {imatch.COMMON} <= (SELECT count(*) FROM d)),
r AS (SELECT *, CAST('0x' || substr(md5(term), 1, 1) AS INTEGER) AS part, CAST('0x' || substr(md5(term), 2, 7) AS INTEGER) AS draw, term IN (SELECT term FROM lex) AS in_band FROM t),
u AS (SELECT * FROM (SELECT *, bool_or(in_band) OVER (PARTITION BY doc_id, kind) AS held FROM r WHERE draw < {imatch.DRAW} >> level) WHERE in_band OR NOT held),
s AS (SELECT doc_id, kind, level + k AS level, part, k, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS h FROM u, range({imatch.LEVELS}) g(k) WHERE draw < {imatch.DRAW} >> (level + k) GROUP BY ALL),
p AS (SELECT v.doc_id, v.kind, any_value(v.level) AS level, CAST(any_value(v.level) AS VARCHAR) || ':' || string_agg(coalesce(h, ''), ',' ORDER BY g.part, k.k) AS print
  FROM v CROSS JOIN range({imatch.PARTS}) g(part) CROSS JOIN range({imatch.LEVELS}) k(k) LEFT JOIN s ON s.doc_id = v.doc_id AND s.kind = v.kind AND s.part = g.part AND s.k = k.k GROUP BY v.doc_id, v.kind),
w AS (SELECT doc_id, doc_id AS other, 1 AS kind FROM e UNION ALL SELECT doc_id, next_id, 0 FROM e),
y AS (SELECT w.doc_id, w.kind, a.level AS la, z.level AS lz, a.print AS pa, z.print AS pz, w.other FROM w JOIN p a ON a.doc_id = w.doc_id AND a.kind = 0 JOIN p z ON z.doc_id = w.other AND z.kind = w.kind),
q AS (SELECT y.doc_id, y.kind, 'a' AS side, s.level, s.part, s.h FROM y JOIN s ON s.doc_id = y.doc_id AND s.kind = 0 WHERE s.level BETWEEN lz AND lz + {imatch.LEVELS - 1}
  UNION ALL SELECT y.doc_id, y.kind, 'z', s.level, s.part, s.h FROM y JOIN s ON s.doc_id = y.other AND s.kind = y.kind WHERE s.level BETWEEN la AND la + {imatch.LEVELS - 1}),
j AS (SELECT doc_id, kind, CAST(count(*) FILTER (c = 2 AND same) AS DOUBLE) / count(*) AS near FROM (SELECT doc_id, kind, level, part, count(*) AS c, min(h) = max(h) AS same FROM q GROUP BY ALL) GROUP BY doc_id, kind),
n AS (SELECT y.doc_id, y.kind, CASE WHEN pa = pz THEN 1.0 ELSE coalesce(near, 0.0) END AS near FROM y LEFT JOIN j ON j.doc_id = y.doc_id AND j.kind = y.kind)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, o.print AS fingerprint, k.print AS edited_fingerprint, CAST(m.near AS DOUBLE) AS near_edited, CAST(f.near AS DOUBLE) AS near_next
FROM e JOIN p o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN p k ON k.doc_id = e.doc_id AND k.kind = 1 JOIN n m ON m.doc_id = e.doc_id AND m.kind = 1 JOIN n f ON f.doc_id = e.doc_id AND f.kind = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11, "op12_imatch": OP12, "op2_ngram_jaccard_join": OP2, "op3_chat_format": OP3, "op7_quality_rules": OP7, "op9_warc": OP9}
