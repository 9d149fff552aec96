"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import (
    byte_gru, decision_list, feistel, filter_audit, maxplus, repair, sharding, simhash, spelling, suffix, template, tiling,
    url_rules,
)
from ledgerline.llm.common import table


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shuffled shards, written and read back."""
    return sharding.digest(sharding.shuffle_shards(table(spark, sf_dir, "documents"), shards=24))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, by greedy string tiling of all against all items."""
    return tiling.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and the learned decision list's verdict on every document."""
    judged = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by format-preserving pseudonyms."""
    made = feistel.pseudonymise(table(spark, sf_dir, "documents"), feistel.session_key(spark))
    return made.select("doc_id", "text", "n_pseudonyms")


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and pattern rules over every page's URL."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's deduced template."""
    return template.extract(table(spark, sf_dir, "pages"))


def op8_maxplus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again: doc_id, ids, n_tokens, round_trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = maxplus.decode(maxplus.encode(docs))
    return maxplus.digest(decoded).select("doc_id", "ids", "n_tokens", "round_trip")


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written grammar-compressed and read back."""
    path = repair.write_ids(table(spark, sf_dir, "documents"))
    return repair.read_ids(spark, path, with_ids=False)


def op10_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    return suffix.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte network, learned from those not held out."""
    return byte_gru.languages_of(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in each of their 120 orders."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_shuffle_shards,
        op2_string_tiling,
        op3_decision_list,
        op4_feistel_pseudonyms,
        op5_simhash_pivots,
        op6_url_rules,
        op7_template_text,
        op8_maxplus_pieces,
        op9_repair_tokens,
        op10_suffix_sort,
        op11_byte_gru,
        op12_filter_audit,
        op13_spelling_variants,
    )
}


def _op6_sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rules = sorted(url_rules.DOMAIN_RULES, key=lambda r: (-len(r[0].split(".")), -len(r[1]), r))
    fit = [
        (f"((host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}))", h + p, v)
        for h, p, v in rules
    ]
    name = "CASE " + " ".join(f"WHEN {c} THEN {q(n)}" for c, n, _ in fit) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN {q(v)}" for c, _, v in fit) + " END"

    def any_of(kind: str) -> str:
        found = [f"regexp_matches(low, {q(p)})" for _, v, _, p in url_rules.PATTERN_RULES if v == kind]
        return "(" + " OR ".join(found) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH u AS (
      SELECT page_id, coalesce(url, '') AS url,
             translate(coalesce(url, ''), '{upper}', '{lower}') AS low FROM pages
    ), r AS (
      SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u
    ), h AS (
      SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r
    )
    SELECT page_id, host, path, {name} AS rule,
           coalesce({ruled}, CASE WHEN {any_of('allow')} THEN 'allow' WHEN {any_of('block')} THEN 'block' END,
                    'allow') AS verdict
    FROM h"""


#: Every 100-byte string by its hex text; a string's first start stays, later ones are removed.
_OP10_SQL = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, 100 * i AS base, substr(h, 200 * i + 1, 398) AS piece
  FROM (SELECT doc_id, h, n, unnest(range(0, (n - 100) // 100 + 1)) AS i FROM d WHERE n >= 100)
), starts AS (
  SELECT doc_id, base + q AS p, substr(piece, 2 * q + 1, 200) AS string
  FROM (SELECT doc_id, base, piece, unnest(range(0, least(100, n - 99 - base))) AS q FROM pieces)
), again AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY string ORDER BY doc_id, p) AS k FROM starts)
  WHERE k > 1
), marked AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS fresh FROM again
), numbered AS (
  SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM numbered GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS b FROM runs
  UNION ALL SELECT doc_id, 0, min(lo) FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS k
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Every order is run step by step over the documents' sets of failing filters.
_OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
         EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM documents d
), failed AS (
  SELECT part, good, toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t
), classes AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders
), now AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, fails, n, good, toxic,
         translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS gone
  FROM steps, classes
), sums AS (
  SELECT part, filter_order, step, any_value(x) AS x,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT contains(fails, x)), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND contains(fails, x)), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND contains(fails, x)), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND contains(fails, x)), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND contains(fails, x)), 0) AS BIGINT) AS toxic_lost
  FROM now GROUP BY part, filter_order, step
)
SELECT * EXCLUDE x, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums"""

#: CRC-32 by its 256-entry table; near words share a pattern with one character taken out.
_OP13_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8
), runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  GROUP BY ALL
), hexed AS (
  SELECT w, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM runs
), bytes AS (
  SELECT w, c, list_transform(range(0, len(h) // 2),
    lambda i: CAST((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS b
  FROM hexed
), summed AS (
  SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) AS h FROM bytes, crc_table
), made AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c
  FROM summed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k
  FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN (FROM best WHERE k = 1) b USING (word)
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM walk JOIN forms last ON last.word = walk.at AND last.form IS NULL JOIN forms f ON f.word = walk.word"""

ORACLE = {"op6_url_rules": _op6_sql(), "op10_suffix_sort": _OP10_SQL, "op12_filter_audit": _OP12_SQL, "op13_spelling_variants": _OP13_SQL}
