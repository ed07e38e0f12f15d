"""One registered query for each corpus operator, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bitplanes import read_token_planes, write_token_planes
from quire.llm.common import read_table, shared_dir
from quire.llm.decontaminate import decontaminate
from quire.llm.fingerprints import fingerprint_edits
from quire.llm.hardnegatives import mine_hard_negatives
from quire.llm.hostrules import judge
from quire.llm.langid import identify_language
from quire.llm.neardup import near_duplicates
from quire.llm.packing import pack, token_pieces
from quire.llm.prefixtrie import prefix_trie
from quire.llm.quality import score_quality
from quire.llm.sharding import shard_by_bytes
from quire.llm.substring import kept_digest, remove_repeats
from quire.llm.toxicity import score_toxicity

#: Where the vocabulary lies; any byte-level BPE file of the tokenizers library will do.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    write_token_planes(read_table(spark, sf_dir, "documents"), path, tokenizer=TOKENIZER)
    return read_token_planes(spark, path)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", kept_digest().alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), tokenizer=TOKENIZER))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_planes, op2_quality, op3_substring_dedup, op4_sharding, op5_packing, op6_toxicity, op7_language, op8_near_duplicates, op9_decontamination, op10_host_rules, op11_fingerprints, op12_prefix_trie, op13_hard_negatives]
    return {f.__name__: f for f in found}


#: Window starts that an earlier document also has; DuckDB keeps them as strings.
OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM base)
), held AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM wins) WHERE lo < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM held, (SELECT unnest(range(0, 13)) AS o)
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM base
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT b.doc_id, len(b.ws)::BIGINT AS n_words, (len(b.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM base b LEFT JOIN kept k USING (doc_id)
"""

#: All pairs with a shingle in common, and everything that is reachable from a document.
OP8_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM base WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, c) AS (SELECT a, a FROM ways UNION SELECT w.b, r.c FROM reached r JOIN ways w ON w.a = r.doc_id
), named AS (SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), pats AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(ws)) AS m, array_to_string(ws[i:i+12], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM items WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT m FROM pats
), wins AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS s
  FROM (SELECT doc_id, ws, m, unnest(range(1, greatest(1, len(ws) - m + 2))) AS i FROM docs, lens)
), hits AS (SELECT doc_id, item, i, m FROM wins JOIN pats USING (m, s)
), cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS k FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(k.n, 0)::BIGINT AS n_items, sha256(coalesce(k.k, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN cover c USING (doc_id) LEFT JOIN named k USING (doc_id)
"""

OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM base)
), reps AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM reps, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), judged AS (
  SELECT b.doc_id, b.source, len(b.ws)::BIGINT AS n_words, length(array_to_string(b.ws, ''))::BIGINT AS word_chars,
    (length(b.t) - length(regexp_replace(b.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(b.ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(b.ws) AS base_failed
  FROM base b LEFT JOIN cover c USING (doc_id) LEFT JOIN lines l USING (doc_id)
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM judged GROUP BY source
), prior AS (
  SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts
), strength AS (
  SELECT m, CASE WHEN v > 0 THEN least(1000, greatest(0, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM prior
), verdict AS (
  SELECT source, (bad + m * s) / (n + s) <= 0.5 AS ok FROM hosts, strength
)
SELECT j.* EXCLUDE (source), NOT base_failed AND v.ok AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""


#: Rebuilt conversations by the CRC of their ids, bit by bit; a node is a list of turns.
OP12_SQL = r"""
WITH RECURSIVE convs AS (
  SELECT DISTINCT conv_id AS c, conv_id - ((conv_id % 5) + 5) % 5 AS base, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL
), crc(c, base, s, i, v) AS (
  SELECT c, base, s, 0, 4294967295::BIGINT FROM convs
  UNION ALL
  SELECT c, base, s, i + 1, list_reduce([xor(v, ascii(s[i + 1])::BIGINT)] || range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) FROM crc WHERE i < length(s)
), heads AS (
  SELECT c, base, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = length(s)
), own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT h.c, CASE WHEN h.c = h.base THEN o.ts ELSE coalesce(b.ts[1:h.h], []) || coalesce(o.ts[h.h + 1:], []) END AS ts
  FROM heads h JOIN own o ON o.c = h.c LEFT JOIN own b ON b.c = h.base
), on_path AS (
  SELECT c, ts, unnest(range(0, len(ts) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT depth, ts[1:depth] AS k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ts) = depth), '') AS ends FROM on_path GROUP BY ALL
), valued AS (
  SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(k[-1].t) ELSE 0 END AS v, count(*) OVER (PARTITION BY depth, k[1:depth - 1]) AS siblings FROM nodes
), children AS (
  SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), told AS (
  SELECT v.*, coalesce(n, 0) AS n_children FROM valued v LEFT JOIN children USING (depth, k)
), sums AS (
  SELECT d AS depth, k[1:d] AS k, sum(v) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM told) GROUP BY ALL
)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN sums s USING (depth, k) LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.k = t.k[1:t.depth - 1]
"""

OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), near AS (
  SELECT anchor_id, other AS positive_id, s AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5
)
SELECT n.anchor_id, n.positive_id, (row_number() OVER w)::INT AS rank, f.other AS negative_id, n.positive_score, f.s AS negative_score
FROM near n JOIN scored f ON f.anchor_id = n.anchor_id AND NOT f.same AND 100 * f.s BETWEEN 30 * n.positive_score AND 90 * n.positive_score
WINDOW w AS (PARTITION BY n.anchor_id, n.positive_id ORDER BY f.s DESC, f.other) QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op8_near_duplicates": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_host_rules": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
