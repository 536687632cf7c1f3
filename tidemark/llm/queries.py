"""Queries of the operators over the given tables, with comparison SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, html, language, lines, minhash, mixing, packing, search, substring, topk, trie, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_decisions(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("did").alias("doc_id"), "line", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_files() -> tuple[str, str]:
    """The byte-level vocabulary, and the same as ranks; where they are is a parameter of ``packing.pack``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *tokenizer_files())


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_substring_dedup, op3_language_id, op4_line_dedup, op5_html_text, op6_minhash_near_dedup, op7_warc_round_trip, op8_pack_sequences, op9_exact_top_k, op10_embedding_near_dedup, op11_exact_dedup, op12_prefix_trie, op13_lexical_search)
}

_COUNT = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {
    # Water filling by repeated resharing, then the words [0, target) of each source's repeated line.
    "op1_mix_sources": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_COUNT}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n,
        CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
      FROM d GROUP BY source),
fill(step, source, n, w, full_at) AS (
  SELECT 0, source, n, w, FALSE FROM s
  UNION ALL
  SELECT step + 1, source, n, w,
    full_at OR w * (sum(n) OVER () - sum(CASE WHEN full_at THEN 3 * n ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN full_at THEN 0 ELSE w END) OVER (), 0) >= 3 * n
  FROM fill WHERE step < 200),
t AS (SELECT source, n, CASE WHEN full_at THEN 3 * n ELSE w * (sum(n) OVER () - sum(CASE WHEN full_at THEN 3 * n ELSE 0 END) OVER ())
        / nullif(sum(CASE WHEN full_at THEN 0 ELSE w END) OVER (), 0) END AS target FROM fill WHERE step = 200),
line AS (SELECT doc_id, d.source, size, n, target, floor(target + 1e-6) AS words,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || doc_id)) - size AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target::DOUBLE AS target,
  (greatest(0, least(size, words - a)) + greatest(0, least(size, words - a - n)) + greatest(0, least(size, words - a - 2 * n)))::BIGINT AS taken
FROM line""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM k JOIN m USING (k) WHERE least < doc_id)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k2 AS (SELECT u.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k2 ON d.doc_id = k2.doc_id""",
    # A variant is the text of the line with a mark where the word is missing.
    "op4_line_dedup": r"""
WITH o AS (SELECT doc_id, i - 1 AS line, array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ') AS t
  FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
l AS MATERIALIZED (SELECT * FROM o WHERE t <> ''),
f AS MATERIALIZED (SELECT t, min((doc_id, line)) AS place, string_split(t, ' ') AS w FROM l GROUP BY t),
j AS (SELECT t, place, w, unnest(range(1, len(w) + 2)) AS j FROM f WHERE len(w) >= 5),
p AS (SELECT place, hash(array_to_string(list_slice(w, 1, j - 1), ' '), array_to_string(list_slice(w, j + d, len(w)), ' '), j - 1, len(w) - j - d + 1) AS k
  FROM j, (SELECT 0 AS d UNION ALL SELECT 1) WHERE j + d <= len(w) + 1),
n AS (SELECT DISTINCT p.place FROM p JOIN (SELECT k, min(place) AS leader FROM p GROUP BY k) m ON p.k = m.k AND m.leader < p.place)
SELECT l.doc_id, l.line::BIGINT AS line, (doc_id, line) = f.place AND n.place IS NULL AS kept
FROM l JOIN f ON l.t = f.t LEFT JOIN n ON f.place = n.place""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op7_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN o.owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.owner <> page_id THEN o.owner END AS refers_to
FROM p LEFT JOIN o ON p.html = o.html""",
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
  LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id""",
    "op11_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    # CRC-32 byte by byte, prefixes as lists, each node added to all its ancestors.
    "op12_prefix_trie": """
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
c AS MATERIALIZED (SELECT conv_id AS c, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(c, j, v) AS (SELECT c, 0, 4294967295::BIGINT FROM c UNION ALL
  SELECT c, j + 1, xor(t.v, crc.v // 256) FROM crc JOIN t ON t.i = xor(crc.v, ascii(substr(c::VARCHAR, j + 1, 1))::BIGINT) % 256 WHERE j < len(c::VARCHAR)),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE j = len(c::VARCHAR)),
o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations),
k AS MATERIALIZED (SELECT c.c, h, least(h, coalesce(p.n, 0)) AS k, c.n FROM c JOIN h ON h.c = c.c LEFT JOIN c p ON p.c = c.c - c.c % 5),
r AS MATERIALIZED (SELECT k.c, k + i - h AS d, role, text FROM k JOIN o ON o.c = k.c AND i > h
  UNION ALL SELECT k.c, i, role, text FROM k JOIN o ON o.c = k.c - k.c % 5 AND i <= h),
p AS (SELECT c, d, strlen(text) AS b, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS s FROM r),
a AS MATERIALIZED (SELECT c, d, b, min(c) OVER (PARTITION BY d, s) AS o FROM p UNION ALL SELECT c, 0, 0, (SELECT min(c) FROM c) FROM c),
e AS (SELECT c, max(d) AS d FROM a GROUP BY c),
n AS (SELECT o AS c, d, count(*) AS n, (count(*) - 1) * min(b) AS saved,
    sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM (SELECT a.*, e.c IS NOT NULL AS last FROM a LEFT JOIN e ON e.c = a.c AND e.d = a.d) GROUP BY o, d),
q AS MATERIALIZED (SELECT n.*, u.o AS parent FROM n LEFT JOIN a u ON u.c = n.c AND u.d = n.d - 1),
m AS MATERIALIZED (SELECT q.*, coalesce(x.x, 0) AS children FROM q LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS x FROM q WHERE d > 0 GROUP BY ALL) x ON x.parent = q.c AND x.d = q.d),
z AS (SELECT a.o AS c, a.d, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM m JOIN a ON a.c = m.c AND a.d <= m.d GROUP BY a.o, a.d)
SELECT m.c AS conv_id, m.d::BIGINT AS depth, parent AS parent_conv_id, m.n AS n_convs, children::BIGINT AS n_children, z.leaves::BIGINT AS n_leaves,
  z.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM m JOIN z ON z.c = m.c AND z.d = m.d""",
    "op13_lexical_search": r"""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM x GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d),
f AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t),
i AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, p.doc_id, sum(i.c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
  FROM i JOIN p ON p.t = i.t JOIN f ON f.t = i.t JOIN d ON d.doc_id = p.doc_id, c GROUP BY item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
