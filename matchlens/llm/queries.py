"""Registered queries of the text operators; each takes (spark, data directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import (
    bpe, decontaminate, licenses, merkle, quality, secrets, sharding, simhash, toxicity, url_filters, vectors, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(spark, _table(spark, sf_dir, "pages"))
    return read.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_qgram_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first_id FROM p GROUP BY h
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::INTEGER >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, and its texts in one language are a repository."""
    docs = _table(spark, sf_dir, "documents")
    return secrets.report(docs, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source"))


def tokenizer_path() -> str:
    """The word tokenizer's file, where the library of public vocabularies keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.write_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch dates and a dated entry come from every page: its host, the domain above, or its first path step."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    start, page = F.lit("2024-01-01").cast("date"), F.col("page_id")
    captures = pages.withColumn("fetch_date", F.date_add(start, (page * 37 % 365).cast("int")))
    host = url_filters.host_of(F.col("url"))
    step = F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]*)", 1)
    entries = pages.select(
        F.when(page % 2 == 0, "block").otherwise("allow").alias("list"),
        F.when(page % 3 == 0, host).when(page % 3 == 1, F.regexp_extract(host, r"^[^.]*\.(.*)$", 1)).otherwise(F.concat_ws("/", host, step)).alias("pattern"),
        F.when(page % 5 < 3, "add").otherwise("remove").alias("action"),
        F.date_add(start, (page * 13 % 400).cast("int")).alias("date"),
    )
    return url_filters.judged(captures, entries)


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetch_date,
    nullif(lower(rtrim(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1), '.')), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages
), e AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'block' ELSE 'allow' END AS list,
    CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '^[^.]*\.(.*)$', 1)
      ELSE concat_ws('/', host, regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]*)', 1)) END AS pattern,
    CASE WHEN page_id % 5 < 3 THEN 'add' ELSE 'remove' END AS action,
    DATE '2024-01-01' + CAST(page_id * 13 % 400 AS INTEGER) AS day
  FROM p
), d AS (
  SELECT list, pattern, day, max(action) AS action FROM e WHERE pattern IS NOT NULL GROUP BY list, pattern, day
), v AS (
  SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM d
), k AS (
  SELECT page_id, fetch_date, unnest(list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(steps) + 1), lambda i: concat_ws('/', host, array_to_string(list_slice(steps, 1, i), '/')))))) AS pattern
  FROM p WHERE host IS NOT NULL
), a AS (
  SELECT k.page_id, k.pattern, v.list, v.day,
    row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.pattern) DESC, v.list DESC) AS r,
    count(*) OVER (PARTITION BY k.page_id) AS n
  FROM k JOIN v ON v.pattern = k.pattern AND v.action = 'add' AND v.day <= k.fetch_date AND (v.until IS NULL OR k.fetch_date < v.until)
)
SELECT p.page_id, p.url, p.host, p.fetch_date,
  CASE WHEN a.list IS NULL THEN 'unlisted' WHEN a.list = 'block' THEN 'blocked' ELSE 'allowed' END AS decision,
  a.pattern, a.day AS listed_since, coalesce(a.n, 0) AS n_active
FROM p LEFT JOIN a ON a.page_id = p.page_id AND a.r = 1
"""


def op9_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are repositories, languages their directories; every fifth name is that of a licence file."""
    doc = F.col("doc_id")
    folder = F.array(F.col("source"), F.when(doc % 3 > 0, F.col("lang")), F.when(doc % 3 > 1, F.concat(F.lit("p"), (doc % 11).cast("string"))))
    name = F.when(doc % 5 == 0, "LICENSE.md").otherwise(F.concat(F.lit("f"), doc.cast("string"), F.lit(".txt")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", F.array_compact(folder), name).alias("path"))
    return licenses.report(docs)


OP9_SQL = r"""
WITH templates AS (
  SELECT * FROM (VALUES {templates}) v(template, license, body)
), d AS (
  SELECT doc_id, text,
    concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 > 1 THEN 'p' || (doc_id % 11) END) AS dir,
    CASE WHEN doc_id % 5 = 0 THEN 'LICENSE.md' ELSE 'f' || doc_id || '.txt' END AS name
  FROM documents
), l AS (
  SELECT doc_id, name, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM d WHERE text IS NOT NULL
), lx AS (
  SELECT doc_id, name, line,
    list_filter(list_transform(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}.-]+'), lambda x: trim(x, '.-')), lambda x: x <> '') AS terms FROM l
), lb AS (
  SELECT *, sum(CASE WHEN len(terms) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM lx
), u AS (
  SELECT doc_id, line, 0 AS scope, terms FROM lx
  UNION ALL SELECT doc_id, min(line), 1, flatten(list(terms ORDER BY line)) FROM lb WHERE len(terms) > 0 GROUP BY doc_id, block HAVING count(*) > 1
  UNION ALL SELECT doc_id, 0, 2, flatten(list(terms ORDER BY line)) FROM lx WHERE name = 'LICENSE.md' GROUP BY doc_id HAVING count(*) > 1
), ut AS (
  SELECT doc_id, line, scope, term, count(*) AS tf FROM (SELECT doc_id, line, scope, unnest(terms) AS term FROM u) GROUP BY ALL
), tt AS (
  SELECT template, t AS term, count(*) AS tf FROM (
    SELECT template, unnest(list_transform(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}.-]+'), lambda x: trim(x, '.-'))) AS t FROM templates
  ) WHERE t <> '' GROUP BY ALL
), n AS (
  SELECT count(*) AS n FROM d
), idf AS (
  SELECT v.term, ln((1 + n.n) / (1 + coalesce(f.n, 0))) + 1 AS idf
  FROM (SELECT term FROM tt UNION SELECT term FROM ut) v CROSS JOIN n
  LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS n FROM ut WHERE scope = 0 GROUP BY term) f ON f.term = v.term
), uw AS (
  SELECT doc_id, line, scope, term, tf * idf AS w FROM ut JOIN idf USING (term)
), tw AS (
  SELECT template, term, tf * idf AS w FROM tt JOIN idf USING (term)
), c AS (
  SELECT doc_id, line, scope, template, round(dot / (un.norm * tn.norm), 6) AS similarity
  FROM (SELECT uw.doc_id, uw.line, uw.scope, tw.template, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL)
  JOIN (SELECT doc_id, line, scope, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL) un USING (doc_id, line, scope)
  JOIN (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL) tn USING (template)
), own AS (
  SELECT doc_id, line, license, similarity, ['line', 'block', 'file'][scope + 1] AS scope
  FROM c JOIN templates USING (template) WHERE similarity >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, line, c.scope, template) = 1
), speaking AS (
  SELECT dir AS at, min(struct_pack(path := dir || '/' || name, license := license)).license AS license
  FROM d JOIN own USING (doc_id) WHERE name = 'LICENSE.md' GROUP BY dir
), inherited AS (
  SELECT d.doc_id, s.at, s.license FROM d JOIN speaking s ON d.dir = s.at OR starts_with(d.dir, s.at || '/')
  QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY length(s.at) DESC) = 1
)
SELECT d.doc_id, d.dir || '/' || d.name AS path, own.license AS own_license, own.similarity, CAST(own.line AS INTEGER) AS line, own.scope,
  coalesce(own.license, i.license) AS license, CASE WHEN own.license IS NULL THEN i.at END AS inherited_from
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN inherited i USING (doc_id)
""".format(
    templates=", ".join("({}, '{}', '{}')".format(i, *row) for i, row in enumerate(licenses.TEMPLATES)), threshold=licenses.THRESHOLD
)


def op10_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op11_sign_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
), least AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM pairs GROUP BY a) n ON n.a = v.vec_id
"""


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered rows count one character more."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)")
    return merkle.verify(_table(spark, sf_dir, "documents"), {"n_chars": F.when(hit, more + 1).otherwise(more)})


#: DuckDB has no crc32: a table of eight-step remainders folds the digits of an id.
OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT b, list_reduce([CAST(b AS UBIGINT)] || [CAST(0 AS UBIGINT)] || list_transform(range(7), lambda x: CAST(0 AS UBIGINT)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS r
  FROM range(256) t(b)
), table_of AS (
  SELECT list(r ORDER BY b) AS t FROM crc
), d AS (
  SELECT doc_id, lang, n_chars, source, text, CAST(doc_id AS VARCHAR) AS s,
    xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT)),
      lambda c, x: xor(c >> 8, t[1 + CAST(xor(c, x) & 255 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS crc
  FROM documents, table_of
), f AS (
  SELECT doc_id, lang, crc % 7 = 0 AS hit, n_chars,
    strlen(s) || ':' || s || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + hit::INT AS VARCHAR)) || ':' || (n_chars + hit::INT), '-') || tail) AS edited
  FROM f
), trees(level, lang, i, n, h) AS (
  SELECT 0, lang, i, count(*) OVER (PARTITION BY lang), leaf FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY level, lang, i // 2, n
), subroots AS (
  SELECT level AS height, lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM trees WHERE n = 1
), tops(level, i, n, h) AS (
  SELECT 0, k, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n
), nodes AS (
  SELECT level, lang, false AS top, i, h FROM trees WHERE n > 1 UNION ALL SELECT level, NULL, true, i, h FROM tops WHERE n > 1
), way(doc_id, lang, subroot, height, k, level, i, top, h, proof) AS (
  SELECT l.doc_id, l.lang, s.subroot, s.height, s.k, 0, CASE WHEN s.height = 0 THEN s.k ELSE l.i END, s.height = 0, l.edited, ''
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.subroot, w.height, w.k,
    CASE WHEN NOT w.top AND w.level + 1 = w.height THEN 0 ELSE w.level + 1 END,
    CASE WHEN NOT w.top AND w.level + 1 = w.height THEN w.k ELSE w.i // 2 END,
    w.top OR w.level + 1 = w.height,
    sha256(CASE WHEN o.h IS NULL THEN w.h WHEN w.i % 2 = 1 THEN o.h || w.h ELSE w.h || o.h END),
    w.proof || coalesce(o.h, '')
  FROM way w JOIN (SELECT max(level) AS up FROM tops) t ON NOT w.top OR w.level < t.up
  LEFT JOIN nodes o ON o.top = w.top AND o.level = w.level AND o.i = xor(w.i, 1) AND (w.top OR o.lang IS NOT DISTINCT FROM w.lang)
), done AS (
  SELECT doc_id, subroot, h, proof FROM way, (SELECT max(level) AS up FROM tops) t WHERE top AND level = up
)
SELECT l.doc_id, l.leaf, e.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN done e USING (doc_id), (SELECT h FROM tops WHERE n = 1) r
"""


QUERIES = {
    "op1_warc_normalise": op1_warc_normalise,
    "op2_toxicity_compression": op2_toxicity_compression,
    "op4_qgram_decontaminate": op4_qgram_decontaminate,
    "op3_secret_ownership": op3_secret_ownership,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_two_pass_shuffle": op7_two_pass_shuffle,
    "op8_url_temporal_lists": op8_url_temporal_lists,
    "op9_license_inheritance": op9_license_inheritance,
    "op10_quality_mcd": op10_quality_mcd,
    "op11_sign_hash_dedup": op11_sign_hash_dedup,
    "op12_jacobi_davidson": op12_jacobi_davidson,
    "op13_midstate_manifest": op13_midstate_manifest,
}

#: DuckDB text of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_warc_normalise": OP1_SQL,
    "op8_url_temporal_lists": OP8_SQL,
    "op9_license_inheritance": OP9_SQL,
    "op11_sign_hash_dedup": OP11_SQL,
    "op13_midstate_manifest": OP13_SQL,
}
