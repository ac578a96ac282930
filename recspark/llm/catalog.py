"""Queries of the operators in this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import archive, byte_bpe, clusters, decontaminate, hosts, main_text, manifest, ngram_join, sanitize, substrings, token_files, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a session and a folder under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL_TWINS[fn.__name__] = sql
        return fn

    return register


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query()
def op1_byte_bpe(spark, folder):
    return byte_bpe.round_trip(_read(spark, folder, "documents"))


@query()
def op2_decontamination(spark, folder):
    return decontaminate.contaminated(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


@query(r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS first FROM grams GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM grams JOIN firsts USING (g), range(13) AS r(k) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def op3_substring_dedup(spark, folder):
    return substrings.digest(substrings.drop_repeated(_read(spark, folder, "documents")))


def _rank_steps() -> str:
    """The steps of the propagation over host edges, each a table of its own."""
    out, d = [], hosts.DAMPING
    for k in range(hosts.STEPS):
        has = "SELECT host, 0.0 AS t, 0.0 AS d FROM seeds" if k == 0 else f"SELECT * FROM step{k - 1}"
        out.append(f"""
held{k} AS MATERIALIZED (
  SELECT host, {1 - d} * coalesce(st, 0) + coalesce(t, 0) AS t, {1 - d} * coalesce(sd, 0) + coalesce(d, 0) AS d
  FROM seeds FULL JOIN ({has}) USING (host)),
step{k} AS MATERIALIZED (
  SELECT dst AS host, {d} * sum(t * ahead) AS t, {d} * sum(d * back) AS d
  FROM (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS ahead, 0 AS back FROM edges
        UNION ALL SELECT dst, src, 0, n / sum(n) OVER (PARTITION BY dst) FROM edges) JOIN held{k} ON src = host GROUP BY dst)""")
    return ",".join(out)


@query(rf"""
WITH split AS MATERIALIZED (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS MATERIALIZED (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(h, p, says) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in hosts.RULES)}),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(says, length(h || p) * 1000 + length(h)) AS ruled
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
judged AS MATERIALIZED (SELECT page_id, html, host, path, rule, ruled FROM parts LEFT JOIN fits USING (page_id)),
links AS (
  SELECT host AS src, lower(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1))) AS dst FROM judged),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
seeds AS MATERIALIZED (
  SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS st, count(*) FILTER (ruled = 'block') / count(*) AS sd
  FROM judged WHERE host <> '' GROUP BY host),
{_rank_steps()}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN t + d > 0 AND d >= {hosts.BLOCK_SHARE} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN step{hosts.STEPS - 1} USING (host)
""")
def op4_url_filter(spark, folder):
    return hosts.judged_urls(_read(spark, folder, "pages")).drop("trust", "distrust")


def _held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query()
def op5_toxicity(spark, folder):
    docs = _read(spark, folder, "documents")
    model = toxicity.fit(docs, _read(spark, folder, "labels").where(~_held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), toxicity.score_of(F.col("text"), model, spark).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query(r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT x, z FROM reach JOIN (SELECT a AS y, b AS z FROM links UNION ALL SELECT b, a FROM links) USING (y))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)
""")
def op6_ngram_join(spark, folder):
    return ngram_join.near_duplicate_groups(_read(spark, folder, "documents"))


@query()
def op7_main_text(spark, folder):
    return main_text.main_texts(_read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op8_token_files(spark, folder):
    path = token_files.write_tokens(_read(spark, folder, "documents"))
    rows = token_files.read_tokens(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(r"""
WITH named AS MATERIALIZED (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS k FROM pages),
firsts AS (SELECT k, min(page_id) AS first FROM named GROUP BY k),
letters AS (
  SELECT page_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM named JOIN firsts USING (k) JOIN letters USING (page_id)
""")
def op9_archive(spark, folder):
    written = archive.write_archive(_read(spark, folder, "pages"))
    rows = archive.read_records(spark, written)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT x AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON x = a GROUP BY x
""")
def op10_near_vectors(spark, folder):
    return vectors.near_vectors(_read(spark, folder, "embeddings"))


def _kmeans_rounds() -> str:
    """Centroids of each round, from the vectors assigned to those of the round before."""
    out = []
    for r in range(clusters.ROUNDS + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, min(ROW(d, c)) AS best FROM (
    SELECT row, vec_id, c, list_sum(list_transform(range(1, {clusters.COMPONENTS + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d
    FROM kept k, c{r} c) GROUP BY row),
m{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT a.best[2] AS c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM a{r} a JOIN kept k USING (row)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{r} GROUP BY c) n USING (c))""")
    return ",".join(out)


@query(rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {clusters.COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clusters.COMPONENTS}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id), v) - 1)::INTEGER AS c, v FROM kept QUALIFY c < {clusters.CENTROIDS}),
{_kmeans_rounds()},
final AS (
  SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance FROM a{clusters.ROUNDS})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM final JOIN c{clusters.ROUNDS} ON c = cluster
""")
def op11_centroid_clusters(spark, folder):
    return clusters.with_inertia(*clusters.cluster_vectors(_read(spark, folder, "embeddings")))


def _tree_levels(name: str, levels: int) -> str:
    """Nodes of all levels of the trees of ``{name}0 (g, idx, h, n)``, each with its siblings left and right."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}{k}s AS MATERIALIZED (
  SELECT a.g, a.idx, a.n, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.idx // {manifest.FAN} = b.idx // {manifest.FAN} GROUP BY a.g, a.idx, a.n),
{name}{k + 1} AS MATERIALIZED (
  SELECT g, idx // {manifest.FAN} AS idx, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h,
    CASE WHEN n = 1 THEN 1 ELSE (n + {manifest.FAN - 1}) // {manifest.FAN} END AS n
  FROM {name}{k} GROUP BY g, idx // {manifest.FAN}, n)""")
    return ",".join(out)


def _folds(name: str, tree: str, levels: int) -> str:
    """Values folded along the siblings from ``{name}0 (row, g, idx, value, proof)`` on."""
    return ",".join(
        f"""
{name}{k + 1} AS MATERIALIZED (
  SELECT row, g, f.idx // {manifest.FAN} AS idx, CASE WHEN n = 1 THEN value ELSE sha256(l || value || r) END AS value, proof || l || r AS proof
  FROM {name}{k} f JOIN {tree}{k}s USING (g, idx))"""
        for k in range(levels)
    )


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


# DuckDB has no crc32, so the twin steps through the bits of each byte
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {steps})"
_DEEP = 6


def _crc32() -> str:
    step = "xor(a, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)[1]"
    return f"xor({_CRC.format(steps=step)}, 4294967295::BIGINT)"


@query(f"""
WITH crcs AS MATERIALIZED (SELECT *, {_crc32()} AS crc FROM documents),
hashed AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS g,
    sha256({" || ".join(_field(c) for c in manifest.FIELDS)}) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256({" || ".join(_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in manifest.FIELDS)}) END AS forged
  FROM crcs),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM hashed),
t0 AS (SELECT g, idx, leaf AS h, n FROM placed),
{_tree_levels("t", _DEEP)},
subroots AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t{_DEEP}),
u0 AS (SELECT '' AS g, place AS idx, subroot AS h, n FROM subroots),
{_tree_levels("u", 2)},
f0 AS (SELECT row, g, idx, coalesce(forged, leaf) AS value, '' AS proof FROM placed),
{_folds("f", "t", _DEEP)},
e0 AS (SELECT row, '' AS g, place AS idx, value, proof FROM f{_DEEP} f JOIN subroots USING (g)),
{_folds("e", "u", 2)}
SELECT doc_id, leaf, subroot, u2.h AS root, sha256(proof) AS proof_sha256, value AS folded_root, value = u2.h AS verified
FROM placed p JOIN e2 USING (row) JOIN subroots s ON s.g = p.g, u2
""")
def op12_merkle_manifest(spark, folder):
    return manifest.manifest(_read(spark, folder, "documents")).drop("lang", "copies")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The patterns in their plain forms.
_PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_WORD = r"[\p{L}\p{N}]+"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INTEGER
  ELSE (substr({_DIGITS}, i, 1)::INTEGER * 2) // 10 + (substr({_DIGITS}, i, 1)::INTEGER * 2) % 10 END)) % 10 = 0"""
_VALID = (
    "true",
    "len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0",
    f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    f"length({_DIGITS}) BETWEEN 10 AND 15",
)


def _matches(source: str, text: str, pattern: str) -> str:
    """``row, m, start, stop`` of all matches of a pattern in the texts of a table."""
    return f"""SELECT row, m, (before - length(m))::BIGINT AS start, before::BIGINT AS stop FROM (
    SELECT row, m, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS before FROM (
      SELECT row, unnest(ms) AS m, unnest(list_slice(string_split_regex({text}, '{pattern}'), 1, len(ms))) AS gap, generate_subscripts(ms, 1) AS i
      FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms FROM {source})))"""


def _base(source: str, text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT row, {k} AS kind, m, start, stop FROM ({_matches(source, text, p)}) WHERE {v}" for k, (p, v) in enumerate(zip(_PLAIN, _VALID, strict=True))
    )


@query(rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({_base("texts", "text")}),
lines AS MATERIALIZED (
  SELECT row_number() OVER () AS row, line FROM (
    SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^ 	-
]'))),
held AS MATERIALIZED ({_base("lines", "line")}),
around AS (
  SELECT row, kind || ':' || CASE kind WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE {_DIGITS} END AS entity,
    substring(line, greatest(start - {sanitize.REACH}, 0) + 1, start - greatest(start - {sanitize.REACH}, 0)) AS l, start > {sanitize.REACH} AS cut_l,
    substring(line, stop + 1, {sanitize.REACH}) AS r, length(line) > stop + {sanitize.REACH} AS cut_r
  FROM held JOIN lines USING (row)),
near AS (
  SELECT row, entity, unnest(regexp_extract_all({_LOW.format("w")}, '[\p{{L}}\p{{N}}]+')) AS term FROM (
    SELECT row, entity, CASE WHEN cut_l THEN regexp_replace(l, '^[\p{{L}}\p{{N}}]+', '') ELSE l END || chr(10)
      || CASE WHEN cut_r THEN regexp_replace(r, '[\p{{L}}\p{{N}}]+$', '') ELSE r END AS w FROM around)),
pairs AS (
  SELECT row, entity, term AS key FROM near UNION SELECT row, entity, left(term, {sanitize.GENERAL}) || '*' FROM near UNION SELECT row, entity, '' FROM around),
shared AS MATERIALIZED (SELECT entity, key, count(*) AS n_both FROM pairs GROUP BY ALL HAVING count(*) >= {sanitize.LEAST_LINES}),
words AS (SELECT row, unnest(regexp_extract_all({_LOW.format("line")}, '[\p{{L}}\p{{N}}]+')) AS term FROM lines),
keys AS (SELECT row, term AS key FROM words UNION SELECT row, left(term, {sanitize.GENERAL}) || '*' FROM words),
counts AS MATERIALIZED (SELECT key, count(*) AS n FROM keys GROUP BY key),
telling AS MATERIALIZED (
  SELECT DISTINCT s.key FROM shared s JOIN shared o ON o.entity = s.entity AND o.key = '' JOIN counts c ON c.key = s.key, (SELECT count(*) AS total FROM lines)
  WHERE s.key <> '' AND o.n_both < total AND ln(s.n_both::DOUBLE * total / (o.n_both::DOUBLE * c.n)) >= {sanitize.DISCLOSURE} * ln(total / o.n_both::DOUBLE)),
low AS (SELECT row, {_LOW.format("text")} AS text FROM texts),
spans AS MATERIALIZED (
  SELECT row, kind, start, stop FROM base
  UNION ALL SELECT row, {sanitize.TERM}, start, stop FROM ({_matches("low", "text", _WORD)}) t
  WHERE m IN (SELECT key FROM telling) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.start < t.stop AND t.start < b.stop)),
said AS (SELECT row, kind, start, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM spans),
joined AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
    count(*) FILTER (kind = 3) AS n_phone, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {sanitize.TERM}) AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM said GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (row)
""")
def op13_personal_data(spark, folder):
    return sanitize.digest(sanitize.sanitized(_read(spark, folder, "documents")))
