"""The corpus operators as queries over the documents, embeddings and pages tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.llm import exact_dedup, filter_audit, language_id, license_scan, mixing, near_dup, packing, quality, toxicity, url_filter, vector_codes, vector_dedup, warc
from geostream.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), texts=False)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_near_duplicates, op3_mixing, op4_toxicity, op5_url_filter, op6_license_scan, op7_exact_dedup, op8_vector_dedup, op9_packing, op10_language_id, op11_warc, op12_vector_codes, op13_filter_audit, pipeline)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _url_sql() -> str:
    """The URL filter with its default rules and parameters, the purity by recursion over the depth of the tree."""
    fits = lambda host, path: f"(host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%'"
    rule = " ".join(f"WHEN {fits(*text.split('/', 1)[:1], '/' + text.split('/', 1)[1])} THEN '{text}'" for text, _ in sorted(url_filter.RULES, key=lambda x: (-len(x[0]), x[0])))
    says = " ".join(f"WHEN '{text}' THEN '{verdict}'" for text, verdict in url_filter.RULES)
    return f"""
WITH RECURSIVE p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {rule} END AS rule FROM h),
s AS (SELECT *, CASE rule {says} END AS ruled FROM r),
k AS (SELECT host, path, count(*) AS n, count(ruled) AS l, count(*) FILTER (WHERE ruled = 'block') AS b FROM s WHERE host <> '' GROUP BY 1, 2),
e AS (SELECT host, path, n, unnest(range(2, len(parts) + 1)) AS d, parts FROM (SELECT *, string_split(regexp_replace(path, '/$', ''), '/') AS parts FROM k)),
w AS (SELECT host, path, n, d, parts[d] AS part, regexp_full_match(parts[d], '[0-9]+(\\.[A-Za-z0-9]+)?') OR regexp_full_match(parts[d], '[0-9a-f-]{{16,}}') AS varies FROM e),
c AS (SELECT host, d, part, sum(n) AS pages, count(*) OVER (PARTITION BY host, d) AS kinds FROM w WHERE NOT varies GROUP BY 1, 2, 3),
t AS (SELECT w.host, w.path, string_agg(CASE WHEN c.pages >= 5 OR c.kinds <= 3 THEN w.part ELSE '*' END, '/' ORDER BY w.d) AS tail FROM w LEFT JOIN c ON w.host = c.host AND w.d = c.d AND w.part = c.part AND NOT varies GROUP BY 1, 2),
f AS (SELECT k.*, coalesce('/' || tail, '') AS template FROM k LEFT JOIN t USING (host, path)),
g AS (SELECT host, template, sum(l) AS l, sum(b) AS b FROM f GROUP BY 1, 2),
x AS (SELECT host, template, l, b, unnest(range(1, len(string_split(template, '/')) + 1)) AS d, string_split(template, '/') AS parts FROM g),
o AS (SELECT host, d, array_to_string(parts[1:d], '/') AS node, array_to_string(parts[1:d - 1], '/') AS parent, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b FROM x GROUP BY 1, 2, 3, 4),
q AS (SELECT o.*, u.l - o.l AS rl, u.b - o.b AS rb, u.b / u.l AS s FROM o LEFT JOIN o u ON u.host = o.host AND u.d = o.d - 1 AND u.node = o.parent),
y AS (SELECT host, d, node, parent, l, b, coalesce(CASE WHEN l > 0 AND rl > 0 THEN abs(b / l - rb / rl) > 1.96::DOUBLE * sqrt(s * (1 - s) * (1 / l + 1 / rl)) + 1e-12 END, FALSE) AS differs FROM q),
m AS (SELECT host, d, node, parent, sum(l) OVER v AS l, sum(b) OVER v AS b FROM y WINDOW v AS (PARTITION BY host, d, parent, CASE WHEN differs THEN node END)),
z(host, d, node, purity) AS (
  SELECT host, d, node, (b + 1.5::DOUBLE * (SELECT (sum(b) + 0.5) / (sum(l) + 1) FROM g)::DOUBLE) / (l + 2) FROM m WHERE d = 1
  UNION ALL SELECT m.host, m.d, m.node, (m.b + 1.5::DOUBLE * z.purity) / (m.l + 2) FROM m JOIN z ON m.host = z.host AND m.d = z.d + 1 AND m.parent = z.node)
SELECT page_id, s.host, s.path, rule, coalesce(ruled, CASE WHEN purity >= 0.75 THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f ON s.host = f.host AND s.path = f.path LEFT JOIN z ON f.host = z.host AND z.d = len(string_split(f.template, '/')) AND f.template = z.node"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Integer k-means by a full search in each round."""
    nearest = lambda book: f"""SELECT n, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.n, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d FROM x JOIN {book} b ON x.p = b.p) GROUP BY 1, 2, 3"""
    steps = ""
    for i in range(rounds):
        steps += f"""
a{i} AS MATERIALIZED ({nearest(f"c{i}")}),
m{i} AS (SELECT p, e, list(s ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.e = m.e),"""
    return f"""
WITH k AS (SELECT vec_id, label, embedding::DOUBLE[] AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS n, vec_id, label, list_transform(w, lambda v: floor(1024 * v)::BIGINT) AS w FROM k),
x AS MATERIALIZED (SELECT n, p, w[p * len(w) // {parts} + 1:(p + 1) * len(w) // {parts}] AS v FROM r, range({parts}) t(p)),
c0 AS (SELECT p, n - 1 AS e, v FROM x WHERE n <= {entries}),{steps}
f AS ({nearest(f"c{rounds}")}),
g AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN g USING (n), h"""


def _audit_sql(names: str = "ABCDE") -> str:
    orders = ", ".join(f"('{order}', {step}, {1 << names.index(order[step - 1])}, {sum(1 << names.index(c) for c in order[:step - 1])})" for order, _ in filter_audit.orders(names) for step in range(1, len(names) + 1))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask
  FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(filter_order, step, bit, before) AS (VALUES {orders}),
s AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM c, o GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM s"""


ORACLE_SQL = {
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, sha1(h) AS x, row_number() OVER w AS k, first_value(page_id) OVER w AS top FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((instr('0123456789abcdef', x[5 * i // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', x[5 * i // 4 + 2]) - 1) // (1 << (3 - (5 * i) % 4))) % 32 + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM r""",
    "op12_vector_codes": _codes_sql(),
    "op13_filter_audit": _audit_sql(),
    "op5_url_filter": _url_sql(),
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(greatest(1 - 1.8 * (len(regexp_extract_all(text, '[0-9#$%&*|!=<>{}]')) / greatest(length(text), 1)), 0.1), 1.0)::DOUBLE AS w,
    concat('0x', substr(md5(concat('17:', coalesce(doc_id::VARCHAR, ':' || md5(text), ''))), 1, 13))::BIGINT AS bits
  FROM documents),
k AS (SELECT doc_id, source, size, -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::DOUBLE AS most,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM k GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s),
t AS (
  SELECT source, source_size, coalesce(w * first_value(CASE WHEN level * w <= most THEN level END IGNORE NULLS) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), most) AS target
  FROM l),
p AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN 2 * reached - size <= 2 * (target - epochs * source_size) AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p""",
    "op2_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS own
  FROM w),
u AS (SELECT doc_id, unnest(own) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 85 * (len(x.own) + len(y.own) - n)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op8_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95::DOUBLE),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
}
