"""The queries of this subpackage that SQL can express, for checking on small tables."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---- set similarity -------------------------------------------------------------------------------

SET_RELATIONS = f"""WITH RECURSIVE worded AS MATERIALIZED (
 SELECT row_number() OVER () AS r, doc_id,
  list_filter(string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
 FROM documents),
sets AS MATERIALIZED (
 SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
 FROM worded),
entries AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS token FROM sets),
pairs AS (
 SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS shared
 FROM entries a JOIN entries b ON a.token = b.token AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (
 SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)
 UNION SELECT b, a FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)),
reach AS (
 SELECT r AS a, r AS b FROM sets
 UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT x.doc_id, len(x.s) AS n_shingles, min(y.doc_id) AS component_id
FROM sets x JOIN reach ON reach.a = x.r JOIN sets y ON y.r = reach.b GROUP BY x.r, x.doc_id, len(x.s)"""

# ---- resampling -----------------------------------------------------------------------------------

# the table of the checksum, one bit after the other, and the checksum of a text's bytes
_STEP = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k::BIGINT)"
_CRC = """xor(4294967295, list_reduce(list_transform(range(octet_length(encode(feature))),
  lambda i: ('0x' || substr(hex(encode(feature)), 2 * i::INT + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""


def _features(name: str, source: str) -> str:
    return f"""{name}_words AS MATERIALIZED (
 SELECT row_number() OVER () AS r, {source}, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {name}),
{name}_features AS MATERIALIZED (
 SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM {name}_words)"""


RESAMPLE = f"""WITH {_features("documents", "doc_id")},
{_features("benchmark", "item_id")},
crc AS (SELECT list({_STEP} ORDER BY k) AS steps FROM range(256) t(k)),
hashed AS MATERIALIZED (
 SELECT feature, {_CRC} % 10000 AS bucket
 FROM (SELECT feature FROM documents_features UNION SELECT feature FROM benchmark_features), crc),
raw AS (SELECT bucket, count(*) AS s FROM documents_features JOIN hashed USING (feature) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM benchmark_features JOIN hashed USING (feature) GROUP BY bucket),
gains AS MATERIALIZED (
 SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM raw) + 10000)
  / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)))) AS BIGINT) AS gain
 FROM raw LEFT JOIN target USING (bucket)),
weights AS (
 SELECT r, count(*) AS n, sum(gain)::BIGINT AS total
 FROM documents_features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY r),
scored AS MATERIALIZED (
 SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
  coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
 FROM documents_words LEFT JOIN weights USING (r)),
placed AS (
 SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS every
 FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * every // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)"""

# ---- clusters -------------------------------------------------------------------------------------

_ROUNDS = 5
_AWAY = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _near(k: int) -> str:
    return f"""near{k} AS MATERIALIZED (
 SELECT r, min(away) AS away, arg_min(c, (away, c)) AS c
 FROM (SELECT kept.r, c.c, CAST({_AWAY} AS BIGINT) AS away FROM kept, centre{k} c) GROUP BY r)"""


def _next(k: int) -> str:
    return f"""centre{k} AS MATERIALIZED (
 SELECT c, coalesce(moved.v, old.v) AS v FROM centre{k - 1} old LEFT JOIN (
  SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY d) AS v FROM (
   SELECT c, d, sum(x)::BIGINT AS total, count(*) AS n FROM near{k - 1} JOIN components USING (r) GROUP BY c, d) GROUP BY c) moved USING (c))"""


CLUSTERS = f"""WITH kept AS MATERIALIZED (
 SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
components AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
centre0 AS MATERIALIZED (
 SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), vec_id, v) - 1 AS c, v FROM kept
 ORDER BY sha256('2:' || vec_id::VARCHAR), vec_id, v LIMIT 40),
{", ".join(f"{_near(k)}, {_next(k + 1)}" for k in range(_ROUNDS))},
{_near(_ROUNDS)}
SELECT vec_id, near{_ROUNDS}.c::INT AS cluster, away AS distance, CAST(sum(away) OVER (PARTITION BY near{_ROUNDS}.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(away) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre{_ROUNDS}.v, ',')) AS centroid_sha256
FROM near{_ROUNDS} JOIN kept USING (r) JOIN centre{_ROUNDS} USING (c)"""

SQL: dict[str, str] = {"op11_resample": RESAMPLE, "op12_set_relations": SET_RELATIONS, "op13_vantage_clusters": CLUSTERS}
