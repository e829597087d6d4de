"""The operators as queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, embedding_dedup, fingerprints, license_scan, line_dedup, mixing, near_dedup, personal_data, piece_sampling, pipeline as corpus, runs, substring_dedup, token_counts, toxicity
from .common import read, tokenizer

TOKEN_LIMIT = 2048


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, similarity=(80, 100))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("detections")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(read(spark, sf_dir, "documents"), window=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text_kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(read(spark, sf_dir, "documents"), by_cycle=False)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), least_cosine=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_and_decode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = toxicity.toxicity(docs, machine).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"), k=40, rounds=5).withColumnRenamed("id", "vec_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read(spark, sf_dir, "documents"), plant=True, whole=False).withColumnRenamed("id", "doc_id")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.personal_data(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in personal_data.KINDS], F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_dedup, op2_license_scan, op3_substring_dedup, op4_token_counts, op5_mixing, op6_line_dedup, op7_embedding_dedup, op8_fingerprints, op9_piece_sampling, op10_toxicity, op11_centroids, op12_periodic_runs, op13_personal_data, pipeline)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINKED = """, reach(u, v) AS (SELECT id, id FROM node UNION SELECT r.u, e.b FROM reach r JOIN edge e ON r.v = e.a),
component AS (SELECT u AS id, min(v) AS c FROM reach GROUP BY u)"""

_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
node AS (SELECT doc_id AS id FROM documents)
{_LINKED}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN component c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_PASSAGES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
lo AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN lo USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t FROM word x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, line, p, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM l),
held AS (SELECT k, min(doc_id) AS m FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(k.doc_id > m, false) AS gone FROM k LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
node AS (SELECT vec_id AS id FROM embeddings)
{_LINKED}
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN component c ON c.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM edge GROUP BY a) ON a = v.vec_id
"""




def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Components as rows; each round is an assignment by the smallest (distance, number) and a new table of centroids."""
    out = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(e) AS x FROM v),
seed AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM seed JOIN x USING (r))"""
    for n in range(rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS a FROM (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)"""
        if n < rounds:
            out += f""",
m{n} AS (SELECT a.c AS c, i, floor(sum(x) / count(*))::BIGINT AS y FROM x JOIN a{n} USING (r) GROUP BY a.c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.y, o.y) AS y FROM c{n} o LEFT JOIN m{n} m USING (c, i))"""
    return out + f""",
final AS (SELECT vec_id, a.c AS c, a.d AS d FROM a{rounds} JOIN v USING (r)),
digest AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM final JOIN digest USING (c)"""


def _personal_sql(window: int = 8, disclosure: float = 0.95, contexts: int = 3) -> str:
    """Matches and words with their places from the gaps between them; then the counts of documents, and the spans in order."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    low = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    at = lambda g, h: f"coalesce(list_sum(list_transform({g}[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform({h}[1:i - 1], lambda v: length(v))), 0)"
    whole = lambda gap: f"regexp_extract_all(regexp_replace({gap}, '^{word}|{word}$', ' ', 'g'), '{word}')"
    digit = "CAST(substr(dg, length(dg) - k + 1, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length(dg) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    valid = f"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda v: length(ltrim(v, '0')) > 3 OR coalesce(TRY_CAST(ltrim(v, '0') AS BIGINT), 0) > 255)) = 0
      WHEN 'card' THEN length(dg) BETWEEN 12 AND 19 AND {luhn} ELSE length(dg) BETWEEN 9 AND 15 END"""
    class_of = lambda c: f"CASE WHEN regexp_matches({c}, '[0-9]') THEN '#number' WHEN regexp_matches({c}, '^\\p{{Lu}}') THEN '#name' ELSE '#word' END"
    kinds = " UNION ALL ".join(f"SELECT r, {o} AS o, '{k}' AS kind, regexp_extract_all(text, '{rx}') AS hs, regexp_split_to_array(text, '{rx}') AS gs FROM d" for o, (k, rx) in enumerate(plain.items()))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM d),
h AS ({kinds}), x AS (SELECT r, o, kind, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM h WHERE len(hs) > 0),
m AS (SELECT r, o, kind, i, hs[i] AS hit, regexp_replace(hs[i], '[^0-9]', '', 'g') AS dg, {at("gs", "hs")} AS s,
  {whole("CASE WHEN i = 1 THEN ' ' || gs[1] ELSE gs[i] END")} AS lw, {whole("CASE WHEN i = len(hs) THEN gs[i + 1] || ' ' ELSE gs[i + 1] END")} AS rw FROM x),
b AS MATERIALIZED (SELECT r, o, kind, s, s + length(hit) AS e, kind || ':' || CASE kind WHEN 'email' THEN {low("hit")} WHEN 'ip' THEN hit ELSE dg END AS c, list_concat(list_reverse(list_reverse(lw)[1:{window}]), rw[1:{window}]) AS around FROM m WHERE {valid}),
held AS (SELECT c, count(DISTINCT r) AS n_c FROM b GROUP BY c), w AS (SELECT r, c, around, unnest(around) AS w FROM b),
near AS (SELECT r, c, around, {low("w")} AS t FROM w UNION SELECT r, c, around, {class_of("w")} FROM w),
pair AS (SELECT c, t, count(DISTINCT r) AS n_ct FROM near GROUP BY c, t HAVING count(DISTINCT around) >= {contexts}),
word AS MATERIALIZED (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM d)),
df AS (SELECT t, count(DISTINCT r) AS n_t FROM (SELECT r, {low("w")} AS t FROM word UNION ALL SELECT DISTINCT r, {class_of("w")} FROM word) WHERE t IN (SELECT t FROM pair) GROUP BY t),
reveal AS (SELECT DISTINCT t FROM pair JOIN held USING (c) JOIN df USING (t), n WHERE n_ct >= n_t * pow(n_c / n, 1::DOUBLE - {disclosure}::DOUBLE)),
told AS (SELECT DISTINCT r FROM word WHERE {low("w")} IN (SELECT t FROM reveal)),
place AS (SELECT r, ws[i] AS w, {at("gs", "ws")} AS s FROM (SELECT r, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws, regexp_split_to_array(text, '{word}') AS gs FROM d WHERE r IN (SELECT r FROM told)))),
term AS (SELECT r, 4 AS o, 'term' AS kind, s, s + length(w) AS e FROM place p WHERE {low("w")} IN (SELECT t FROM reveal) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = p.r AND b.s < p.s + length(p.w) AND b.e > p.s)),
base AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS l FROM b GROUP BY r),
every AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS l FROM (SELECT r, o, kind, s, e FROM b UNION ALL SELECT * FROM term) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base.l, '')) AS base_sha256, coalesce(every.l, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL gives the same rows; the others are tested against brute force in tests/llm."""
    return {"op1_near_dedup": _NEAR, "op3_substring_dedup": _PASSAGES, "op6_line_dedup": _LINES, "op7_embedding_dedup": _VECTORS, "op11_centroids": _centroids_sql(), "op13_personal_data": _personal_sql()}
