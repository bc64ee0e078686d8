"""The registered queries of the numbered operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import ann, decontam, langid, merkle, packing, phrases, pii, secrets, sharding, simhash, substrings, topk, toxicity
from .common import id_crc
from .registry import register


@register("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op2_top_k_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op2_top_k_search(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _spans_sql(order: int, kind: str, pattern: str, keep: str) -> str:
    """Matches of one kind with code-point positions: gaps and matches before each one are added up."""
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, v, s, s + length(v) AS e FROM (
  SELECT doc_id, m[i] AS v,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d) x,
       unnest(range(1, len(m) + 1)) u(i)) y
WHERE {keep}"""


_ASSIGN = secrets.ASSIGN.replace("\\x20", " ")
_SECRETS_SQL = ("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ("
                + _spans_sql(0, "assign", _ASSIGN, "length(regexp_extract(v, '{}', 2)) >= 8".format(_ASSIGN.replace("'", "''")))
                + " UNION ALL " + _spans_sql(1, "access", "AKIA[A-Z0-9]{12,}", "true")
                + " UNION ALL " + _spans_sql(2, "hex", "[0-9a-f]{32,}", "true") + """),
f AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS a,
             count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2
      FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(a, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN f USING (doc_id)""")


@register("op4_secret_scan", _SECRETS_SQL)
def op4_secret_scan(spark, sf_dir):
    return secrets.summarise(secrets.scan_versions(read_table(spark, sf_dir, "documents")))


@register("op5_sharding")
def op5_sharding(spark, sf_dir):
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out)
    scored = toxicity.score_documents(docs, train, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op7_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i AS s, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
f AS (SELECT k, min((doc_id, s)) AS first FROM g GROUP BY k),
c AS (SELECT DISTINCT g.doc_id, g.s + j AS p FROM g JOIN f USING (k), range(20) r(j) WHERE (g.doc_id, g.s) <> f.first),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
r AS (SELECT x.doc_id, count(c.p) AS n_removed,
             string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""")
def op7_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc() % 3 == 1, F.lit(False))
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out)
    return langid.identify(docs, train).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf_dir):
    """One row for each document and class of benchmark items that contaminates it; the smallest item id stands for the class."""
    found = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_items", "n_windows", "coverage", "exact")


@register("op10_pii")
def op10_pii(spark, sf_dir):
    return pii.summarise(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


_MERKLE_SQL = """
WITH RECURSIVE m AS (
  SELECT doc_id, lang, n_chars,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS z
  FROM documents),
h AS (SELECT doc_id, lang, n_chars, a, z,
             sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || z) AS leaf FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM h),
t(lang, lvl, i, n, d) AS (
  SELECT lang, 0, i, n, leaf FROM l
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (min(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, j, n, d) AS (
  SELECT 0, j, n, subroot FROM s
  UNION ALL
  SELECT lvl + 1, j // 2, (min(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY j)) FROM u WHERE n > 1 GROUP BY lvl, j // 2),
{crc}
b AS (SELECT l.doc_id, l.lang, l.leaf, l.i,
             CASE WHEN c.crc % 7 = 0 AND l.n_chars IS NOT NULL
                  THEN sha256(l.a || octet_length(encode(CAST(l.n_chars + 1 AS VARCHAR))) || ':' || (l.n_chars + 1) || l.z)
                  ELSE l.leaf END AS given
      FROM l LEFT JOIN crcs c ON c.doc_id = l.doc_id),
p(doc_id, lang, leaf, i0, lvl, i, acc, sib) AS (
  SELECT doc_id, lang, leaf, i, 0, i, given, '' FROM b
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.i0, p.lvl + 1, p.i // 2,
         sha256(CASE WHEN p.i % 2 = 1 THEN o.d || p.acc ELSE p.acc || coalesce(o.d, '') END), p.sib || coalesce(o.d, '')
  FROM p JOIN t x ON x.lang IS NOT DISTINCT FROM p.lang AND x.lvl = p.lvl AND x.i = p.i AND x.n > 1
         LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lvl = p.lvl AND o.i = xor(p.i, 1)),
q AS (SELECT doc_id, lang, leaf, i0, acc, sib FROM p QUALIFY row_number() OVER (PARTITION BY lang, i0 ORDER BY lvl DESC) = 1),
r(doc_id, lang, leaf, i0, subroot, lvl, j, acc, sib) AS (
  SELECT q.doc_id, q.lang, q.leaf, q.i0, s.subroot, 0, s.j, q.acc, q.sib FROM q JOIN s ON s.lang IS NOT DISTINCT FROM q.lang
  UNION ALL
  SELECT r.doc_id, r.lang, r.leaf, r.i0, r.subroot, r.lvl + 1, r.j // 2,
         sha256(CASE WHEN r.j % 2 = 1 THEN o.d || r.acc ELSE r.acc || coalesce(o.d, '') END), r.sib || coalesce(o.d, '')
  FROM r JOIN u x ON x.lvl = r.lvl AND x.j = r.j AND x.n > 1 LEFT JOIN u o ON o.lvl = r.lvl AND o.j = xor(r.j, 1)),
e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, i0 ORDER BY lvl DESC) = 1)
SELECT e.doc_id, e.leaf, e.subroot, k.d AS root, sha256(e.sib) AS proof_sha256, e.acc AS folded_root, e.acc = k.d AS verified
FROM e, (SELECT d FROM u WHERE n = 1) k""".format(crc="""
chars AS (SELECT DISTINCT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)) AS cs
          FROM documents WHERE doc_id IS NOT NULL),
steps(doc_id, cs, k, crc) AS (
  SELECT doc_id, cs, 0, CAST(4294967295 AS BIGINT) FROM chars
  UNION ALL
  SELECT doc_id, cs, k + 1, list_reduce(list_prepend(xor(crc, CAST(cs[k + 1] AS BIGINT)), range(8)),
         lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)
  FROM steps WHERE k < len(cs)),
crcs AS (SELECT doc_id, xor(crc, CAST(4294967295 AS BIGINT)) AS crc FROM steps WHERE k = len(cs)),""")


@register("op13_merkle_manifest", _MERKLE_SQL)
def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(merkle.prove(read_table(spark, sf_dir, "documents")))


@register("op12_ann_search")
def op12_ann_search(spark, sf_dir):
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


_PHRASE_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS r,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM d),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, ws[i:i + m - 1] AS ph FROM w, range(1, 5) x(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
cuts AS (SELECT c.lang, c.ph, c.f AS a, a.f AS l, b.f AS r, k,
                CAST(2000000::HUGEINT * c.f // (a.f + b.f) AS BIGINT) AS score
         FROM f c, range(1, 4) x(k), f a, f b
         WHERE len(c.ph) >= 2 AND k < len(c.ph) AND a.lang = c.lang AND b.lang = c.lang
           AND a.ph = c.ph[1:k] AND b.ph = c.ph[k + 1:]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
sub AS (SELECT lang, ph[s:s + m - 1] AS ph, max(f) AS longer FROM f, range(2, 4) x(m), range(1, 4) y(s)
        WHERE m < len(ph) AND s + m - 1 <= len(ph) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, ph) WHERE longer IS NULL OR 100 * longer < 80 * a),
best AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000"""


@register("op11_phrase_collocations", _PHRASE_SQL)
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(read_table(spark, sf_dir, "documents"))
