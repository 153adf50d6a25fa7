"""The operator queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, exact_digest, fast_minhash, html_blocks, langid, linear_grouping, merkle_manifest, missing_followup, mixing_cube, simhash_index, superkmer_dedup, toxicity_fm, vector_sharding


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mix_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_cube.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.rate_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_grouping.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup.dedup_substrings(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(_read(spark, sf_dir, "pages"))


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.fingerprints(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return merkle_manifest.verified(*merkle_manifest.manifest(docs, merkle_manifest.tampered(docs)))


def op12_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_missing_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_followup.follow(missing_followup.events_of(_read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "sales")))


QUERIES = {f.__name__: f for f in (op1_ann_forest, op2_mix_cube, op3_language_id, op4_simhash, op5_toxicity_fm, op6_vector_sharding, op7_linear_grouping, op8_superkmer_dedup, op9_html_blocks, op10_exact_digest, op11_merkle_manifest, op12_fast_minhash, op13_missing_followup)}

ORACLE_SQL = {
    "op8_superkmer_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    # op12: all pairs of texts that share a shingle, and components by label propagation over the links
    "op12_fast_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS sh FROM d),
x AS (SELECT doc_id, unnest(sh) AS v FROM s),
n AS (SELECT doc_id, len(sh) AS c FROM s),
met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM x p JOIN x q ON p.v = q.v AND p.doc_id < q.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.c + nb.c - shared)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS doc_id, CAST(max(n.c) AS BIGINT) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach JOIN n ON n.doc_id = a GROUP BY a
""",
    # op11: levels by recursion; crc32 bit by bit; a proof is the list of siblings by level, those to the left marked L, to the right R, none N
    "op11_merkle_manifest": r"""
WITH RECURSIVE f AS (SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS c, CAST(n_chars + 1 AS VARCHAR) AS c1 FROM documents),
h AS (SELECT doc_id, lang, i,
  sha256(concat(coalesce(strlen(i) || ':' || i, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
  sha256(concat(coalesce(strlen(i) || ':' || i, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(c1) || ':' || c1, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf1 FROM f),
bits AS (SELECT DISTINCT i, list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST((ascii(i[k]) >> j) & 1 AS BIGINT) FOR j IN range(0, 8)] FOR k IN range(1, strlen(i) + 1)])) AS v FROM f WHERE i IS NOT NULL),
crc AS (SELECT i, xor(list_reduce(v, lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT)) AS r FROM bits),
base AS (SELECT h.*, CASE WHEN r % 7 = 0 THEN leaf1 ELSE leaf END AS tried, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS width FROM h LEFT JOIN crc USING (i)),
up AS (SELECT tree, 0 AS level, pos, width, leaf AS d FROM base
  UNION ALL SELECT tree, level + 1, pos // 2, (max(width) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE width > 1 GROUP BY tree, level, pos // 2),
subs AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS width FROM up WHERE width = 1),
top AS (SELECT 0 AS level, pos, width, subroot AS d FROM subs
  UNION ALL SELECT level + 1, pos // 2, (max(width) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE width > 1 GROUP BY level, pos // 2),
low AS (SELECT b.doc_id, b.tree, b.pos, u.level, CASE WHEN s.d IS NULL THEN 'N' WHEN s.pos % 2 = 0 THEN 'L' || s.d ELSE 'R' || s.d END AS s
  FROM base b JOIN (SELECT DISTINCT tree, level FROM up WHERE width > 1) u USING (tree) LEFT JOIN up s ON s.tree = b.tree AND s.level = u.level AND s.pos = xor(b.pos // CAST(power(2, u.level) AS BIGINT), 1)),
high AS (SELECT b.tree, u.level, CASE WHEN s.d IS NULL THEN 'N' WHEN s.pos % 2 = 0 THEN 'L' || s.d ELSE 'R' || s.d END AS s
  FROM subs b JOIN (SELECT DISTINCT level FROM top WHERE width > 1) u ON true LEFT JOIN top s ON s.level = u.level AND s.pos = xor(b.pos // CAST(power(2, u.level) AS BIGINT), 1)),
lows AS (SELECT tree, pos, list(s ORDER BY level) AS p FROM low GROUP BY ALL), highs AS (SELECT tree, list(s ORDER BY level) AS p FROM high GROUP BY ALL),
proof AS (SELECT b.*, subroot, list_concat(coalesce(lows.p, []), coalesce(highs.p, [])) AS p FROM base b JOIN subs USING (tree) LEFT JOIN lows ON lows.tree = b.tree AND lows.pos = b.pos LEFT JOIN highs ON highs.tree = b.tree),
done AS (SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE width = 1) AS root, sha256(array_to_string([x[2:] FOR x IN p], '')) AS proof_sha256,
  list_reduce(list_concat([tried], p), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root FROM proof)
SELECT *, folded_root = root AS verified FROM done
""",
}
