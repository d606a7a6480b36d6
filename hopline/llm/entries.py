"""Queries of the training-data operators, with SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import default_vocabulary, documents
from .decontamination import contamination_report
from .licences import licence_scan
from .matching import repeated_word_runs
from .packing import pack_documents
from .quality import quality_report
from .sharding import balanced_shards
from .simhash import simhash_components
from .suffixes import repeated_substrings
from .tables import read_token_tables, write_token_tables
from .toxicity import toxicity_scores


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(documents(spark, sf_dir), 40).drop("row_number")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_word_runs(documents(spark, sf_dir))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary(), end_id=2).drop("ids")


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_tables(documents(spark, sf_dir), default_vocabulary(), end_id=1)
    return read_token_tables(spark, files).drop("ids")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_suffix_array": op3_suffix_array,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_licences": op8_licences,
    "op9_packing": op9_packing,
    "op10_token_tables": op10_token_tables,
}

# doc_id is unique in ``documents``, so no tie hangs on the operators' further order columns
_CRC32 = """
tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
byte AS (SELECT doc_id, coalesce(strlen(text), 0) AS len, coalesce(hex(encode(text)), '') AS h FROM documents),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len), lambda i: (position(substr(h, 2 * i + 1, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(h, 2 * i + 2, 1) IN '0123456789ABCDEF') - 1)), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) AS text_crc32 FROM byte, tbl)"""

ORACLES = {
    "op1_sharding": f"""WITH {_CRC32.strip()},
sized AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size FROM documents),
run AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM sized),
cut AS (SELECT *, CAST(least((2 * upto - size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM run)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut JOIN crc USING (doc_id)""",
    "op3_suffix_array": """WITH b AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
hit AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE f.first < g.doc_id),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT * FROM span UNION ALL SELECT doc_id, -1, 0 FROM b)),
total AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(substr(h, CAST(2 * gap.a + 1 AS BIGINT), CAST(2 * (coalesce(gap.z, length(h) // 2) - gap.a) AS BIGINT)), '' ORDER BY gap.a) AS k FROM b JOIN gap ON gap.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)""",
    "op5_decontamination": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
q AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM q WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item FROM g JOIN win ON win.s = g.s AND win.n = g.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op7_substring_dedup": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT s, min({'d': doc_id, 'i': i}) AS first FROM g GROUP BY s),
hit AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 20)) AS p FROM g JOIN f USING (s) WHERE f.first < {'d': g.doc_id, 'i': g.i}),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x LEFT JOIN hit USING (doc_id, p) WHERE hit.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
