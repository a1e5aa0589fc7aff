"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .language import language_id
from .language_model import lm_scores
from .line_dedup import line_dedup
from .manifest import tamper_check
from .minhash import near_groups
from .mixing import mix_plan
from .neighbours import nearest_neighbours
from .packing import pack
from .quality import quality_scores
from .secrets import BASE_KINDS, listed, secret_spans
from .sharding import byte_shards
from .variants import word_counts, word_forms

#: A document counts as good from this score on.
GOOD = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = line_dedup(_table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op4_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = byte_shards(_table(spark, sf_dir, "documents"), shards=40)
    return result.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents"))
    each = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return each.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken)


def op11_word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_forms(word_counts(_table(spark, sf_dir, "documents"), every=199, least_chars=6), least_chars=6, least=5, ratio=5)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    confirmed = (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed")
    return found.select("doc_id", *counts, confirmed, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(_table(spark, sf_dir, "documents"), fanout=3, levels=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup,
        op2_quality,
        op3_line_dedup,
        op4_near_groups,
        op5_neighbours,
        op6_language_id,
        op7_byte_shards,
        op8_lm_scores,
        op9_pack,
        op10_pareto_mix,
        op11_word_variants,
        op12_secret_scan,
        op13_manifest,
    )
    return {f.__name__: f for f in found}


NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP3 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
c AS (
  SELECT line_key, max(doc_id) AS last_id FROM k WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.*, coalesce(k.doc_id <> c.last_id, false) AS gone FROM k LEFT JOIN c USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('10|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size) AS cap,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS place,
         ((SELECT sum(size) FROM d) * 1.5 - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT arg_min(level, place) FROM o WHERE level * weight <= cap))::DOUBLE AS target FROM o),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target / t.source_size) AS whole,
         t.target - floor(t.target / t.source_size) * t.source_size AS rest, rest / t.source_size AS p,
         CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p) * length(bin(size)) / 8.0) ELSE u END AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

#: The UTF-8 bytes of a text of code points up to 255, and the CRC-32 of bytes, bit by bit.
BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))"
CRC = """xor(list_reduce(flatten(list_transform({x}, lambda c: list_transform(range(8), lambda k: (c >> k::INT) & 1))),
        lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1)), 4294967295), 4294967295)"""

OP11 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
g AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {CRC.format(x=BYTES.format(x="doc_id || ':' || run"))} AS h FROM g),
s AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
m AS (SELECT word, n, i, word[:i - 1] || '*' || word[i + 1:] AS mask, word[:i - 1] || word[i + 1:] AS less FROM p),
near AS (
  SELECT a.word, b.word AS near, b.n FROM m a JOIN m b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM m a JOIN v ON a.less = v.word
  UNION SELECT v.word, a.word, a.n FROM m a JOIN v ON a.less = v.word),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS best FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form,
         (CASE WHEN -best[1] >= 5 * v.n THEN -best[1] END)::BIGINT AS form_n
  FROM v LEFT JOIN best USING (word)),
w AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, w.root, n, n_near, form_n FROM f JOIN w USING (word)
WHERE NOT EXISTS (SELECT 1 FROM f t WHERE t.word = w.root AND t.form IS NOT NULL)
"""


def _value(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"


FIELDS = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({FIELDS} || {_value('text')}) AS leaf,
         sha256({FIELDS} || {_value("replace(text, chr(10), '')")}) AS cut,
         {CRC.format(x=BYTES.format(x='doc_id::VARCHAR'))} % 2 = 0 AS even
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (
  SELECT source, 0 AS level, idx, leaf AS digest, n FROM p
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, level, idx // 3, n),
sub AS (
  SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, idx // 3, n),
runs AS (
  SELECT source, level, idx // 3 AS run, list(digest ORDER BY idx) AS held FROM up WHERE n > 1 GROUP BY ALL),
top_runs AS (
  SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS held FROM top WHERE n > 1 GROUP BY ALL),
way AS (
  SELECT doc_id, leaf, p.source, 0 AS level, p.idx, sub.idx AS tree, height, CASE WHEN even THEN cut ELSE leaf END AS node, '' AS proof
  FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT doc_id, leaf, way.source, way.level + 1, CASE WHEN way.level + 1 = height THEN tree ELSE way.idx // 3 END, tree, height,
         sha256(array_to_string(coalesce(r.held, t.held)[:way.idx % 3], '') || node || array_to_string(coalesce(r.held, t.held)[way.idx % 3 + 2:], '')),
         proof || array_to_string(coalesce(r.held, t.held)[:way.idx % 3], '') || array_to_string(coalesce(r.held, t.held)[way.idx % 3 + 2:], '')
  FROM way
  LEFT JOIN runs r ON r.source IS NOT DISTINCT FROM way.source AND r.level = way.level AND r.run = way.idx // 3 AND way.level < height
  LEFT JOIN top_runs t ON t.level = way.level - height AND t.run = way.idx // 3
  WHERE r.held IS NOT NULL OR t.held IS NOT NULL)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = (SELECT digest FROM top WHERE n = 1) AS verified
FROM way JOIN sub ON way.source IS NOT DISTINCT FROM sub.source
QUALIFY way.level = max(way.level) OVER (PARTITION BY way.source, doc_id, leaf)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_line_dedup": OP3, "op10_pareto_mix": OP10, "op11_word_variants": OP11, "op13_manifest": OP13}
