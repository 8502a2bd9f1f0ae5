"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    fill_middle,
    html_extraction,
    jaccard_join,
    nearest_vectors,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    spelling_variants,
    substring_dedup,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"), jaccard_join.Law(k=3, percent=90))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.graded(docs, quality_classifier.learned(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transformed(table(spark, sf_dir, "documents"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Query]:
    every = (
        op1_secret_scan, op2_decontamination, op3_html_extraction, op4_quality_rules, op5_jaccard_join, op6_quality_classifier, op7_substring_dedup,
        op8_sharding, op9_toxicity, op10_packing, op11_spelling_variants, op12_fill_middle, op13_nearest_vectors,
    )
    return {f.__name__: f for f in every}


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
c AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
cls AS (SELECT sh, min(doc_id) AS rep, any_value(n) AS n FROM c WHERE n > 0 GROUP BY sh),
r AS (SELECT rep, n, unnest(sh) AS g FROM cls),
p AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM r a JOIN r b ON a.g = b.g AND a.rep <> b.rep WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * k >= 90 * (nx + ny - k)),
reach AS (SELECT rep AS x, rep AS y FROM cls UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
comp AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, coalesce(comp.m, c.doc_id) AS component_id
FROM c LEFT JOIN cls ON c.n > 0 AND cls.sh = c.sh LEFT JOIN comp ON comp.x = cls.rep
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, i + o.o AS p FROM win JOIN f USING (h), unnest(range(0, 50)) AS o(o) WHERE win.doc_id > f.first),
wd AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
k AS (SELECT wd.doc_id, count(*) AS n_words, count(hit.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY wd.p) FILTER (WHERE hit.p IS NULL), '') AS kept
      FROM wd LEFT JOIN hit ON wd.doc_id = hit.doc_id AND wd.p = hit.p GROUP BY wd.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

# CRC-32 of a string, 4 bits at a time, from the remainders of its polynomial.
_NIBBLES = [0]
for _n in range(1, 16):
    _c = _n
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES.append(_c)

OP11_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS raw FROM documents),
c AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r GROUP BY ALL),
x AS (SELECT run, k, hex(encode(doc_id || ':' || run)) AS hx FROM c),
b AS (SELECT run, k, list_transform(range(0, len(hx)), lambda i: CAST(instr('0123456789ABCDEF', hx[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT)) AS nib FROM x),
h AS (SELECT run, k, xor(list_reduce(nib, lambda a, v: xor(a >> 4, ({_NIBBLES})[CAST(xor(a, v) & 15 AS INT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:CAST(h % length(run) AS INT)] || run[CAST(h % length(run) AS INT) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
g AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -near_n, near := near)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, CASE WHEN -best.k >= 10 * v.n THEN best.near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 10 * v.n THEN -best.k END AS form_n
      FROM v LEFT JOIN g ON v.word = g.word),
t AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(t.root, t.depth) AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, l, len(l) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS q FROM d),
c AS (SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR q[3] % 100 >= 100 AS plain,
      least(q[1] % (n + 1), q[2] % (n + 1)) AS a, greatest(q[1] % (n + 1), q[2] % (n + 1)) AS b FROM k),
s AS (SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN q[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
      coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM s
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the learned and iterative operators are tested against brute force."""
    return {"op5_jaccard_join": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_fill_middle": OP12_SQL}
