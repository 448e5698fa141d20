"""The registered queries ``opN_<name>`` and their DuckDB SQL.

Each query applies one operator with its production parameters to whole
tables and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (bpe_codec, decontaminate, exact_dedup, kmeans, language_id, near_dedup, packing, pii, quality,
                         spelling, substring_dedup, token_counts, url_filter)

# The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deployment passes its own secret key; equal values stay linked under one key
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="public-test-key")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    out = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damaged=True)


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.with_inertia(*kmeans.cluster(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_spelling": op12_spelling,
    "op13_kmeans": op13_kmeans,
}

SQL: dict[str, str] = {}

SQL["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

SQL["op7_url_filter"] = rf"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
rest AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest)
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM parts
LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op3_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m,
         array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM win),
occ AS (
  SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k
  FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, i, occ.m, item_id FROM occ JOIN win ON occ.m = win.m AND occ.k = win.k),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL["op4_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, other) AS (
  SELECT x, y FROM links
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x),
smallest AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

SQL["op8_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
  FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT win.doc_id, p FROM win JOIN first USING (k), unnest(range(i, i + 50)) AS t(p)
  WHERE low < win.doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _lloyd_sql(k: int, rounds: int, dimensions: int, scale: int) -> str:
    """Rounds of assignment and update as a chain of common table expressions at row grain."""
    steps = [f"""
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), g) - 1 AS c, g FROM v
       QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), g) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, rid, v.g AS g, c,
           list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.g[i] - c{r}.g[i]) * (v.g[i] - c{r}.g[i])))::BIGINT AS distance
         FROM v, c{r}),
a{r} AS (SELECT vec_id, rid, g, c, distance FROM d{r}
         QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, i, sum(g[i])::BIGINT AS s, count(*) AS n
         FROM a{r}, unnest(range(1, {dimensions + 1})) AS t(i) GROUP BY c, i),
u{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS g FROM m{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c AS c, coalesce(u{r}.g, c{r}.g) AS g FROM c{r} LEFT JOIN u{r} ON c{r}.c = u{r}.c)""")
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS g
  FROM embeddings
  WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
{",".join(steps)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, distance,
       sum(distance) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.g, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c
"""


SQL["op13_kmeans"] = _lloyd_sql(16, 3, 64, 64)
