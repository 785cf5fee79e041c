"""The operators applied to their whole tables, and SQL for those that SQL can express.

Each query takes its rows through its operator and only derives digest columns from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_tree import nearest_neighbours
from .chat_format import rotate_perspectives
from .conversation_trie import conversation_trie
from .decontaminate import contamination
from .hard_negatives import hard_negatives
from .language_id import CompressionClassifier, identify_language, sample_dictionaries
from .license_scan import scan_licenses
from .minhash import near_duplicates
from .packing import pack
from .quality_knn import learn_quality, score_quality
from .substring_dedup import substring_dedup
from .token_codes import read_token_files, write_token_files
from .url_filter import filter_urls

#: The rules of op4.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null doc_id is learned from
    model = CompressionClassifier(sample_dictionaries(docs.filter(~held_out)))
    judged = identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(_table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.concat_ws(" ", "host_words").alias("host_words"), "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express: hosts, paths, and what the rules say."""
    return filter_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "rule_verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word", end=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte", end=2)
    return read_token_files(files, folder).select("doc_id", F.col("place").alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated", "longest")


def _base_columns() -> list:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",")
    return ["doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names.alias("base_labels")]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(*_base_columns(), F.array_join("labels", ",").alias("labels"), "score", "permissive")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: the places of the base phrases."""
    return scan_licenses(_table(spark, sf_dir, "documents")).select(*_base_columns())


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn_quality(docs, labels.filter(~held_out), "quality")
    return score_quality(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"), label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


def queries() -> dict:
    from corpus_pipeline import run

    made = [op1_substring_dedup, op2_nearest_neighbours, op3_language_id, op4_url_filter, op5_packing, op6_near_duplicates, op7_token_files, op8_chat_perspectives, op9_decontamination, op10_license_scan, op11_conversation_trie, op12_quality, op13_hard_negatives, url_rules, license_places]
    return {f.__name__: f for f in made} | {"pipeline": run}


_OP8 = r"""
WITH said AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '|>', '|\>') AS speaker, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS body FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
messages AS (SELECT s.*, p.perspective, CASE WHEN s.speaker = p.perspective THEN '<|assistant|>' WHEN s.speaker = 'system' THEN '<|system|>' ELSE '<|user:' || s.speaker || '|>' END || chr(10) AS header FROM said s JOIN speakers p USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(header) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM messages)
SELECT conv_id, perspective, CAST(turn AS BIGINT) AS turn, speaker, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role, header || body || chr(10) AS rendered,
  CAST(place AS BIGINT) AS message_start, CAST(place + length(header) AS BIGINT) AS text_start, CAST(place + length(header) + length(body) AS BIGINT) AS text_end, CAST(speaker = perspective AS INTEGER) AS loss
FROM placed
"""


_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP1 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least_ AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win JOIN least_ USING (s) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit CROSS JOIN (SELECT unnest(range(0, 13)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_OP6 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ways.y FROM reach JOIN ways ON ways.x = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

_OP9 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS MATERIALIZED (SELECT item_id, j, size, array_to_string(w[j:j + size - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 11, 2))) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes)),
m AS MATERIALIZED (SELECT doc_id, item_id, i, j, size FROM dw JOIN bw USING (size, s)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m CROSS JOIN (SELECT unnest(range(0, 13)) AS k) WHERE k < size GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM m GROUP BY 1),
chain AS (SELECT doc_id, size, count(*) - 1 + size AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM m) GROUP BY doc_id, item_id, i - j, run, size),
best AS (SELECT doc_id, max(length) AS longest FROM chain GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_URLS = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r(rule_verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
f AS (SELECT page_id, rule, rule_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))))
SELECT p.page_id, host, path, rule, rule_verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND n = 1
"""

_PLACES = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT doc_id, i - 1 AS pos, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM t WHERE w[i] IN ('mit', 'apache', 'general')),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM m WHERE label IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""


_OP11 = """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list([role, text] ORDER BY turn IS NOT NULL, turn, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS ts FROM said GROUP BY 1),
bits AS (SELECT conv_id, [4294967295] || flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))::BIGINT[] AS b FROM own),
crc AS (SELECT conv_id, xor(list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS crc FROM bits),
made AS MATERIALIZED (SELECT o.conv_id, coalesce(b.ts, [])[1:crc % 6] || o.ts[crc % 6 + 1:] AS ts FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = d), '')) AS ends
  FROM (SELECT conv_id, ts, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM made)) GROUP BY 1, 2),
kids AS MATERIALIZED (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT p[1:a] AS p, sum(CAST(k IS NULL AS INTEGER)) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * length(p[d][2]) ELSE 0 END) AS saved
  FROM (SELECT node.*, k, unnest(range(0, d + 1)) AS a FROM node LEFT JOIN kids ON kids.p = node.p) GROUP BY 1)
SELECT node.conv AS conv_id, node.d AS depth, parent.conv AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN up ON up.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node parent ON node.d > 0 AND parent.p = node.p[1:node.d - 1]
"""

_OP13 = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return {"op1_substring_dedup": _OP1, "op6_near_duplicates": _OP6, "op8_chat_perspectives": _OP8, "op9_decontamination": _OP9, "op11_conversation_trie": _OP11, "op13_hard_negatives": _OP13, "url_rules": _URLS, "license_places": _PLACES} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
