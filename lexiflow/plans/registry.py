"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Vocabulary and bigrams come from all documents; probes come from all conversations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import tables as table_functions
from ..functions import text as X
from ..operators import complete, complete_index, confuse, correct, learn, metric, ngram, predict, rules, similarity, temporal, vocab_build
from ..sources.learned_log import LearnedLog
from ..sources.tables import once, shared_folder
from ..streaming import sessions, tracker

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.count_words(table(spark, sf_dir, "documents"))


def bigrams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.count_bigrams(table(spark, sf_dir, "documents"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sentence, pos, word, previous_word, next_word) of all conversations."""
    return X.tokens(table(spark, sf_dir, "conversations").withColumn("doc_id", F.concat_ws("-", "conv_id", "turn")))


def typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(typed) distinct words of conversations."""
    return talk(spark, sf_dir).select(F.col("word").alias("typed")).distinct()


def unknown(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(typed) distinct words of conversations that the documents' vocabulary (or `words`) lacks."""
    return correct.misspelled(typed_words(spark, sf_dir), words_of(spark, sf_dir) if words is None else words, "typed")


_W = r"'([\p{L}'']+)'"
CTE = rf"""
WITH sent AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS sentence, unnest(l) AS s FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.?!]') AS l FROM documents)),
arr AS (SELECT doc_id, sentence, regexp_extract_all(lower(s), {_W}) AS a FROM sent),
tok AS (SELECT doc_id, sentence, unnest(a) AS word FROM arr),
words AS MATERIALIZED (SELECT word, count(*) AS freq FROM tok GROUP BY 1),
bigrams AS MATERIALIZED (SELECT a[i] AS first, a[i + 1] AS second, count(*) AS cnt FROM (SELECT a, unnest(range(1, len(a))) AS i FROM arr) GROUP BY 1, 2),
totals AS (SELECT first, sum(cnt) AS total FROM bigrams GROUP BY 1),
stats AS (SELECT sum(freq) AS total_freq, max(freq) AS max_freq, count(*) AS word_count FROM words),
csent AS (SELECT conv_id || '-' || turn AS id, generate_subscripts(l, 1) - 1 AS sentence, unnest(l) AS s FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '[.?!]') AS l FROM conversations)),
carr AS (SELECT id, sentence, regexp_extract_all(lower(s), {_W}) AS a FROM csent),
talk AS (SELECT id, sentence, i - 1 AS pos, a[i] AS word, CASE WHEN i > 1 THEN a[i - 1] END AS previous_word, CASE WHEN i < len(a) THEN a[i + 1] END AS next_word FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM carr)),
asked AS (SELECT DISTINCT word AS typed FROM talk),
unknown AS MATERIALIZED (SELECT typed FROM asked WHERE typed NOT IN (SELECT word FROM words))
"""
#: DuckDB's levenshtein counts bytes, so words are compared with one ASCII sign for each Latin letter. Pairs meet on what up to two deletions leave.
_SIGNS = "translate({}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456')"


def _rests(name: str, source: str, column: str, k: int = 2) -> str:
    """CTEs that end in name(column, signs, rest)."""
    cut = "SELECT DISTINCT {c}, signs, left(rest, i - 1) || substr(rest, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(rest) + 1)) AS i FROM {f})"
    steps = [f"{name}0 AS MATERIALIZED (SELECT {column}, {_SIGNS.format(column)} AS signs, {_SIGNS.format(column)} AS rest FROM {source})"]
    steps += [f"{name}{i + 1} AS MATERIALIZED ({cut.format(c=column, f=f'{name}{i}')})" for i in range(k)]
    return ", ".join([*steps, f"{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(k + 1)) + ")"])


_NEAR = f""", {_rests("trest", "unknown", "typed")}, {_rests("wrest", "words", "word")},
met AS (SELECT DISTINCT typed, word, trest.signs AS a, wrest.signs AS b FROM trest JOIN wrest USING (rest)),
near2 AS MATERIALIZED (SELECT typed, word, levenshtein(a, b) AS distance FROM met WHERE abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2)"""


@query(CTE + "SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, count(DISTINCT sentence) AS n_sentences FROM tok GROUP BY 1")
def tokens_per_doc(spark, sf_dir):
    return X.tokens(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_distinct"), F.countDistinct("sentence").alias("n_sentences"))


@query(CTE + "SELECT word, freq FROM words ORDER BY freq DESC, word LIMIT 100")
def word_freq_topk(spark, sf_dir):
    return ngram.most_frequent(words_of(spark, sf_dir), 100)


@query(CTE + "SELECT word_count, CAST(total_freq AS BIGINT) AS total_freq, CAST(max_freq AS BIGINT) AS max_freq FROM stats")
def vocab_stats(spark, sf_dir):
    return ngram.vocab_stats(words_of(spark, sf_dir))


@query(CTE + "SELECT * FROM bigrams")
def bigram_counts(spark, sf_dir):
    return bigrams_of(spark, sf_dir)


@query(CTE + "SELECT first, second, cnt, CAST(total AS BIGINT) AS total, round(cnt / total::DOUBLE, 9) AS probability FROM bigrams JOIN totals USING (first)")
def bigram_probability(spark, sf_dir):
    return ngram.bigram_probabilities(bigrams_of(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


_TOP = "SELECT *, row_number() OVER (PARTITION BY first ORDER BY cnt DESC, second) AS rank FROM bigrams QUALIFY rank <= 5"


@query(CTE + f"SELECT first, second, cnt, rank FROM ({_TOP})")
def predict_next(spark, sf_dir):
    return predict.top_followers(bigrams_of(spark, sf_dir))


@query(CTE + f""", ask AS (SELECT DISTINCT word AS previous FROM talk), top AS ({_TOP}), best AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM words QUALIFY rank <= 5)
SELECT previous, second AS word, cnt, rank, false AS is_fallback FROM ask JOIN top ON first = previous
UNION ALL SELECT previous, word, freq, rank, true FROM ask CROSS JOIN best WHERE previous NOT IN (SELECT first FROM bigrams)""")
def predict_next_fallback(spark, sf_dir):
    return predict.predict_next(talk(spark, sf_dir).select(F.col("word").alias("previous")), words_of(spark, sf_dir), bigrams_of(spark, sf_dir))


_COMPLETE = """, p AS (SELECT DISTINCT left(word, 3) AS prefix{prev} FROM talk WHERE length(word) >= 3),
m AS (SELECT p.*, w.word, w.freq FROM p JOIN words w ON left(w.word, 3) = p.prefix LEFT JOIN words own ON own.word = p.prefix WHERE w.freq >= coalesce(own.freq // 5, 0))"""


@query(CTE + _COMPLETE.format(prev="") + "SELECT prefix, word, freq, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS rank FROM m QUALIFY rank <= 5")
def prefix_completions(spark, sf_dir):
    probes = talk(spark, sf_dir).filter(F.length("word") >= 3).select(F.left("word", F.lit(3)).alias("prefix"))
    return complete.complete(probes, words_of(spark, sf_dir)).select("prefix", "word", "freq", "rank")


@query(ORACLES["prefix_completions"])
def indexed_completions(spark, sf_dir):
    """The same rows, searched best first in a stored trie."""
    words = once(words_of(spark, sf_dir), "vocabulary")
    index = complete_index.build_completion_index(words, f"{shared_folder(spark)}/lexiflow-trie-{uuid.uuid4().hex}")
    probes = talk(spark, sf_dir).filter(F.length("word") >= 3).select(F.left("word", F.lit(3)).alias("prefix"))
    return complete_index.complete_from_index(probes, words, index).select("prefix", "word", "freq", "rank")


@query(ORACLES["prefix_completions"])
def sql_completions(spark, sf_dir):
    """The same rows in SQL, by a table function that ranks under any score."""
    table_functions.register(spark)
    words, asked = once(words_of(spark, sf_dir), "vocabulary"), talk(spark, sf_dir).filter(F.length("word") >= 3).select(F.left("word", F.lit(3)).alias("prefix")).distinct()
    return spark.sql("""
        WITH matches AS (SELECT a.prefix, w.word, w.freq, CAST(w.freq AS DOUBLE) AS score FROM {asked} a JOIN {words} w ON left(w.word, 3) = a.prefix LEFT JOIN {words} own ON own.word = a.prefix WHERE w.freq >= coalesce(own.freq div 5, 0))
        SELECT prefix, word, freq, rank FROM ranked_completions(TABLE(SELECT * FROM matches) PARTITION BY (prefix), 5)""", asked=asked, words=words)


@query(CTE + """, u AS (SELECT id, CAST(split_part(id, '-', 1) AS BIGINT) AS conv_id, CAST(split_part(id, '-', 2) AS BIGINT) AS turn, word, word IN (SELECT word FROM words) AS base FROM talk),
e AS (SELECT conv_id, word, min(CASE WHEN NOT base AND turn % 2 = 0 THEN turn END) AS added, min(CASE WHEN base AND length(word) >= 6 AND turn % 2 = 1 THEN turn END) AS removed FROM u GROUP BY 1, 2)
SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (CASE WHEN base THEN NOT coalesce(removed < turn, false) ELSE coalesce(added < turn, false) END) AS n_known FROM u JOIN e USING (conv_id, word) GROUP BY 1, 2""")
def words_as_of(spark, sf_dir):
    """Each conversation adds the unknown words of its even turns to its dictionary and takes out long known ones of its odd turns, both after the turn."""
    words = once(words_of(spark, sf_dir), "vocabulary")
    part = F.split("id", "-")
    uses = talk(spark, sf_dir).withColumnRenamed("doc_id", "id").select(part[0].cast("long").alias("user_id"), part[1].cast("long").alias("turn"), "word", (part[1].cast("long") * 2).alias("at"))
    uses = once(uses.join(words.select("word", F.lit(True).alias("base")), "word", "left"), "uses")
    op = F.when(F.col("base").isNull() & (F.col("turn") % 2 == 0), "add").when(F.col("base") & (F.length("word") >= 6) & (F.col("turn") % 2 == 1), "remove")
    judged = temporal.known_as_of(uses, words, uses.select("user_id", "word", op.alias("op"), (F.col("at") + 1).alias("at")))
    return judged.groupBy(F.col("user_id").alias("conv_id"), "turn").agg(F.count("*").alias("n_words"), F.count_if("known").alias("n_known"))


@query(CTE + f""", t AS MATERIALIZED (SELECT typed, {_SIGNS.format('typed')} AS a, length(typed) AS n FROM unknown WHERE length(typed) >= 10), w AS MATERIALIZED (SELECT word, {_SIGNS.format('word')} AS b, length(word) AS m FROM words WHERE length(word) >= 7),
p AS (SELECT typed, a, n, i, substr(a, n * i // 4 + 1, n * (i + 1) // 4 - n * i // 4) AS piece FROM t, range(4) r(i)),
q AS (SELECT DISTINCT word, b, n, i, substr(b, n * i // 4 + 1 + s, n * (i + 1) // 4 - n * i // 4) AS piece FROM w, range(m - 3, m + 4) x(n), range(4) r(i), range(-3, 4) y(s) WHERE n >= 10 AND n * i // 4 + s >= 0 AND n * (i + 1) // 4 + s <= m),
met AS (SELECT DISTINCT typed, word, a, b FROM p JOIN q USING (n, i, piece))
SELECT typed, word, CAST(d AS INTEGER) AS distance FROM (SELECT typed, word, levenshtein(a, b) AS d FROM met) WHERE d <= 3""")
def metric_range(spark, sf_dir):
    """Words within three edits of each unknown word of ten letters or more."""
    words = once(words_of(spark, sf_dir), "vocabulary")
    index = metric.build_index(words)
    return metric.range_search(unknown(spark, sf_dir, words).filter(F.length("typed") >= 10), index, 3)


@query(CTE + _COMPLETE.format(prev=", coalesce(previous_word, '') AS previous") + """, s AS (SELECT m.*, CASE WHEN coalesce(t.total, 0) > 0 THEN 0.7::DOUBLE * (coalesce(b.cnt, 0) / t.total::DOUBLE) + 0.3::DOUBLE * (freq / total_freq::DOUBLE) ELSE freq / total_freq::DOUBLE END AS score
FROM m CROSS JOIN stats LEFT JOIN totals t ON t.first = m.previous LEFT JOIN bigrams b ON b.first = m.previous AND b.second = m.word)
SELECT prefix, previous, word, round(score, 9) AS score, row_number() OVER (PARTITION BY (prefix), previous ORDER BY score DESC, word) AS rank FROM s QUALIFY rank <= 5""")
def prefix_completions_context(spark, sf_dir):
    probes = talk(spark, sf_dir).filter(F.length("word") >= 3).select(F.left("word", F.lit(3)).alias("prefix"), F.col("previous_word").alias("previous"))
    return complete.complete(probes, words_of(spark, sf_dir), bigrams_of(spark, sf_dir)).select("prefix", "previous", "word", F.round("score", 9).alias("score"), "rank")


@query(CTE + "SELECT word, freq // 5 AS floor FROM words")
def completion_floor(spark, sf_dir):
    return complete.completion_floor(words_of(spark, sf_dir))


# Contractions hardly occur in generated text, so an apostrophe is put before the last letter of each word that has none.
_MARKED = """, marked AS (SELECT left(word, length(word) - 1) || chr(39) || right(word, 1) AS word, freq FROM words WHERE length(word) >= 4 AND NOT contains(word, chr(39))),
w AS (SELECT * FROM words UNION ALL SELECT * FROM marked WHERE word NOT IN (SELECT word FROM words))"""


def _with_marks(spark, sf_dir):
    words = words_of(spark, sf_dir)
    bare = words.filter((F.length("word") >= 4) & ~F.contains("word", F.lit("'")))
    marked = bare.select(F.concat(F.expr("left(word, length(word) - 1)"), F.lit("'"), F.right("word", F.lit(1))).alias("word"), "freq")
    return words.union(marked.join(words, "word", "left_anti"))


@query(CTE + _MARKED + """, p AS (SELECT DISTINCT left(word, 4) AS prefix FROM talk WHERE length(word) >= 4),
t AS (SELECT prefix, left(prefix, i) || chr(39) || substr(prefix, i + 1) AS t FROM (SELECT prefix, unnest(range(1, length(prefix))) AS i FROM p WHERE NOT contains(prefix, chr(39)))),
a AS (SELECT DISTINCT prefix, word, freq, 0 AS src FROM t JOIN w ON left(word, 5) = t
UNION ALL SELECT prefix, w.word, w.freq, 1 FROM p JOIN w ON left(w.word, 4) = prefix LEFT JOIN w own ON own.word = prefix WHERE w.freq >= coalesce(own.freq // 5, 0))
SELECT prefix, word, freq, src = 0 AS is_contraction, row_number() OVER (PARTITION BY prefix ORDER BY src, freq DESC, word) AS rank FROM a QUALIFY rank <= 5""")
def contraction_completions(spark, sf_dir):
    probes = talk(spark, sf_dir).filter(F.length("word") >= 4).select(F.left("word", F.lit(4)).alias("prefix"))
    return complete.complete(probes, _with_marks(spark, sf_dir)).select("prefix", "word", "freq", "is_contraction", "rank")


@query(CTE + "SELECT word, count(*) AS n FROM talk WHERE word NOT IN (SELECT word FROM words) GROUP BY 1")
def misspelled_words(spark, sf_dir):
    return correct.misspelled(talk(spark, sf_dir), words_of(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


@query(CTE + "SELECT id, sentence, pos, t.word, coalesce(freq, 0) AS freq, freq IS NOT NULL AS known FROM talk t LEFT JOIN words w ON w.word = t.word")
def word_lookup(spark, sf_dir):
    return ngram.lookup(talk(spark, sf_dir), words_of(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("sentence").cast("long"), F.col("pos").cast("long"), "word", "freq", "known")


@query(CTE + _NEAR + "SELECT typed, word, CAST(distance AS INTEGER) AS distance FROM near2")
def edit_distance_pairs(spark, sf_dir):
    words = once(words_of(spark, sf_dir), "vocabulary")
    return similarity.similarity_join(unknown(spark, sf_dir, words), words, 2)


@query(CTE + ", u AS (SELECT typed, unnest(range(1, length(typed))) AS i FROM unknown) SELECT typed, word, freq FROM (SELECT DISTINCT typed, substr(typed, 1, i - 1) || typed[i + 1] || typed[i] || substr(typed, i + 2) AS word FROM u WHERE typed[i] <> typed[i + 1]) JOIN words USING (word)")
def letter_swaps(spark, sf_dir):
    return _edits(unknown(spark, sf_dir), words_of(spark, sf_dir), X.letter_swaps)


@query(CTE + """, u AS (SELECT typed, unnest(range(1, length(typed) + 1)) AS i FROM unknown WHERE length(typed) >= 4)
SELECT typed, word, freq FROM (SELECT typed, substr(typed, 1, i) || substr(typed, i) AS word FROM u UNION SELECT typed, substr(typed, 1, i) || substr(typed, i + 2) FROM u WHERE i < length(typed) AND typed[i] = typed[i + 1]) JOIN words USING (word)""")
def double_letter_fixes(spark, sf_dir):
    return _edits(unknown(spark, sf_dir), words_of(spark, sf_dir), X.double_letter_edits)


@query(CTE + _MARKED + """SELECT typed, word, freq FROM (SELECT typed, left(typed, i) || chr(39) || substr(typed, i + 1) AS word FROM (SELECT typed, unnest(range(1, length(typed))) AS i FROM asked WHERE NOT contains(typed, chr(39)))) JOIN w USING (word)""")
def apostrophe_fixes(spark, sf_dir):
    return _edits(typed_words(spark, sf_dir), _with_marks(spark, sf_dir), X.apostrophe_insertions)


def _edits(asked, words, make):
    made = asked.select("typed", F.explode(F.array_distinct(make(F.col("typed")))).alias("word"))
    return made.join(words, "word").select("typed", "word", "freq")


_CANDS = _NEAR + r""", sw AS (SELECT DISTINCT typed, substr(typed, 1, i - 1) || typed[i + 1] || typed[i] || substr(typed, i + 2) AS word FROM (SELECT typed, unnest(range(1, length(typed))) AS i FROM unknown) WHERE typed[i] <> typed[i + 1]),
ap AS (SELECT typed, left(typed, i) || '''' || substr(typed, i + 1) AS word FROM (SELECT typed, unnest(range(1, length(typed))) AS i FROM unknown WHERE NOT contains(typed, ''''))),
d4 AS (SELECT typed, unnest(range(1, length(typed) + 1)) AS i FROM unknown WHERE length(typed) >= 4),
db AS (SELECT typed, substr(typed, 1, i) || substr(typed, i) AS word FROM d4 UNION SELECT typed, substr(typed, 1, i) || substr(typed, i + 2) FROM d4 WHERE i < length(typed) AND typed[i] = typed[i + 1]),
near AS (SELECT * FROM near2 WHERE distance <= CASE WHEN length(typed) <= 4 THEN 1 ELSE 2 END),
least_ AS (SELECT typed, word, min(distance) AS distance FROM (SELECT * FROM near UNION ALL SELECT typed, word, 1 FROM sw JOIN words USING (word) UNION ALL SELECT typed, word, 1 FROM ap JOIN words USING (word)) GROUP BY 1, 2),
flagged AS (SELECT l.typed, l.word, l.distance, c.freq, (l.typed, l.word) IN (SELECT (typed, word) FROM ap) AS is_ap, CASE WHEN (l.typed, l.word) IN (SELECT (typed, word) FROM ap) THEN 0 WHEN (l.typed, l.word) IN (SELECT (typed, word) FROM db) THEN 1 WHEN (l.typed, l.word) IN (SELECT (typed, word) FROM sw) THEN 2
  WHEN length(l.typed) >= 3 AND length(l.word) > length(l.typed) AND starts_with(l.word, l.typed) THEN 3 ELSE 4 END AS slip_rank FROM least_ l JOIN words c USING (word)),
cands AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY distance, slip_rank, freq DESC, word) AS rank FROM flagged QUALIFY rank <= 20)"""


@query(CTE + _CANDS + "SELECT typed, word, CAST(distance AS INTEGER) AS distance, freq, CAST(slip_rank AS INTEGER) AS slip_rank, rank FROM cands WHERE rank <= 5")
def fuzzy_corrections(spark, sf_dir):
    words = once(words_of(spark, sf_dir), "vocabulary")
    return correct.find_corrections(typed_words(spark, sf_dir), words).select("typed", "word", "distance", "freq", "slip_rank", "rank")


_REASON = """CASE WHEN a.typed IN (SELECT word FROM words) THEN 'already a real word' WHEN b.word IS NULL THEN 'no close word found' WHEN b.distance = 2 AND length(a.typed) < 6 THEN 'too short to guess at two mistakes'
  WHEN r.word IS NOT NULL AND r.distance <= b.distance AND NOT ({clear}) THEN 'two words are too close to call' ELSE 'corrected' END"""
_PLAIN = "b.slip_rank < r.slip_rank OR r.freq <= 0 OR b.freq >= CASE WHEN b.distance = 1 THEN 2 ELSE 4 END * r.freq"


@query(CTE + _CANDS + f""", a AS (SELECT typed FROM asked),
j AS (SELECT a.typed, b.word, {_REASON.format(clear=_PLAIN)} AS reason FROM a LEFT JOIN cands b ON b.typed = a.typed AND b.rank = 1 LEFT JOIN cands r ON r.typed = a.typed AND r.rank = 2)
SELECT typed, reason = 'corrected' AS changed, CASE WHEN reason = 'corrected' THEN word ELSE typed END AS corrected, reason FROM j""")
def autocorrect_decisions(spark, sf_dir):
    words = once(words_of(spark, sf_dir), "vocabulary")
    return correct.autocorrect(typed_words(spark, sf_dir), words).select("typed", "changed", "corrected", "reason")


@query(CTE + _CANDS + f""", a AS (SELECT DISTINCT word AS typed, coalesce(previous_word, '') AS prev FROM talk),
f1 AS (SELECT typed, is_ap FROM cands WHERE rank = 1), tf AS (SELECT sum(freq)::DOUBLE AS t FROM words),
sc AS (SELECT a.typed, a.prev, c.word, c.distance, c.slip_rank, c.freq, c.rank, coalesce(t.total, 0) > 0 AND a.prev <> '' AND NOT f1.is_ap AS ctx,
  (CASE WHEN coalesce(t.total, 0) > 0 THEN 0.7::DOUBLE * (coalesce(g.cnt, 0) / t.total::DOUBLE) + 0.3::DOUBLE * (c.freq / tf.t) ELSE c.freq / tf.t END) * [50.0::DOUBLE, 20, 20, 10, 1][c.slip_rank + 1] AS score
  FROM a JOIN cands c USING (typed) JOIN f1 USING (typed) CROSS JOIN tf LEFT JOIN totals t ON t.first = a.prev LEFT JOIN bigrams g ON g.first = a.prev AND g.second = c.word),
o AS (SELECT *, row_number() OVER (PARTITION BY typed, prev ORDER BY CASE WHEN ctx THEN distance ELSE rank END, CASE WHEN ctx THEN -score ELSE 0 END, word) AS n FROM sc),
j AS (SELECT a.typed, a.prev, b.word, {_REASON.format(clear="CASE WHEN b.ctx THEN r.score <= 0 OR b.score >= CASE WHEN b.distance = 1 THEN 2 ELSE 4 END * r.score ELSE " + _PLAIN + " END")} AS reason
  FROM a LEFT JOIN o b ON b.typed = a.typed AND b.prev = a.prev AND b.n = 1 LEFT JOIN o r ON r.typed = a.typed AND r.prev = a.prev AND r.n = 2)
SELECT typed, prev AS previous, reason = 'corrected' AS changed, CASE WHEN reason = 'corrected' THEN word ELSE typed END AS corrected, reason FROM j""")
def autocorrect_in_context(spark, sf_dir):
    probes = talk(spark, sf_dir).select(F.col("word").alias("typed"), F.coalesce("previous_word", F.lit("")).alias("previous")).distinct()
    return correct.autocorrect(probes, words_of(spark, sf_dir), ngram.neighbours(table(spark, sf_dir, "documents"))).select("typed", "previous", "changed", "corrected", "reason")


@query(CTE + """, conf(low, alternative) AS (SELECT unnest(['from','form','than','then','of','off','to','too','lose','loose','quite','quiet','whether','weather','buy','by','there','their','accept','except','affect','effect','advice','advise','breath','breathe','past','passed','here','hear','know','now','were','where']), unnest(['form','from','then','than','off','of','too','to','loose','lose','quiet','quite','weather','whether','by','buy','their','there','except','accept','effect','affect','advise','advice','breathe','breath','passed','past','hear','here','now','know','where','were'])),
ask AS (SELECT DISTINCT coalesce(previous_word, '') AS b, word AS w, coalesce(next_word, '') AS a FROM talk),
v AS (SELECT ask.*, alternative, total_freq::DOUBLE AS n, coalesce(g1.cnt, 0) AS bt, coalesce(g2.cnt, 0) AS ba, coalesce(g3.cnt, 0) AS ta, coalesce(g4.cnt, 0) AS aa, coalesce(t1.total, 0)::DOUBLE AS tb, coalesce(t2.total, 0)::DOUBLE AS tl, coalesce(t3.total, 0)::DOUBLE AS tal,
  coalesce(w1.freq, 0) / total_freq::DOUBLE AS pl, coalesce(w2.freq, 0) / total_freq::DOUBLE AS pa, coalesce(w3.freq, 0) / total_freq::DOUBLE AS pn FROM ask LEFT JOIN conf ON low = w CROSS JOIN stats
  LEFT JOIN bigrams g1 ON g1.first = b AND g1.second = w LEFT JOIN bigrams g2 ON g2.first = b AND g2.second = alternative LEFT JOIN bigrams g3 ON g3.first = w AND g3.second = a LEFT JOIN bigrams g4 ON g4.first = alternative AND g4.second = a
  LEFT JOIN totals t1 ON t1.first = b LEFT JOIN totals t2 ON t2.first = w LEFT JOIN totals t3 ON t3.first = alternative LEFT JOIN words w1 ON w1.word = w LEFT JOIN words w2 ON w2.word = alternative LEFT JOIN words w3 ON w3.word = a),
ch AS (SELECT *, CASE WHEN tb > 0 THEN 0.9::DOUBLE * (bt / tb) + (1 - 0.9::DOUBLE) * pl ELSE pl END AS lt, CASE WHEN tb > 0 THEN 0.9::DOUBLE * (ba / tb) + (1 - 0.9::DOUBLE) * pa ELSE pa END AS la, CASE WHEN tl > 0 THEN 0.9::DOUBLE * (ta / tl) + (1 - 0.9::DOUBLE) * pn ELSE pn END AS rt, CASE WHEN tal > 0 THEN 0.9::DOUBLE * (aa / tal) + (1 - 0.9::DOUBLE) * pn ELSE pn END AS ra FROM v),
ad AS (SELECT *, (CASE WHEN lt <= 0 THEN CASE WHEN la <= 0 THEN 1 ELSE 50 END ELSE greatest(1 / 50::DOUBLE, least(50, la / lt)) END) * (CASE WHEN a = '' THEN 1 WHEN rt <= 0 THEN CASE WHEN ra <= 0 THEN 1 ELSE 50 END ELSE greatest(1 / 50::DOUBLE, least(50, ra / rt)) END) AS advantage FROM ch),
r AS (SELECT *, CASE WHEN alternative IS NULL THEN 'not a word people mix up' WHEN b = '' AND a = '' THEN 'nothing around it to go on' WHEN ba <= 0 AND aa <= 0 THEN 'no alternative fits better' WHEN advantage < 8 THEN 'what was typed fits well enough' ELSE 'corrected' END AS reason FROM ad)
SELECT b AS before, w AS word, a AS after, reason = 'corrected' AS changed, CASE WHEN reason = 'corrected' THEN alternative ELSE w END AS corrected, round(CASE WHEN alternative IS NOT NULL AND (ba > 0 OR aa > 0) THEN advantage END, 6) AS advantage, reason FROM r""")
def realword_check(spark, sf_dir):
    probes = talk(spark, sf_dir).select(F.coalesce("previous_word", F.lit("")).alias("before"), "word", F.coalesce("next_word", F.lit("")).alias("after"))
    return confuse.check_real_words(probes, words_of(spark, sf_dir), bigrams_of(spark, sf_dir)).withColumn("advantage", F.round("advantage", 6))


_USERS = ", users(word) AS (VALUES ('zzqx'), ('qwvz')), wt AS (SELECT greatest(25, max_freq // 1000) AS weight FROM stats), ok AS (SELECT word FROM words UNION SELECT word FROM users), good AS (SELECT * FROM talk WHERE word IN (SELECT word FROM ok))"


def _users(spark):
    return spark.createDataFrame([("zzqx",), ("QWVZ ",)], "word string")


def _uses(spark, sf_dir):
    return talk(spark, sf_dir).select("word", F.col("previous_word").alias("previous"))


@query(CTE + _USERS + "SELECT previous_word AS first, word AS second, CAST(count(*) * any_value(weight) AS BIGINT) AS cnt FROM good CROSS JOIN wt WHERE previous_word IN (SELECT word FROM ok) GROUP BY 1, 2")
def learn_deltas(spark, sf_dir):
    return learn.learn_deltas(_uses(spark, sf_dir), words_of(spark, sf_dir), _users(spark))[1]


@query(CTE + _USERS + "SELECT word, CAST(count(*) * any_value(weight) AS BIGINT) AS cnt FROM good CROSS JOIN wt GROUP BY 1")
def learned_log(spark, sf_dir):
    """What all conversations teach, added to a durable log in four batches, one of them twice."""
    log = LearnedLog(spark, f"{shared_folder(spark)}/lexiflow-log-{uuid.uuid4().hex}", merge_every=2)
    words, uses = once(words_of(spark, sf_dir), "vocabulary"), once(_uses(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("word"), F.lit(4))), "uses")
    for i in (0, 1, 2, 1, 3):
        log.append(*learn.learn_deltas(uses.filter(F.col("batch") == i), words, _users(spark)), f"batch {i}")
    return log.totals()[0]


@query(CTE + _USERS + "SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT word, freq FROM words UNION ALL SELECT word, count(*) * any_value(weight) FROM good CROSS JOIN wt GROUP BY 1) GROUP BY 1")
def learn_apply(spark, sf_dir):
    words = words_of(spark, sf_dir)
    return learn.apply_learned(words, learn.learn_deltas(_uses(spark, sf_dir), words, _users(spark))[0])


@query(CTE + "SELECT word, freq FROM words UNION ALL SELECT word, 100 FROM (VALUES ('zzqx'), ('qwvz')) u(word) WHERE word NOT IN (SELECT word FROM words)")
def user_words_merge(spark, sf_dir):
    return learn.merge_user_words(words_of(spark, sf_dir), _users(spark))


# Raw counts are the documents' words; words of conversations stand for the list of valid ones.
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_BUILD = f""", web AS (SELECT word, freq * 10 AS raw FROM words), valid AS (SELECT DISTINCT word FROM talk), mx AS (SELECT max(raw) AS biggest FROM web),
sc AS (SELECT word, greatest(1, CAST(round_even(raw * (200000 / biggest::DOUBLE), 0) AS BIGINT)) AS freq FROM web CROSS JOIN mx WHERE (word IN (SELECT word FROM valid) OR word IN {_IN(C.MODERN + list(C.INFORMAL))}) AND word NOT IN {_IN(C.UNWANTED)}),
kept AS MATERIALIZED (SELECT * FROM sc WHERE regexp_full_match(word, '[a-z]+(''[a-z]+)*') AND length(word) <= 20 AND CASE WHEN length(word) = 1 THEN word IN ('a', 'i') WHEN length(word) = 2 THEN word IN {_IN(C.TWO_LETTER)}
  ELSE NOT regexp_full_match(word, '[ivx]{{2,}}') AND word NOT IN {_IN(C.BROKEN_CONTRACTIONS + C.DIALECT)} AND (length(word) <> 3 OR freq >= 10 OR word IN {_IN(C.MODERN + list(C.INFORMAL) + C.EVERYDAY_SHORT)}) END)"""


def _kept(spark, sf_dir):
    web = words_of(spark, sf_dir).select("word", (F.col("freq") * 10).alias("raw"))
    return vocab_build.filter_vocabulary(web, talk(spark, sf_dir).select("word").distinct())


@query(CTE + _BUILD + "SELECT * FROM kept")
def vocab_filter(spark, sf_dir):
    return _kept(spark, sf_dir)


@query(CTE + _BUILD + f""", rare AS (SELECT word AS bad, freq FROM kept WHERE freq <= 25 AND length(word) >= 5), often AS (SELECT word AS good, freq FROM kept WHERE freq >= 50), {_rests("brest", "rare", "bad", 1)}, {_rests("grest", "often", "good", 1)}
SELECT * FROM kept WHERE word NOT IN (SELECT b.bad FROM brest b JOIN grest g USING (rest) JOIN rare r ON r.bad = b.bad JOIN often o ON o.good = g.good
  WHERE o.freq >= 50 * r.freq AND damerau_levenshtein(g.good, b.bad) = 1 AND length(replace(g.good, chr(39), '')) - length(g.good) >= length(replace(b.bad, chr(39), '')) - length(b.bad))""")
def drop_misspellings(spark, sf_dir):
    return vocab_build.drop_misspellings(_kept(spark, sf_dir))


@query(CTE + _BUILD + """, listed(bad, good) AS (SELECT a.word, b.word FROM kept a JOIN kept b ON b.word = left(a.word, length(a.word) - 2))
SELECT * FROM kept WHERE word NOT IN (SELECT bad FROM listed JOIN kept k ON k.word = bad JOIN kept g ON g.word = good WHERE k.freq <= 25 AND g.freq >= 50 * k.freq)""")
def drop_known_misspellings(spark, sf_dir):
    words = _kept(spark, sf_dir)
    listed = words.select(F.col("word").alias("bad"), F.left("word", F.length("word") - 2).alias("good")).join(words.select(F.col("word").alias("good")), "good").select("bad", "good")
    return vocab_build.drop_known_misspellings(words, listed)


@query(CTE + _BUILD + """, free AS (SELECT *, row_number() OVER (ORDER BY freq, word) AS r FROM kept WHERE left(word, 1) <> 't'), ex AS (SELECT greatest(0, count(*) - 500) AS n FROM kept)
SELECT word, freq FROM kept WHERE word NOT IN (SELECT word FROM free CROSS JOIN ex WHERE r <= n)""")
def trim_vocab(spark, sf_dir):
    words = once(_kept(spark, sf_dir), "kept")
    return vocab_build.trim(words, words.filter("left(word, 1) = 't'"), 500)


@query(CTE + _BUILD + """, pr AS (SELECT first, second, cnt FROM bigrams WHERE first IN (SELECT word FROM kept) AND second IN (SELECT word FROM kept)), mp AS (SELECT max(cnt) AS biggest FROM pr)
SELECT first, second, greatest(1, CAST(round_even(cnt * (200000 / biggest::DOUBLE), 0) AS BIGINT)) AS cnt FROM pr CROSS JOIN mp""")
def pairs_semijoin_scaled(spark, sf_dir):
    return vocab_build.scale_pairs(bigrams_of(spark, sf_dir).withColumnRenamed("cnt", "raw"), _kept(spark, sf_dir))


_RAW = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}'']+')) AS original FROM conversations)"


@query(rf"""SELECT original, lower(original) || 's' AS replacement, CASE WHEN length(original) > 1 AND NOT regexp_matches(original, '[^\p{{Lu}}'']') THEN upper(lower(original) || 's')
  WHEN regexp_matches(original, '^\p{{Lu}}') THEN upper(left(lower(original), 1)) || substr(lower(original) || 's', 2) ELSE lower(original) || 's' END AS cased FROM {_RAW}""")
def match_capitalization(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(X.find_words(F.col("text"))).alias("original")).distinct()
    rows = words.withColumn("replacement", F.concat(F.lower("original"), F.lit("s")))
    return rows.withColumn("cased", X.match_capitalization(F.col("original"), F.col("replacement")))


@query(CTE + """, p AS (SELECT DISTINCT previous_word AS typed, word AS wanted FROM talk WHERE previous_word IS NOT NULL),
l AS (SELECT *, len(list_filter(range(1, least(length(typed), length(wanted)) + 1), lambda i: left(typed, i) = left(wanted, i))) AS n FROM p)
SELECT typed, wanted, CAST(length(typed) - n AS INTEGER) AS backspaces, substr(wanted, n + 1) AS to_type FROM l""")
def replacement_plan(spark, sf_dir):
    rows = talk(spark, sf_dir).filter("previous_word is not null").select(F.col("previous_word").alias("typed"), F.col("word").alias("wanted")).distinct()
    return rows.select("typed", "wanted", X.replacement_plan(F.col("typed"), F.col("wanted")).alias("p")).select("typed", "wanted", "p.*")


@query(r"""WITH v(text, caret) AS (SELECT text, unnest([3, 40, 100]) FROM conversations), h AS (SELECT *, left(text, caret) AS head FROM v),
w AS (SELECT *, regexp_extract(head, '[\p{L}'']*$') AS prefix FROM h), b AS (SELECT *, left(head, length(head) - length(prefix)) AS lead FROM w)
SELECT text, caret, prefix, nullif(lower(regexp_extract(lead, '([\p{L}'']+)[^\p{L}''.?!]*$', 1)), '') AS previous, regexp_matches(lead, '(^|[.?!])\s*$') AS sentence_start FROM b""")
def sentence_start(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select("text", F.explode(F.array(F.lit(3), F.lit(40), F.lit(100))).alias("caret"))
    t, c = F.col("text"), F.col("caret")
    return v.select(t, c, X.current_prefix(t, c).alias("prefix"), X.previous_word(t, c).alias("previous"), X.is_sentence_start(t, X.current_word_start(t, c)).alias("sentence_start"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'password|passcode|passphrase|sign in|signin|sign-in|log in|login|log-in|credential|authentication|authenticator|two factor|2fa|bitlocker|keychain|bitwarden|lastpass|keepass|dashlane|private browsing|incognito|seed phrase|recovery phrase') AS sensitive FROM pages")
def sensitive_titles(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title")).withColumn("sensitive", rules.looks_sensitive(F.col("title")))


# Windows and controls are dealt to the rows of conversations by their numbers.
_PROCESSES = [f"{p.title()}.EXE" for p in C.CODE_PROCESSES] + [f" {p} " for p in C.CODE_PROCESSES] + ["notepad", "code.exe.exe", "", "decode.exe"]
_CONTROLS = ["", "Strange", *(f"My.{c.title()}.7" for c in C.NON_TEXT_CLASSES + C.TEXT_CLASSES + C.UNKNOWABLE_CLASSES)]
_LIST = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_HAS = lambda c, parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def _dealt(spark, sf_dir, items, name):
    rows = table(spark, sf_dir, "conversations")
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, items)), (F.pmod(7 * F.col("conv_id") + F.col("turn"), F.lit(len(items))) + 1).cast("int")))


_DEALT = "(SELECT *, {items}[(7 * conv_id + turn) % {n} + 1] AS {name} FROM conversations)"


@query(f"SELECT conv_id, turn, process, regexp_replace(lower(trim(process)), '\\.exe$', '') IN {_IN(C.CODE_PROCESSES)} AS is_code FROM {_DEALT.format(items=_LIST(_PROCESSES), n=len(_PROCESSES), name='process')}")
def code_windows(spark, sf_dir):
    return _dealt(spark, sf_dir, _PROCESSES, "process").select("conv_id", "turn", "process", rules.is_code_window(F.col("process")).alias("is_code"))


@query(f"""SELECT conv_id, turn, control, CASE WHEN turn % 3 = 0 THEN true WHEN conv_id % 4 = 0 THEN false WHEN trim(control) = '' THEN true ELSE NOT {_HAS("lower(trim(control))", C.NON_TEXT_CLASSES)} END AS takes_text,
  trim(control) <> '' AND {_HAS("lower(trim(control))", C.TEXT_CLASSES + C.UNKNOWABLE_CLASSES)} AS known FROM {_DEALT.format(items=_LIST(_CONTROLS), n=len(_CONTROLS), name='control')}""")
def text_target(spark, sf_dir):
    takes = rules.takes_text(F.col("turn") % 3 == 0, F.col("conv_id") % 4 != 0, F.col("control"))
    return _dealt(spark, sf_dir, _CONTROLS, "control").select("conv_id", "turn", "control", takes.alias("takes_text"), rules.is_known_text_class(F.col("control")).alias("known"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'NotATextTarget' WHEN turn % 3 = 0 THEN 'WordStartUnknown' WHEN length(left(coalesce(text, ''), turn % 4)) < 2 THEN 'TooFewLetters' ELSE 'None' END AS completions,
  CASE WHEN conv_id % 5 = 0 THEN 'NotATextTarget' WHEN turn % 2 = 0 THEN 'NoSession' ELSE 'None' END AS predictions FROM conversations)
SELECT *, completions = 'None' AS shows FROM r""")
def suggestion_policy(spark, sf_dir):
    target, turn = F.col("conv_id") % 5 != 0, F.col("turn")
    completions = rules.check_completions(F.left("text", (turn % 4).cast("int")), target, turn % 3 != 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", completions.alias("completions"), rules.check_predictions(target, turn % 2 != 0).alias("predictions"))
    return rows.withColumn("shows", rules.should_show(F.col("completions")))


_CONFIRM = "coalesce({e} <> '' AND ends_with(before, {e}) AND CASE WHEN length(before) = length({e}) THEN {r} > length({e}) ELSE NOT regexp_matches(substr(before, length(before) - length({e}), 1), '[\\p{{L}}\\p{{Nd}}'']') END, false)"


@query(f"""WITH b AS (SELECT conv_id, turn, left(text, CAST(turn % 40 AS INTEGER)) AS before FROM conversations), e AS (SELECT *, regexp_extract(before, '[\\p{{L}}'']*$') AS expected FROM b)
SELECT conv_id, turn, expected, {_CONFIRM.format(e="expected", r="(length(expected) + turn % 2)")} AS word, {_CONFIRM.format(e="expected", r="(length(expected) + 1)")}
  OR (length(expected) > 1 AND {_CONFIRM.format(e="left(expected, length(expected) - 1)", r="(length(expected) + 1)")}) AS prefix FROM e""")
def caret_text(spark, sf_dir):
    before, turn = F.left("text", (F.col("turn") % 40).cast("int")), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("before")).withColumn("expected", F.regexp_extract("before", r"[\p{L}']*\z", 0))
    b, e = F.col("before"), F.col("expected")
    return rows.select("conv_id", "turn", "expected", rules.confirms_word(b, e, F.length(e) + turn % 2).alias("word"), rules.confirms_prefix(b, e).alias("prefix"))


@query(CTE + f"SELECT typed, typed IN {_IN([w for pair in C.CONFUSION_SETS for w in pair])} AS confusable, regexp_full_match(typed, '[\\p{{L}}'']+') AS allowed FROM asked")
def word_rules(spark, sf_dir):
    return typed_words(spark, sf_dir).select("typed", rules.is_confusable(F.col("typed")).alias("confusable"), rules.is_allowed_word(F.col("typed")).alias("allowed"))


@query(CTE + f", p AS (SELECT DISTINCT previous_word AS a, word AS b FROM talk WHERE previous_word IS NOT NULL) SELECT a, b, CAST(least(levenshtein({_SIGNS.format('a')}, {_SIGNS.format('b')}), 4) AS INTEGER) AS distance FROM p")
def limited_distances(spark, sf_dir):
    pairs = talk(spark, sf_dir).filter("previous_word is not null").select(F.col("previous_word").alias("a"), F.col("word").alias("b")).distinct()
    return pairs.withColumn("distance", X.levenshtein_with_limit(F.col("a"), F.col("b"), 3))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, n""")
def typing_sessions(spark, sf_dir):
    return tracker.typing_sessions(table(spark, sf_dir, "events"), gap=3600.0)


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'error', 'signup') THEN event_type END AS e FROM events),
l AS (SELECT *, lag(ts) OVER w AS before, lag(e) OVER w AS ended FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, before IS NOT NULL AND ended IS NULL AND ts - before < INTERVAL 12 HOUR AS live FROM l),
n AS (SELECT *, sum(CAST(e IS NULL AND NOT live AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, min(ts) FILTER (e IS NULL) AS first_ts, max(ts) FILTER (e IS NULL) AS last_ts, count(*) FILTER (e IS NULL) AS n_events, coalesce(max(e), 'idle') AS ended_by,
  coalesce(max(ts) FILTER (e IS NOT NULL), max(ts) FILTER (e IS NULL) + INTERVAL 12 HOUR) AS ended_at FROM n WHERE e IS NULL OR live GROUP BY user_id, n""")
def event_sessions(spark, sf_dir):
    return sessions.event_sessions(table(spark, sf_dir, "events"), 12 * 3600.0, tie="event_id", kind="event_type", keep="event_type in ('view', 'purchase')", ends=("click", "error", "signup"))


@query("""WITH q AS (SELECT user_id, event_id AS seq, ts, event_type AS kind, CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END AS quiet FROM events),
c AS (SELECT *, coalesce(last_value(quiet IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), false) AS now_, coalesce(last_value(quiet IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS then_ FROM q WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, ts, CASE WHEN now_ THEN 'window' ELSE kind END AS kind FROM c WHERE NOT now_ OR NOT then_""")
def quiet_events(spark, sf_dir):
    quiet = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "signup", False)
    return sessions.quiet_gate(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("kind"), quiet.alias("quiet")))


def key_events(spark, sf_dir):
    """Conversations typed out: one user per message, one key per character."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("user_id"), F.posexplode(F.split("text", "")).alias("seq", "ch"))
    return c.select("user_id", F.col("seq").cast("long"), F.timestamp_millis(F.col("seq") * 200).alias("ts"), F.lit("key").alias("kind"), "ch").filter("ch != ''")


_PAIRS_TALK = "SELECT DISTINCT coalesce(previous_word, '') AS previous, word FROM talk"


def _probe_pairs(spark, sf_dir):
    return talk(spark, sf_dir).select(F.coalesce("previous_word", F.lit("")).alias("previous"), "word").distinct()


@query(CTE + "SELECT prefix, prefix = '' OR EXISTS (SELECT 1 FROM (SELECT DISTINCT left(word, 4) AS l FROM words) w WHERE w.l = prefix) AS found FROM (SELECT DISTINCT left(word, 4) AS prefix FROM talk WHERE length(word) >= 4 UNION ALL SELECT '')")
def prefix_exists(spark, sf_dir):
    asked = talk(spark, sf_dir).filter(F.length("word") >= 4).select(F.left("word", F.lit(4)).alias("prefix")).union(spark.createDataFrame([(" ",)], "prefix string"))
    return complete.has_prefix(asked, words_of(spark, sf_dir))


@query(CTE + ", p AS (SELECT DISTINCT left(word, 5) AS prefix FROM talk WHERE length(word) >= 5) SELECT prefix, w.word, freq FROM p JOIN words w ON left(w.word, 5) = prefix UNION ALL SELECT '', word, freq FROM words")
def prefix_matches(spark, sf_dir):
    asked = talk(spark, sf_dir).filter(F.length("word") >= 5).select(F.left("word", F.lit(5)).alias("prefix")).union(spark.createDataFrame([("",)], "prefix string"))
    return complete.prefix_matches(asked, words_of(spark, sf_dir))


@query(CTE + f""", ask AS (SELECT DISTINCT word AS previous FROM talk), top AS ({_TOP}), best AS (SELECT word, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM words QUALIFY rank <= 5)
SELECT previous, string_agg(word, ' ' ORDER BY rank) AS words FROM (SELECT previous, second AS word, rank FROM ask JOIN top ON first = previous UNION ALL SELECT previous, word, rank FROM ask CROSS JOIN best WHERE previous NOT IN (SELECT first FROM bigrams)) GROUP BY 1""")
def predict_next_words(spark, sf_dir):
    found = predict.predict_next_words(talk(spark, sf_dir).select(F.col("word").alias("previous")), words_of(spark, sf_dir), bigrams_of(spark, sf_dir))
    return found.select("previous", F.array_join("words", " ").alias("words"))


@query(CTE + "SELECT typed, typed IN (SELECT first FROM bigrams) AS has_context FROM asked")
def has_context(spark, sf_dir):
    return predict.has_context(typed_words(spark, sf_dir), bigrams_of(spark, sf_dir), "typed")


@query(CTE + f"SELECT previous, word AS next, round(coalesce(cnt / total::DOUBLE, 0), 9) AS probability FROM ({_PAIRS_TALK}) LEFT JOIN bigrams ON first = previous AND second = word LEFT JOIN totals USING (first)")
def next_probability(spark, sf_dir):
    pairs = _probe_pairs(spark, sf_dir).withColumnRenamed("word", "next")
    return predict.next_probability(pairs, bigrams_of(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


@query(CTE + _USERS + f", lw AS (SELECT word, count(*) * any_value(weight) AS n FROM good CROSS JOIN wt GROUP BY 1) SELECT typed, CAST(coalesce(n, 0) AS BIGINT) AS learned FROM asked LEFT JOIN lw ON word = typed")
def learned_counts(spark, sf_dir):
    learned = learn.learn_deltas(_uses(spark, sf_dir), words_of(spark, sf_dir), _users(spark))[0]
    return learn.learned_counts(typed_words(spark, sf_dir), learned, "typed")


_PAIRED = ", lp AS (SELECT previous_word AS first, word AS second, count(*) * any_value(weight) AS n FROM good CROSS JOIN wt WHERE previous_word IN (SELECT word FROM ok) GROUP BY 1, 2)"


@query(CTE + _USERS + _PAIRED + f" SELECT previous, word, CAST(coalesce(n, 0) AS BIGINT) AS learned FROM ({_PAIRS_TALK}) LEFT JOIN lp ON first = previous AND second = word")
def learned_pair_counts(spark, sf_dir):
    learned = learn.record_pairs(_uses(spark, sf_dir), words_of(spark, sf_dir), _users(spark))
    return learn.learned_pair_counts(_probe_pairs(spark, sf_dir), learned)


@query(CTE + _USERS + _PAIRED + " SELECT first, second, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT first, second, cnt FROM bigrams UNION ALL SELECT * FROM lp) GROUP BY 1, 2")
def learn_apply_pairs(spark, sf_dir):
    learned = learn.record_pairs(_uses(spark, sf_dir), words_of(spark, sf_dir), _users(spark))
    return learn.apply_learned_pairs(bigrams_of(spark, sf_dir), learned)


@query(CTE + "SELECT DISTINCT word, word NOT IN (SELECT word FROM words WHERE freq >= 3) AND regexp_full_match(word, '[\\p{L}'']+') AS added FROM talk UNION ALL SELECT 'a1', false")
def user_words_added(spark, sf_dir):
    have = words_of(spark, sf_dir).filter("freq >= 3").select("word")
    return learn.add_user_words(have, typed_words(spark, sf_dir).toDF("word").union(spark.createDataFrame([(" A1",)], "word string")))[1]


@query(CTE + "SELECT typed AS word, typed IN (SELECT word FROM words) AS removed FROM asked")
def user_words_removed(spark, sf_dir):
    return learn.remove_user_words(words_of(spark, sf_dir).select("word"), typed_words(spark, sf_dir).toDF("word"))[1]


@query(CTE + "SELECT word, freq FROM words WHERE word NOT IN (SELECT word FROM talk) UNION ALL SELECT word, 100 FROM (VALUES ('zzqx'), ('qwvz')) u(word) WHERE word NOT IN (SELECT word FROM words) AND word NOT IN (SELECT word FROM talk)")
def live_vocabulary(spark, sf_dir):
    return learn.live_vocabulary(words_of(spark, sf_dir), _users(spark), typed_words(spark, sf_dir).toDF("word"))


@query(CTE + "SELECT typed, typed IN (SELECT word FROM words WHERE freq < 3) AS mine FROM asked")
def user_words_contains(spark, sf_dir):
    return learn.is_user_word(typed_words(spark, sf_dir), words_of(spark, sf_dir).filter("freq < 3"), "typed")


@query(CTE + "SELECT typed FROM unknown WHERE typed NOT IN (SELECT right(typed, length(typed) - 1) FROM unknown)")
def words_to_mark(spark, sf_dir):
    strange = unknown(spark, sf_dir)
    ignored = strange.select(F.expr("right(typed, length(typed) - 1)").alias("word"))
    return correct.should_mark(typed_words(spark, sf_dir), words_of(spark, sf_dir), ignored, "typed")


@query(CTE + "SELECT word, CASE WHEN word IN (SELECT word FROM talk) THEN length(word) ELSE freq END AS freq FROM words UNION ALL SELECT typed, length(typed) FROM unknown")
def set_frequencies(spark, sf_dir):
    return ngram.set_frequencies(words_of(spark, sf_dir), typed_words(spark, sf_dir).select(F.col("typed").alias("word"), F.length("typed").alias("freq")))


@query(CTE + "SELECT word, freq FROM words WHERE word NOT IN (SELECT word FROM talk)")
def remove_words(spark, sf_dir):
    return ngram.remove_words(words_of(spark, sf_dir), typed_words(spark, sf_dir).toDF("word"))


@query(CTE + "SELECT word, CAST(max(freq) AS BIGINT) AS freq FROM (SELECT word, freq FROM words UNION ALL SELECT typed, 10 FROM asked) GROUP BY 1")
def raise_counts(spark, sf_dir):
    return vocab_build.raise_to(words_of(spark, sf_dir), typed_words(spark, sf_dir).select(F.col("typed").alias("word"), F.lit(10).alias("freq")))


@query(CTE + "SELECT word, freq FROM words UNION ALL SELECT typed, 7 FROM unknown")
def insert_new_words(spark, sf_dir):
    return vocab_build.insert_new(words_of(spark, sf_dir), typed_words(spark, sf_dir).select(F.col("typed").alias("word"), F.lit(7).alias("freq")))


@query(CTE + f""", p AS (SELECT DISTINCT previous_word AS typed, word AS wanted FROM talk WHERE previous_word IS NOT NULL),
l AS (SELECT *, len(list_filter(range(1, least(length(typed), length(wanted)) + 1), lambda i: left(typed, i) = left(wanted, i))) AS n FROM p)
SELECT typed, wanted, length(wanted) <= 100 AND length(typed) <= 100 AS ok, CAST(length(typed) - n AS INTEGER) AS deleted, CAST(length(wanted) - n AS INTEGER) AS n_typed, CAST(2 * (length(typed) + length(wanted) - 2 * n) AS INTEGER) AS expected FROM l""")
def replacement_keys(spark, sf_dir):
    rows = talk(spark, sf_dir).filter("previous_word is not null").select(F.col("previous_word").alias("typed"), F.col("word").alias("wanted")).distinct()
    keys = X.replacement_keys(F.col("typed"), F.col("wanted"))
    return rows.select("typed", "wanted", keys.alias("k")).select("typed", "wanted", "k.ok", "k.deleted", F.col("k.typed").alias("n_typed"), "k.expected")


@query(r"""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, regexp_full_match(ch, '[^\p{L}\p{Nd}''\x00-\x1F\x7F-\x{9F}]') AS separates FROM c WHERE ch <> '' AND ch <> chr(10)""")
def separators(spark, sf_dir):
    signs = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).distinct().filter("ch != '' and ch != '\n'")
    return signs.withColumn("separates", X.is_word_separator(F.col("ch")))


@query(r"""WITH v AS (SELECT DISTINCT text, unnest([0, 5, 17, 1000]) AS caret FROM conversations)
SELECT text, caret, regexp_extract(left(text, caret), '[\p{L}'']*$') || regexp_extract(substr(text, caret + 1), '^[\p{L}'']*') AS word FROM v""")
def word_at_caret(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select("text", F.explode(F.array(*map(F.lit, (0, 5, 17, 1000)))).alias("caret")).distinct()
    return v.withColumn("word", X.word_at_caret(F.col("text"), F.col("caret")))


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), p AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS start, unnest(l) AS ch, text FROM (SELECT *, string_split(text, '') AS l FROM t)),
f AS (SELECT *, regexp_matches(ch, '[\p{L}'']') AS inside, lag(regexp_matches(ch, '[\p{L}'']')) OVER (PARTITION BY conv_id, turn ORDER BY start) AS before FROM p)
SELECT conv_id, turn, CAST(start AS INTEGER) AS start, regexp_extract(substr(text, start + 1), '^[\p{L}'']+') AS word FROM f WHERE inside AND NOT coalesce(before, false)""")
def word_spans(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.word_spans(F.col("text"))).alias("s"))
    return per.select("conv_id", "turn", "s.start", "s.word")


_TRACK = """WITH c AS (SELECT conv_id * 1000 + turn AS user_id, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS ch FROM (SELECT conv_id, turn, string_split(text, '') AS l FROM conversations)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS idx, CASE WHEN regexp_matches(ch, '[\\p{L}'']') THEN 'L' WHEN regexp_matches(ch, '\\p{Nd}') THEN 'D' ELSE 'S' END AS t FROM c WHERE ch >= ' '),
full_ AS (SELECT user_id, string_agg(ch, '' ORDER BY idx) AS line FROM k GROUP BY 1),
m AS (SELECT *, coalesce(max(CASE WHEN t <> 'L' THEN idx END) OVER w, 0) AS stop, coalesce(max(CASE WHEN t = 'S' AND ch IN ('.', '?', '!') THEN idx END) OVER w, 0) AS sentence_end FROM k WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
known AS (SELECT user_id, min(idx) AS known_at FROM m WHERE t = 'S' OR (t = 'D' AND stop < idx - 1) GROUP BY 1),
f AS (SELECT user_id, seq, idx, stop, sentence_end, ch AS separator, substr(line, stop + 1, idx - 1 - stop) AS word, coalesce(known_at <= stop, false) AS start_was_known FROM m JOIN full_ USING (user_id) LEFT JOIN known USING (user_id) WHERE t = 'S' AND stop < idx - 1),
p AS (SELECT *, CASE WHEN lag(idx) OVER u > sentence_end THEN lower(lag(word) OVER u) END AS previous_word, coalesce(lag(idx) OVER u = stop AND lag(separator) OVER u NOT IN ('.', '?', '!'), false) AS linked FROM f WINDOW u AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, seq, word, previous_word, separator, start_was_known, CASE WHEN linked THEN lag(word) OVER u END AS link_typed, CASE WHEN linked THEN lag(separator) OVER u END AS link_separator, CASE WHEN linked THEN lag(start_was_known) OVER u END AS link_start_known, CASE WHEN linked THEN lag(previous_word) OVER u END AS link_before
FROM p WINDOW u AS (PARTITION BY user_id ORDER BY idx)"""


@query(_TRACK)
def tracker_words(spark, sf_dir):
    found = tracker.track_batch(key_events(spark, sf_dir))
    return found.select("user_id", "seq", "word", "previous_word", "separator", "start_was_known", *(F.col(f"link.{c}").alias(f"link_{c}") for c in ("typed", "separator", "start_known", "before")))
