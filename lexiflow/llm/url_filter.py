"""URL filter: rules by host suffix and path prefix, else naive Bayes over segmented host and path words.

Unigram counts come from all pages' visible text. Each distinct host label is cut into substrings, which are joined with the counts,
so that no vocabulary is held by a task; Viterbi then takes the most probable split. There are no labelled urls, so a fixed list of
unwanted words is the seed: all pages whose host holds one teach the classifier to block, all others that no rule blocks to allow. What it
finds beyond the list are the words that stand beside listed ones, and only there. Its features are segmented host words and path words,
without the words that the rules themselves are made of, or it would only repeat the rules; they are hashed to a fixed number of columns,
so the model has a fixed size. A word's probability in a class leans on its share in all pages, so that what is rare, or as usual in both
classes, says little; the prior is the share of pages that teach to block. So without evidence a page is allowed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, stored

#: Hashed columns, and words of all pages' mixture that are added to each class.
FEATURES, SMOOTH = 1 << 18, 20.0
#: Letters of the longest host name there can be; a longer label stays one word.
LONGEST = 253
#: Words of a host that mark it as unwanted.
UNWANTED = ("adult", "bet", "bets", "betting", "casino", "cialis", "escort", "gambling", "jackpot", "loan", "loans", "lottery", "pharmacy", "pill", "pills", "poker", "porn", "replica", "roulette", "slots", "spam", "viagra", "warez", "xxx")


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one or for null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. A rule is `host/path`: it fits its host and subdomains where
    the path starts with the rule's; of rules of one length that both fit, the one later in the order of their texts wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def visible_words(html: Column) -> Column:
    """Lower-cased ASCII letter runs of a page's text without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.filter(F.split(F.lower(bare), "[^a-z]+"), lambda w: F.length(w) > 0)


def _viterbi(total: float):
    def run(frames):
        for frame in frames:
            cuts = [viterbi(label, dict(zip(pieces, counts, strict=True)), total) for label, pieces, counts in zip(frame["label"], frame["pieces"], frame["counts"], strict=True)]
            yield pd.DataFrame({"label": frame["label"], "words": cuts})

    return run


def viterbi(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The most probable split of a label under unigram counts; an unknown piece of n letters weighs 10 / (total * 10^n), and ties
    go to the longer last piece. Pieces may be of any length."""
    best, back, ten = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1), math.log(10)
    lengths = sorted({len(piece) for piece in counts}, reverse=True)
    free, begin = -math.inf, 0  # the best start of an unknown piece does not depend on its end
    for end in range(1, len(label) + 1):
        if (value := best[end - 1] + (end - 1) * ten) > free + 1e-12:
            free, begin = value, end - 1
        best[end], back[end] = free + math.log(10 / total) - end * ten, begin
        for n in lengths:
            count = counts.get(label[end - n : end], 0) if n <= end else 0
            if count:
                score = best[end - n] + math.log(count / total)
                if score > best[end] + 1e-12 or (score > best[end] - 1e-12 and end - n < back[end]):
                    best[end], back[end] = score, end - n
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segment_labels(labels: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(label, words) for distinct labels; unigrams is (word, n). Labels that are empty or null are left out; one of more than LONGEST
    letters is one word."""
    of = unigrams.agg(F.sum("n").alias("n"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, lengths = float(of["n"] or 1), F.array(*map(F.lit, sorted(of["lengths"]))).cast("array<int>")  # only pieces of these lengths can be known
    own = labels.select("label").filter(F.length("label") > 0).distinct()
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.filter(lengths, lambda n: n <= F.length("label") - i + 1), lambda n: F.col("label").substr(i, n))))
    pieces = own.filter(F.length("label") <= LONGEST).select("label", F.explode(F.array_distinct(spans)).alias("word"))
    known = pieces.join(unigrams, "word").groupBy("label").agg(F.collect_list("word").alias("pieces"), F.collect_list("n").alias("counts"))
    ready = own.join(known, "label", "left").select("label", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"), F.coalesce("counts", F.array().cast("array<long>")).alias("counts"))
    cut = ready.filter(F.length("label") <= LONGEST).mapInPandas(_viterbi(total), "label string, words array<string>")
    return cut.union(own.filter(F.length("label") > LONGEST).select("label", F.array("label")))


def _columns(host_words: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Hashed feature columns: host words, and path words with all digit runs as one word; none that a rule is made of."""
    words = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", " 0 "), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    of_rules = sorted({w for _, text in rules for w in re.findall("[a-z0-9]+", text.lower())}) or [""]
    other = lambda ws: F.filter(ws, lambda w: ~w.isin(*of_rules))
    named = F.concat(F.transform(other(host_words), lambda w: F.concat(F.lit("h:"), w)), F.transform(other(words), lambda w: F.concat(F.lit("p:"), w)))
    return F.transform(named, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def _odds(weights):
    """Log odds of block without the prior."""

    def run(frames):
        for frame in frames:
            odds = [float(weights.value[list(c)].sum()) if len(c) else 0.0 for c in frame["features"]]
            yield frame.drop(columns=["features"]).assign(odds=odds)

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """One row per page: id, host, path, host_words, rule and rule_verdict (null without a rule), score (probability of block by the
    classifier, 0 to 1), verdict (the rule's, else block if score > 0.5, else allow).

    The classifier learns to block from pages with a word of `unwanted` in their host, and to allow from the others that no rule blocks; the
    prior is their share (each counted once more). A url that is null or has no `://` has an empty host and path and no words;
    only the prior speaks. Without any page of either kind no word says anything, and verdicts are allow. Repeated rows are judged alike; urls may be of any length; an empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("__lf_id"), host.alias("host"), path.alias("path"))
    rule, what = rule_of(F.col("host"), F.col("path"), rules)
    unigrams = stored(pages.select(F.explode(visible_words(F.col(html_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "unigrams")
    hosts = base.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^a-z0-9]+")).alias("place", "label"))
    cut = segment_labels(labels, unigrams)
    words = labels.join(cut, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("host_words"))
    words = stored(words, "host-words")
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= BROADCAST_ROWS and size["bytes"] <= 8 << 20
    judged = base.join(F.broadcast(words) if few else words, "host", "left").select("__lf_id", "host", "path", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"), rule.alias("rule"), what.alias("rule_verdict"))
    judged = judged.withColumn("features", _columns(F.col("host_words"), F.col("path"), rules))
    judged = stored(judged, "urls")
    marked = F.exists("host_words", lambda w: w.isin(*unwanted)) if unwanted else F.lit(False)
    trained = judged.withColumn("taught", F.when(marked, "block").when(F.coalesce("rule_verdict", F.lit("allow")) == "allow", "allow")).filter("taught is not null")
    count = lambda what: F.count_if(F.col("taught") == what)
    table = trained.select("taught", F.explode("features").alias("f")).groupBy("f").agg(count("block").alias("b"), count("allow").alias("a")).collect()  # FEATURES rows at most
    counts = np.zeros((2, FEATURES))
    for row in table:
        counts[:, row["f"]] = row["b"], row["a"]
    shares = counts.sum(axis=0) / max(counts.sum(), 1)
    with np.errstate(divide="ignore"):
        logs = np.log(counts + SMOOTH * shares) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH)
    logs[:, (counts.sum(axis=0) == 0) | (counts.sum(axis=1) == 0).any()] = 0  # what neither class has says nothing
    weights = pages.sparkSession.sparkContext.broadcast(logs[0] - logs[1])
    scored = stored(judged.mapInPandas(_odds(weights), "__lf_id long, host string, path string, host_words array<string>, rule string, rule_verdict string, odds double"), "odds")
    pages_of = trained.agg(count("block").alias("b"), count("allow").alias("a")).first()
    prior = math.log((pages_of["b"] + 1) / (pages_of["a"] + 1)) if pages_of["b"] else -math.log(pages_of["a"] + 2)
    score = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(-prior) - F.col("odds")))))
    scored = scored.withColumn("score", score)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("__lf_id").alias(id_col), "host", "path", "host_words", "rule", "rule_verdict", "score", verdict.alias("verdict"))
