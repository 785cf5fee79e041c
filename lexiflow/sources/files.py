"""Readers and writers of the text formats: word counts, pairs, user words, learned counts, raw corpora, settings."""

from __future__ import annotations

import time
from dataclasses import dataclass, fields, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DIAGNOSTICS_BYTES, MAX_WORD_LENGTH
from ..functions.text import norm
from ..operators.vocab_build import WORD, keep_word


def _lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if missing_ok:
            return spark.createDataFrame([], "value string")
        raise FileNotFoundError(path)
    return spark.read.text(path)


def split_line(line: Column, most: int) -> Column:
    """At most `most` parts between runs of spaces and tabs; the last keeps what is left."""
    return F.split(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"[ \t]+", most)


def _numbered(parts: Column, at: int) -> Column:
    """A count as a 32-bit integer; missing or unreadable counts as 1."""
    return F.coalesce(F.get(parts, F.lit(at)).try_cast("int"), F.lit(1)).cast("long")


def _content(spark: SparkSession, path: str) -> DataFrame:
    trimmed = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return _lines(spark, path).filter((trimmed != "") & ~trimmed.startswith("#"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq), one row a line; counts that are not positive are dropped."""
    parts = split_line(F.col("value"), 2)
    return _content(spark, path).select(F.lower(parts[0]).alias("word"), _numbered(parts, 1).alias("freq")).filter("freq > 0")


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    parts = split_line(F.col("value"), 3)
    rows = _content(spark, path).filter(F.size(parts) >= 2)
    return rows.select(F.lower(parts[0]).alias("first"), F.lower(parts[1]).alias("second"), _numbered(parts, 2).alias("cnt")).filter("cnt > 0")


def read_user_words(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, missing_ok=True).select(norm(F.col("value")).alias("word")).filter("word != ''").distinct()


def read_learned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Learned words and pairs from `W word n` and `P first second n`; other lines are skipped, the last of a key's lines wins."""
    lines = _lines(spark, path, missing_ok=True).withColumn("line", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"[ \t]+")
    rows = lines.select("line", parts.alias("p")).withColumn("n", F.element_at("p", -1).try_cast("int").cast("long")).filter("n is not null")
    last = F.max_by("n", "line").alias("cnt")
    words = rows.filter((F.get("p", F.lit(0)) == "W") & (F.size("p") == 3)).groupBy(F.lower(F.get("p", F.lit(1))).alias("word")).agg(last)
    pairs = rows.filter((F.get("p", F.lit(0)) == "P") & (F.size("p") == 4)).groupBy(F.lower(F.get("p", F.lit(1))).alias("first"), F.lower(F.get("p", F.lit(2))).alias("second")).agg(last)
    return words, pairs


def write_user_words(words: DataFrame, path: str) -> None:
    words.filter(norm(F.col("word")) != "").select(F.col("word").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_learned(words: DataFrame, pairs: DataFrame, path: str) -> None:
    w = words.select(F.concat_ws(" ", F.lit("W"), "word", "cnt").alias("value"), F.lit(0).alias("o"))
    p = pairs.select(F.concat_ws(" ", F.lit("P"), "first", "second", "cnt").alias("value"), F.lit(1).alias("o"))
    w.union(p).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def write_words(words: DataFrame, path: str) -> None:
    words.orderBy(F.desc("freq"), "word").select(F.concat_ws(" ", "word", "freq").alias("value")).write.mode("overwrite").text(path)


def write_bigrams(bigrams: DataFrame, path: str) -> None:
    bigrams.orderBy(F.desc("cnt"), "first", "second").select(F.concat_ws(" ", "first", "second", "cnt").alias("value")).write.mode("overwrite").text(path)


def _decode(raw: bytes) -> str:
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files: UTF-8 where that is valid, else Windows-1252, else Latin-1."""

    def run(frames):
        for frame in frames:
            yield frame[["path"]].assign(text=[_decode(c) for c in frame["content"]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def read_valid_words(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.explode(F.split(F.lower("value"), r"(?U)\s+")).alias("word")).filter("word != ''").distinct()


def read_web_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, raw) of lines of two tab-separated columns; the last line of a word wins."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).filter(F.size(parts) == 2)
    rows = rows.select("line", F.lower(F.trim(parts[0])).alias("word"), F.trim(parts[1]).try_cast("long").alias("raw")).filter("raw is not null")
    return rows.groupBy("word").agg(F.max_by("raw", "line").alias("raw"))


def read_web_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(first, second, raw); repeated pairs are kept."""
    parts = F.split("value", "\t")
    names = F.split(F.lower(F.trim(parts[0])), r"\s+")
    rows = _lines(spark, path).filter((F.size(parts) == 2) & (F.size(names) == 2))
    return rows.select(names[0].alias("first"), names[1].alias("second"), F.trim(parts[1]).try_cast("long").alias("raw")).filter("raw is not null")


def read_misspellings(spark: SparkSession, path: str) -> DataFrame:
    """(bad, good) of lines `bad->good` with a single correction; the first line of a word wins."""
    parts = F.split(F.lower(F.trim("value")), "->")
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).filter(F.size(parts) == 2)
    rows = rows.select("line", F.trim(parts[0]).alias("bad"), F.trim(parts[1]).alias("good")).filter(F.col("bad").rlike(rf"^{WORD}\z") & F.col("good").rlike(rf"^{WORD}\z"))
    return rows.groupBy("bad").agg(F.min_by("good", "line").alias("good"))


def read_dictionary_entries(spark: SparkSession, path: str) -> DataFrame:
    """(word, flags) of a .dic file without its count line and without entries flagged `!`."""
    parts = F.split(F.trim("value"), "/", 2)
    rows = _lines(spark, path).filter(~F.trim("value").rlike(r"^\d*\z"))
    return rows.select(parts[0].alias("word"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("flags")).filter(~F.contains("flags", F.lit("!")))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a hand-written list: `#` lines are comments, several words may share a line."""
    rows = _lines(spark, path).filter(~F.trim("value").startswith("#"))
    words = rows.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(rf"({WORD})"), 1)).alias("word"))
    return words.filter(keep_word(F.col("word"), F.lit(None).cast("long")) & (F.length("word") <= MAX_WORD_LENGTH)).distinct()


@dataclass(frozen=True)
class Settings:
    completion: bool = True
    spell_check: bool = True
    autocorrect: bool = True
    fix_messy_words: bool = True
    real_word_fixes: bool = False
    prediction: bool = True
    learning: bool = True
    diagnostics: bool = False
    suggestion_count: int = 5


def parse_settings(text: str, base: Settings | None = None) -> Settings:
    """`name=value` lines over defaults: unknown names are ignored, unreadable values keep the default, the count stays in 1..10."""
    out = base or Settings()
    kinds = {f.name.replace("_", ""): f for f in fields(Settings)}
    for line in text.splitlines():
        name, found, value = line.partition("=")
        field = kinds.get(name.strip().lower().replace("_", ""))
        value = value.strip().lower()
        if not found or field is None:
            continue
        if field.name == "suggestion_count":
            if value.lstrip("+-").isdigit():
                out = replace(out, suggestion_count=min(10, max(1, int(value))))
        elif value in ("true", "false"):
            out = replace(out, **{field.name: value == "true"})
    return out


def format_settings(settings: Settings) -> str:
    return "".join(f"{f.name}={str(getattr(settings, f.name)).lower()}\n" for f in fields(Settings))


class Repository(Protocol):
    """Where words, pairs, user words and learned counts are kept."""

    def words(self) -> DataFrame: ...
    def bigrams(self) -> DataFrame: ...
    def user_words(self) -> DataFrame: ...
    def save_user_words(self, words: DataFrame) -> None: ...
    def learned(self) -> tuple[DataFrame, DataFrame]: ...
    def save_learned(self, words: DataFrame, pairs: DataFrame) -> None: ...


@dataclass(frozen=True)
class TextRepository:
    """The text files of one folder."""

    spark: SparkSession
    folder: str

    def words(self) -> DataFrame:
        return read_words(self.spark, f"{self.folder}/words.txt")

    def bigrams(self) -> DataFrame:
        return read_bigrams(self.spark, f"{self.folder}/bigrams.txt")

    def user_words(self) -> DataFrame:
        return read_user_words(self.spark, f"{self.folder}/user_dict.txt")

    def save_user_words(self, words: DataFrame) -> None:
        write_user_words(words, f"{self.folder}/user_dict.txt")

    def learned(self) -> tuple[DataFrame, DataFrame]:
        return read_learned(self.spark, f"{self.folder}/learned.txt")

    def save_learned(self, words: DataFrame, pairs: DataFrame) -> None:
        write_learned(words, pairs, f"{self.folder}/learned.txt")


class Dictionary:
    """The words and pairs that are in use. Loading counts both tables once and then changes them together; a failed load changes nothing."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        for table in (getattr(self, "words", None), getattr(self, "bigrams", None)):
            if table is not None:
                table.unpersist()
        self.words: DataFrame | None = None
        self.bigrams: DataFrame | None = None
        self.load_ms = 0

    @property
    def is_loaded(self) -> bool:
        return self.words is not None

    def load(self, repository: Repository) -> None:
        began = time.monotonic()
        words = repository.words().groupBy("word").agg(F.sum("freq").alias("freq")).cache()
        bigrams = repository.bigrams().groupBy("first", "second").agg(F.sum("cnt").alias("cnt")).cache()
        words.count(), bigrams.count()
        self.reset()
        self.words, self.bigrams, self.load_ms = words, bigrams, int(1000 * (time.monotonic() - began))


def append_diagnostics(results: DataFrame, path: str, enabled: bool = True, most: int = DIAGNOSTICS_BYTES) -> None:
    """Appends one line a replacement: time, app, and counts of keys, never text. What is there is deleted first once it is larger
    than `most` bytes. results: ts, app, deleted, typed, sent, expected."""
    if not enabled:
        return
    spark = results.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where) and files.getContentSummary(where).getLength() > most:
        files.delete(where, True)
    app = F.coalesce(F.nullif(F.col("app"), F.lit("")), F.lit("unknown"))
    shown = F.format_string("%s  app=%s  delete=%d  type=%d  sent=%d/%d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), app, "deleted", "typed", "sent", "expected")
    results.select(shown.alias("value")).write.mode("append").text(path)
