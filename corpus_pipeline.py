"""The corpus pipeline: language ID, near-duplicates, substring deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next one's docs. All but the
last return the columns of documents. A test compares run() with a brute-force version, as SQL cannot express the stages.

Rows are judged one by one, whatever their ids: null and repeated ids change nothing but where a stage says so. Texts of any length are
worked on whole, empty tables give empty results, and further columns, of any names, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import forget, light, scratch, stored
from lexiflow.llm.decontaminate import decontaminate
from lexiflow.llm.language_id import CompressionClassifier, identify_language, sample_dictionaries
from lexiflow.llm.minhash import near_duplicates
from lexiflow.llm.packing import pack
from lexiflow.llm.queries import tokenizer_path
from lexiflow.llm.substring_dedup import substring_dedup

#: Words of a passage that the pipeline removes when an earlier document has it.
PASSAGE = 50
ROW = "__lf_source_row"


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """docs under names that no operator's results have, those names in order, and the name of each column."""
    inner = [f"__lf_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*inner), inner, dict(zip(docs.columns, inner, strict=True))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose margin between two languages is narrow, go; lang becomes the language
    found. Of languages that fit equally the one with more labelled rows is found, but with no margin such documents go."""
    model = CompressionClassifier(sample_dictionaries(docs.select("doc_id", "text", "lang")))
    rows, inner, named = _hidden(docs)
    judged = identify_language(rows, model, named["text"]).filter("accepted").withColumn(named["lang"], F.col("lang_pred"))
    return judged.select(*inner).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (a null id is larger than any other; of rows with the same id, the
    first). Shingles of five words, similarity of 0.8 or more. Texts without words stay."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")  # once: another reading may be split in other ways
    groups = stored(near_duplicates(rows.select(ROW, "text"), shingle=5, percent=80, id_col=ROW), "groups").filter("n_shingles > 0")
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    members = groups.join(sizes, "component_id").select(ROW, "component_id").join(rows.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = members.groupBy("component_id").agg(F.min_by(ROW, order).alias(ROW)).select(ROW)
    gone = members.select(ROW).join(first, ROW, "left_anti")
    return rows.join(light(gone, "gone"), ROW, "left_anti").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more that a document with a smaller id holds are cut out; texts that lose nothing stay as they are. A text
    may become empty; rows with the same id do not cut each other."""
    rows, inner, named = _hidden(docs)
    found = substring_dedup(rows, PASSAGE, named["doc_id"], named["text"], carry=tuple(inner))
    cut = F.col("n_removed") > 0
    found = found.withColumn(named["n_chars"], F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col(named["n_chars"])))
    return found.withColumn(named["text"], F.when(cut, F.col("kept_text")).otherwise(F.col(named["text"]))).select(*inner).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in passages of the benchmark go; those without words stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens; a null or empty text is its end id alone."""
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"), "word", end=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express compression, signatures or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage has stored on its way goes when its result is there, and so does its input
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        forget(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
