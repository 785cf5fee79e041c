"""Language identification by compression: a text belongs to the language whose dictionary lets zstandard encode it smallest.

Each language's raw-content dictionary is a bounded sample of its labelled texts. A text is reduced to its lower-cased letters (runs
of anything else become one space) and cut into blocks of two kilobytes, all of which are encoded, so that the text's own history cannot
replace the dictionary. Equal sizes go to the language with more labelled documents. The score is a logistic function of the
relative margin between the smallest and the second smallest size; narrow margins are rejected.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, frugal_group, whole

_LETTER = re.compile("[A-Za-z]")
_OTHER = re.compile(r"[\W\d_]+")
BLOCK = 2048
MARGIN = 0.005
STEEP = 0.04
#: Bytes of a dictionary that still tells a language.
LEAST = 1024
RESULT = "__lf_row long, lang_pred string, score double, margin double, accepted boolean"


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or not text.isascii() and any(c.isalpha() for c in text))


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def equal_share(sizes: list[int], room: int) -> int:
    """The largest share with which the sizes, each cut to it, fit into the room."""
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > room:
            return max(0, room) // (len(sizes) - i)
        room -= size
    return max(sizes, default=0)


def _dictionary(size: int):
    def run(key, table):
        texts = [letters(t) for t in table.sort_by("r").column("t").to_pylist()]
        share = equal_share([len(t) for t in texts], size - len(texts) + 1)
        data = b" ".join(t[:share] for t in reversed(texts))[-size:]
        return pa.table([table.column("lang")[:1], pa.array([data], pa.binary())], names=["lang", "data"])

    return run


def sample_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, dictionary_bytes: int = 65_536, total_bytes: int = 64 << 20) -> dict[str, bytes]:
    """Raw-content dictionaries: per language, texts of the `per_language` labelled rows with the smallest id hashes, an equal share of
    each (what short ones leave goes to the others), `dictionary_bytes` in all, from the first `dictionary_bytes` characters of each. The bounds are these two parameters, for each language; all languages are learned. Beyond
    `total_bytes` of dictionaries each gets an equal share; a share below LEAST bytes is an error. Rows without label or text are left out.
    The languages come in the order of their numbers of labelled rows, which are counted over all."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0))
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), F.col(id_col), F.xxhash64(text_col)))
    picked = rows.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, dictionary_bytes).alias("t"), rank.alias("r")).filter(F.col("r") <= per_language)
    many = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    share = min(dictionary_bytes, total_bytes // max(len(many), 1))
    if share < min(LEAST, dictionary_bytes):
        raise ValueError(f"{len(many)} languages are too many for {total_bytes} bytes of dictionaries")
    made = picked.groupBy("lang").applyInArrow(frugal_group(_dictionary(share)), f"lang {picked.schema['lang'].dataType.simpleString()}, data binary")
    found = {row["lang"]: bytes(row["data"]) for row in made.collect()}
    return {row["lang"]: found[row["lang"]] for row in many}


class CompressionClassifier:
    """Sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self._made = dictionaries, None

    def _compressors(self):
        import zstandard

        if self._made is None:
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=15, chain_log=15, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = []
            for name, data in self.dictionaries.items():
                known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=how)
                self._made.append((name, zstandard.ZstdCompressor(compression_params=how, dict_data=known)))
        return self._made

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted); `und` without a letter or without any learned language, never accepted."""
        if not self.dictionaries or not has_letter(text):
            return "und", 0.0, 0.0, False
        data = letters(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted(((sum(len(c.compress(b)) for b in blocks), name) for name, c in self._compressors()), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0, True
        margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
        return sizes[0][1], 1 / (1 + math.exp(-margin / STEEP)), margin, margin >= MARGIN


def _judge(sent, text: str, schema: pa.Schema):
    def run(batches):
        model = CompressionClassifier(sent.value)
        for batch in batches:
            rows = [model.judge(t) for t in batch.column(text).to_pylist()]
            made = dict(zip(("lang_pred", "score", "margin", "accepted"), zip(*rows, strict=True) if rows else [()] * 4, strict=True))
            yield pa.record_batch([pa.array(made[f.name], f.type) if f.name in made else whole(batch.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def identify_language(docs: DataFrame, model: CompressionClassifier, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, score (0 to 1), margin and accepted.

    lang_pred is a learned language, `und` for a text that is null or has no letter. accepted is false for `und` and for margins
    below MARGIN. Columns of docs that are named as a result are replaced. Rows are judged one by one; an empty table gives none.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = {f.name for f in made}
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in names]
    shape = T.StructType(kept + made)
    return docs.mapInArrow(frugal(_judge(docs.sparkSession.sparkContext.broadcast(model.dictionaries), text_col, to_arrow_schema(shape))), shape)
