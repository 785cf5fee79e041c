"""Recorded keys and clicks as a source, and replacements as a sink, both for Structured Streaming.

The source reads folders of JSON lines that recorders append to. Its offsets are bytes of each file up to the last whole line, so a restart
goes on at the line where the last batch ended, and a batch that is run again reads the same lines. The sink writes the keys of
replacements; a batch counts once its entry is in the sink's log, and a batch that is there already is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from ..functions.constants import MAX_REPLACEMENT

RAW = "user_id long, seq long, ts timestamp, kind string, key string, ch string, ctrl boolean, alt boolean, injected boolean, x int, y int"
NAMES = [f.split()[0] for f in RAW.split(", ")]
PART_BYTES = 8 << 20
REPLACEMENT = "user_id long, seq long, ok boolean, deleted int, typed int, sent int, expected int"


def _opened(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """Bytes of whole lines of each file of a folder and the folders in it."""
    from pyarrow import fs

    where, top = _opened(path)
    out = {}
    for info in where.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
        name = info.path[len(top) :].lstrip("/")
        if info.is_file and not name.split("/")[-1].startswith((".", "_")):
            with where.open_input_file(info.path) as file:
                end = file.size()
                while end:  # back to the last line's end
                    begin = max(0, end - 65_536)
                    at = file.read_at(end - begin, begin).rfind(b"\n")
                    if at >= 0:
                        end = begin + at + 1
                        break
                    end = begin
            out[name] = end
    return out


class _Range(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


def _cut(start: dict[str, int], end: dict[str, int], size: int) -> list[_Range]:
    return [_Range(name, at, min(at + size, to)) for name, to in sorted(end.items()) for at in range(start.get(name, 0), to, size)]


def _lines(path: str, part: _Range, first: int) -> Iterator[bytes]:
    """The lines that begin in a range; `first` is where the file's lines to read begin."""
    where, top = _opened(path)
    with where.open_input_file(f"{top}/{part.name}") as file:
        if file.size() < part.end:
            raise ValueError(f"{part.name} has become shorter than what was read of it")
        at, held = part.begin, b""
        if part.begin > first:  # the line that begins before belongs to the range before
            at = part.begin - 1
            skipping = True
        else:
            skipping = False
        while True:
            block = file.read_at(1 << 20, at)
            if not block:
                return
            base, held = at - len(held), held + block
            at += len(block)
            begin = 0
            while (to := held.find(b"\n", begin)) >= 0:
                if not skipping:
                    yield held[begin:to]
                skipping, begin = False, to + 1
                if base + begin >= part.end:
                    return
            held = held[begin:]


class _Rows:
    """Reads ranges of lines as rows of RAW."""

    def __init__(self, options: dict):
        self.path, self.size, self.bad = options["path"], int(options.get("partbytes", PART_BYTES)), options.get("badlines", "fail")

    def rows(self, part: _Range, first: int = 0) -> Iterator[tuple]:
        for line in _lines(self.path, part, first):
            if not line.strip():
                continue
            try:
                said = json.loads(line)
                ts = datetime.fromtimestamp(said["ts"] / 1e6, UTC) if said.get("ts") is not None else None
                yield tuple(ts if n == "ts" else said.get(n, "key" if n == "kind" else None) for n in NAMES)
            except (ValueError, TypeError, AttributeError) as error:
                if self.bad != "skip":
                    raise ValueError(f"a line of {part.name} is no record: {line[:100]!r}") from error


class _BatchReader(_Rows, DataSourceReader):
    def partitions(self):
        return _cut({}, _sizes(self.path), self.size)

    def read(self, partition):
        return self.rows(partition)


class _StreamReader(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _sizes(self.path)

    def partitions(self, start: dict, end: dict):
        out = _cut(start, end, self.size)
        for part in out:
            part.first = start.get(part.name, 0)
        return out

    def read(self, partition):
        return self.rows(partition, partition.first)

    def commit(self, end: dict) -> None:
        """Nothing is kept."""


class Keystrokes(DataSource):
    """`keystrokes`: JSON lines with the names of RAW (ts in microseconds; kind `key` or `click`, by default `key`) of all files below `path`. Options:
    `partBytes` of a task; `badLines`, `fail` or `skip`. Files may grow and appear, but not shrink. Names that begin with . or _ are
    left out, and so is a last line without its end, until it has one."""

    @classmethod
    def name(cls) -> str:
        return "keystrokes"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


def replacement_events(typed: str | None, wanted: str | None, rejects: str = "") -> tuple[dict, list[str]]:
    """What a replacement sends: a result and the keys, `<` for Backspace, of which each is two events. Sending ends before the first key that
    the target rejects; an empty replacement, or one with more than MAX_REPLACEMENT characters on either side, is refused."""
    was, want = typed or "", wanted or ""
    if not want or max(len(was), len(want)) > MAX_REPLACEMENT:
        return {"ok": False, "deleted": 0, "typed": 0, "sent": 0, "expected": 0}, []
    same = next((i for i, (a, b) in enumerate(zip(was, want, strict=False)) if a != b), min(len(was), len(want)))
    deleted, rest = len(was) - same, want[same:]
    stop = next((i for i, c in enumerate(rest) if c in rejects), len(rest))
    keys = ["<"] * deleted + list(rest[:stop])
    return {"ok": stop == len(rest), "deleted": deleted, "typed": stop, "sent": 2 * len(keys), "expected": 2 * (deleted + len(rest))}, keys


class _Sink(DataSourceStreamWriter):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.query, self.rejects, self.names = options["path"], options.get("query", "query"), options.get("rejects", ""), names

    def write(self, iterator) -> _Written:
        where, top = _opened(self.path)
        out = []
        for row in iterator:
            said = dict(zip(self.names, row, strict=True))
            result, keys = replacement_events(said["typed"], said["wanted"], self.rejects)
            out.append(json.dumps({"user_id": said["user_id"], "seq": said["seq"], **result, "keys": "".join(keys)}))
        if not out:
            return _Written(None)
        name = f"data/{uuid.uuid4().hex}.json"
        where.create_dir(f"{top}/data")
        with where.open_output_stream(f"{top}/{name}") as file:
            file.write(("\n".join(out) + "\n").encode())
        return _Written(name)

    def _entry(self, batch: int) -> str:
        return f"log/{self.query}-{batch:012d}.json"

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs

        where, top = _opened(self.path)
        entry = f"{top}/{self._entry(batchId)}"
        if where.get_file_info(entry).type != fs.FileType.NotFound:  # the batch has been written before
            self.abort(messages, batchId)
            return
        where.create_dir(f"{top}/log")
        made = f"{top}/log/.{uuid.uuid4().hex}"
        with where.open_output_stream(made) as file:
            file.write(json.dumps([m.file for m in messages if m is not None and m.file]).encode())
        where.move(made, entry)

    def abort(self, messages, batchId: int) -> None:
        where, top = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                where.delete_file(f"{top}/{m.file}")


class Replacements(DataSource):
    """`replacements`: a sink for (user_id, seq, typed, wanted). Options: `path`; `query`, which with the number of a batch names it, so that
    several queries may share a folder; `rejects`, characters that the target takes no key for. read_replacements gives the results."""

    @classmethod
    def name(cls) -> str:
        return "replacements"

    def schema(self) -> str:
        return "user_id long, seq long, typed string, wanted string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if missing := {"user_id", "seq", "typed", "wanted"} - set(schema.names):
            raise ValueError(f"replacements need the columns {sorted(missing)}")
        return _Sink(self.options, schema.names)


def register(spark: SparkSession) -> None:
    """Makes `keystrokes` and `replacements` known to the session."""
    spark.dataSource.register(Keystrokes)
    spark.dataSource.register(Replacements)


def read_replacements(spark: SparkSession, path: str) -> DataFrame:
    """Results and keys of all batches in the sink's log, each once: REPLACEMENT and keys."""
    schema = f"{REPLACEMENT}, keys string"
    where, top = _opened(path)
    from pyarrow import fs

    if where.get_file_info(f"{top}/log").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    logged = spark.read.text(f"{path}/log", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("file"))
    rows = spark.read.schema(schema).json(f"{path}/data").select("*", F.concat(F.lit("data/"), F.col("_metadata.file_name")).alias("file"))
    return rows.join(logged, "file", "left_semi").drop("file")
