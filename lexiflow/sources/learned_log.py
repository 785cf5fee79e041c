"""A durable store of learned counts: a log of deltas with merges, resets and rollback.

Counts are kept as tables of deltas. Each change is one numbered entry of a log, a small file that is put in place only if no other has its
number, so writers on several machines cannot overwrite each other, and a reader sees whole changes only. A batch is known by its name:
appending it again changes nothing, so a sink may hand on a batch as often as it likes. When MERGE_EVERY tables of one level
are there, they are summed into one of the next level; so a count is rewritten once a level, and a reading sums few tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SAVE_EVERY
from ..operators.learn import learn_deltas

DELTA = "first string, second string, cnt long"
MERGE_EVERY = SAVE_EVERY


@dataclass
class _State:
    """What a log says up to some entry: tables by level, and the names of the batches in them."""

    version: int = 0
    tables: list[tuple[str, int]] = field(default_factory=list)
    batches: set[str] = field(default_factory=set)

    def copy(self) -> _State:
        return _State(self.version, list(self.tables), set(self.batches))


class LearnedLog:
    """Learned counts in a folder that all machines share. Words are rows with a null second word."""

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = MERGE_EVERY):
        self.spark, self.folder, self.merge_every = spark, folder.rstrip("/"), merge_every

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[dict]:
        files, log = self._files(), self._path("log")
        if not files.exists(log):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(log) if s.getPath().getName().endswith(".json"))
        return [json.loads(r.value) for r in self.spark.read.text([f"{self.folder}/log/{n}" for n in names], wholetext=True).collect()] if names else []

    def _put(self, version: int, entry: dict) -> bool:
        """Writes the entry of this number unless there is one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, made = self._files(), self._path("log", f".{uuid.uuid4().hex}")
        out = files.create(made)
        out.write(json.dumps(entry | {"version": version}).encode())
        out.close()
        try:
            how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(made, self._path("log", f"{version:020d}.json"), how)
            return True
        except Exception as error:
            files.delete(made, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise

    def state(self, at: int | None = None) -> _State:
        """The log as of an entry, by default the last."""
        now, past = _State(), {0: _State()}
        for e in sorted(self._entries(), key=lambda e: e["version"]):
            if at is not None and e["version"] > at:
                break
            if e["op"] == "append" and e["batch"] not in now.batches:
                now.tables.append((e["table"], 0))
                now.batches.add(e["batch"])
            elif e["op"] == "merge" and set(e["tables"]) <= {t for t, _ in now.tables}:
                now.tables = [t for t in now.tables if t[0] not in e["tables"]] + [(e["table"], e["level"])]
            elif e["op"] == "reset":
                now.tables = []
            elif e["op"] == "rollback":
                now = past[e["to"]].copy()
            now.version = e["version"]
            past[now.version] = now.copy()
        return now

    def _change(self, decide) -> int | None:
        """Puts the entry that decide(state) wants behind the last one, again and again until no other came first; None for no entry."""
        while True:
            now = self.state()
            entry = decide(now)
            if entry is None:
                return None
            if self._put(now.version + 1, entry):
                return now.version + 1

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def append(self, words: DataFrame, pairs: DataFrame, batch: str) -> bool:
        """Adds (word, cnt) and (first, second, cnt); False if the batch has been added before."""
        if batch in self.state().batches:
            return False
        rows = words.select(F.col("word").alias("first"), F.lit(None).cast("string").alias("second"), F.col("cnt").cast("long")).union(pairs.select("first", "second", F.col("cnt").cast("long")))
        table = self._write(rows)
        added = self._change(lambda now: None if batch in now.batches else {"op": "append", "batch": batch, "table": table})
        if added is None:
            self._files().delete(self._path(table), True)
            return False
        self.merge()
        return True

    def _summed(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*(f"{self.folder}/{t}" for t in tables)).groupBy("first", "second").agg(F.sum("cnt").alias("cnt"))

    def merge(self, everything: bool = False) -> None:
        """Sums the tables of a level into one of the next once there are enough, from the lowest level on; or all tables into one."""
        while True:
            now, chosen = self.state(), None
            for level in sorted({n for _, n in now.tables}):
                some = [t for t, n in now.tables if n == level]
                if len(some) >= self.merge_every:
                    chosen = (some, level + 1)
                    break
            if everything and len(now.tables) > 1:
                chosen = ([t for t, _ in now.tables], max(n for _, n in now.tables) + 1)
            if chosen is None:
                return
            table = self._write(self._summed(chosen[0]))
            entry = {"op": "merge", "tables": chosen[0], "level": chosen[1], "table": table}
            if self._change(lambda now, e=entry: e if set(e["tables"]) <= {t for t, _ in now.tables} else None) is None:
                self._files().delete(self._path(table), True)  # another merge or a reset came first

    def totals(self, at: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(word, cnt) and (first, second, cnt) as of an entry, by default now."""
        rows = self._summed([t for t, _ in self.state(at).tables])
        return rows.filter("second is null").select(F.col("first").alias("word"), "cnt"), rows.filter("second is not null").select("first", "second", "cnt")

    def reset(self) -> int:
        """Forgets what was learned; batches stay known. Returns the entry's number."""
        return self._change(lambda now: {"op": "reset"})

    def rollback(self, to: int) -> int:
        """Goes back to how things were after entry `to` (0: empty). Batches added since are unknown again and may be added anew."""
        if not 0 <= to <= self.state().version:
            raise ValueError(f"the log has no entry {to}")
        return self._change(lambda now: {"op": "rollback", "to": to})

    def vacuum(self) -> int:
        """Deletes the tables that are no longer summed: what was merged, reset or rolled back. Earlier states cannot be read or gone back to
        afterwards, and a batch that is being appended right now may lose its table, so no writer may run. Returns how many went."""
        files, data = self._files(), self._path("data")
        if not files.exists(data):
            return 0
        needed = {t.split("/")[-1] for t, _ in self.state().tables}
        gone = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in needed]
        for path in gone:
            files.delete(path, True)
        return len(gone)


def learn_to_log(finished: DataFrame, words: DataFrame, user_words: DataFrame, log: LearnedLog, checkpoint: str, name: str | None = None):
    """Starts a query that adds what a stream of finished words (word, previous_word) teaches to the log. Each micro-batch is added once, however
    often it is run: batches go by `name` (by default the checkpoint, which is what a restart has in common) and number."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        learned = learn_deltas(frame.select("word", F.col("previous_word").alias("previous")), words, user_words)
        log.append(*learned, f"{name or checkpoint}#{batch_id}")

    return finished.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
