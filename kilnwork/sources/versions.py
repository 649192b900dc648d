"""Versioned snapshots of a table: data in folders of their own, a manifest for each version, readers pinned to one."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"
#: The part of rows without a value to part them by.
NO_PART = "__HIVE_DEFAULT_PARTITION__"
#: Folders that a part may have before an append merges them.
MAX_FOLDERS = 16


class Conflict(RuntimeError):
    """Another writer took the version first."""


@dataclass
class Version:
    """What a manifest says: the folders of each part, and the last batch of each stream that is in it."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Snapshots:
    """A table at ``path``, in parts such as days, that writers change by committing one version after another.

    ``part`` is an expression over the rows whose text names their part. A
    version's manifest is written beside its data and then renamed to the next
    number, which only one writer can do; the loser reads the new version and
    does its change again. Readers read the folders of one manifest, so no
    change shows before its commit, and one that fails leaves folders that no
    version names. The driver handles names of parts and folders, never rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, part: Column):
        self.spark, self.path, self.schema, self.part = spark, path.rstrip("/"), schema, part
        context = spark.sparkContext
        self.jvm, self.conf = context._jvm, context._jsc.hadoopConfiguration()
        self.gateway = context._gateway

    def _place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._place("").getFileSystem(self.conf)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [s.getPath().getName() for s in self._files().listStatus(place)] if self._files().exists(place) else []

    def _read_text(self, name: str) -> str:
        stream = self._files().open(self._place(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        stream = self._files().create(self._place(name), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def latest(self) -> Version:
        """The last version; number 0, without rows, before the first commit."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        found = json.loads(self._read_text(f"versions/{number:012d}.json"))
        return Version(number, found["parts"], found["batches"])

    def read(self, at: Version | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """Rows of a version, by default the last, and of some parts only if these are named."""
        at = self.latest() if at is None else at
        chosen = at.parts if parts is None else [p for p in parts if p in at.parts]
        folders = [f"{self.path}/{f}" for p in chosen for f in at.parts[p]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _commit(self, version: Version) -> None:
        """Make ``version`` the one of its number; Conflict if there is one already.

        A hard link on a mounted file system and a rename that refuses to
        overwrite elsewhere: both are done wholly or not at all, by one writer.
        """
        name, draft = f"versions/{version.number:012d}.json", f"versions/.{uuid.uuid4().hex}"
        self._files().mkdirs(self._place("versions"))
        self._write_text(draft, json.dumps({"parts": version.parts, "batches": version.batches}))
        if self._files().getScheme() == "file":
            local = lambda n: unquote(urlparse(self._files().makeQualified(self._place(n)).toString()).path)
            try:
                os.link(local(draft), local(name))
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                self._files().delete(self._place(draft), False)
            return
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._place("").toUri(), self.conf)
        kinds = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._place(draft), self._place(name), kinds)
        except Exception as e:
            self._files().delete(self._place(draft), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def _store(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows to a new folder; the folders of each part that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        parted = rows.select(*names).withColumn(PART, self.part.cast("string"))
        parted.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {unquote(n.split("=", 1)[1]): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith(PART)}

    def parts_of(self, rows: DataFrame) -> list[str]:
        """Names of the parts that rows fall into."""
        found = rows.select(F.coalesce(self.part.cast("string"), F.lit(NO_PART)).alias("part")).distinct().collect()
        return sorted(r.part for r in found)

    def _until_committed(self, attempt: Callable[[Version], Version | None], retries: int) -> Version:
        for _ in range(retries + 1):
            at = self.latest()
            new = attempt(at)
            if new is None:
                return at
            new.number = at.number + 1
            try:
                self._commit(new)
                return new
            except Conflict:
                continue
        raise Conflict(f"no version of {self.path} could be committed in {retries + 1} attempts")

    def change(self, parts: Iterable[str], to: Callable[[DataFrame], DataFrame], retries: int = 20) -> Version:
        """Replace the rows of ``parts`` by what ``to`` makes of them; other parts keep their folders.

        A writer that loses a race applies ``to`` anew where the winner changed
        one of its parts, else it keeps what it has written.
        """
        parts = list(parts)
        done: tuple[dict, dict] | None = None

        def attempt(at: Version) -> Version:
            nonlocal done
            own = {p: at.parts.get(p) for p in parts}
            if done is None or done[0] != own:
                done = own, self._store(to(self.read(at, parts)))
            outside = set(done[1]) - set(parts)
            if outside:
                raise ValueError(f"the change put rows into other parts: {sorted(outside)}")
            return Version(0, {p: f for p, f in at.parts.items() if p not in own} | done[1], dict(at.batches))

        return self._until_committed(attempt, retries)

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], retries: int = 20) -> Version:
        """``merge(old, rows)`` in the parts that ``rows`` fall into; a key must not move from one part to another."""
        return self.change(self.parts_of(rows), lambda old: merge(old, rows), retries)

    def expire(self, first: str, keep: Column, retries: int = 20) -> Version:
        """Drop the parts before ``first`` by name alone and keep the rows of part ``first`` that satisfy ``keep``; no other part is read or written."""

        def attempt(at: Version) -> Version:
            kept = {p: f for p, f in at.parts.items() if p > first or p == NO_PART}
            edge = self._store(self.read(at, [first]).filter(keep)) if first in at.parts else {}
            return Version(0, kept | edge, dict(at.batches))

        return self._until_committed(attempt, retries)

    def append_batch(self, rows: DataFrame, keys: list[str], stream: str, batch: int, retries: int = 20) -> Version:
        """Add rows of unknown keys, each once, as batch number ``batch`` of ``stream``; a batch that is in already adds nothing.

        Keys are looked up in the parts that the batch falls into, so the same
        key must have the same part. Nulls are values of a key like any other.
        Rows and batch number become visible by the same commit. A part of more
        than MAX_FOLDERS folders is merged into one.
        """
        rows = rows.dropDuplicates(keys)
        parts = self.parts_of(rows)

        def attempt(at: Version) -> Version | None:
            if at.batches.get(stream, -1) >= batch:
                return None
            held = self.read(at, parts).select(*[F.col(k).alias(f"__held_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__held_{k}")) for k in keys]
            added = self._store(rows.join(held, same, "left_anti"))
            new = dict(at.parts)
            for p, folders in added.items():
                new[p] = [*new.get(p, []), *folders]
            long = [p for p in parts if len(new.get(p, [])) > MAX_FOLDERS]
            if long:
                new |= self._store(self.read(Version(0, new), long))
            return Version(0, new, at.batches | {stream: batch})

        return self._until_committed(attempt, retries)

    def vacuum(self, keep: int = 10) -> int:
        """Delete manifests but the last ``keep`` and the folders that none of these names; returns how many folders went.

        For a time without writers: folders of a change that is not committed yet go, too.
        """
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith("."))
        named = {f for n in numbers[-keep:] for folders in self.version(n).parts.values() for f in folders}
        for n in numbers[:-keep]:
            self._files().delete(self._place(f"versions/{n:012d}.json"), False)
        gone = [f"data/{d}/{p}" for d in self._names("data") for p in self._names(f"data/{d}") if p.startswith(PART) and f"data/{d}/{p}" not in named]
        for f in gone:
            self._files().delete(self._place(f), True)
        return len(gone)


def day_of(ts: str) -> Column:
    """The part of a row by the day of a time."""
    return F.date_format(F.col(ts), "yyyy-MM-dd")
