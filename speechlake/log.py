"""Tables that change together: a log of commits over Parquet files.

A commit is one small JSON file. It names, for every table, the parts that hold its rows (a folder of Parquet files each)
and the keys that went (a folder of keys each), all with the number of the commit that brought them. Writers add folders
of unique names and then publish the next number, which only one of them can; a reader takes the newest commit. So a
change is seen whole or not at all, a folder that no commit names is no obstacle, and a change costs what it holds, not
what the table holds. A row is there if no later commit removed its key: one anti-join, merged on read.

A writer sorts the rows of each of its files by the table's order, and a part knows the range of the first of these
columns in every file, so that readers who ask for some values open only the files that can hold them. compact() merges
young parts (or all) and deals their rows into files by ranges, restore() publishes an old state as a new commit, vacuum()
deletes what no kept commit names.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files whose ranges stand in the commit itself; those of larger parts are a table beside the part.
INLINE_FILES = 64
#: Values that are looked up in ranges, and told to the scan, at most; for more a reader scans and joins.
LOOKED_UP = 1000


class Conflict(RuntimeError):
    """Another writer published this commit first. Nothing of the change is seen; it may be made again."""


@dataclass
class Change:
    """What a commit does to a table: rows come, keys go first; whole: all earlier rows go. Rows may be a function of what
    the commit has written for earlier tables, by name, so that what costs much is computed once."""

    rows: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None = None
    gone: DataFrame | None = None
    whole: bool = False
    key: str = "transcript_id"
    order: list[str] = field(default_factory=list)
    #: Files that rows go to; by default as many as they come in.
    files: int | None = None


class Files:
    """The file system of a path, as Hadoop reaches it from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that wasn't there; False if it was. It's seen with all its content or not at all."""
        tmp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(tmp), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._local:
                os.link(self._path(tmp).toUri().getPath(), self._path(path).toUri().getPath())
            else:
                kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self._jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
                options[0] = kind.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(tmp), self._path(path), options)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(tmp)
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000


class Log:
    """Commits and tables under a path."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.files = Files(spark, self.path)

    # --- commits

    def numbers(self) -> list[int]:
        """Of the commits that are still there, ascending."""
        return [int(n[:12]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[:12].isdigit()]

    def newest(self) -> int:
        return max(self.numbers(), default=0)

    def state(self, commit: int | None = None) -> dict:
        """A commit, by default the newest one; without any, no tables."""
        n = self.newest() if commit is None else commit
        if not n:
            return {"commit": 0, "action": "", "tables": {}}
        if commit is not None and n not in self.numbers():
            raise ValueError(f"no such commit: {n}")
        return json.loads(self.files.read(f"{self.path}/log/{n:012d}.json"))

    def tables(self, commit: int | None = None) -> dict[str, list[str]]:
        """Columns of every table."""
        return {name: self._schema(t).names for name, t in self.state(commit)["tables"].items()}

    @staticmethod
    def _schema(table: dict) -> T.StructType:
        return T.StructType.fromJson(table["schema"])

    def _publish(self, state: dict, action: str, tables: dict, written: list[str]) -> int:
        n = state["commit"] + 1
        text = json.dumps({"commit": n, "action": action, "time": round(time.time(), 3), "tables": tables})
        if not self.files.create(f"{self.path}/log/{n:012d}.json", text):
            for folder in written:
                self.files.delete(folder)
            raise Conflict(f"commit {n} was published by another writer")
        return n

    def _writable(self) -> None:
        if self.read_only:
            raise ValueError(f"opened for reading only: {self.path}")

    def commit(self, changes: dict[str, Change], action: str = "write", state: dict | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None) -> int:
        """Publishes the changes as one commit on top of `state` (by default the newest); raises Conflict if it isn't the newest
        any more. check sees the rows that are written and may raise: then nothing is published."""
        self._writable()
        state = state or self.state()
        tables, written, new = json.loads(json.dumps(state["tables"])), [], {}
        try:
            self._write(changes, state["commit"] + 1, tables, written, new)
            if check:
                check(new)
        except BaseException:
            for folder in written:
                self.files.delete(folder)
            raise
        return self._publish(state, action, tables, written)

    def _write(self, changes: dict[str, Change], n: int, tables: dict, written: list[str], new: dict[str, DataFrame]) -> None:
        for name, c in changes.items():
            t = tables.setdefault(name, {"key": c.key, "order": c.order or [c.key], "schema": None, "parts": [], "gone": []})
            if c.whole:
                t |= {"parts": [], "gone": [], "schema": None}
            if c.gone is not None and t["parts"]:
                at = f"{uuid.uuid4().hex}-gone"
                written.append(f"{self.path}/data/{name}/{at}")
                c.gone.select(F.col(c.gone.columns[0]).alias("key")).distinct().write.parquet(written[-1])
                t["gone"].append({"at": at, "seq": n})
            if c.rows is not None:
                rows = c.rows(new) if callable(c.rows) else c.rows
                if t["schema"]:
                    known = self._schema(t)
                    more = [f for f in rows.schema.fields if f.name not in known.names]
                    t["schema"] = T.StructType([*known.fields, *more]).jsonValue()
                    rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.fields], *[f"`{f.name}`" for f in more])
                else:
                    t["schema"] = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]).jsonValue()
                t["parts"].append(self._part(name, rows.repartition(c.files) if c.files else rows, t["order"], n, written))
                new[name] = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}/{t['parts'][-1]['at']}")

    def _part(self, name: str, rows: DataFrame, order: list[str], seq: int, written: list[str], ranged: bool = False) -> dict:
        """Writes rows as a part whose files are in the table's order, and notes the range of the first column in each of them.

        ranged: files don't overlap. That takes a look at all rows beforehand, so it's left to compaction; else rows stay
        in the partitions that they came in, without an exchange.
        """
        at = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}/{at}"
        written.append(folder)
        own = [c for c in order if c in rows.columns]
        dealt = rows.repartitionByRange(*own) if ranged and own else rows
        (dealt.sortWithinPartitions(*own) if own else dealt).write.parquet(folder)
        part = {"at": at, "seq": seq, "bytes": self.files.bytes(folder), "files": None}
        if own:
            file = F.element_at(F.split("_metadata.file_path", "/"), -1)
            key = F.col(f"`{own[0]}`").cast("string")
            ranges = self.spark.read.schema(rows.schema).parquet(folder).groupBy(file.alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
            few = ranges.limit(INLINE_FILES + 1).collect()
            if len(few) <= INLINE_FILES:
                part["files"] = sorted([r["file"], r["lo"], r["hi"]] for r in few)
            else:
                written.append(f"{folder}-ranges")
                ranges.orderBy("lo", "file").write.parquet(written[-1])
        return part

    # --- reading

    def _chosen(self, name: str, table: dict, values: list[str], prefixes: list[str]) -> list[str]:
        """Files that may hold one of the values, or one that begins with one of the prefixes."""
        spans = [(v, v) for v in values] + [(p, p + "\U0010ffff") for p in prefixes]
        out = []
        for p in table["parts"]:
            folder = f"{self.path}/data/{name}/{p['at']}"
            if p["files"] is not None:
                out += [f"{folder}/{f}" for f, lo, hi in p["files"] if lo is not None and any(lo <= b and a <= hi for a, b in spans)]
            else:
                fits = F.lit(False)
                for a, b in spans:
                    fits = fits | ((F.col("lo") <= b) & (F.col("hi") >= a))
                out += [f"{folder}/{r['file']}" for r in self.spark.read.parquet(f"{folder}-ranges").where(fits).select("file").collect()]
        return out

    def read(self, name: str, commit: int | None = None, values: list[str] | None = None, prefixes: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """The table's rows; with values or prefixes, those whose first order column (text) is one of them or begins so."""
        table = (state or self.state(commit))["tables"].get(name)
        if table is None or table["schema"] is None:
            raise ValueError(f"no such table: {name}")
        return self._merged(name, table, values, prefixes)

    def _merged(self, name: str, table: dict, values: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
        schema = self._schema(table)
        asked = values is not None or prefixes is not None
        values, prefixes = values or [], prefixes or []
        if asked and len(values) + len(prefixes) <= LOOKED_UP:
            paths = self._chosen(name, table, values, prefixes)
        else:
            paths = [f"{self.path}/data/{name}/{p['at']}" for p in table["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        if asked:
            first = F.col(f"`{table['order'][0]}`")
            fits = first.isin(values) if values else F.lit(False)
            for p in prefixes:
                fits = fits | first.startswith(p)
            df = df.where(fits)
        if not table["gone"]:
            return df
        rows = df.withColumn("__part", F.element_at(F.split("_metadata.file_path", "/"), -2))
        rows = rows.withColumn("__seq", _number(F.col("__part"), {p["at"]: p["seq"] for p in table["parts"]}))
        gone = self.spark.read.schema("key string").parquet(*[f"{self.path}/data/{name}/{g['at']}" for g in table["gone"]])
        gone = gone.select(F.col("key").alias("__key"), _number(F.element_at(F.split("_metadata.file_path", "/"), -2), {g["at"]: g["seq"] for g in table["gone"]}).alias("__gone"))
        later = (F.col(f"`{table['key']}`") == F.col("__key")) & (F.col("__seq") < F.col("__gone"))
        return rows.join(gone, later, "left_anti").select(*[f"`{c}`" for c in schema.names])

    # --- upkeep

    def compact(self, name: str, whole: bool = False) -> int:
        """Merges parts of a table into one. By default the youngest ones, up to the first that is larger than all that are
        younger together, so that a row is rewritten as often as the table doubles; whole: all, and the keys that went are
        forgotten."""
        self._writable()
        state = self.state()
        tables = json.loads(json.dumps(state["tables"]))
        t = tables.get(name)
        if t is None:
            raise ValueError(f"no such table: {name}")
        parts, cut = sorted(t["parts"], key=lambda p: p["seq"]), 0
        if not whole:
            cut, size = len(parts), 0
            while cut and (size == 0 or parts[cut - 1]["bytes"] <= size):
                size, cut = size + max(1, parts[cut - 1]["bytes"]), cut - 1
            while cut and parts[cut - 1]["seq"] == parts[cut]["seq"]:
                cut -= 1
        young, written = parts[cut:], []
        if not young or len(young) < 2 and not whole:
            return state["commit"]
        merged = self._merged(name, t | {"parts": young})
        new = self._part(name, merged, t["order"], max(p["seq"] for p in young), written, True)
        oldest = min((p["seq"] for p in parts[:cut]), default=None)
        # keys that went before all older parts came can hide nothing any more
        t |= {"parts": [*parts[:cut], new], "gone": [g for g in t["gone"] if oldest is not None and g["seq"] > oldest]}
        return self._publish(state, f"compact {name}", tables, written)

    def restore(self, commit: int) -> int:
        """The tables as they were then, as a new commit; the commits between stay."""
        self._writable()
        return self._publish(self.state(), f"restore {commit}", self.state(commit)["tables"], [])

    def vacuum(self, keep: int = 10, grace_s: float = 3600) -> list[str]:
        """Deletes commits but for the newest `keep`, and data that none of these names and nobody wrote in grace_s."""
        self._writable()
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.files.delete(f"{self.path}/log/{n:012d}.json")
        named = {(name, x["at"]) for n in numbers[-keep:] for name, t in self.state(n)["tables"].items() for x in [*t["parts"], *t["gone"]]}
        out = []
        for name in self.files.names(f"{self.path}/data"):
            for at in self.files.names(f"{self.path}/data/{name}"):
                folder = f"{self.path}/data/{name}/{at}"
                if (name, at.removesuffix("-ranges")) not in named and self.files.age(folder) >= grace_s:
                    self.files.delete(folder)
                    out.append(folder)
        for name in self.files.names(f"{self.path}/log"):
            if name.endswith(".tmp"):
                with contextlib.suppress(Py4JJavaError):  # its writer may have just removed it
                    if self.files.age(f"{self.path}/log/{name}") >= grace_s:
                        self.files.delete(f"{self.path}/log/{name}")
        return out


def _number(at: Column, of: dict[str, int]) -> Column:
    """The number of a folder."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), at)
