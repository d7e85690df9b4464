"""Sources and sinks beside Parquet: source trees, vector files, SCIP indexes, git logs, and versioned tables.

Vector file: records of a key length (uint32, little endian), the key in UTF-8, the number of
values (uint32) and the values (float32).
"""

from __future__ import annotations

import json
import os
import struct
import subprocess
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def source_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """file_path (from ``root``), content of all text files below ``root`` that ``ignore`` (lines of an ignore file) doesn't exclude."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace(".", "\\.") + "/", "")
    out = files.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content"))
    for pattern in ignore or []:
        if (rule := ignore_rule(pattern)) is not None:
            out = out.where(~F.col("file_path").rlike(rule))
    return out


def ignore_rule(pattern: str) -> str | None:
    """A line of an ignore file as a regular expression over paths; null for comments, blanks and negations."""
    p = pattern.strip()
    if not p or p[0] in "#!":
        return None
    anchored, folder = p.startswith("/") or "/" in p.rstrip("/")[:-1], p.endswith("/")
    body = "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else "\\" + t if t in ".+()[]{}^$|\\" else t for t in _glob(p.strip("/")))
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def _glob(p: str) -> Iterator[str]:
    i = 0
    while i < len(p):
        step = 2 if p.startswith("**", i) else 1
        yield p[i : i + step]
        i += step


# -- vector files -------------------------------------------------------------------------------

def vector_records(data: bytes) -> Iterator[tuple[str, list[float]]]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        key = data[at + 4 : at + 4 + n].decode()
        (dim,) = struct.unpack_from("<I", data, at + 4 + n)
        yield key, list(struct.unpack_from(f"<{dim}f", data, at + 8 + n))
        at += 8 + n + 4 * dim


def vector_bytes(records: Iterator[tuple[str, list[float]]]) -> bytes:
    return b"".join(struct.pack("<I", len(k := key.encode())) + k + struct.pack(f"<I{len(v)}f", len(v), *v) for key, v in records)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """key, vec of vector files; one task per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = list(vector_records(data))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.list_(pa.float32()))], ["key", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, vec array<float>")


def vectors_by_key(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """key, vec of the vectors whose key is asked for (key), in one pass over them; the last of equal keys isn't told from the others."""
    return vectors.join(keys.select("key").distinct(), "key", "left_semi")


#: Bytes after which a vector file is closed and another begun: a file is read as one row.
FILE_BYTES = 256 << 20


def write_vectors(vectors: DataFrame, folder: str) -> list[str]:
    """Writes key, vec as vector files of about FILE_BYTES into a folder that all executors share; an existing file is never touched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        f = None
        for batch in batches:
            if f is None or f.tell() > FILE_BYTES:
                if f is not None:
                    f.close()
                names.append(f"{folder}/part-{uuid.uuid4().hex}.bin")
                f = open(f"{names[-1]}.tmp", "wb")  # noqa: SIM115
            f.write(vector_bytes(zip(batch.column("key").to_pylist(), batch.column("vec").to_pylist())))
        if f is not None:
            f.close()
        for name in names:
            os.replace(f"{name}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    os.makedirs(folder, exist_ok=True)
    return [r.file for r in vectors.select("key", "vec").mapInArrow(run, "file string").collect()]


# -- SCIP ------------------------------------------------------------------------------------------

def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and varint or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
        elif kind == 2:
            n, at = _varint(data, at)
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            at += 8 if kind == 1 else 4


def scip_occurrences(data: bytes) -> Iterator[tuple[str, int, str, bool]]:
    """relative_path, start_line (from 0), symbol, is_definition of an index, protobuf or JSON."""
    if data.lstrip()[:1] == b"{":
        pick = lambda d, *names: next((d[n] for n in names if n in d), None)
        for doc in json.loads(data).get("documents", []):
            for o in doc.get("occurrences", []):
                yield pick(doc, "relative_path", "relativePath"), int(o["range"][0]), o["symbol"], bool(int(pick(o, "symbol_roles", "symbolRoles") or 0) & 1)
        return
    for number, document in _fields(data):
        if number != 2:
            continue
        path, found = "", []
        for n, v in _fields(document):
            if n == 1:
                path = v.decode()
            elif n == 2:
                line, symbol, roles = 0, "", 0
                for k, x in _fields(v):
                    if k == 1:
                        line = _varint(x, 0)[0] if isinstance(x, bytes) else x
                    elif k == 2:
                        symbol = x.decode()
                    elif k == 3:
                        roles = x
                found.append((line, symbol, roles))
        for line, symbol, roles in found:
            yield path, line, symbol, bool(roles & 1)


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, start_line, symbol, is_definition of SCIP indexes; one task per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for data in batch.column("content").to_pylist() for r in scip_occurrences(data)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.bool_()))], ["relative_path", "start_line", "symbol", "is_definition"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "relative_path string, start_line int, symbol string, is_definition boolean")


# -- git ----------------------------------------------------------------------------------------------

class GitLog(DataSource):
    """spark.read.format("gitlog").option("path", repo).option("limit", n): commit_id, ts, file of non-merge commits."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "commit_id string, ts bigint, file string"

    def reader(self, schema) -> DataSourceReader:
        return _GitLogReader(self.options)


class _GitLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        out = subprocess.run(
            ["git", "-c", "safe.directory=*", "-C", self.options["path"], "log", "--no-merges", f"--max-count={int(self.options.get('limit', '500'))}", "--relative", "--name-only", "--format=%x01%H %ct"],
            capture_output=True, text=True, check=True,
        ).stdout
        for commit in out.split("\x01")[1:]:
            head, *files = commit.splitlines()
            sha, ts = head.split()
            for f in files:
                if f:
                    yield sha, int(ts), f


# -- versioned tables -----------------------------------------------------------------------------------

class Catalog:
    """Tables of an index as Parquet versions under a root, with a manifest that names the current ones.

    Readers resolve the manifest when they plan; a table that it doesn't name is absent, and what
    depends on it is off. Replacing the manifest is one rename, in any file system that Hadoop reaches.
    """

    #: Tables over the whole program, which any change of a file makes invalid.
    WHOLE_PROGRAM = ("edges", "centrality", "taint_flows", "scip_refs", "associations")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        """File system and path of a file under the root, whichever store it is in."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        fs, path = self._at("manifest.json")
        if not fs.exists(path):
            return {"version": 0, "tables": {}, "meta": {}}
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        """Replaces the manifest: the new one is written beside it and renamed over it."""
        sc = self.spark.sparkContext
        fs, path = self._at(f"manifest.{uuid.uuid4().hex}")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(path), fs.makeQualified(self._at("manifest.json")[1]), options)

    def table(self, name: str) -> DataFrame | None:
        path = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(path) if path else None

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), meta: dict | None = None) -> int:
        """Writes new versions of ``tables``, forgets ``drop``, and swaps the manifest."""
        m = self.manifest()
        m["version"] += 1
        for name, df in tables.items():
            path = f"{self.root}/{name}/v{m['version']}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(path)
            m["tables"][name] = path
        for name in drop:
            m["tables"].pop(name, None)
        m["meta"].update(meta or {})
        self._swap(m)
        return m["version"]

    def replace_files(self, chunks: DataFrame, changed: DataFrame) -> int:
        """A new version of ``chunks`` in which the rows of changed files are ``chunks``; tables over the whole program are dropped."""
        from codeloom.operators.index import replace_files

        old = self.table("chunks")
        new = chunks if old is None else replace_files(old, chunks.select(old.columns), changed)
        return self.commit({"chunks": new}, drop=self.WHOLE_PROGRAM)
