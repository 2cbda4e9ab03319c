"""Corpora of JSON lines as a data source: spark.read.format("corpus"), a stream that goes on where it stopped, and a sink of one file a row.

A corpus is a folder of shards, .jsonl or .jsonl.gz, on any file system that Arrow reads, by its URI or a mounted path.  A shard, or what is new in it, is one
partition; of plain shards, pieces of `split` bytes.  A stream's offset is how many bytes of each shard it has read, up to a line's end, so lines that are
added to a shard are read once, and half a line waits; compressed shards are read whole when they are there.  The sink writes drafts; the commit of
the whole job puts them in place, an abort removes them.
"""

from __future__ import annotations

import gzip
import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id string, title string, text string, shard string"
SPLIT = 64 << 20


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _shards(path: str) -> dict[str, int]:
    """Names of the shards and their sizes."""
    fs, root = _fs(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=False))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith((".jsonl", ".jsonl.gz")) and f.size}


@dataclass
class Piece(InputPartition):
    """Bytes of a shard; the lines that begin in them are its own."""

    shard: str
    start: int
    end: int


def _lines(path: str, piece: Piece):
    fs, root = _fs(path)
    with fs.open_input_file(f"{root}/{piece.shard}") as f:
        if piece.shard.endswith(".gz"):
            yield from gzip.decompress(f.read()).splitlines()
            return
        at = max(0, piece.start - 1)
        f.seek(at)
        rest, done = b"", piece.start == 0
        while True:
            block = f.read(1 << 20)
            rest += block
            while (cut := rest.find(b"\n")) >= 0:
                line, rest = rest[:cut], rest[cut + 1 :]
                if done and at < piece.end:
                    yield line
                at, done = at + cut + 1, True
                if at >= piece.end:
                    return
            if not block:
                if rest and done and at < piece.end:
                    yield rest
                return


class _Rows:
    def __init__(self, options: dict):
        self.path, self.names = options["path"], [options.get(k, k) for k in ("id", "title", "text")]
        self.split = int(options.get("split", SPLIT))

    def pieces(self, shard: str, start: int, end: int) -> list[Piece]:
        if shard.endswith(".gz"):
            return [Piece(shard, 0, end)]
        return [Piece(shard, a, min(a + self.split, end)) for a in range(start, end, self.split)]

    def read(self, piece: Piece):
        for line in _lines(self.path, piece):
            if line.strip():
                row = json.loads(line)
                yield (*[None if row.get(n) is None else str(row[n]) for n in self.names], piece.shard)


class _Reader(_Rows, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return [p for shard, size in sorted(_shards(self.path).items()) for p in self.pieces(shard, 0, size)]


class _Stream(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"shards": {}}

    def latestOffset(self) -> dict:
        return {"shards": {s: self._whole(s, size) for s, size in _shards(self.path).items()}}

    def _whole(self, shard: str, size: int) -> int:
        """The place after the last line's end."""
        if shard.endswith(".gz"):
            return size
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{shard}") as f:
            while size:
                start = max(0, size - (1 << 16))
                f.seek(start)
                if (cut := f.read(size - start).rfind(b"\n")) >= 0:
                    return start + cut + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, out = start["shards"], []
        for shard, size in sorted(end["shards"].items()):
            if size > before.get(shard, 0) and not (shard.endswith(".gz") and shard in before):
                out += self.pieces(shard, before.get(shard, 0), size)
        return out


@dataclass
class _Draft(WriterCommitMessage):
    folder: str
    names: list


class _Files(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".txt")
        self.drafts = f".drafts-{uuid.uuid4().hex}"

    def write(self, rows) -> _Draft:
        fs, root = _fs(self.path)
        folder, names = f"{root}/{self.drafts}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for row in rows:
            name = "".join("_" if ch in "/\\:" else ch for ch in str(row["name"])) + self.suffix
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write((row["body"] or "").encode())
            names.append(name)
        return _Draft(folder, names)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*_fs(self.path))

    def _clear(self, fs, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.drafts}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.drafts}")


class Corpus(DataSource):
    """Options: path; id, title and text name the fields of a line; split; suffix of written files.  Rows to write have a name and a body."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)

    def writer(self, schema, overwrite: bool) -> _Files:
        return _Files(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Corpus)
