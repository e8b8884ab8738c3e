"""Digests and item counts of files of any size, read as streams by a Python data source.

One partition per file, or per group of small files; a task reads ``buffer`` bytes at a time, so memory holds a buffer
and the largest single item of a list, never a file. Paths are files or folders; those with a scheme are opened by
Arrow's file systems on the workers. ``runs.file_manifest`` reads whole files through Spark's own file systems
instead, which suits files far below 2 GB.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.session import ship_package

FORMAT = "tracewell_digests"
BUFFER = 4 << 20
GROUP_BYTES = 64 << 20
BLANK = " \t\r\n"
# Characters at the end of a piece that may be the beginning of a literal, an escape or a number's rest.
EDGE = 400


class ItemCounter:
    """Counts the items of a JSON list that arrives in pieces; ``total`` is None where the bytes are no such list."""

    def __init__(self):
        import codecs

        self.decode = codecs.getincrementaldecoder("utf-8")("strict").decode
        self.parse = json.JSONDecoder(parse_constant=self._refuse).raw_decode
        self.text, self.count, self.wants, self.broken = "", 0, "start", False
        self.tried = 0

    @staticmethod
    def _refuse(name: str):
        raise ValueError(name)

    def feed(self, data: bytes, last: bool = False) -> None:
        if self.broken:
            return
        try:
            self.text += self.decode(data, last)
        except UnicodeDecodeError:
            self.broken = True
            return
        # An item that was cut off is parsed again only when the text has doubled.
        if last or len(self.text) >= 2 * self.tried:
            self._advance(last)

    def _advance(self, last: bool) -> None:
        at, size = 0, len(self.text)
        while not self.broken:
            while at < size and self.text[at] in BLANK:
                at += 1
            if at == size:
                break
            mark = self.text[at]
            if self.wants == "start":
                self.broken, self.wants, at = mark != "[", "first", at + 1
            elif self.wants == "first" and mark == "]" or self.wants == "comma" and mark == "]":
                self.wants, at = "end", at + 1
            elif self.wants == "comma":
                self.broken, self.wants, at = mark != ",", "item", at + 1
            elif self.wants == "end":
                self.broken = True
            else:
                try:
                    _, end = self.parse(self.text, at)
                except json.JSONDecodeError as e:
                    # What was cut off fails at the end of the text, or as a string that does not end.
                    self.broken = last or not (e.msg.startswith("Unterminated string") or e.pos >= size - EDGE)
                    break
                except (ValueError, RecursionError):
                    self.broken = True
                    break
                # A number may go on in the next piece.
                if end == size or self.text[end] not in BLANK + ",]":
                    self.broken = last or size - end > EDGE
                    break
                self.count, self.wants, at = self.count + 1, "comma", end
        self.text = self.text[at:]
        self.tried = len(self.text)

    @property
    def total(self) -> int | None:
        """The number of items once everything was fed."""
        return self.count if not self.broken and self.wants == "end" else None


@dataclass
class Files(InputPartition):
    paths: list[str]


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of all files below a folder; hidden ones do not count."""
    from pyarrow import fs

    system, inner = _opened(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if found.type == fs.FileType.File:
        return [(prefix + found.path, found.size)]
    infos = system.get_file_info(fs.FileSelector(inner, recursive=True))
    own = [i for i in infos if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path[len(inner):].split("/") if p)]
    return [(prefix + i.path, i.size) for i in sorted(own, key=lambda i: i.path)]


class DigestReader(DataSourceReader):
    def __init__(self, paths: list[str], buffer: int, group: int):
        self.paths, self.buffer, self.group = paths, buffer, group

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, length in (one for path in self.paths for one in _listed(path)):
            if out[-1].paths and size + length > self.group:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += length
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, inner = _opened(path)
            digest, counter, length = hashlib.sha256(), ItemCounter(), 0
            with system.open_input_stream(inner) as stream:
                while data := stream.read(self.buffer):
                    digest.update(data)
                    counter.feed(data)
                    length += len(data)
            counter.feed(b"", True)
            yield path, length, digest.hexdigest(), counter.total


class DigestSource(DataSource):
    """Options: paths (a JSON list), buffer and group (bytes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length long, sha256 string, item_count long"

    def reader(self, schema) -> DigestReader:
        return DigestReader(
            json.loads(self.options["paths"]), int(self.options.get("buffer", BUFFER)), int(self.options.get("group", GROUP_BYTES))
        )


def streamed_manifest(spark: SparkSession, *paths: str, buffer: int = BUFFER, group: int = GROUP_BYTES) -> DataFrame:
    """One row per file: path, length, sha256, item_count (items of a file that is one JSON list) and frozen_at."""
    ship_package(spark)
    spark.dataSource.register(DigestSource)
    rows = spark.read.format(FORMAT).options(paths=json.dumps(list(paths)), buffer=buffer, group=group).load()
    return rows.withColumn("frozen_at", F.current_timestamp())
