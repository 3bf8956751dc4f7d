"""Stored feeds and sitemaps as a data source: spark.read.format("feeds") and spark.readStream.format("feeds") over a folder of XML files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "feed string, pos int, url string, title string, published string"
#: Bytes of files that one task reads, about.
TASK_BYTES = 32 << 20


def entries(feed: str, file) -> list[tuple]:
    """SC4, SC5: the entries of RSS, Atom or a sitemap's urlset, in order; none of a file that isn't well-formed XML. An entry without a link has no row, as it names nothing to read."""
    rows, pos = [], 0
    try:
        for _, node in ET.iterparse(file):
            name = node.tag.rsplit("}", 1)[-1]
            if name not in ("item", "entry", "url"):
                continue
            held = {}
            for child in node:
                key = child.tag.rsplit("}", 1)[-1]
                value = (child.text or "").strip() or child.get("href", "")
                held.setdefault(key, value)
            url = held.get("loc") or held.get("link") or ""
            if url:
                rows.append((feed, pos, url, held.get("title"), held.get("pubDate") or held.get("published") or held.get("lastmod")))
            pos += 1
            node.clear()
    except ET.ParseError:
        return []
    return rows


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Folder:
    """The XML files below a path, of any store that Arrow can open (file, hdfs, s3, gs)."""

    def __init__(self, options: dict):
        self.store, self.path = pafs.FileSystem.from_uri(options["path"])

    def files(self) -> list[pafs.FileInfo]:
        found = self.store.get_file_info(pafs.FileSelector(self.path, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.extension in ("xml", "rss", "txt") and not f.base_name.startswith((".", "_"))), key=lambda f: (f.mtime_ns or 0, f.path))

    def partitions(self, files: list[pafs.FileInfo]) -> list[InputPartition]:
        out, now, size = [], [], 0
        for f in files:
            if now and size + f.size > TASK_BYTES:
                out.append(Files(now))
                now, size = [], 0
            now.append(f.path)
            size += f.size
        return [*out, Files(now)] if now else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with self.store.open_input_stream(path) as file:
                yield from entries(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], file)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        folder = _Folder(self.options)
        return folder.partitions(folder.files()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _Folder(self.options).read(partition)


class FeedStreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file seen; files arrive once they are whole."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        files = _Folder(self.options).files()
        return {"time": str(files[-1].mtime_ns), "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folder = _Folder(self.options)
        at = lambda o: (int(o["time"]), o["path"])
        return folder.partitions([f for f in folder.files() if at(start) < (f.mtime_ns, f.path) <= at(end)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _Folder(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    """Rows feed (the file's name), pos, url, title, published of the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feeds)




def stored(lines: DataFrame, path: str, name: str) -> None:
    """Write the lines (place, value) in the order of their places as one file of a feed."""
    spark = lines.sparkSession
    aside = f"{path}/_{name}"
    lines.repartition(1).sortWithinPartitions("place").select("value").write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(hadoop(aside)) if s.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop(f"{path}/{name}.xml"))
    fs.delete(hadoop(aside), True)
