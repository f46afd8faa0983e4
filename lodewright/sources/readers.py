"""Readers: shards of page samples, corpora, indexes, graphs, question sets, logs, caches.

Tables are read as the writers leave them, as JSON lines in a folder, by many tasks.  ``whole`` reads the
exchange form instead: one JSON document, which is one row and one task by its nature.
"""

from __future__ import annotations

import logging
import tarfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..conf import Ingest

_SAMPLE = "key string, image binary, payload string"
_IMAGES = ("png", "jpg", "jpeg", "image")


def shard_paths(root: str, settings: Ingest) -> list[str]:
    """One path for each shard; a template that is a path or an address of its own stands for itself."""
    names = [settings.dataset_url_template.format(i=i) for i in range(settings.num_shards)]
    return [n if "://" in n or n.startswith("/") else f"{root.rstrip('/')}/{n}" for n in names]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Shard(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _ShardReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Shard]:
        found: list[str] = []
        for path in self.paths:
            files, at = _opened(path)
            if files.get_file_info(at).type == fs.FileType.Directory:
                head = path.rstrip("/")
                found += sorted(f"{head}/{f.base_name}" for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".tar"))
            else:
                found.append(path)
        return [_Shard(p, i) for i, p in enumerate(found)]

    def read(self, shard: _Shard) -> Iterator[tuple]:
        """Samples as they come: the members of one key follow each other, so one sample is held at a time."""
        files, path = _opened(shard.path)
        key, image, payload, n = None, None, None, 0
        with files.open_input_stream(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for member in tar:
                if not member.isfile():
                    continue
                name, _, ending = member.name.rpartition("/")[2].partition(".")
                name = name or f"sample_{shard.number:04d}_{n:06d}"
                if name != key:
                    if key is not None:
                        yield key, image, payload
                    key, image, payload, n = name, None, None, n + 1
                if ending.lower() == "json":
                    payload = tar.extractfile(member).read().decode("utf-8", "replace")
                elif ending.lower() in _IMAGES:
                    image = tar.extractfile(member).read()
        if key is not None:
            yield key, image, payload


class ShardSource(DataSource):
    """Tar shards of page samples, streamed member by member, one task for each shard."""

    @classmethod
    def name(cls) -> str:
        return "page_shards"

    def schema(self) -> str:
        return _SAMPLE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ShardReader(self.options["paths"].split("\n"))


def samples(spark: SparkSession, paths: list[str] | str, max_pages: int | None = None, complete: bool = True) -> DataFrame:
    """(key, image, payload) of tar shards.  The limit counts samples as they are read; those without image or JSON go after it."""
    spark.dataSource.register(ShardSource)
    rows = spark.read.format("page_shards").option("paths", paths if isinstance(paths, str) else "\n".join(paths)).load()
    if max_pages is not None:
        rows = rows.limit(max_pages)
    return rows.filter("image is not null and payload is not null") if complete else rows


def page_sizes(rows: DataFrame) -> DataFrame:
    """Adds width and height from PNG headers, without decoding pixels."""
    png = F.hex(F.substring("image", 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring("image", at, 4)), 16, 10).cast("int")
    return rows.withColumns({"width": F.when(png, number(17)), "height": F.when(png, number(21))})


def _two(spark: SparkSession, path: str, whole: bool, **shapes: str) -> list[DataFrame]:
    """Two tables: folders of JSON lines named after them, or arrays of one document."""
    if not whole:
        return [spark.read.schema(shape).json(f"{path}/{name}") for name, shape in shapes.items()]
    shape = ", ".join(f"{name} array<struct<{shape}>>" for name, shape in shapes.items())
    document = spark.read.schema(shape).option("multiLine", True).json(path)
    return [document.select(F.inline(name)) for name in shapes]


def corpus(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Regions and chunks of an exported corpus; optional keys may be missing."""
    return tuple(_two(spark, path, whole, regions=schema.REGIONS, chunks=schema.CHUNKS))


def graph(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    return tuple(_two(spark, path, whole, nodes=schema.NODES, edges=schema.EDGES))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, embedding, modality) of a vector index."""
    return spark.read.parquet(path)


def questions(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.schema(schema.QUESTIONS).option("multiLine", whole).json(path)


def retrieval_log(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(system, ...) rows of a log; the exchange form maps systems to their records."""
    if not whole:
        return spark.read.schema(f"system string, {schema.RETRIEVAL_LOG}").json(path)
    shape = f"map<string,array<struct<{schema.RETRIEVAL_LOG}>>>"
    document = spark.read.option("wholetext", True).text(path)
    opened = document.select(F.explode(F.from_json("value", shape)).alias("system", "records"))
    return opened.select("system", F.inline("records"))


def images(spark: SparkSession, path: str, regions: DataFrame, files: bool = False) -> DataFrame:
    """(region_id, content) of regions whose image is there: in a table of crops, or among image files."""
    named = regions.filter("image_path is not null").select("region_id", F.regexp_extract("image_path", "([^/]+)$", 1).alias("name"))
    if files:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    else:
        found = spark.read.parquet(path).select(F.regexp_extract("image_path", "([^/]+)$", 1).alias("name"), F.col("image").alias("content"))
    return named.join(found, "name").select("region_id", "content")


def cache(spark: SparkSession, path: str, columns: str = "key string, reply string") -> DataFrame:
    """A cache table, one row for each key (the first by value); one that is missing is empty, and files of it that cannot be read are left out."""
    shape = spark.createDataFrame([], columns)
    try:
        found = spark.read.schema(shape.schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        logging.getLogger(__name__).warning("no cache at %s", path)
        return shape
    key, *rest = shape.columns
    return found.groupBy(key).agg(F.min(F.struct(*rest)).alias("v")).select(key, "v.*")
