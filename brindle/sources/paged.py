"""Boards whose pages stand in a folder: a data source that reads a page a task and refuses boards that are not whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from brindle.session import shared_dir, written_files

SCHEMA = "company string, page int, body string, announced long, missing int"


#: Tasks that a folder is read by at most; below that a page is a task.
MOST_TASKS = 500


@dataclass
class _Pages(InputPartition):
    """Pages with their files, and the runs (first, last) of pages that each of their boards has."""

    pages: list[tuple[str, int, list[str]]]
    runs: dict[str, list[tuple[int, int]]]

    def __post_init__(self):
        self.value = self.pages[0][:2]


def _runs(pages: list[int]) -> list[tuple[int, int]]:
    """Rising page numbers as runs (first, last)."""
    out: list[tuple[int, int]] = []
    for n in pages:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.size, self.total = int(options.get("page_size", "20")), options.get("total", "total")
        self.strict = options.get("incomplete", "refuse") == "fail"

    def partitions(self) -> list[_Pages]:
        """A partition for each page, or for as many as make MOST_TASKS, from names alone: nothing is read here."""
        fs, root = pa.fs.FileSystem.from_uri(self.folder)
        boards: dict[str, dict[int, list[str]]] = {}
        for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in f.path.removeprefix(root).split("/") if "=" in p)
            if f.is_file and not f.base_name.startswith(("_", ".")) and {"company", "page"} <= parts.keys():
                boards.setdefault(unquote(parts["company"]), {}).setdefault(int(parts["page"]), []).append(f.path)
        runs = {c: _runs(sorted(pages)) for c, pages in boards.items()}
        every = [(c, n, sorted(files)) for c, pages in sorted(boards.items()) for n, files in sorted(pages.items())]
        size = max(1, -(-len(every) // MOST_TASKS))
        some = [every[a : a + size] for a in range(0, len(every), size)]
        return [_Pages(pages, {c: runs[c] for c, _, _ in pages}) for pages in some]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        """The pages of boards that are whole by what the pages themselves announce; of another its first page says how many are missing."""
        fs, _ = pa.fs.FileSystem.from_uri(self.folder)
        for company, page, files in partition.pages:
            body = "".join(fs.open_input_stream(f).read().decode() for f in files).strip()
            announced = json.loads(body).get(self.total) or 0
            wanted, runs = max(1, -(-announced // self.size)), partition.runs[company]
            missing = wanted - sum(max(0, min(last, wanted - 1) - max(first, 0) + 1) for first, last in runs)
            if missing and self.strict:
                raise ValueError(f"{company}: {missing} of {wanted} pages are missing")
            if not missing:
                yield self._row(company, page, body, announced, 0)
            elif page == runs[0][0]:
                yield self._row(company, None, None, announced, missing)

    @staticmethod
    def _row(*values) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["company", "page", "body", "announced", "missing"])


class PagedBoards(DataSource):
    """spark.read.format("paged_boards").load(folder): company, page, body, announced, missing.

    Folders are named company=.../page=N and pages count from 0. Options:
    page_size (postings of a full page), total (the field of a page that
    announces all postings), incomplete ("refuse": a board without all its
    pages gives one row without a body that says how many are missing; "fail":
    the read fails). Paths are those that pyarrow's file systems read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, folder: str, page_size: int, total: str = "total", incomplete: str = "refuse") -> DataFrame:
    spark.dataSource.register(PagedBoards)
    return spark.read.format("paged_boards").option("page_size", page_size).option("total", total).option("incomplete", incomplete).load(folder)


def pages_written(pages: DataFrame, label: str) -> str:
    """pages(company, page, body) -> a folder that PagedBoards reads, a file a page, gone when its `scratch` ends."""
    rows = pages.select("company", "page", F.col("body").alias("value")).repartition("company", "page")
    return written_files(f"{shared_dir(pages.sparkSession)}/brindle/{label}-{uuid.uuid4().hex}", lambda path: rows.write.partitionBy("company", "page").text(path))
