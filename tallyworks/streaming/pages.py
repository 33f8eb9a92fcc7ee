"""Incremental pull of paged feeds as a stream.

A feed is a chain of pages: each holds items and the cursor of the next page, or
none yet. The offset is, for each feed, how many pages were read and the cursor
of the last one, so a pull that is stopped goes on behind it, also when the feed
has grown meanwhile. The driver follows cursors only, once a pull; the items are
read by tasks, a page each or, of more than MOST_TASKS pages, several each.

Pages lie in ``<path>/feed=<feed>/cursor=<cursor>/`` as one file of JSON
(``{"items": [...], "next_cursor": "..."}``) each; a feed's first cursor is
``start``. A feed without a first page has no rows yet. A page that is missing or
no JSON ends its feed until it is there. The path can be of any file system that
pyarrow opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

START = "start"
#: Characters that Spark writes as % and two digits in the name of a partition's folder.
ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
#: Tasks that a batch has at most, besides one a feed: more pages are read several by a task.
MOST_TASKS = 1000
SCHEMA = "feed string, cursor string, item string"


def folder_name(value: str) -> str:
    return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)


class Page(InputPartition):
    """A page of a feed, and those behind it that the same task reads."""

    def __init__(self, feed: str, cursor: str, more: tuple[str, ...] = ()):
        super().__init__((feed, cursor, more))
        self.feed, self.cursor, self.more = feed, cursor, more


class PagedFeeds(DataSource):
    """The format ``paged_feeds``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "paged_feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(self.options["path"])


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.last: dict[str, dict] = {}
        #: The cursors that were followed for an offset so that ``partitions`` need not read the pages again.
        self.followed: dict[str, list[str]] = {}

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _page(self, feed: str, cursor: str) -> dict | None:
        """A page, or None if it is not there or not whole yet."""
        system, top = self._files()
        folder = f"{top}/feed={folder_name(feed)}/cursor={folder_name(cursor)}"
        for file in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name):
            if file.is_file and not file.base_name.startswith(("_", ".")):
                with system.open_input_stream(file.path) as stream:
                    try:
                        page = json.loads(stream.read())
                    except ValueError:
                        return None
                return page if isinstance(page, dict) else None
        return None

    def _behind(self, feed: str, cursor: str | None) -> Iterator[str]:
        """The cursors of the pages behind one, as far as they are there."""
        seen = {cursor}
        following = START if cursor is None else (self._page(feed, cursor) or {}).get("next_cursor")
        while following and following not in seen and (page := self._page(feed, following)) is not None:
            yield following
            seen.add(following)
            following = page.get("next_cursor")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, top = self._files()
        feeds = [unquote(f.base_name.removeprefix("feed=")) for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith("feed=")]
        for feed in sorted(feeds):
            read = self.last.get(feed, {"pages": 0, "cursor": None})
            chain = self.followed.setdefault(feed, [])
            for cursor in self._behind(feed, read["cursor"]):
                read = {"pages": read["pages"] + 1, "cursor": cursor}
                chain.append(cursor)
            if read["pages"]:
                self.last[feed] = read
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        asked = {}
        for feed, upto in end.items():
            read = start.get(feed, {"pages": 0, "cursor": None})
            chain = self.followed.get(feed, [])  # from the first page on
            if len(chain) >= upto["pages"] and chain[upto["pages"] - 1] == upto["cursor"] and (not read["pages"] or chain[read["pages"] - 1] == read["cursor"]):
                asked[feed] = chain[read["pages"] : upto["pages"]]
            else:
                behind = self._behind(feed, read["cursor"])
                asked[feed] = [cursor for _, cursor in zip(range(upto["pages"] - read["pages"]), behind, strict=False)]
        size = -(-sum(map(len, asked.values())) // MOST_TASKS) or 1
        return [Page(feed, chain[i], tuple(chain[i + 1 : i + size])) for feed, chain in asked.items() for i in range(0, len(chain), size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for cursor in (partition.cursor, *partition.more):
            page = self._page(partition.feed, cursor)
            if page is None:  # it was there when the batch was planned: the task is tried again
                raise ValueError(f"page {cursor} of feed {partition.feed} is gone")
            for item in page.get("items") or []:
                yield partition.feed, cursor, json.dumps(item, ensure_ascii=False)


def feed_stream(spark: SparkSession, path: str) -> DataFrame:
    """feed, cursor and item (JSON) of each item of the feeds below a path, as a stream."""
    spark.dataSource.register(PagedFeeds)
    return spark.readStream.format("paged_feeds").option("path", path).load()


def pull(stream: DataFrame, folder: str) -> DataFrame:
    """Take what there is since the last pull into ``folder``; all rows pulled so far, each once."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_pages(items: DataFrame, path: str) -> None:
    """Write pages of (feed, page, item): page is a number, item a struct; the pages of a feed are chained in their order."""
    pages = items.groupBy("feed", "page").agg(F.collect_list("item").alias("items"))
    chain = Window.partitionBy("feed").orderBy("page")
    cursor = F.when(F.row_number().over(chain) == 1, START).otherwise(F.concat(F.lit("p"), F.col("page").cast("string")))
    following = F.concat(F.lit("p"), F.lead("page").over(chain).cast("string"))
    text = F.to_json(F.struct("items", following.alias("next_cursor")))
    pages.select("feed", cursor.alias("cursor"), text.alias("value")).write.partitionBy("feed", "cursor").text(path)
