"""STM-01: the incremental run over the list pages of schools, as a stream with a budget.

The source reads folders ``<path>/school=<s>/page=<n>/`` of JSON lines (key, title, digest). Its offset is how many pages of each school have been
taken; each batch takes at most ``budget`` more of each. The end of a planned batch is kept in ``progress`` before the batch runs, so a run that
begins anew goes on where the last one was, and a batch that was planned and not finished is run again with the same pages.

Every entry is told apart as new, same or changed against what is known of its key. That state has a time to live: it holds the keys of the
last ``ttl``, not all that ever were.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ENTRY = "school string, page int, position int, key string, title string, digest string"
SEEN = "school string, page int, position int, key string, title string, digest string, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pages_there(path: str) -> dict[str, list[int]]:
    """The numbers of each school's pages, in order."""
    store, root = _at(path)
    found: dict[str, list[int]] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        school, _, page = info.path.removeprefix(f"{root}/").partition("/page=")
        if info.type == fs.FileType.Directory and school.startswith("school=") and page.isdigit():
            found.setdefault(school.removeprefix("school="), []).append(int(page))
    return {s: sorted(p) for s, p in sorted(found.items())}


class Page(InputPartition):
    def __init__(self, school: str, page: int):
        self.school, self.page = school, page


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.progress, self.budget = options["path"], options["progress"], int(options.get("budget", 20))

    def initialOffset(self) -> dict:
        return {}

    def _taken(self) -> dict:
        store, path = _at(self.progress)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        taken = self._taken()
        return {s: min(len(p), taken.get(s, 0) + self.budget) for s, p in pages_there(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        store, path = _at(self.progress)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}.next") as f:
            f.write(json.dumps(end).encode())
        store.move(f"{path}.next", path)
        there = pages_there(self.path)
        return [Page(s, page) for s, n in end.items() for page in there[s][start.get(s, 0) : n]]

    def read(self, partition: Page) -> Iterator[tuple]:
        store, root = _at(self.path)
        folder, position = f"{root}/school={partition.school}/page={partition.page}", 0
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            if info.base_name[0] in "._":
                continue
            with store.open_input_stream(info.path) as f:
                for line in f.read().decode().splitlines():
                    if line.strip():
                        entry = json.loads(line)
                        yield partition.school, partition.page, position, entry.get("key"), entry.get("title"), entry.get("digest")
                        position += 1


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)


class Known(StatefulProcessor):
    """Of one school's key: each entry against the digest before it."""

    def __init__(self, ttl: timedelta | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string", int(self.ttl.total_seconds() * 1000) if self.ttl else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entries = pd.concat(list(rows)).sort_values(["page", "position"])
        known = self.last.get()[0] if self.last.exists() else None
        status = []
        for digest in entries["digest"]:
            status.append("new" if known is None else "same" if digest == known else "changed")
            known = digest
        self.last.update((known,))
        yield entries.assign(status=status)[[c.split()[0] for c in SEEN.split(", ")]]

    def close(self) -> None:
        pass


def entries(spark: SparkSession, path: str, progress: str, budget: int) -> DataFrame:
    spark.dataSource.register(Listing)
    return spark.readStream.format("listing").option("path", path).option("progress", progress).option("budget", budget).load()


def run(spark: SparkSession, path: str, target: str, state: str, budget: int = 20, ttl: timedelta | None = timedelta(days=400)) -> dict:
    """One run: at most ``budget`` pages of each school, its entries with their status appended to ``target``. ``state`` holds the run's progress; what
    happened is returned. Entries without a key are left out."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # for this query alone
    try:
        query = _started(spark, path, target, state, budget, ttl)
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return {"batches": len(query.recentProgress), "rows": sum(p.numInputRows for p in query.recentProgress)}


def _started(spark: SparkSession, path: str, target: str, state: str, budget: int, ttl: timedelta | None) -> StreamingQuery:
    stream = entries(spark, path, f"{state}/progress/taken.json", budget).where("key IS NOT NULL")
    told = stream.groupBy("school", "key").transformWithStateInPandas(Known(ttl), outputStructType=SEEN, outputMode="append", timeMode="processingTime" if ttl else "none")
    return told.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def dry_run(spark: SparkSession, path: str, state: str, budget: int = 20) -> DataFrame:
    """What the next run would take, (school, page): nothing is read of the pages, and nothing written."""
    reader = ListingReader({"path": path, "progress": f"{state}/progress/taken.json", "budget": budget})
    taken, end, there = reader._taken(), reader.latestOffset(), pages_there(path)
    return spark.createDataFrame([(s, p) for s, n in end.items() for p in there[s][taken.get(s, 0) : n]], "school string, page int")


def listed(rows: DataFrame, path: str) -> None:
    """Writes list pages (school, page, key, title, digest) where the source finds them."""
    rows.repartition("school", "page").sortWithinPartitions("school", "page", F.col("position")).drop("position").write.mode("append").partitionBy("school", "page").json(path)
