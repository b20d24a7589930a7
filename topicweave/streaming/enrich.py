"""Enrichment of an article stream from captured pages, restartable at any point."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from topicweave.operators.bounded import SALTS
from topicweave.operators.curate import from_site
from topicweave.operators.extract import DESCRIPTION, enrich_from_pages

_WATCHERS: dict[str, threading.Thread] = {}

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW, SALT = "_row_json", "_salt"
# microseconds survive
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def finished_links(spark: SparkSession, out_path: str, before_batch: int | None = None) -> DataFrame | None:
    """Links already written, or None if there is no output yet. Reads only the link column of earlier batches."""
    try:
        done = spark.read.parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before_batch is not None:
        done = done.where(F.col("batch_id") < before_batch)
    return done.select("link")


class _Runs:
    """Notes beside the checkpoint: one folder per run, named by the run's first batch; ``done`` in it once it has ended."""

    def __init__(self, spark: SparkSession, checkpoint_path: str) -> None:
        self.path, self.checkpoint = spark._jvm.org.apache.hadoop.fs.Path, checkpoint_path
        self.fs = self.path(checkpoint_path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self, folder: str) -> int:
        """The largest number that names an entry of a folder, -1 if there is none."""
        at = self.path(folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((int(x) for x in names if x.isdigit()), default=-1)

    def begin(self) -> int:
        """The first batch of this run: that of the last run if it was cut off, else the next one."""
        first = self._last(f"{self.checkpoint}.runs")
        if first < 0 or self.fs.exists(self.path(f"{self.checkpoint}.runs/{first}/done")):
            first = self._last(f"{self.checkpoint}/commits") + 1
        self.fs.mkdirs(self.path(f"{self.checkpoint}.runs/{first}"))
        self.fs.delete(self.path(f"{self.checkpoint}.runs/{first}/done"), True)
        return first

    def end(self, query: StreamingQuery, first: int) -> None:
        """Wait for the end; a run that failed or was stopped within a batch stays open."""
        try:
            query.awaitTermination()
            if query.exception() is None and self._last(f"{self.checkpoint}/offsets") == self._last(f"{self.checkpoint}/commits"):
                self.fs.mkdirs(self.path(f"{self.checkpoint}.runs/{first}/done"))
        except Exception:  # the caller sees it at the query
            return


def open_rows(articles: DataFrame, run: int, link: str = "link") -> DataFrame:
    """Rows of a stream whose link no earlier run has seen. Rows without link are always open.

    The state has one number per link, the run that saw it first; a batch looks up its own links only. Other columns pass
    through Python as one JSON text, which keeps every value as it is. Rows without link are spread over several keys.
    """
    rest = [f for f in articles.schema.fields if f.name != link]
    shape = StructType([StructField(link, articles.schema[link].dataType), StructField(ROW, StringType())])
    own = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in rest]), JSON) if rest else F.lit("{}")
    packed = articles.select(link, own.alias(ROW))
    salt = F.when(F.col(link).isNull(), F.pmod(F.xxhash64(ROW), F.lit(SALTS))).otherwise(F.lit(0))

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is not None:
            if not state.exists:
                state.update((run,))
            if state.get[0] != run:
                return
        yield from (frame[[link, ROW]] for frame in frames)

    keyed = packed.withColumn(SALT, salt).groupBy(link, SALT)
    kept = keyed.applyInPandasWithState(keep, shape, "run long", "append", GroupStateTimeout.NoTimeout)
    back = F.from_json(ROW, StructType(rest), JSON)
    return kept.withColumn(ROW, back).select(*[F.col(link) if c == link else F.col(ROW)[c].alias(c) for c in articles.columns])


def stream_enrich(
    articles: DataFrame,
    pages: DataFrame,
    out_path: str,
    checkpoint_path: str,
    domain: str | None = None,
    target=DESCRIPTION,
    keyed_state: bool = False,
) -> StreamingQuery:
    """Enrich each micro-batch of ``articles`` (with a ``link`` column) and write it to its own directory.

    A link is done once an earlier run wrote it, so no state grows inside the stream: the output is the state. Which links
    are done is fixed when a run starts, so every row of a link that repeats within a run is kept, in whatever files and
    batches its rows lie, as the batch job does. A run that was cut off (an error, a stop within a batch, a lost driver)
    goes on as the same run; a batch that is retried overwrites its directory.

    With ``keyed_state`` done links are a state by link instead (RocksDB, in the checkpoint): a batch reads the state of
    its own links, whatever the length of the history, where otherwise it reads the links of all earlier runs. A
    checkpoint belongs to one of the two forms.
    """
    spark = articles.sparkSession
    if (watcher := _WATCHERS.pop(checkpoint_path, None)) is not None:
        watcher.join()
    runs = _Runs(spark, checkpoint_path)
    first = runs.begin()

    def write(batch: DataFrame, batch_id: int) -> None:
        done = finished_links(batch.sparkSession, out_path, first) if first and not keyed_state else None
        enriched = enrich_from_pages(batch, pages, done, domain, target=target)
        enriched.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    source = open_rows(from_site(articles, "link", domain) if domain else articles, first) if keyed_state else articles
    before = spark.conf.get(PROVIDER)
    if keyed_state:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            source.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    # no daemon: the note is written even if the program ends right after the stream
    _WATCHERS[checkpoint_path] = threading.Thread(target=runs.end, args=(query, first))
    _WATCHERS[checkpoint_path].start()
    return query
