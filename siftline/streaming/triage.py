"""Scanning what arrives: the same plan over a stream, first sightings, rules that may change meanwhile."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from siftline.operators.rule_table import RULES, RuleTable
from siftline.plans.scan import Options, findings, places, scan
from siftline.sinks.report import accept_all, accepted_rules
from siftline.sources.files import decoded, is_scannable
from siftline.sources.rules import load_rules, merged, save_rules


def file_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """file, text and modified for files as they arrive; at most `per_trigger` in a batch."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return df.filter(is_scannable(F.col("path"))).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def table_stream(spark: SparkSession, path: str, schema, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_findings(docs: DataFrame, id_col: str = "file", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """Findings of a stream; no state."""
    return findings(scan(docs, id_col, text_col, options))


def first_seen(found: DataFrame, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first finding of each file, type and text. With a time column its state is bounded by the watermark."""
    keys = ["file", "entity_type", "text"]
    return found.dropDuplicates(keys) if time_col is None else found.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(found: DataFrame, time_col: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Findings by type and window of event time; late ones count until the watermark has passed."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return found.withWatermark(time_col, delay).groupBy(window, "entity_type").agg(F.count("*").alias("n"))


def triage(
    docs: DataFrame, checkpoint: str, rules_file: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None,
    accept: bool = False, id_col: str = "file", text_col: str = "text", options: Options | None = None, available_now: bool = True,
):
    """Scans each micro-batch with the rules as they stand then; a rules file that can't be read leaves the rules before.

    on_batch gets the outcomes and the batch's number. With accept, findings become rules, and so silence later ones.
    """
    state = {"rules": (options or Options()).rules}

    def each(batch: DataFrame, number: int) -> None:
        if rules_file:
            try:
                state["rules"] = load_rules(rules_file)
            except Exception as e:
                warnings.warn(f"{rules_file}: {e}; the rules before stay", stacklevel=1)
        now = replace(options or Options(), rules=state["rules"])
        outcomes = scan(batch, id_col, text_col, now)
        if accept and rules_file:
            new = accept_all(findings(outcomes))
            state["rules"] = merged(state["rules"], new)
            save_rules(state["rules"], rules_file)
        if on_batch:
            on_batch(outcomes, number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sightings(StatefulProcessor):
    """The last time that a key was seen; forgotten by a timer once it lies `keep` milliseconds back."""

    def __init__(self, keep: int, keys: tuple[str, ...], time_col: str):
        self.keep, self.keys, self.time_col = keep, keys, time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = sorted(_ms(r[self.time_col]) for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        for ms in at:
            if before is None or ms - before > self.keep:
                seen = datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
                yield Row(**dict(zip(self.keys, key, strict=True)), **{self.time_col: seen})
            before = ms if before is None else max(before, ms)
        self.last.update((before,))
        self.handle.registerTimer(before + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[0] + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ms(t: datetime) -> int:
    return round((t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t).timestamp() * 1000)


def first_in_a_while(found: DataFrame, time_col: str, keep_seconds: int, delay: str = "1 hour", keys: tuple[str, ...] = ("file", "entity_type", "text")) -> DataFrame:
    """keys and the time (to milliseconds) of each sighting that follows none of the same keys for `keep_seconds`.

    State is one number for each key seen in that time, in the RocksDB store (set its provider, as ROCKSDB names it):
    a timer of event time forgets it, so state doesn't grow with the stream, and a restart goes on from the checkpoint. Rows
    behind the watermark are dropped, and counted in the query's progress. A session in UTC; null times count as none.
    """
    kinds = dict(found.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{time_col}` timestamp"
    rows = found.filter(F.col(time_col).isNotNull()).select(*keys, F.col(time_col).cast("timestamp").alias(time_col)).withWatermark(time_col, delay)
    return rows.groupBy(*keys).transformWithState(_Sightings(keep_seconds * 1000, keys, time_col), schema, "append", "EventTime")


def sessions(found: DataFrame, time_col: str, gap: str, keys: tuple[str, ...] = ("file", "entity_type"), delay: str = "10 minutes") -> DataFrame:
    """keys, started, ended (the last sighting and the gap) and n: sightings that lie within `gap` of each other.

    The same for a table and a stream; in a stream, a session comes out once the watermark has passed its end.
    """
    rows = found.withWatermark(time_col, delay) if found.isStreaming else found
    return rows.groupBy(*keys, F.session_window(time_col, gap).alias("session")).agg(F.count("*").alias("n")).select(*keys, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n")


class StreamTotals(StreamingQueryListener):
    """Adds up, for all queries of a session, what batches tell: their metrics (see report.observed), and late rows."""

    def __init__(self):
        self.totals: dict[str, int] = {}
        self.late_rows = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for k, v in row.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)
        self.late_rows += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class RuleLog:
    """Rules as a table that batches add to: a folder for each batch's rules, so that a batch that runs again writes the same
    again. Nothing of it passes through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rules(self, before: int | None = None) -> DataFrame:
        """All rules, or those of batches before one."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], RULES)
        rows = self.spark.read.schema(f"{RULES}, batch long").parquet(self.path)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def put(self, rules: DataFrame, batch: int) -> None:
        columns = [F.col(f"`{c.split()[0].strip('`')}`") if c.split()[0].strip("`") in rules.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0].strip("`")) for c in RULES.split(", ")]
        rules.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def triage_to_log(
    docs: DataFrame, checkpoint: str, log: RuleLog, on_batch: Callable[[DataFrame, int], None] | None = None, accept: bool = False,
    id_col: str = "file", text_col: str = "text", options: Options | None = None, available_now: bool = True,
):
    """Scans each micro-batch with the rules that the log held before it; on_batch gets the findings left, and the number.

    With accept, these become rules of the log: one for each file, type and text. A batch that runs again sees the rules that
    it saw, and adds nothing new.
    """

    def each(batch: DataFrame, number: int) -> None:
        rules = RuleTable(log.rules(number))
        left = rules.suppressed(places(scan(batch, id_col, text_col, options))).filter(~F.col("suppressed")).drop("suppressed")
        if accept:
            log.put(accepted_rules(left), number)
        if on_batch:
            on_batch(left, number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
