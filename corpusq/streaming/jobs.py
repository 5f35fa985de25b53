"""Structured Streaming jobs.

Each micro-batch owns the folder batch=<id> of its sink and rewrites it whole
when replayed, so a lost executor or a restarted query cannot apply a batch
twice.  The current state is the latest version per key; for paths and chunks
it is kept by ``streaming/store.py``.
"""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusq.functions import fixed_values as fv
from corpusq.operators.chunks import chunk_documents, clean_documents
from corpusq.operators.maintenance import CHANGED, NEW, diff_manifest, fingerprint
from corpusq.operators.records import apply_changes
from corpusq.streaming.store import BUCKETS, CHUNK_COLUMNS, COMPACT_AFTER, PathStore, RecordStore

def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def current_chunks(spark: SparkSession, store: str, more: str = "") -> DataFrame:
    """Chunks of the latest version of every living path."""
    return PathStore(spark, store, more=more).chunks()


def ingest_batch(docs: DataFrame, batch: int, store: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER,
                 enrich: Callable[[DataFrame], DataFrame] | None = None, more: str = "", **chunking) -> None:
    """One micro-batch of (doc_path, text, op, seq); op is upsert or remove.

    Of several events of a path only the last by seq counts, also across
    micro-batches: one that arrives late is ignored.  Unchanged content keeps
    its chunks.  Only the buckets of the batch's paths are read.  ``enrich``
    adds the columns that ``more`` names to new chunks (labels, counts, vectors).
    """
    spark = docs.sparkSession
    kept = PathStore(spark, store, buckets, compact_after, more)
    if batch <= kept.compacted:  # replayed after it went into the base
        return
    last = (docs.groupBy("doc_path").agg(F.max_by(F.struct("text", "op", "seq"), "seq").alias("e")).select("doc_path", "e.*")).persist()
    try:
        _ingest(kept, last, batch, enrich or (lambda chunks: chunks), chunking)
    finally:
        last.unpersist()


def _ingest(kept: PathStore, last: DataFrame, batch: int, enrich: Callable[[DataFrame], DataFrame], chunking: dict) -> None:
    known = kept.versions(kept.touched(last), batch)
    seen = known.select("doc_path", F.col("seq").alias("_seen"), F.col("chunk_batch").alias("_held"))
    events = last.join(seen, "doc_path", "left").filter(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen")))
    arriving = events.filter("op <> 'remove'")
    status = (diff_manifest(fingerprint(arriving), known.filter("op <> 'remove'"))
              .select("doc_path", F.col("status").isin(NEW, CHANGED).alias("_fresh")))
    listed = (fingerprint(arriving).join(arriving.select("doc_path", "op", "seq", "_held"), "doc_path").join(status, "doc_path"))
    fresh = arriving.select("doc_path", "text").join(status.filter("_fresh"), "doc_path", "left_semi")
    columns = [f.split()[0] for f in kept.schemas["chunks"].split(", ") if f != "batch bigint"]
    chunks = enrich(chunk_documents(clean_documents(fresh), **chunking)).select(*columns)
    held = listed.withColumn("chunk_batch", F.when(F.col("_fresh"), F.lit(batch)).otherwise(F.col("_held"))).select(
        "doc_path", "hash", F.col("file_size").cast("bigint").alias("file_size"), "op", "seq", F.col("chunk_batch").cast("bigint").alias("chunk_batch"))
    gone = events.filter("op = 'remove'").select(
        "doc_path", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("bigint").alias("file_size"), "op", "seq",
        F.lit(None).cast("bigint").alias("chunk_batch"))
    kept.append(batch, held.unionByName(gone), chunks)


def stream_ingest(events: DataFrame, store: str, checkpoint: str, once: bool = True, **chunking):
    """Keep the chunk store in step with a stream of file events, removals included.  Options as of ``ingest_batch``."""
    def run(batch_df, batch_id):
        ingest_batch(batch_df, batch_id, store, **chunking)
    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---- markdown files ----------------------------------------------------------------------
def markdown_events(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of (doc_path, text, op, seq): every *.md below the folder, whole, again whenever it is modified.

    At most ``max_files`` files a batch, oldest first.  The source remembers
    the newest time of modification it has seen instead of every path for a week, so
    a path that is written again counts as new.  A file that appears with an
    older time than that is not seen; ``reconcile_markdown`` finds it.
    """
    files = (spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.md")
             .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).option("maxFileAge", "1ms").load(folder))
    return files.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"), F.lit("upsert").alias("op"),
                        F.unix_micros("_metadata.file_modification_time").alias("seq"))


def stream_markdown(spark: SparkSession, folder: str, store: str, checkpoint: str, max_files: int = 1000, once: bool = True, **options):
    """Keep the chunk store in step with a folder of Markdown files; files whose text did not change keep their chunks."""
    return stream_ingest(markdown_events(spark, folder, max_files), store, checkpoint, once, **options)


def reconcile_markdown(spark: SparkSession, folder: str, store: str, batch: int, **options) -> None:
    """One batch of what the stream cannot see: files with an old time that the store lacks, and paths whose file is gone.

    Files are listed with their times and compared with the store's versions;
    only the texts of missing ones are read.  ``batch`` is a number above the stream's last.
    """
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
              .select(F.col("_metadata.file_path").alias("doc_path"), F.unix_micros("modificationTime").alias("seq")))
    live = PathStore(spark, store).versions().filter("op <> 'remove'")
    gone = live.join(listed, "doc_path", "left_anti").select(
        "doc_path", F.lit(None).cast("string").alias("text"), F.lit("remove").alias("op"), (F.col("seq") + 1).alias("seq"))
    lacking = listed.join(live, "doc_path", "left_anti")
    files = (spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
             .select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"), F.lit("upsert").alias("op")))
    ingest_batch(files.join(lacking, "doc_path").unionByName(gone), batch, store, **options)


# ---- change log --------------------------------------------------------------------------
def stream_change_log(log: DataFrame, store: str, checkpoint: str, once: bool = True):
    """Append change events, one folder per micro-batch."""
    writer = log.writeStream.foreachBatch(lambda df, i: _write_batch(df, f"{store}/log", i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_records(log: DataFrame, store: str, checkpoint: str, base: DataFrame, key: str, payload: list[str], once: bool = True, **options):
    """Keep a ``RecordStore`` in step with a stream of change events (key, seq, op, payload)."""
    def run(batch_df, batch_id):
        RecordStore(batch_df.sparkSession, store, base, key, payload, **options).append(batch_id, batch_df)
    writer = log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_records(spark: SparkSession, base: DataFrame, store: str, key: str, payload: list[str]) -> DataFrame:
    return apply_changes(base, spark.read.parquet(f"{store}/log"), key, payload)


# ---- job status -----------------------------------------------------------------------------
def clamp_progress(progress: DataFrame) -> DataFrame:
    return progress.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress"))))


def job_status(progress: DataFrame, as_of=None, retention: int = fv.JOB_RETENTION_SECONDS) -> DataFrame:
    """Batch twin: latest row per job, complete jobs only for ``retention`` seconds."""
    last = clamp_progress(progress).groupBy("job_id").agg(
        F.max_by(F.struct("stage", "progress", "details", "ts"), F.struct("ts", "seq")).alias("s")).select("job_id", "s.*")
    if as_of is None:
        return last
    return last.filter((F.col("stage") != "complete") | (F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(retention))))


#: A job that never completes is forgotten after this time without a report.
JOB_IDLE_SECONDS = 24 * 3600
STATUS_SCHEMA = "job_id string, stage string, progress double, details string, ts timestamp, seq bigint"
#: Keys of a stream share so many groups: a group has a fixed cost of some milliseconds a batch, a key in it a tenth of one.
BUNDLES = 1024


def _bundled(rows: DataFrame, key: str):
    """Rows grouped by the hash of the key; the state of each key is an entry of its group's map."""
    bundle = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUNDLES)).cast("int"))
    return rows.withColumn("_bundle", bundle).groupBy("_bundle")


def _wake(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer a group, at the earliest time asked for."""
    timers = list(handle.listTimers())
    if not timers or at < min(timers):
        for timer in timers:
            handle.deleteTimer(timer)
        handle.registerTimer(at)


class JobStatus(StatefulProcessor):
    """Latest status per job; a complete job is dropped after the retention time, any other once it was idle for long.

    One timer a group: it drops the jobs that are due, at the latest a tenth of the retention time after that.
    """

    def __init__(self, retention: int = fv.JOB_RETENTION_SECONDS, idle: int = JOB_IDLE_SECONDS):
        self.retention, self.idle = retention, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "job_id string", "stage string, progress double, details string, ts timestamp, seq bigint, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            both = pdf if newest is None else pd.concat([newest, pdf])
            newest = both.sort_values(["ts", "seq"]).drop_duplicates("job_id", keep="last")
        out, now, wake = [], timerValues.getCurrentProcessingTimeInMs(), None
        for job, stage, progress, details, ts, seq in newest[["job_id", "stage", "progress", "details", "ts", "seq"]].itertuples(index=False, name=None):
            held = self.latest.getValue((job,))
            best = (stage, min(100.0, max(0.0, float(progress))), details, ts.to_pydatetime(), int(seq))
            if held is not None and (pd.Timestamp(held[3]).tz_localize(None), held[4]) > (ts.tz_localize(None), best[4]):
                best = tuple(held[:5])
            due = now + (self.retention if best[0] == "complete" else self.idle) * 1000
            self.latest.updateValue((job,), (*best, due))
            wake = due if wake is None else min(wake, due)
            out.append((job, *best))
        _wake(self.handle, wake)
        yield pd.DataFrame(out, columns=["job_id", "stage", "progress", "details", "ts", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, wake = timerValues.getCurrentProcessingTimeInMs(), None
        for job, held in list(self.latest.iterator()):
            if held[5] <= now:
                self.latest.removeKey(job)
            else:
                wake = held[5] if wake is None else min(wake, held[5])
        if wake is not None:
            self.handle.registerTimer(max(wake, now + self.retention * 100))  # the one that called is deleted by Spark
        return iter(())

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_job_status(progress: DataFrame, retention: int = fv.JOB_RETENTION_SECONDS, idle: int = JOB_IDLE_SECONDS) -> DataFrame:
    """Update-mode stream with the latest status of each job that reported."""
    use_keyed_state(progress.sparkSession)
    return _bundled(progress, "job_id").transformWithStateInPandas(
        statefulProcessor=JobStatus(retention, idle), outputStructType=STATUS_SCHEMA, outputMode="Update", timeMode="ProcessingTime")


# ---- reasoning tags ----------------------------------------------------------------------------
class ReasoningSplitter(StatefulProcessor):
    """Depth and a possible tag prefix per conversation; tags may be cut anywhere between tokens.

    A closing tag outside thinking is ignored.  The state of a conversation ends
    with its last token.  With ``idle_seconds`` the stream runs on event time (column
    ts, under a watermark): a conversation without a last token ends that long
    after its newest token, and what was held as a possible tag is given out as text.
    Text that no tag cuts is one row a batch.
    """

    def __init__(self, open_tag: str, close_tag: str, idle_seconds: int | None = None):
        self.tags, self.idle = {open_tag: 1, close_tag: -1}, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "conv_id bigint", "depth int, held string, out_seq bigint, newest bigint")
        self.cut = re.compile("(" + "|".join(re.escape(tag) for tag in sorted(self.tags)) + ")")

    def _held_length(self, text: str) -> int:
        """Length of the longest end of the text that could still become a tag."""
        return max((n for tag in self.tags for n in range(1, len(tag)) if text.endswith(tag[:n])), default=0)

    def _split(self, conv: int, before: tuple, tokens: list[str], last: list[bool]) -> tuple[list, tuple, bool]:
        """(rows, state after, whether the conversation ended) of its tokens in order."""
        depth, held, number, newest = before
        out, ends, ended = [], [i + 1 for i, x in enumerate(last) if x], any(last)
        for start, end in zip([0, *ends], [*ends, len(tokens)]):
            *parts, text = self.cut.split(held + "".join(tokens[start:end]))
            keep = 0 if end in ends else self._held_length(text)
            held = text[len(text) - keep:]
            for i, part in enumerate([*parts, text[:len(text) - keep]]):
                if i % 2:
                    depth = max(0, depth + self.tags[part])
                elif part:
                    out.append((conv, number, depth > 0, part))
                    number += 1
        return out, (depth, held, number, newest), ended

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, wake = [], None
        for conv, tokens in pd.concat(list(rows)).sort_values(["conv_id", "seq"]).groupby("conv_id", sort=False, dropna=False):
            conv = None if pd.isna(conv) else int(conv)
            found = self.state.getValue((conv,))
            parts, after, ended = self._split(conv, found or (0, "", 0, 0), tokens["token"].tolist(), tokens["is_last"].tolist())
            out += parts
            if ended:
                if found:
                    self.state.removeKey((conv,))
                continue
            if self.idle:
                after = (*after[:3], max(after[3], int(tokens["ts"].max().timestamp() * 1000)))
                wake = after[3] if wake is None else min(wake, after[3])
            self.state.updateValue((conv,), after)
        if wake is not None:
            _wake(self.handle, wake + self.idle * 1000)
        elif self.idle and not self.state.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield pd.DataFrame(out, columns=["conv_id", "out_seq", "inside", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, wake = [], None
        for conv, (depth, held, number, newest) in list(self.state.iterator()):
            if newest + self.idle * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.removeKey(conv)
                out += [(conv[0], number, depth > 0, held)] if held else []
            else:
                wake = newest if wake is None else min(wake, newest)
        if wake is not None:
            self.handle.registerTimer(wake + self.idle * 1000)  # the one that called is deleted by Spark
        yield pd.DataFrame(out, columns=["conv_id", "out_seq", "inside", "text"])

    def close(self) -> None:
        pass


def stream_split_reasoning(tokens: DataFrame, open_tag: str = "<think>", close_tag: str = "</think>",
                           idle_seconds: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """(conv_id, out_seq, inside, text) of a token stream (conv_id, seq, token, is_last).

    With ``idle_seconds`` the tokens also carry their time in ts; rows later than
    the watermark are dropped, so none can revive a conversation that has ended.
    """
    use_keyed_state(tokens.sparkSession)
    if idle_seconds:
        tokens = tokens.withWatermark("ts", lateness)
    return _bundled(tokens, "conv_id").transformWithStateInPandas(
        statefulProcessor=ReasoningSplitter(open_tag, close_tag, idle_seconds),
        outputStructType="conv_id bigint, out_seq bigint, inside boolean, text string",
        outputMode="Append", timeMode="EventTime" if idle_seconds else "None")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into Parquet, one folder per micro-batch.

    Batches without data are off meanwhile: with timers they would never end.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        query = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: _write_batch(df, path, i))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        conf.set(name, before)
