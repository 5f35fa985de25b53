"""A store of path versions and chunks whose cost per batch does not grow with the number of batches.

A path belongs to one of ``buckets`` by its hash.  The store is a base, one
folder per bucket, and a tail, one folder per micro-batch since the base was
made.  Reads merge the two: of a path's versions the latest by (seq, batch)
counts, and its chunks are those of the batch that version names.  After
``compact_after`` batches the tail is folded into the base: only the buckets it
touches are read and written anew, under a new name, and the switch is one new
manifest.  A manifest that is not complete does not count, so a run that stops
halfway changes nothing.  What the two last manifests do not name is deleted;
a reader that opened the one before the last is not disturbed.

A batch that is replayed rewrites its own tail folder; one that is in the base
already is left alone.  Removed paths keep a version without chunks, so an
event that arrives late cannot bring them back.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusq.operators.records import apply_changes
from corpusq.plans.nesting import salted_join

VERSION_FIELDS = "hash string, file_size bigint, op string, seq bigint, chunk_batch bigint, batch bigint"
VERSION_SCHEMA = f"doc_path string, {VERSION_FIELDS}"
CHUNK_SCHEMA = ("doc_path string, chunk_id string, section_index int, section_title string, chunk_index int, chunk_pos bigint, "
                "text string, token_count int, chunk_type string, batch bigint")
CHUNK_COLUMNS = [field.split()[0] for field in CHUNK_SCHEMA.split(", ")[:-1]]
SCHEMAS = {"versions": VERSION_SCHEMA, "chunks": CHUNK_SCHEMA}
BUCKETS, COMPACT_AFTER = 64, 8
#: Files a bucket's chunks are spread over when it is written.
WRITERS = 4


class Folders:
    """Names, marks and removal of folders on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def complete(self, folder: str) -> bool:
        return self.fs.exists(self.path(f"{folder}/_SUCCESS"))

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


def latest_versions(versions: DataFrame) -> DataFrame:
    """Last event per path, removals included.  Combines before the shuffle."""
    fields = [f.split()[0] for f in VERSION_FIELDS.split(", ")]
    return (versions.groupBy("doc_path").agg(F.max_by(F.struct(*fields), F.struct("seq", "batch")).alias("v"))
            .select("doc_path", "v.*"))


class PathStore:
    """The store under ``root``; the number of buckets is fixed by its first compaction.

    ``more`` names further columns of the chunks, as a DDL string.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, more: str = ""):
        self.spark, self.root, self.compact_after = spark, root, compact_after
        self.schemas = {**SCHEMAS, "chunks": SCHEMAS["chunks"] + (f", {more}" if more else "")}
        self.folders = Folders(spark, root)
        self.buckets, self.compacted, self.number, self.base = buckets, -1, 0, {}
        done = [n for n in self.folders.names(f"{root}/manifest") if self.folders.complete(f"{root}/manifest/{n}")]
        if done:
            self.number, self.buckets, self.compacted, self.base = self._manifest(done[-1])

    def _manifest(self, name: str):
        rows = self.spark.read.schema("kind string, bucket int, version bigint").json(f"{self.root}/manifest/{name}").collect()
        meta = next(r for r in rows if r["kind"] == "meta")
        base = {(r["kind"], r["bucket"]): r["version"] for r in rows if r["kind"] != "meta"}
        return int(name), meta["bucket"], meta["version"], base

    def bucket(self, path: str = "doc_path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def touched(self, paths: DataFrame) -> list[int]:
        """Buckets of these paths; at most ``buckets`` numbers."""
        return sorted(r[0] for r in paths.select(self.bucket()).distinct().collect())

    def tail(self) -> list[int]:
        """Complete batches that are not in the base."""
        found = [int(n.split("=")[1]) for n in self.folders.names(f"{self.root}/tail/versions") if "=" in n]
        return sorted(b for b in found if b > self.compacted and self.folders.complete(f"{self.root}/tail/versions/batch={b}"))

    def read(self, kind: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of base and tail, of some buckets only and of batches below ``before`` only."""
        base = [f"{self.root}/base/{kind}/v={v}/bucket={b}" for (k, b), v in sorted(self.base.items())
                if k == kind and (buckets is None or b in buckets)]
        tail = [f"{self.root}/tail/{kind}/batch={b}" for b in self.tail() if before is None or b < before]
        if not base and not tail:
            return self.spark.createDataFrame([], self.schemas[kind])
        rows = self.spark.read.schema(self.schemas[kind]).parquet(*base, *tail)
        return rows if buckets is None or not tail else rows.filter(self.bucket().isin(buckets))

    def versions(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        return latest_versions(self.read("versions", buckets, before))

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        """Chunks of the latest version of every living path."""
        live = (self.versions(buckets).filter("op <> 'remove'").select("doc_path", F.col("chunk_batch").alias("batch")))
        return self.read("chunks", buckets).join(live, ["doc_path", "batch"], "left_semi").drop("batch")

    def chunks_of(self, paths: list[str]) -> DataFrame:
        """Chunks of some paths; only their buckets are read."""
        wanted = self.spark.createDataFrame([(p,) for p in paths], "doc_path string")
        return self.chunks(self.touched(wanted)).filter(F.col("doc_path").isin(paths))

    def append(self, batch: int, versions: DataFrame, chunks: DataFrame) -> None:
        """Write a batch; it counts when its versions, which are written last, are complete."""
        for kind, rows in (("chunks", chunks), ("versions", versions)):
            rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/tail/{kind}/batch={batch}")
        if len(self.tail()) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Fold the tail into the buckets it touches and switch to a new manifest."""
        tail, version = self.tail(), self.number + 1
        if not tail:
            return
        touched = self.touched(self.spark.read.schema(VERSION_SCHEMA).parquet(*[f"{self.root}/tail/versions/batch={b}" for b in tail]))
        spread = F.pmod(F.xxhash64("doc_path", "batch"), F.lit(WRITERS))
        merged = {"versions": self.versions(touched).select(*[f.split()[0] for f in VERSION_SCHEMA.split(", ")]),
                  "chunks": self.read("chunks", touched).join(self.versions(touched).filter("op <> 'remove'").select(
                      "doc_path", F.col("chunk_batch").alias("batch")), ["doc_path", "batch"], "left_semi")}
        base = {k: v for k, v in self.base.items() if k[1] not in touched}
        for kind, rows in merged.items():
            folder = f"{self.root}/base/{kind}/v={version}"
            (rows.withColumn("bucket", self.bucket()).repartition("bucket", spread).write.mode("overwrite")
             .partitionBy("bucket").parquet(folder))
            base.update({(kind, int(n.split("=")[1])): version for n in self.folders.names(folder) if n.startswith("bucket=")})
        rows = [("meta", self.buckets, tail[-1]), *[(k, b, v) for (k, b), v in base.items()]]
        self.spark.createDataFrame(rows, "kind string, bucket int, version bigint").coalesce(1).write.mode("overwrite").json(
            f"{self.root}/manifest/{version:09d}")
        before = (self.base, self.compacted, self.number)
        self.number, self.compacted, self.base = version, tail[-1], base
        self._drop(*before)

    def _drop(self, base: dict, compacted: int, number: int) -> None:
        """Delete what neither this manifest nor the one before names."""
        root, folders = self.root, self.folders
        for kind in SCHEMAS:
            named = {(b, v) for (k, b), v in [*base.items(), *self.base.items()] if k == kind}
            for folder in folders.names(f"{root}/base/{kind}"):
                held = [n for n in folders.names(f"{root}/base/{kind}/{folder}") if n.startswith("bucket=")]
                dead = [n for n in held if (int(n.split("=")[1]), int(folder.split("=")[1])) not in named]
                for n in [folder] if len(dead) == len(held) else [f"{folder}/{n}" for n in dead]:
                    folders.remove(f"{root}/base/{kind}/{n}")
            for folder in folders.names(f"{root}/tail/{kind}"):
                if "=" in folder and int(folder.split("=")[1]) <= compacted:
                    folders.remove(f"{root}/tail/{kind}/{folder}")
        for name in folders.names(f"{root}/manifest"):
            if int(name) < number:
                folders.remove(f"{root}/manifest/{name}")


class RecordStore:
    """Records kept by a change log: a snapshot of the state and the batches of changes since.

    After ``compact_after`` batches all but the newest ``keep`` are folded into
    the next snapshot.  A key's row in a snapshot, deleted or not, names the last
    seq folded into it; a change that arrives with a lower one, more than ``keep`` batches late,
    is ignored, any other has the effect it would have had in time.  A snapshot counts when it is complete.
    """

    def __init__(self, spark: SparkSession, root: str, base: DataFrame, key: str, payload: list[str],
                 compact_after: int = COMPACT_AFTER, keep: int = 2):
        self.spark, self.root, self.base, self.key, self.payload = spark, root, base, key, payload
        self.compact_after, self.keep, self.folders = compact_after, keep, Folders(spark, root)
        done = [n for n in self.folders.names(f"{root}/state") if self.folders.complete(f"{root}/state/{n}")]
        self.compacted = max((int(n.split("=")[1]) for n in done), default=-1)

    def state(self) -> DataFrame:
        """(key, payload, touched_seq, folded_seq, alive) as of the last snapshot."""
        if self.compacted < 0:
            none = F.lit(None).cast("bigint")
            return self.base.select(self.key, *self.payload, none.alias("touched_seq"), none.alias("folded_seq"), F.lit(True).alias("alive"))
        return self.spark.read.parquet(f"{self.root}/state/upto={self.compacted}")

    def tail(self) -> list[int]:
        found = [int(n.split("=")[1]) for n in self.folders.names(f"{self.root}/log") if "=" in n]
        return sorted(b for b in found if b > self.compacted and self.folders.complete(f"{self.root}/log/batch={b}"))

    def append(self, batch: int, changes: DataFrame) -> None:
        """Write a batch of (key, seq, op, payload); a batch that is replayed is rewritten or, once folded, left alone."""
        if batch <= self.compacted:
            return
        changes.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")
        tail = self.tail()
        if len(tail) >= self.compact_after + self.keep:
            self.compact(tail[:len(tail) - self.keep])

    def _replayed(self, batches: list[int]) -> tuple[DataFrame, DataFrame]:
        """(the living rows after these batches, the last seq of each key they change)."""
        state = self.state()
        log = self.spark.read.parquet(*[f"{self.root}/log/batch={b}" for b in batches])
        folded = state.filter("folded_seq is not null").select(self.key, F.col("folded_seq").alias("_folded"))
        fresh = salted_join(log, folded, [self.key], "seq").filter("_folded is null or seq > _folded").drop("_folded")
        now = apply_changes(state.filter("alive").select(self.key, *self.payload), fresh, self.key, self.payload)
        return now, fresh.groupBy(self.key).agg(F.max("seq").alias("_last"))

    def records(self) -> DataFrame:
        """(key, payload, touched_seq) now."""
        state, tail = self.state().filter("alive").select(self.key, *self.payload, "touched_seq"), self.tail()
        if not tail:
            return state
        before = state.select(self.key, F.col("touched_seq").alias("_before"))
        return (self._replayed(tail)[0].join(before, self.key, "left")
                .withColumn("touched_seq", F.coalesce("touched_seq", "_before")).drop("_before"))

    def compact(self, batches: list[int]) -> None:
        """Fold these batches, the oldest of the tail, into a new snapshot; then drop what is older than the one before."""
        state = self.state()
        now, last = self._replayed(batches)
        before = state.select(self.key, F.col("touched_seq").alias("_before"), "folded_seq")
        rows = (now.withColumn("alive", F.lit(True)).join(before, self.key, "full_outer").join(last, self.key, "full_outer")
                .select(self.key, *self.payload, F.coalesce("touched_seq", F.when(F.col("alive"), F.col("_before"))).alias("touched_seq"),
                        F.greatest("folded_seq", "_last").alias("folded_seq"), F.coalesce("alive", F.lit(False)).alias("alive")))
        rows.write.mode("overwrite").parquet(f"{self.root}/state/upto={batches[-1]}")
        previous, self.compacted = self.compacted, batches[-1]
        for name in self.folders.names(f"{self.root}/state"):
            if int(name.split("=")[1]) < previous:
                self.folders.remove(f"{self.root}/state/{name}")
        for name in self.folders.names(f"{self.root}/log"):
            if "=" in name and int(name.split("=")[1]) <= previous:
                self.folders.remove(f"{self.root}/log/{name}")
