"""Secret scan with an incremental ledger of content-addressed blobs.

Every historical version of a file is addressed by the SHA-256 of its content.
A ledger holds one row per (blob, rule, rule version) that was scanned, with
the spans found.  A run scans only the pairs the ledger lacks, and the findings
are joined back to every path and version that holds the blob.

Nulls: a null text is the empty blob.  Repeated rows and copies share one blob
and are all reported.  An empty table gives an empty result.  Other columns of
the versions are kept; columns named like a result column are replaced.
"""

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusq.llm.arrow import text_bytes
from corpusq.plans.scratch import shared_folder

LEDGER = "blob_id binary, rule string, rule_version int, spans array<struct<start: bigint, end: bigint>>"
#: Unseen blob ids that may be broadcast (32 bytes each) to skip known texts before the shuffle.
BROADCAST_IDS = 200_000


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern`` whose group has ``least`` or more characters."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    anchors: tuple  # a text without any of these (lower-cased where fold) has no match
    fold: bool = False


# Kinds, patterns and least lengths of the scan.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, ()),
)

HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def _scanner(rule: Rule):
    """Function from whole UTF-8 bytes to byte spans.  The patterns name ASCII only, so bytes and characters agree."""
    pattern = re.compile(rule.pattern.encode())
    anchors = [a.lower().encode() if rule.fold else a.encode() for a in rule.anchors]
    run = b"\x01" * rule.least

    def scan(data: bytes, low: bytes):
        if anchors:
            if not any(a in (low if rule.fold else data) for a in anchors):
                return []
            return [m.span() for m in pattern.finditer(data) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        # a rule without anchors is a run of one character class: find long runs first
        marks, spans, at = data.translate(HEX), [], 0
        while (start := marks.find(run, at)) >= 0:
            end = marks.find(b"\x00", start)
            at = len(data) if end < 0 else end
            spans.append((start, at))
        return spans
    return scan


def _code_points(data: bytes, spans: list) -> list:
    """Byte spans as code point spans, end exclusive, in order."""
    if data.isascii():
        return [{"start": s, "end": e} for s, e in spans]
    out, at, points = [], 0, 0
    for s, e in spans:
        points += len(data[at:s].decode("utf-8", "replace"))
        out.append({"start": points, "end": points + e - s})
        points, at = points + e - s, e
    return out


def blob_id(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _current(ledger: DataFrame, rules) -> DataFrame:
    known = [(r.kind, r.version) for r in rules]
    return ledger.filter(F.array_contains(
        F.array(*[F.lit(f"{k}:{v}") for k, v in known]), F.concat_ws(":", "rule", F.col("rule_version").cast("string"))))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``versions`` that ``ledger`` lacks.

    Copies are dropped by each task before texts are shuffled, so a blob that
    holds a third of all rows reaches its task once per input task.
    """
    blobs = versions.select(blob_id(text).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [f"{r.kind}:{r.version}" for r in rules]
    todo = F.array(*[F.lit(n) for n in names])
    seen = None
    if ledger is not None:
        seen = _current(ledger, rules).groupBy("blob_id").agg(
            F.collect_set(F.concat_ws(":", "rule", F.col("rule_version").cast("string"))).alias("_seen"))
        unseen = (blobs.select("blob_id").distinct()
                  .join(seen.filter(F.size("_seen") == len(rules)), "blob_id", "left_anti"))
        if unseen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            blobs = blobs.join(F.broadcast(unseen), "blob_id", "left_semi")
    once = blobs.groupBy("blob_id").agg(F.first("_text").alias("_text"))
    if seen is not None:
        once = once.join(seen, "blob_id", "left").withColumn(
            "_todo", F.array_except(todo, F.coalesce("_seen", F.array().cast("array<string>")))).filter(F.size("_todo") > 0)
    else:
        once = once.withColumn("_todo", todo)
    rules = tuple(rules)

    def scan(batches):
        scanners = {f"{r.kind}:{r.version}": (r, _scanner(r)) for r in rules}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, kinds, versions_, spans = [], [], [], []
            for key, data, wanted in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                low = data.lower()
                for name in wanted:
                    rule, find = scanners[name]
                    ids.append(key)
                    kinds.append(rule.kind)
                    versions_.append(rule.version)
                    spans.append(_code_points(data, find(data, low)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(kinds, pa.string()), pa.array(versions_, pa.int32()), pa.array(spans, kind)],
                names=["blob_id", "rule", "rule_version", "spans"])
    return once.select("blob_id", "_text", "_todo").mapInArrow(scan, LEDGER)


def join_findings(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Every version (path) with ``spans_<kind>``: the spans the ledger holds for its blob.

    Only blobs with findings are joined; a blob with many paths is split by the
    adaptive skew join, since the ledger side has one row per blob.
    """
    found = (_current(ledger, rules).filter(F.size("spans") > 0).groupBy("blob_id")
             .agg(*[F.first(F.when(F.col("rule") == r.kind, F.col("spans")), ignorenulls=True).alias(f"spans_{r.kind}") for r in rules]))
    base = versions.drop("blob_id", *[f"spans_{r.kind}" for r in rules])
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return (base.withColumn("blob_id", blob_id(text)).join(found, "blob_id", "left")
            .withColumns({f"spans_{r.kind}": F.coalesce(f"spans_{r.kind}", empty) for r in rules}))


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text"):
    """(findings per version, ledger after the run).  The new ledger rows are written to the shared folder first."""
    spark = versions.sparkSession
    path = shared_folder(spark, "secret-ledger")
    scan_unseen(versions, ledger, rules, text).write.parquet(path)
    after = spark.read.parquet(path)
    if ledger is not None:
        after = ledger.select(*after.columns).unionByName(after)
    return join_findings(versions, after, rules, text), after


def span_text(rules=RULES) -> Column:
    """All spans as kind:start:end, by start, then kind as listed, comma-joined."""
    def named(rank, kind):
        return F.transform(f"spans_{kind}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    listed = F.concat(*[named(i, r.kind) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
