"""Acknowledged, idempotent writes into the hot tier: rows, NDJSON, files and streams."""

from __future__ import annotations

import json
import threading
import time
import uuid
import zlib
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.types import Refused
from stratum.sources import writer
from stratum.sources.files import Files

from . import validate

REPORTED = 100
FLUSH_ROWS = 200_000


@dataclass(frozen=True)
class Ack:
    inserted: int
    errors: list[tuple[int, list[str]]]
    repeated: bool = False


class Admission:
    """Bounds on what waits: rows, bytes, and the time that it would take at the observed rate."""

    def __init__(self, rows: int = 500_000, size: int = 64 << 20, budget_ms: int = 5_000):
        self.most_rows, self.most_bytes, self.budget_ms = rows, size, budget_ms
        self.rows = self.bytes = 0
        self.rate = 0.0

    def enter(self, rows: int, size: int) -> None:
        if self.rows + rows > self.most_rows or self.bytes + size > self.most_bytes:
            raise Refused("buffer_full")
        if self.rate and (wait := (self.rows + rows) * 1000 / self.rate) > self.budget_ms:
            raise Refused("overloaded", f"{wait:.0f} ms")
        self.rows, self.bytes = self.rows + rows, self.bytes + size

    def leave(self, rows: int, size: int, seconds: float) -> None:
        self.rows, self.bytes = self.rows - rows, self.bytes - size
        self.rate = rows / max(seconds, 1e-3) if not self.rate else 0.8 * self.rate + 0.2 * rows / max(seconds, 1e-3)


@dataclass
class _Request:
    lines: list[tuple[int, str]]
    batch: str | None
    size: int
    ack: Future = field(default_factory=Future)


class Group:
    """Group commit for one table: requests that wait together are validated, written and acknowledged together.

    A flush takes all that waits (up to FLUSH_ROWS), so under load one Spark job, one file
    and one version of the log serve many requests; an idle table pays `window` seconds.
    Admission refuses what would wait too long or hold too much.
    """

    def __init__(self, ingest: Ingest, ref, admission: Admission, window: float):
        self.ingest, self.ref, self.admission, self.window = ingest, ref, admission, window
        self.waiting: list[_Request] = []
        self.lock, self.busy = threading.Lock(), False

    def submit(self, lines: list[tuple[int, str]], batch: str | None) -> Future:
        request = _Request(lines, batch, sum(len(x) for _, x in lines))
        with self.lock:
            self.admission.enter(len(lines), request.size)
            self.waiting.append(request)
            if not self.busy:
                self.busy = True
                threading.Thread(target=self._run, daemon=True).start()
        return request.ack

    def _run(self) -> None:
        time.sleep(self.window)
        while True:
            with self.lock:
                taken, rows, names = [], 0, set()
                while self.waiting and (not taken or rows + len(self.waiting[0].lines) <= FLUSH_ROWS) and self.waiting[0].batch not in names:
                    taken.append(self.waiting.pop(0))
                    rows += len(taken[-1].lines)
                    names |= {taken[-1].batch} - {None}
                if not taken:
                    self.busy = False
                    return
            began = time.monotonic()
            try:
                acks = self.ingest.together(self.ref, [(r.lines, r.batch) for r in taken])
                outcome = [(r.ack.set_result, a) for r, a in zip(taken, acks, strict=True)]
            except Exception as error:  # noqa: BLE001  each request hears of it
                outcome = [(r.ack.set_exception, error) for r in taken]
            with self.lock:
                self.admission.leave(rows, sum(r.size for r in taken), time.monotonic() - began)
            for call, value in outcome:
                call(value)


class Ingest:
    def __init__(self, warehouse, window: float = 0.02, admission=Admission):
        self.w, self.window, self.admission = warehouse, window, admission
        self.groups: dict[tuple, Group] = {}
        self.lock = threading.Lock()

    def part(self, ref, batch_id: str | None) -> int:
        """The write partition: by hash of the batch id, else in turn."""
        n = self.w.catalog.schema(ref).partitions
        self.w.turn += 1
        return (zlib.crc32(batch_id.encode()) if batch_id else self.w.turn) % n

    def commit(self, ref, rows: DataFrame, batch_id: str | None = None, outputs: int | None = None) -> bool:
        """Write typed rows as micro-segments, as many as their size asks for, and acknowledge them; false if the batch was there."""
        manifest, schema = self.w.manifest(ref), self.w.catalog.schema(ref)
        if batch_id and manifest.batch(batch_id):
            return False
        made = writer.write(rows, schema, self.w.files, f"{ref[0]}/{ref[1]}/hot", outputs=outputs)
        part = self.part(ref, batch_id)
        one = uuid.uuid4().hex
        if manifest.add([{**s, "part": part, "commit": one} for s in made], [batch_id] if batch_id else []) or not made:
            return True
        for s in made:  # another writer acknowledged the batch first
            self.w.files.delete(s["key"])
        return False

    def lines(self, ref, lines: DataFrame, batch_id: str | None = None, outputs: int | None = None, rejects: bool = False) -> Ack:
        """Validate (index, line) rows, keep the valid ones, report the others; with rejects these go to the table's table of rejects, all of them."""
        if batch_id and self.w.manifest(ref).batch(batch_id):
            return Ack(0, [], True)
        kept = self.w.scratch(validate.checked(lines, self.w.catalog.schema(ref), "line"))
        try:
            good = kept.where(F.size("errors") == 0).drop("index", "errors", validate.LINE)
            bad = kept.where(F.size("errors") > 0).select("index", "errors", validate.LINE)
            n = good.count()
            found = [(r["index"], list(r["errors"])) for r in bad.orderBy("index").limit(REPORTED).collect()]
            if rejects and found:
                rows = bad.select(F.lit(batch_id).alias("batch"), F.col("index").alias("line_number"), F.col(validate.LINE).alias("line"), F.array_join("errors", "; ").alias("errors"))
                self.commit(self.rejects(ref), rows, batch_id and f"{batch_id}:rejects")
            fresh = self.commit(ref, good, batch_id, outputs)
        finally:
            self.w.drop_scratch(kept)
        return Ack(n if fresh else 0, found, not fresh)

    def rejects(self, ref):
        """The table of a table's rejected lines."""
        return self.w.create((ref[0], f"{ref[1][:54]}_rejects"), ("batch", "STRING"), ("line_number", "INT64"), ("line", "STRING"), ("errors", "STRING"))

    def together(self, ref, requests: list[tuple[list[tuple[int, str]], str | None]]) -> list[Ack]:
        """Several requests by one write and one version of the log; each has its own rows, errors and batch."""
        manifest, schema, part = self.w.manifest(ref), self.w.catalog.cached(ref), self.part(ref, None)
        acks: list[Ack | None] = [Ack(0, [], True) if b and manifest.batch(b) else None for _, b in requests]
        rows = [(i, index, line) for i, (lines, _) in enumerate(requests) if acks[i] is None for index, line in lines]
        counts, errors, made = dict.fromkeys(range(len(requests)), 0), {i: [] for i in range(len(requests))}, []
        if rows:
            kept = self.w.scratch(validate.checked(self.w.spark.createDataFrame(rows, "__request int, index long, line string"), schema, "__request"))
            try:
                of, good = F.col(validate.LINE), F.size("errors") == 0
                counts |= {r["request"]: r["n"] for r in kept.where(good).groupBy(of.alias("request")).agg(F.count("*").alias("n")).collect()}
                nth = F.row_number().over(Window.partitionBy(of).orderBy("index"))
                for r in kept.where(~good).select(of.alias("request"), "index", "errors", nth.alias("nth")).where(F.col("nth") <= REPORTED).orderBy("request", "index").collect():
                    errors[r["request"]].append((r["index"], list(r["errors"])))
                made = writer.write(kept.where(good).drop("index", "errors", validate.LINE), schema, self.w.files, f"{ref[0]}/{ref[1]}/hot") if sum(counts.values()) else []
            finally:
                self.w.drop_scratch(kept)
        batches = [b for i, (_, b) in enumerate(requests) if b and acks[i] is None]
        if (made or batches) and not manifest.add([{**s, "part": part} for s in made], batches):
            for s in made:  # another writer acknowledged one of the batches first: one by one, then
                self.w.files.delete(s["key"])
            return [a or self.together(ref, [r])[0] for a, r in zip(acks, requests, strict=True)] if len(requests) > 1 else [Ack(0, [], True)]
        return [a or Ack(counts[i], errors[i]) for i, a in enumerate(acks)]

    def submit(self, ref, body: str, batch_id: str | None = None) -> Future:
        """One request body, acknowledged together with others that wait; blank lines are skipped and keep their index."""
        self.w.catalog.cached(ref)
        with self.lock:
            if ref not in self.groups:
                self.groups[ref] = Group(self, ref, self.admission(), self.window)
            group = self.groups[ref]
        return group.submit([(i, line) for i, line in enumerate(body.split("\n")) if line.strip()], batch_id)

    def insert(self, ref, rows: list, batch_id: str | None = None) -> Ack:
        return self.ndjson(ref, "\n".join(json.dumps(r) for r in rows), batch_id)

    def ndjson(self, ref, body: str, batch_id: str | None = None) -> Ack:
        return self.submit(ref, body, batch_id).result()

    def load(self, ref, path: str, format: str = "ndjson", batch_id: str | None = None, outputs: int | None = None) -> Ack:
        """Load a file or folder: ndjson, csv (with a header, typed by the table) or parquet; into as many segments as its size asks for."""
        spark, schema = self.w.spark, self.w.catalog.schema(ref)
        outputs = outputs or self.w.maintenance.outputs_for(self.w.files.size(path))
        if format == "ndjson":
            return self.lines(ref, validate.numbered(spark.read.text(path)), batch_id, outputs)
        if format == "csv":
            names = spark.read.csv(path, header=True).columns
            if extra := set(names) - set(schema.names):
                raise Refused("undeclared_columns", ", ".join(sorted(extra)))
            fields = {f.name: f for f in schema.struct}
            rows = spark.read.schema(schema.struct.__class__([fields[n] for n in names])).csv(path, header=True, mode="FAILFAST")
        elif format == "parquet":
            rows = spark.read.parquet(path)
        else:
            raise Refused("unknown_format", format)
        rows = self.w.scratch(rows.select(schema.projection(rows.columns)))
        try:
            required = [f.name for f in schema.fields if not f.nullable]
            if required and not rows.where(" OR ".join(f"`{c}` IS NULL" for c in required)).isEmpty():
                raise Refused("required_column_is_null", ", ".join(required))
            n = rows.count()
            fresh = self.commit(ref, rows, batch_id, outputs)
        finally:
            self.w.drop_scratch(rows)
        return Ack(n if fresh else 0, [], not fresh)

    def stream(self, ref, folder: str, checkpoint: str, name: str = "spool", once: bool = True, interval: str = "1 second", **options):
        """NDJSON files that appear in a folder, as a Structured Streaming query; each micro-batch is acknowledged once.

        The batch id is the id that the checkpoint gives the stream, and the epoch: an
        epoch that is run again after a crash finds itself acknowledged, and another
        stream is another one. Rejected lines go to the table of rejects.
        options: maxFilesPerTrigger, maxBytesPerTrigger.
        """
        source = self.w.spark.readStream.format("text").options(**options).load(folder)
        marks = Files(self.w.spark, checkpoint)

        def epoch(df: DataFrame, number: int) -> None:
            stream = json.loads(marks.read("metadata"))["id"]
            self.lines(ref, validate.numbered(df), f"{name}:{stream}:{number}", rejects=True)

        sink = source.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
        return (sink.trigger(availableNow=True) if once else sink.trigger(processingTime=interval)).start()
