"""Query jobs: submitted, awaited, paged, cancelled, timed out, explained and remembered."""

from __future__ import annotations

import base64
import datetime
import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa

from stratum.functions import ids
from stratum.functions.types import Refused

PAGE, LARGEST_PAGE = 1_000, 10_000


@dataclass
class Job:
    id: str
    sql: str
    state: str = "pending"
    snapshot: int | None = None
    rows: int | None = None
    statistics: dict = field(default_factory=dict)
    explain: str | None = None
    trace: dict = field(default_factory=dict)
    error: str | None = None
    reason: str | None = None
    created: float = field(default_factory=time.time)
    seconds: float | None = None
    result: pa.Table | None = field(default=None, repr=False)
    done: threading.Event = field(default_factory=threading.Event, repr=False)


def _plain(x):
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return str(x) if isinstance(x, Decimal) else x


def _figures(plan) -> list[dict]:
    """Operators of a plan that ran, from the top, with their depth and what they counted."""
    out, todo = [], [(plan, 0)]
    while todo:
        node, depth = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append((node.executedPlan(), depth))
            continue
        if kind.endswith("QueryStageExec"):
            todo.append((node.plan(), depth))
            continue
        counted, entries = {}, node.metrics().iterator()
        while entries.hasNext():
            pair = entries.next()
            if (value := pair._2().value()) > 0:
                counted[pair._1()] = value
        out.append({"operator": node.nodeName(), "depth": depth, **counted})
        todo += [(node.children().apply(i), depth + 1) for i in range(node.children().size())]
    return out


class Jobs:
    def __init__(self, warehouse, most: int = 8, max_rows: int = 10_000, ttl: float = 300):
        self.w, self.most, self.max_rows, self.ttl = warehouse, most, max_rows, ttl
        self.pool, self.jobs, self.lock = ThreadPoolExecutor(most), {}, threading.Lock()

    def submit(self, sql: str, timeout: float = 60, explain: str | None = None) -> Job:
        """Start a job; Refused beyond the number that may run at once. explain: None, "plan" or "analyze"."""
        if explain not in (None, "plan", "analyze"):
            raise Refused("invalid_argument", f"explain {explain!r}")
        with self.lock:
            self._forget()
            if sum(not j.done.is_set() for j in self.jobs.values()) >= self.most:
                raise Refused("too_many_jobs")
            job = Job(ids.generate(), sql)
            self.jobs[job.id] = job
        timer = threading.Timer(timeout, self._stop, (job, "timeout"))
        timer.daemon = True
        timer.start()
        self.pool.submit(self._run, job, explain, timer)
        return job

    def _run(self, job: Job, explain: str | None, timer: threading.Timer) -> None:
        began, context = time.monotonic(), self.w.spark.sparkContext
        try:
            context.addJobTag(job.id)
            context.setLocalProperty("spark.scheduler.pool", job.id)
            if job.state == "pending":
                job.state = "running"
            plan = self.w.planner.plan(job.sql)
            job.snapshot, job.statistics = plan.snapshot, plan.statistics
            job.trace["plan_ms"] = round((time.monotonic() - began) * 1000, 2)
            if explain:
                job.explain = plan.df._jdf.queryExecution().explainString(self.w.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            if explain != "plan" and job.state == "running":
                at = time.monotonic()
                limited = plan.df.limit(self.max_rows + 1)
                result = limited.toArrow()
                job.trace["run_ms"] = round((time.monotonic() - at) * 1000, 2)
                if explain == "analyze":
                    job.trace["operators"] = _figures(limited._jdf.queryExecution().executedPlan())
                if result.num_rows > self.max_rows:
                    raise Refused("result_too_large", f"more than {self.max_rows} rows")
                if job.state == "running":
                    job.result, job.rows = result, result.num_rows
            if job.state == "running":
                job.state = "done"
        except Exception as error:  # noqa: BLE001  a job's failure is its result
            if job.state not in ("cancelled", "timeout"):
                job.state, job.reason = "error", getattr(error, "reason", "invalid_query")
                job.error = self.w.redacted(str(error))[:2000]
        finally:
            timer.cancel()
            context.removeJobTag(job.id)
            job.seconds = time.monotonic() - began
            self.w.remember({"id": job.id, "sql": job.sql, "state": job.state, "rows": job.rows, "seconds": job.seconds, "snapshot": job.snapshot, "at": job.created})
            job.done.set()

    def _stop(self, job: Job, state: str) -> None:
        if not job.done.is_set() and job.state in ("pending", "running"):
            job.state = state
            threading.Thread(target=self._cancelled, args=(job,), daemon=True).start()

    def _cancelled(self, job: Job) -> None:
        """Cancel its Spark jobs until it is over: one may start just after the others were cancelled."""
        while not job.done.is_set():
            self.w.spark.sparkContext.cancelJobsWithTag(job.id)
            job.done.wait(0.2)

    def _forget(self) -> None:
        edge = time.time() - self.ttl
        for k in [k for k, j in self.jobs.items() if j.done.is_set() and j.created + (j.seconds or 0) < edge]:
            del self.jobs[k]

    def get(self, job_id: str) -> Job:
        with self.lock:
            self._forget()
            if job_id not in self.jobs:
                raise Refused("job_not_found", job_id)
            return self.jobs[job_id]

    def wait(self, job: Job, seconds: float | None = None) -> Job:
        job.done.wait(seconds)
        return job

    def cancel(self, job_id: str) -> Job:
        job = self.get(job_id)
        self._stop(job, "cancelled")
        return job

    def query(self, sql: str, **options) -> pa.Table:
        job = self.wait(self.submit(sql, **options))
        if job.state != "done":
            raise Refused(job.reason or job.state, job.error or "")
        return job.result

    def page(self, job_id: str, token: str | None = None, size: int = PAGE) -> dict:
        """Rows of a finished job as JSON values, and the token of the next page."""
        job, at = self.get(job_id), 0
        if not 0 < size <= LARGEST_PAGE:
            raise Refused("invalid_argument", f"page size {size}")
        if job.state != "done":
            raise Refused("not_done", job.state)
        if token:
            try:
                owner, at = json.loads(base64.urlsafe_b64decode(token))
            except ValueError:
                raise Refused("invalid_page_token") from None
            if owner != job_id:
                raise Refused("invalid_page_token")
        rows = [{k: _plain(v) for k, v in r.items()} for r in job.result.slice(at, size).to_pylist()]
        after = at + len(rows)
        return {"rows": rows, "total": job.rows, "next": base64.urlsafe_b64encode(json.dumps([job_id, after]).encode()).decode() if after < job.rows else None}
