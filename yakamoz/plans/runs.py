"""Runs of the pipeline in the background: one at a time, with their state, logs and history."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark import InheritableThread

from yakamoz.plans.pipeline import STEPS, Context, run
from yakamoz.runtime import write_file


class Busy(RuntimeError):
    """A run is under way."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Runner:
    """Starts, stops and lists runs. A finished run is also a file in the folder runs of the context."""

    def __init__(self, ctx: Context) -> None:
        self.ctx, self.history, self.lock = ctx, [], threading.Lock()
        self.thread: threading.Thread | None = None

    def start(self, step: str = "all", data: Any = None) -> dict:
        """Begin a run of one step or of all; Busy while another goes on, ValueError for an unknown step."""
        if step != "all" and step not in STEPS:
            raise ValueError(f"unknown steps: {step}")
        with self.lock:
            if self.history and self.history[-1]["status"] == "running":
                raise Busy(self.history[-1]["id"])
            one = {"id": uuid.uuid4().hex[:8], "step": step, "input": data, "status": "running", "started_at": _now(), "finished_at": None, "report": None, "logs": []}
            self.history.append(one)
        self.thread = InheritableThread(target=self._execute, args=(one,), daemon=True)
        self.thread.start()
        return one

    def _execute(self, one: dict) -> None:
        def log(text: str) -> None:
            one["logs"].append({"timestamp": _now(), "text": text, "run_id": one["id"]})

        def logged(name: str, step):  # noqa: ANN001, ANN202
            def call(ctx: Context, data: Any) -> dict:
                log(f"{name} begins")
                out = step(ctx, data)
                log(f"{name} ends: {json.dumps(out, ensure_ascii=False, default=str)[:500]}")
                return out

            return call

        self.ctx.spark.sparkContext.setJobGroup(one["id"], f"run {one['id']}", interruptOnCancel=True)
        try:
            steps = {n: logged(n, s) for n, s in STEPS.items()}
            one["report"] = run(self.ctx, None if one["step"] == "all" else [one["step"]], steps, one["input"])
            status = "completed"
        except Exception as e:  # the run's own end, whatever it is
            log(f"{type(e).__name__}: {str(e)[:500]}")
            status = "error"
        one["finished_at"] = _now()
        one["status"] = "stopped" if one.get("stop") and status == "error" else status
        kept = {k: v for k, v in one.items() if k != "stop"}
        write_file(self.ctx.spark, self.ctx.path(f"runs/{one['id']}.json"), json.dumps(kept, ensure_ascii=False, default=str))

    def stop(self) -> bool:
        """Cancel the jobs of the run under way; False if there is none."""
        with self.lock:
            if not self.history or self.history[-1]["status"] != "running":
                return False
            self.history[-1]["stop"] = True
        self.ctx.spark.sparkContext.cancelJobGroup(self.history[-1]["id"])
        return True

    def status(self) -> dict:
        if not self.history:
            return {"status": "idle"}
        one = self.history[-1]
        return {k: one[k] for k in ("id", "step", "status", "started_at", "finished_at")} | {"log_count": len(one["logs"])}

    def logs(self, run_id: str) -> list[dict]:
        return next((list(r["logs"]) for r in self.history if r["id"] == run_id), [])

    def runs(self) -> list[dict]:
        """Without their logs, the last first."""
        return [{k: v for k, v in r.items() if k not in ("logs", "stop")} for r in reversed(self.history)]

    def wait(self, seconds: float | None = None) -> None:
        if self.thread:
            self.thread.join(seconds)
