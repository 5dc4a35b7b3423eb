"""Stages of a run, one after the other, with what became of each."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any


def run_stages(stages: Sequence[tuple[str, Callable[[dict[str, Any]], Any]]], required: Sequence[str] | None = None, clock=time.monotonic) -> list[dict[str, Any]]:
    """Run (name, function of the results so far); after a required stage fails (all are, unless named) the rest is skipped.

    Gives for each stage its status, ok, failed or skipped, its result, the error and its seconds.
    """
    results: dict[str, Any] = {}
    out, stopped = [], False
    for name, f in stages:
        if stopped:
            out.append({"stage": name, "status": "skipped", "result": None, "error": None, "seconds": 0.0})
            continue
        began, result, error = clock(), None, None
        try:
            result = results[name] = f(results)
        except Exception as e:  # a stage may fail in any way; the run tells how
            error = f"{type(e).__name__}: {e}"
            stopped = required is None or name in required
        out.append({"stage": name, "status": "failed" if error else "ok", "result": result, "error": error, "seconds": clock() - began})
    return out
