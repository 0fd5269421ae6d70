"""Recomputing when sources change (SM4 to SM6): fingerprints, a heartbeat and a pause between rewrites."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from codefacts.session import cut
from codefacts.sources.files import changed, fingerprints


def watch(files: Callable[[], DataFrame], act: Callable[[str], None], every: float = 2.0, heartbeat: float = 30.0, pause: float = 0.0, ticks: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``act("changed")`` when a fingerprint differs and ``act("heartbeat")`` after so long without one; the number of calls.

    Changes within ``pause`` seconds of the last call wait for the next tick.
    """
    before, last, calls, n = None, clock(), 0, 0
    while ticks is None or n < ticks:
        n += 1
        now = cut(fingerprints(files()))
        moved = before is None or bool(changed(now, before).limit(1).count())
        if moved and (before is None or clock() - last >= pause):
            act("changed")
            before, last, calls = now, clock(), calls + 1
        elif clock() - last >= heartbeat:
            act("heartbeat")
            last, calls = clock(), calls + 1
        if ticks is None or n < ticks:
            sleep(every)
    return calls
