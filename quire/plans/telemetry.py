"""What the library reports of its work: one line of JSON for each verb and cache, to a logger.

Texts, queries and their results never appear, only their sizes."""

from __future__ import annotations

import contextlib
import json
import logging
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("quire")


@contextlib.contextmanager
def observed(event: str, **facts: object) -> Iterator[dict]:
    """Log how long the block took and whether it failed; the block may add facts to what it is given."""
    started, more = time.monotonic(), {}
    outcome = "ok"
    try:
        yield more
    except Exception as e:
        outcome = type(e).__name__
        raise
    finally:
        LOG.info(json.dumps({"event": event, "outcome": outcome, "duration_ms": round(1000 * (time.monotonic() - started)), **facts, **more}, sort_keys=True, default=str))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its rows once an action has run over all of them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
