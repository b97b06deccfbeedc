"""Fetching archive files into the store: retries, atomic placement, and a log of what failed."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.operators.containers import file_system

STATUS = "key string, status string, sha256 string, bytes bigint, attempts int, error string"
CHUNK = 4 << 20


def fetch_one(key: str, source: str, target: str, retries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """Copy one file: (key, status, sha256, bytes, attempts, error). A missing one is 'absent' at once.

    Other failures are tried again after waits that double. Bytes go to a
    name of their own beside the target and are moved when whole, so that
    a reader never sees part of a file and a repeated task does no harm.
    """
    error = ""
    for attempt in range(1, retries + 1):
        try:
            src, inner = file_system(source)
            dst, out = file_system(target)
            digest, n, part = hashlib.sha256(), 0, f"{out}/{key}.{uuid.uuid4().hex}.part"
            with src.open_input_stream(f"{inner}/{key}") as f:
                dst.create_dir(f"{out}/{key}".rpartition("/")[0], recursive=True)
                with dst.open_output_stream(part) as g:
                    while body := f.read(CHUNK):
                        digest.update(body)
                        g.write(body)
                        n += len(body)
            dst.move(part, f"{out}/{key}")
            return key, "downloaded", digest.hexdigest(), n, attempt, ""
        except FileNotFoundError:
            return key, "absent", None, None, attempt, ""
        except OSError as x:
            error = str(x)
            if attempt < retries:
                sleep(wait * 2 ** (attempt - 1))
    return key, "failed", None, None, retries, error


def backfill(plan: DataFrame, source: str, target: str, tasks: int = 8, retries: int = 4, wait: float = 1.0) -> DataFrame:
    """Fetch the keys of a plan in parallel tasks: a row for each with its status. Failures are recorded and passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fetch_one(k, source, target, retries, wait) for k in batch["key"].to_pylist()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in STATUS.split(", ")])

    return plan.filter("key is not null").select("key").distinct().repartition(tasks).mapInArrow(run, STATUS)
