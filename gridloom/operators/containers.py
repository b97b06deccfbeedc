"""Far too many small files: admit every record once and pack original bytes into indexed containers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import lookup_join

TARGET_BYTES = 128 << 20


def instant_ms(text: Column) -> Column:
    """Epoch ms of an ISO-like instant: 'T' or a blank between date and time, offset '+hh:mm', 'Z' or none (UTC). Else NULL."""
    return F.unix_millis(F.try_to_timestamp(F.replace(F.trim(text), F.lit("T"), F.lit(" "))))


def period_parts(period: Column) -> tuple[Column, Column]:
    """(month 'YYYYMM', day 'DD' or '') of a period spelled with any separator or none; NULL month where it can't be read."""
    p = F.trim(period)
    rx = r"^(\d{4})[-/_. ]?(\d{1,2})(?:[-/_. ]?(\d{1,2}))?$"
    y, m, d = (F.regexp_extract(p, rx, i) for i in (1, 2, 3))
    tight = F.regexp_replace(p, r"\D", "")
    is_tight = (p == tight) & F.length(tight).isin(6, 8)
    month = F.when(is_tight, F.substring(tight, 1, 6)).when(y != "", F.concat(y, F.lpad(m, 2, "0")))
    day = F.when(is_tight, F.substring(tight, 7, 2)).otherwise(F.when(d != "", F.lpad(d, 2, "0")).otherwise(""))
    return month, day


def latest_record(log: DataFrame, key: str, stamp: Column, fields: list[str]) -> DataFrame:
    """The record of each key with the latest stamp. Equal stamps: the largest fields, so the choice doesn't depend on order."""
    # A struct with a map or an uneven type can't be ordered; the fields used here are strings and numbers.
    best = F.max(F.struct(stamp.alias("__at"), *[F.col(f"`{c}`").alias(c) for c in fields])).alias("__r")
    return log.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(best).select(key, *[F.col(f"__r.{c}").alias(c) for c in fields])


def container_index(log: DataFrame, target: int = 1_000_000, max_files: int = 65_536) -> DataFrame:
    """Index of the containers into which the usable files of a log are packed, each record once.

    ``log``: key, dataset, symbol, period, status, sha256, rows, updated_at.
    Returns key, dataset, symbol, length (here ``rows``), checksum, role, and
    for role 'packed' container and offset. Roles:
    'contained' - daily file whose month arrives in a usable monthly file of
    its dataset and symbol; 'copy' - another usable file with a smaller key
    has the same checksum (``of`` names it); 'packed' - the rest.

    Method: archive containers index each original by path, offset, length and
    checksum. Files are dealt to shards by a hash of the key, so that shards
    are even whatever the key; within a shard offsets are running totals and
    a container ends every ``target`` units or ``max_files`` files.

    Defined cases: NULL keys are left out. A NULL or unreadable updated_at
    ranks before all others. NULL dataset, symbol, checksum or an unreadable
    period match nothing. NULL or non-positive rows are not usable.
    """
    files = file_roles(log)
    out = files.filter("role <> 'packed'").select("*", F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("offset"))
    return out.unionByName(assign_offsets(files.filter("role = 'packed'"), target, max_files))


def file_roles(log: DataFrame) -> DataFrame:
    """The part of ``container_index`` that tells which files are packed: all its columns but container and offset."""
    # A checksum is half as long as bytes; text that is no hexadecimal number stands for itself.
    plain = F.lower(F.trim("sha256"))
    log = log.withColumn("sha256", F.coalesce(F.expr("try_to_binary(lower(trim(sha256)), 'hex')"), plain.cast("binary")))
    fields = ["dataset", "symbol", "period", "status", "sha256", "rows"]
    month, day = period_parts(F.col("period"))
    files = latest_record(log, "key", instant_ms(F.col("updated_at")), fields).filter("status = 'converted' and rows > 0")
    files = files.select("key", "dataset", "symbol", "rows", F.col("sha256").alias("checksum"), month.alias("month"), (day != "").alias("daily"))

    # One row per month that has a monthly file: at most a row per (dataset, symbol, month), weighed by nothing but its own size.
    months = files.filter("not daily and month is not null").groupBy("dataset", "symbol", "month").agg(F.lit(True).alias("whole"), F.count(F.lit(1)).alias("w"))
    files = lookup_join(files, months, ["dataset", "symbol", "month"], ["whole"], "w")
    firsts = files.filter("checksum is not null").groupBy("checksum").agg(F.min("key").alias("of"), F.count(F.lit(1)).alias("w")).filter("w > 1")
    files = lookup_join(files, firsts, ["checksum"], ["of"], "w")
    role = F.when(F.col("daily") & F.col("whole"), "contained").when(F.col("key") > F.col("of"), "copy").otherwise("packed")
    text = F.when(F.length("checksum") == 32, F.lower(F.hex("checksum"))).otherwise(F.col("checksum").cast("string"))
    return files.select("key", "dataset", "symbol", F.col("rows").alias("length"), text.alias("checksum"), "of", role.alias("role"))


def assign_offsets(files: DataFrame, target: int, max_files: int) -> DataFrame:
    """Add container and offset to rows with key and length: shards by hash, running totals within a shard."""
    total = files.agg(F.greatest(F.lit(1), F.ceil(F.sum("length") / F.lit(8 * target)), F.ceil(F.count(F.lit(1)) / F.lit(max_files))).cast("bigint").alias("__shards"))
    dealt = files.crossJoin(F.broadcast(total)).withColumn("__shard", F.pmod(F.xxhash64("key"), F.col("__shards")))
    along = W.partitionBy("__shard").orderBy("key")
    before = F.sum("length").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    dealt = dealt.withColumn("__before", before).withColumn("__part", (F.col("__before") / target).cast("bigint"))
    first = F.min("__before").over(W.partitionBy("__shard", "__part"))
    return dealt.select(*files.columns, F.concat_ws("-", F.lpad(F.col("__shard").cast("string"), 6, "0"), F.lpad(F.col("__part").cast("string"), 6, "0")).alias("container"), (F.col("__before") - first).alias("offset"))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3 and what else Arrow knows) and the path within it."""
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner.rstrip("/")


def pack_files(spark: SparkSession, glob: str, out_dir: str, target_bytes: int = TARGET_BYTES, shards: int | None = None) -> DataFrame:
    """Pack the files that match ``glob`` into containers under ``out_dir`` and return their index.

    The index has path, container, offset, length, checksum (SHA-256 of the
    original bytes) and is also written to ``out_dir/index``. Files of equal
    content share one stored copy; only its bytes are shuffled, by path, so a
    content with very many copies makes no task large. A container is written
    under a fresh name and only the committed index refers to it: a task that
    is retried leaves at most an unreferenced file, which readers never see.
    ``out_dir`` is a path or URI that all executors reach. Files of zero length hold
    no record and aren't listed by Spark's file sources: they get no entry.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    # Contents are read twice: once for their checksums, and those that are the first of their kind once more to be stored.
    files.select("path", "length", F.sha2("content", 256).alias("checksum")).write.mode("overwrite").parquet(f"{out_dir}/listed")
    listed = spark.read.parquet(f"{out_dir}/listed")
    if shards is None:
        size = listed.agg(F.sum("length")).first()[0] or 0
        shards = max(1, -(-size // (8 * target_bytes)))
    listed = listed.select("path", "checksum")
    firsts = listed.groupBy("checksum").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("w"))
    dealt = files.select("path", "content").join(firsts.select("path", "checksum"), "path").repartition(shards, "path").sortWithinPartitions("path")
    data = f"{out_dir}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(data)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = {"path": [], "container": [], "offset": [], "length": [], "checksum": []}
            for path, content, checksum in zip(batch["path"].to_pylist(), batch["content"], batch["checksum"].to_pylist()):
                body = content.as_buffer()
                if out is None or at + len(body) > target_bytes and at:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.pack", 0
                    out = fs.open_output_stream(f"{folder}/{name}")
                for c, v in zip(rows, (path, name, at, len(body), checksum)):
                    rows[c].append(v)
                out.write(body)
                at += len(body)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("path", pa.string()), ("container", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("checksum", pa.string())]))
        if out:
            out.close()

    dealt.select("path", "content", "checksum").mapInArrow(write, "path string, container string, offset bigint, length bigint, checksum string").write.mode("overwrite").parquet(f"{out_dir}/stored")
    stored = spark.read.parquet(f"{out_dir}/stored").drop("path").join(firsts.select("checksum", "w"), "checksum")
    lookup_join(listed, stored, ["checksum"], ["container", "offset", "length"], "w").write.mode("overwrite").parquet(f"{out_dir}/index")
    return spark.read.parquet(f"{out_dir}/index")


def read_packed(index: DataFrame, out_dir: str, verify: bool = True) -> DataFrame:
    """Original bytes of the indexed files (path, content), read in parallel by container; raises on a checksum that differs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{out_dir}/data")
        name, f = "", None
        for batch in batches:
            paths, bodies = [], []
            for path, container, offset, length, checksum in zip(*(batch[c].to_pylist() for c in ("path", "container", "offset", "length", "checksum"))):
                if container != name:
                    if f:
                        f.close()
                    name, f = container, fs.open_input_file(f"{folder}/{container}")
                f.seek(offset)
                body = f.read(length)
                if verify and hashlib.sha256(body).hexdigest() != checksum:
                    raise ValueError(f"{path}: its bytes in {container} at {offset} differ from the checksum")
                paths.append(path)
                bodies.append(body)
            yield pa.RecordBatch.from_pydict({"path": paths, "content": bodies}, pa.schema([("path", pa.string()), ("content", pa.binary())]))
        if f:
            f.close()

    rows = index.select("path", "container", "offset", "length", "checksum")
    return rows.repartition("container").sortWithinPartitions("container", "offset").mapInArrow(read, "path string, content binary")
