"""Deterministic sharded WARC archives: written, committed by manifest, and read back.

Writing: records are ordered by id, and a shard begins wherever the running sum of payload bytes
passes a multiple of the shard size; the sums are taken by ranges, so no task holds them all, and the
bounds depend on nothing but the data. Each shard is one task: it sorts its records, writes one gzip
member each, and rolls a file when its compressed size passes a limit. All headers, record ids,
lengths and digests are made anew from the content, so the same rows give the same bytes. A task
writes under a temporary name of its own and renames at the end, over what a lost attempt may have
left there (its bytes are the same); the list of finished files is then written as a manifest table,
and readers open only what the manifest names.

Equal payloads of at least `least` bytes are stored once, by the record with the largest id; the
others are revisit records that name it. Sums of groups are taken before the shuffle, and a group of
any number of equal payloads is only ever a maximum.

Defined cases: null payloads are empty; ids are integers; rows with a null id are records named by
their content, dealt out by its digest, and come back with a null id (they revisit a record with an
id, and are responses where there is none). Repeated rows give repeated records (which revisit
nothing of their own id: a payload whose largest id repeats is stored by each such row); all rows of
one id are in one shard. A record is held in memory whole, one at a time beside its batch. Empty
tables give an empty archive. Urls may be null; control characters in them are percent-encoded. Only
the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.morton import count_upto
from tessella.llm.shared import arrow, cut, integer, literal_table, scratch, small_batches

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARD_BYTES = 64 << 20  # payload bytes of a shard, about
FILE_BYTES = 16 << 20  # compressed bytes at which a file is rolled
STATUS = b"HTTP/1.1 200 OK\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, same: str, n: int = 0) -> str:
    """Of the n-th record of an id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'record:{page}:{same}:{n}')}>"


def clean(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"


def headers(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def http_head(size: int, kind: str) -> bytes:
    return STATUS + headers([("Content-Type", kind), ("Content-Length", str(size))])


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, n: int = 0) -> bytes:
    """One record; a revisit holds the HTTP head alone, which tells its payload's length."""
    head, same = http_head(len(payload), "text/html; charset=utf-8"), digest(payload)
    block = head if refers is not None else head + payload
    pairs = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, same, n)), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{same}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers is not None:
        pairs += [("WARC-Refers-To", record_id(refers, same)), ("WARC-Refers-To-Page", str(refers)), ("WARC-Profile", PROFILE)]
    pairs += [("WARC-Page", str(page))] * (page is not None)
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + headers(pairs) + block + b"\r\n\r\n"


def info(shard: int, part: int) -> bytes:
    body = headers([("software", "tessella"), ("format", "WARC File Format 1.1")])
    name = f"shard-{shard:05d}-{part:05d}.warc.gz"
    rid = f"<urn:uuid:{uuid.uuid5(SPACE, f'info:{shard}:{part}')}>"
    return b"WARC/1.1\r\n" + headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time or name."""
    return gzip.compress(data, 6, mtime=0)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path.split("?")[0][:12] else f"file://{path}")


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Rows (id, kind, url, payload, same, refers): records (kind 1), and before them what they revisit.

    A row of kind 0 tells that records of this id and payload digest are kept by another id. Both
    kinds go through the one shuffle, so payloads are moved once and never joined.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    slim = rows.where(F.octet_length("payload") >= least).select("id", "same")
    keepers = slim.groupBy("same").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    refers = slim.join(keepers, "same").where("not (id <=> keeper)").select("id", "same", "keeper").distinct()
    told = refers.select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "same", F.col("keeper").alias("refers"))
    return told.union(rows.select("id", F.lit(1).alias("kind"), "url", "payload", "same", F.lit(None).cast("long").alias("refers")))


def bounds(rows: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """First ids of the shards behind the first, and shards for rows without an id. rows: id, bytes."""
    sums = rows.groupBy("id").agg(F.sum("bytes").alias("bytes"))
    sums = cut(sums.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "sizes")
    lost = sums.where("id is null").agg(F.sum("bytes")).first()[0] or 0
    known = sums.where("id is not null")
    totals = known.groupBy("range").agg(F.min("id").alias("id"), F.sum("bytes").alias("bytes")).orderBy("id").collect()  # one row a range
    before, offsets = 0, []
    for r in totals:
        offsets.append((r["range"], before))
        before += r["bytes"]
    own = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("bytes").over(own), F.lit(0)) + F.col("offset")
    placed = known.join(F.broadcast(literal_table(rows.sparkSession, offsets, "range int, offset long")), "range").withColumn("shard", F.floor(at / shard_bytes))
    firsts = placed.groupBy("shard").agg(F.min("id").alias("id")).orderBy("id").collect()  # one row a shard
    return [r["id"] for r in firsts[1:]], -(-lost // shard_bytes)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archive under `path` and returns its manifest (file, shard, part, records, bytes, sha256)."""
    integer(pages, id_col)
    spark = pages.sparkSession
    small_batches(spark)
    size = F.coalesce(F.octet_length(F.col(payload_col).cast("binary")), F.lit(0)).cast("long") + 512
    limits, lost = bounds(pages.select(F.col(id_col).cast("long").alias("id"), size.alias("bytes")), shard_bytes)
    known = len(limits) + 1
    rows = with_roles(pages, id_col, url_col, payload_col, least)
    shard = F.when(F.col("id").isNull(), known + F.pmod(F.xxhash64("same"), F.lit(max(1, lost)))).otherwise(count_upto(limits, F.col("id")))
    rows = rows.withColumn("shard", shard.cast("int")).repartitionById(known + lost, "shard").sortWithinPartitions("shard", "id", "same", "kind", "url")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(path)
        attempt, done = uuid.uuid4().hex, []
        system.create_dir(f"{root}/files", recursive=True)
        shard, part, sink, size, count, sha, temp, last, repeat, kept_by = None, 0, None, 0, 0, None, "", None, 0, None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                name = f"files/shard-{shard:05d}-{part:05d}.warc.gz"
                if system.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                    system.delete_file(f"{root}/{name}")
                system.move(temp, f"{root}/{name}")
                done.append((name, shard, part, count, size, sha.hexdigest()))
                sink = None

        def put(data: bytes) -> None:
            nonlocal size
            z = member(data)
            sink.write(z)
            sha.update(z)
            size += len(z)

        for batch in batches:
            for i in range(batch.num_rows):
                page, kind, url, payload, same, refers, own = (batch.column(c)[i].as_py() for c in range(7))
                if (page, same) != last:
                    kept_by, repeat, last = None, -1, (page, same)
                if kind == 0:
                    kept_by = refers
                    continue
                repeat += 1
                if own != shard or size >= file_bytes:
                    close()
                    part = part + 1 if own == shard else 0
                    shard, size, count, sha = own, 0, 0, hashlib.sha256()
                    temp = f"{root}/files/.tmp-{attempt}-{shard:05d}-{part:05d}"
                    sink = system.open_output_stream(temp)
                    put(info(shard, part))
                put(record(page, url, payload, kept_by, repeat))
                count += 1
        close()
        if done:
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "shard", "part", "records", "bytes", "sha256"])

    schema = "file string, shard int, part int, records long, bytes long, sha256 string"
    arrow(rows.select("id", "kind", "url", "payload", "same", "refers", "shard"), over, schema).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def parse(stream: io.BufferedIOBase, what: str = "") -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an archive; raises ValueError where it is broken."""
    packed, plain, unzip = b"", b"", zlib.decompressobj(31)

    def fill() -> bool:
        nonlocal packed, plain, unzip
        packed = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        packed = packed or stream.read(1 << 18)
        plain += unzip.decompress(packed) if packed else b""
        return bool(packed)

    while True:
        while (end := plain.find(b"\r\n\r\n")) < 0:
            if not fill():
                if plain or not (unzip.eof or packed == b""):
                    raise ValueError(f"{what}: a record is cut off")
                return
        lines = plain[:end].decode().split("\r\n")
        if lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"{what}: no WARC record")
        found = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(found["content-length"])
        while len(plain) < end + 4 + size + 4:
            if not fill():
                raise ValueError(f"{what}: a record is cut off")
        yield found, plain[end + 4 : end + 4 + size]
        if plain[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"{what}: a record does not end where it says")
        plain = plain[end + 8 + size :]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files that the manifest names.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).
    Digests are computed anew and compared; a revisit's length is that of its HTTP head.
    """
    small_batches(spark)
    names = spark.read.parquet(f"{path}/manifest").select("file", "records")
    n = max(1, names.count())
    # One file a task at most; a file is bounded by its roll size.
    files = names.repartitionByRange(n, "file") if n > 1 else names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(path)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen = [], 0
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for h, block in parse(stream, file):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        revisit, found = h["warc-type"] == "revisit", h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-block-digest"] != f"sha1:{digest(block)}" or not revisit and (found != digest(payload) or length != len(payload)):
                            raise ValueError(f"{file}: a digest or length does not match")
                        page, refers = h.get("warc-page"), h.get("warc-refers-to-page")
                        rows.append((int(page) if page else None, h["warc-target-uri"], h["warc-type"], length, found, int(refers) if refers else None, None if revisit else payload))
                        seen += 1
                        if len(rows) == 64:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)
                if seen != records:
                    raise ValueError(f"{file}: {seen} records, the manifest says {records}")

    def emit(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return arrow(files, over, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes pages to a new archive in the shared folder and reads it back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, least)
    return read(pages.sparkSession, path)
