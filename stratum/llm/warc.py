"""WARC archives, index first.

`write_archives` writes records, each a gzip member of its own, and returns the index: for each record its file,
offset, length, URL and digest. `read_records` takes any part of the index, puts it in the order of the bytes, joins
ranges that lie close together into one read, and returns the parsed records. Of records with equal payloads (SHA-1)
of at least `revisit_bytes` bytes, that with the smallest id is a response and the others are revisits that name it.

Groups of equal payloads are found over a written slim table of ids and digests. Digests that hold more than a thousandth
of all rows are named by a Misra-Gries summary and verified (1000 at most): they are broadcast, and their revisits leave
their payload behind before any shuffle. All other members of groups are decided over (id, digest), and pages are joined
to their decision by both, which names a row; so no payload moves by its digest.

Defined cases: ids are integers; a null payload counts as empty; a null or empty URL is written as an empty one and read as
null; a null id comes after all others and is read as null; of rows that tie in id and payload each is written, the first
by URL as response; an empty table gives an empty index. Columns other than the three that are named do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path
from .exact_dedup import SUPPORT, heavy_hitters
from .files import new_name, place

INDEX = "file string, offset long, length long, url string, digest string, record_type string, id long, refers_to long"
RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
RECORDED = ("id", "url", "payload", "size", "key", "first_id")
#: A file is closed when it has so many bytes. Ranges with a smaller gap between them are one read, up to a size.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of records that a reading task gets on average, once there are so many.
TASK_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(number: int | None) -> str:
    return f"<urn:x-page:{'' if number is None else number}>"


def _number(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def record_bytes(
    number: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """A record with a payload is a response, one without is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_uri(number)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of RECORD. The payload of a revisit is empty; its size and digest are those of the full payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was written")
    return {
        "id": _number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"] or None,
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _number(fields.get("WARC-Refers-To")),
        "payload": payload,
    }


def _info(name: str, date: str) -> bytes:
    info = "software: stratum\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-file:{name}>", f"WARC-Date: {date}"]
    head += ["Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]
    return ("\r\n".join(head) + f"\r\n\r\n{info}\r\n\r\n").encode()


def _gzip(data: bytes, level: int) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def _groups(keys: DataFrame) -> DataFrame:
    """Of (key, id, ties), the keys of several rows: key, first_id, and the number of rows with the key and that id."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "ties"))
    groups = keys.groupBy("key").agg(first.alias("first"), F.sum("ties").alias("n")).where("n > 1")
    return groups.select("key", F.col("first.id").alias("first_id"), F.col("first.ties").alias("first_ties"))


def _decided(rows: DataFrame, revisit_bytes: int, support: float) -> tuple[DataFrame, bool]:
    """rows (id, url, payload, size, key) with first_id and first_ties of the groups of equal payloads; whether any tie."""
    slim = materialize(rows.where(F.col("size") >= revisit_bytes).select("id", "key"), "warc-keys")
    count = F.count(F.lit(1)).alias("ties")
    named = F.broadcast(heavy_hitters(slim, "key", support))
    hot = materialize(_groups(slim.join(named, "key", "left_semi").groupBy("key", "id").agg(count)), "warc-hot")
    rest = slim.join(F.broadcast(hot.select("key")), "key", "left_anti").groupBy("key", "id").agg(count)
    cold = materialize(rest.join(_groups(rest), "key").drop("ties"), "warc-groups")
    ties = not hot.unionByName(cold.drop("id")).where("first_ties > 1").isEmpty()
    large = F.col("size") >= revisit_bytes
    hot = hot.select(F.col("key").alias("hot_key"), F.col("first_id").alias("hot_id"), F.col("first_ties").alias("hot_ties"))
    cold = cold.withColumnsRenamed({"key": "cold_key", "id": "cold_id"})
    rows = rows.join(F.broadcast(hot), large & (F.col("key") == F.col("hot_key")), "left")
    is_revisit = F.col("hot_key").isNotNull() & ~F.col("id").eqNullSafe(F.col("hot_id"))
    rows = rows.withColumn("payload", F.when(~is_revisit, F.col("payload")))
    mine = large & (F.col("key") == F.col("cold_key")) & F.col("id").eqNullSafe(F.col("cold_id"))
    rows = rows.join(cold, mine, "left").withColumn("grouped", F.coalesce("hot_key", "cold_key").isNotNull())
    for name, of_hot in (("first_id", "hot_id"), ("first_ties", "hot_ties")):
        rows = rows.withColumn(name, F.when(F.col("hot_key").isNotNull(), F.col(of_hot)).otherwise(F.col(name)))
    return rows.select("id", "url", "payload", "size", "key", "grouped", "first_id", "first_ties"), ties


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 4,
    support: float = SUPPORT,
) -> DataFrame:
    """Writes a record for each row to archives in the shared folder; returns the written index."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.unhex(F.sha1("payload")))
    rows, ties = _decided(rows, revisit_bytes, support)
    is_first = ~F.col("grouped") | F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("payload", F.when(is_first, F.col("payload")))
    tied = is_first & F.col("grouped") & (F.col("first_ties") > 1)
    if ties:
        # Rows that tie with the first one in id and payload: counted by URL, then one of the least URL stays a response.
        alike = rows.where(tied).groupBy("id", "key", "url", "size", "first_id")
        alike = alike.agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
        alike = materialize(alike, "warc-ties")
        by_url = F.struct(F.col("url").isNull().alias("no_url"), "url")
        least = alike.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.min(by_url).alias("least"))
        alike = alike.join(least, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        copies = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        kept = (F.col("copy") == 1) & F.col("url").eqNullSafe(F.col("least.url"))
        copies = copies.withColumn("payload", F.when(kept, F.col("payload")))
        rows = rows.where(~tied).select(*RECORDED).unionByName(copies.select(*RECORDED))
    rows = rows.select(*RECORDED)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        out, name, at, index = None, "", 0, []
        for batch in batches:
            for k in range(len(batch)):
                number, url, data, size, key, first = (batch.column(c)[k].as_py() for c in range(6))
                if out is None:
                    name, at = new_name("records", ".warc.gz"), 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    at += out.write(_gzip(_info(name, date), level))
                digest = base64.b32encode(key).decode()
                member = _gzip(record_bytes(number, url, data, size, digest, first, date), level)
                out.write(member)
                kind = "revisit" if data is None else "response"
                index.append((name, at, len(member), url, digest, kind, number, first if data is None else None))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                yield _rows(index, INDEX)
                index = []
        if out is not None:
            out.close()

    index = rows.mapInArrow(write, INDEX).withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))
    return materialize(index, "warc-index")


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges of one file joined into reads: (offset, length, which ranges)."""
    reads: list[tuple[int, int, list[int]]] = []
    for k, (at, size) in enumerate(ranges):
        if reads:
            start, length, which = reads[-1]
            if at - (start + length) <= GAP_BYTES and max(length, at + size - start) <= READ_BYTES:
                reads[-1] = (start, max(length, at + size - start), [*which, k])
                continue
        reads.append((at, size, [k]))
    return reads


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index point to, as RECORD.

    Stretches of files are dealt to as many tasks as the records' bytes ask for, however small the index is.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    ordered = index.select("file", "offset", "length").repartition(tasks, "file", stretch)
    ordered = ordered.sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                folder, name = files[at].rsplit("/", 1)
                system, root = place(folder)
                with system.open_input_file(f"{root}/{name}") as source:
                    for start, length, which in coalesced(list(zip(offsets[at:end], lengths[at:end]))):
                        data = source.read_at(length, start)
                        found = []
                        for k in which:
                            low = offsets[at + k] - start
                            found.append(tuple(parse_record(zlib.decompress(data[low : low + lengths[at + k]], 31)).values()))
                        yield _rows(found, RECORD)
                at = end

    return ordered.mapInArrow(read, RECORD)
