"""WARC archives as a chunked record table.

Writing: a payload is cut into segments of at most ``chunk`` bytes, each a WARC record of its own (the first of the
record's type, the others `continuation` records with a segment number), as the format has it for oversized records.
Records with equal payloads are written once; the others become `revisit` records without a payload.

Reading: archives come back as rows of (record, chunk number, bytes), one segment at a time. A SHA-256 and a length are
carried along from chunk to chunk of a record, so no record is ever held whole, and the last chunk of a record has the
digest of all of it. An archive is compressed as one file, and so read by one task in order: no shuffle is needed.

Spark's own text writer and reader move the bytes, so archives can lie in any store that Spark knows, and a lost
executor's file is written anew. The reader splits at `CRLF CRLF WARC/1.1 CRLF`; the writer starts a new segment within
any `WARC/1.1` of a payload, so that no payload has that sequence.

Null payloads are empty. Null record ids and addresses come back null. Control characters in addresses are escaped.
Records with one id and equal payloads (repeated rows) have the same type. An empty table gives an archive without
records. Addresses and payloads may be of any length. Columns beyond the named ones are not looked at, but for those that
``with_types`` adds, which it replaces; a file is never cut by a session's setting for rows in a file. ``read_chunks``
raises if a payload doesn't have the digest that its record states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CHUNK = 64 << 10
#: Shorter payloads are always written.
REVISIT_FROM = 100
_MARK, _SPLIT = b"WARC/1.1", "\r\n\r\nWARC/1.1\r\n"
_DATE = "2024-01-01T00:00:00Z"


def with_types(records: DataFrame, record_id: str = "record_id", payload: str = "payload", at_least: int = REVISIT_FROM) -> DataFrame:
    """records with payload_bytes, payload_digest, record_type and refers_to: of equal payloads the least id is the response.

    Equal payloads meet by length and digest, added up before the shuffle. The table of digests that come more than
    once is broadcast while it is small; beyond that, hot digests are salted.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    known = records.withColumns({"payload_bytes": F.octet_length(body).cast("bigint"), "payload_digest": F.sha2(body, 256)})
    keys = ["payload_digest", "payload_bytes"]
    seen = known.where(F.col("payload_bytes") >= at_least).groupBy(*keys).agg(F.min(record_id).alias("_first"), F.count("*").alias("_n"))
    seen = shared.written(seen.where("_n > 1"), "digests")
    if seen.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS:
        joined = known.join(F.broadcast(seen), keys, "left")
    else:
        joined = shared.lookup(known, seen, keys, "_n", records.count(), spread=(record_id, "payload_digest"))
    again = F.col("_first").isNotNull() & ~F.col(record_id).eqNullSafe(F.col("_first"))
    return joined.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first", "_n")


def segments(payload: memoryview | bytes, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """The borders of a payload's segments; none has the mark of a record in it. An empty payload is one segment."""
    raw = bytes(payload) if not isinstance(payload, bytes) else payload
    cuts = [m.start() + 4 for m in re.finditer(re.escape(_MARK), raw)]
    start, k = 0, 0
    while True:
        end = min(start + chunk, len(raw))
        while k < len(cuts) and cuts[k] <= start:
            k += 1
        if k < len(cuts) and cuts[k] < end:
            end = cuts[k]
        yield start, end
        if end >= len(raw):
            return
        start = end


def _urn(record_id: object, segment: int = 1) -> str:
    return f"<urn:record:{'' if record_id is None else 'x' + quote(str(record_id), safe='')}{'' if segment == 1 else f':{segment}'}>"


def _clean(text: str) -> str:
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~ ") if re.search(r"[\x00-\x1f\x7f]", text) else text


def write(records: DataFrame, path: str, record_id: str = "record_id", uri: str = "uri", payload: str = "payload", chunk: int = CHUNK) -> None:
    """Writes an archive for each partition of the output of ``with_types``."""
    chosen = records.select(F.col(record_id).cast("string").alias("record_id"), F.col(uri).cast("string").alias("uri"), F.when(F.col("record_type") != "revisit", F.col(payload)).cast("binary").alias("payload"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                one, address, body, total, digest, kind, first = (batch.column(c)[k].as_py() for c in range(7))
                body, parts = body or b"", None
                parts = list(segments(body, chunk))
                for i, (a, b) in enumerate(parts, 1):
                    head = ["WARC/1.1", f"WARC-Type: {kind if i == 1 else 'continuation'}", f"WARC-Record-ID: {_urn(one, i)}", f"WARC-Date: {_DATE}"]
                    if i == 1:
                        if address is not None:
                            head.append(f"WARC-Target-URI: {_clean(address)}")
                        head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {total}", "Content-Type: text/html"]
                        if kind == "revisit":
                            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
                    else:
                        head.append(f"WARC-Segment-Origin-ID: {_urn(one)}")
                    if len(parts) > 1:
                        head.append(f"WARC-Segment-Number: {i}")
                        if i == len(parts):
                            head.append(f"WARC-Segment-Total-Length: {len(body)}")
                    out.append(("\r\n".join([*head, f"Content-Length: {b - a}", "", ""])).encode() + body[a:b] + b"\r\n")
                    size += b - a + 400
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    chosen.mapInArrow(shared.tidy(run), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


_COLUMNS = (
    ("record_id", "string", pa.string()), ("uri", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "string", pa.string()), ("chunk", "int", pa.int32()), ("offset", "bigint", pa.int64()), ("data", "binary", pa.binary()),
    ("sha256_so_far", "string", pa.string()), ("last", "boolean", pa.bool_()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()),
)
_CHUNKS = ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS)


def _id(urn: str | None) -> str | None:
    inner = (urn or "")[len("<urn:record:") : -1].split(":")[0]
    return unquote(inner[1:]) if inner else None


def _read(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    digest, done, no, first = hashlib.sha256(), 0, 0, {}
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _, _ in _COLUMNS])

    for batch in batches:
        for value in batch.column(0):
            raw = value.as_buffer()
            view = memoryview(raw)
            start = len(_MARK) + 2 if view[: len(_MARK)] == _MARK else 0
            end = view.tobytes().index(b"\r\n\r\n", start)
            head = dict(line.split(": ", 1) for line in bytes(view[start:end]).decode().split("\r\n"))
            body = view[end + 4 : end + 4 + int(head["Content-Length"])]
            if len(body) != int(head["Content-Length"]):
                raise ValueError(f"record {head.get('WARC-Record-ID')} is cut short")
            if head["WARC-Type"] != "continuation":
                digest, done, no, first = hashlib.sha256(), 0, 0, head
            elif head["WARC-Segment-Origin-ID"] != first.get("WARC-Record-ID") or int(head["WARC-Segment-Number"]) != no + 1:
                raise ValueError(f"segment {head.get('WARC-Record-ID')} doesn't follow its record")
            no += 1
            digest.update(body)
            last = "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head
            revisit = first["WARC-Type"] == "revisit"
            stated = first["WARC-Payload-Digest"].removeprefix("sha256:")
            so_far = digest.copy().hexdigest()
            if last and not revisit and (so_far != stated or done + len(body) != int(first["X-Payload-Length"])):
                raise ValueError(f"the payload of {first['WARC-Record-ID']} isn't the one that was written")
            rows.append((_id(first["WARC-Record-ID"]), first.get("WARC-Target-URI"), first["WARC-Type"], _id(first.get("WARC-Refers-To")), no - 1, done, bytes(body) if with_data else None, so_far, last, int(first["X-Payload-Length"]) if revisit else done + len(body) if last else None, stated if revisit else so_far if last else None))
            done += len(body)
            size += len(body) if with_data else 300
            if size > 4 << 20:
                yield out()
                rows, size = [], 0
    yield out()


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives at path: a row a segment, with the digest of the record up to it.

    ``payload_bytes`` and ``payload_digest`` stand in a record's last chunk; a revisit has those of what it refers to.
    """
    raw = spark.read.option("lineSep", _SPLIT).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(lambda batches: _read(batches, with_data), _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record, without its bytes."""
    return chunks.where("last").select("record_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", (F.col("chunk") + 1).alias("chunks"))
