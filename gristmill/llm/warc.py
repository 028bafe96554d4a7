"""WARC archives, index first.

Writing: each task writes one archive of gzip members (one a record) straight to the shared folder
under a name of its own attempt, and returns an index row per record: file, offset, length, URL and
payload digest. A task that runs again writes another file; only files named by returned index
rows are ever read, so lost executors leave no wrong records behind.

Reading: the index rows of the selected records are sorted by file and offset, neighbours closer
than ``gap`` bytes are coalesced into ranges of at most ``range_bytes``, and each range is one read. There are as many tasks as ranges of
the selected bytes.

Records are WARC/1.1: a date, an own identifier (from the archive's name and the offset), a target URI, and for a revisit the target URI and date of what it
refers to. A null URL and characters that a header can't hold have no place there: the target URI is then about:blank or percent-encoded, and an own
header keeps the URL as it is (in base64), so that reading gives it back. Page ids are own headers too.

Payloads: null is empty. Equal payloads of at least ``min_revisit`` bytes are stored once, by the
smallest page_id (a null page_id counts as the largest); the others are revisit records. Repeated rows and
page_ids keep a record for each row. Payloads are held whole, one at a time when writing and a range when reading. An empty table gives an empty index, which
reads as no records. Other columns of pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, open_store, shared_folder

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A join's side up to this many bytes is broadcast.
BROADCAST_BYTES = 16 << 20


def clean(url: str) -> str:
    """The URL as a header can hold it: printable ASCII, all else percent-encoded."""
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~-._")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, first_url: str | None, name: str, date: str) -> bytes:
    """One WARC/1.1 record: headers, HTTP head, and the payload unless it revisits another. name: what tells it from all other records."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = lambda u: clean(u) or "about:blank" if u is not None else "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None and target(url) != url:
        head.append(f"Page-URL: {base64.b64encode(url.encode()).decode()}")
    if url == "about:blank":
        head.append(f"Page-URL: {base64.b64encode(url.encode()).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To-Target-URI: {target(first_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}", f"Page-Refers-To: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of one record; a payload that does not match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None else int(x)
    url = base64.b64decode(fields["Page-URL"]).decode() if "Page-URL" in fields else None if fields["WARC-Target-URI"] == "about:blank" else fields["WARC-Target-URI"]
    return {"page_id": number(fields.get("Page-ID")), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("Page-Refers-To")), "payload": payload}


def plan_records(pages: DataFrame, min_revisit: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with size, digest, refers_to (null: a response of its own) and first_url, the URL of what it refers to."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    groups = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first_url"), F.count("*").alias("n"))
    shared = materialize(groups.where("n > 1 and first_id is not null").select("digest", "first_id", "first_url"), "warc-shared")
    if (shared.agg(F.sum(F.coalesce(F.octet_length("first_url"), F.lit(0)) + 150)).first()[0] or 0) <= broadcast_bytes:
        met = rows.join(F.broadcast(shared), "digest", "left")
    else:
        # short payloads refer to none, so the many equal ones among them are no join key
        met = rows.where(F.col("size") >= min_revisit).join(shared, "digest", "left").unionByName(rows.where(F.col("size") < min_revisit), allowMissingColumns=True)
    revisits = (F.col("first_id").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select("page_id", "url", "html", "size", "digest", F.when(revisits, F.col("first_id")).alias("refers_to"), "first_url")


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, level: int = 3, date: str = "", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write a record per row of pages, dated date (now, if empty); the index, as a table in the shared folder."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at, sink, name = *open_store(folder), None, ""
        offset = 0
        for batch in batches:
            out = []
            for row in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                if sink is None:
                    store.create_dir(at, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{at}/{name}", compression=None)
                html = row["html"].encode()
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(row["page_id"], row["url"], html, row["size"], row["digest"], row["refers_to"], row["first_url"], f"{name}/{offset}", date)) + pack.flush()
                sink.write(member)
                out.append({"file": f"{folder}/{name}", "offset": offset, "length": len(member), "url": row["url"], "digest": row["digest"], "page_id": row["page_id"], "record_type": "response" if row["refers_to"] is None else "revisit"})
                offset += len(member)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if sink is not None:
            sink.close()

    return materialize(plan_records(pages, min_revisit, broadcast_bytes).mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame, gap: int = 64 << 10, range_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """Read the records that the rows of index (all, or a selection) name."""
    schema = READ + (", payload binary" if with_payload else "")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple[str, int, int]] = []
        opened: list = [None, None]

        def flush() -> pa.RecordBatch:
            file, start = wanted[0][0], wanted[0][1]
            if opened[0] != file:
                store, at = open_store(file)
                opened[:] = [file, store.open_input_file(at)]
            opened[1].seek(start)
            block = opened[1].read(wanted[-1][1] + wanted[-1][2] - start)
            rows = [parse(zlib.decompress(block[o - start : o - start + n], 31)) for _, o, n in wanted]
            wanted.clear()
            return pa.RecordBatch.from_pylist([{k: r[k] for k, _ in fields} for r in rows], schema=pa.schema(fields))

        for batch in batches:
            for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]):
                if wanted and (file != wanted[0][0] or offset - wanted[-1][1] - wanted[-1][2] > gap or offset + length - wanted[0][1] > range_bytes):
                    yield flush()
                wanted.append((file, offset, length))
        if wanted:
            yield flush()

    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // range_bytes))
    ranges = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(fetch, schema)
