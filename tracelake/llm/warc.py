"""WARC archives with an index that is written beside them.

Each writing task makes one archive of gzip members, a record a member, and
returns the index rows (file, offset, length, url, digest and more): the
index is complete before anything is read. Reading sorts the selected index
rows by file and offset, coalesces neighbouring byte ranges into one read,
and checks every payload against its digest.

Archives go through pyarrow's file systems, under a name of the attempt's
own, so a task that runs twice leaves an unreferenced file and no damage.

Defined results: a null html is an empty payload, a null url an empty one;
runs of white space in a url become a space each, so that it stays one line
of a header (the index holds it so too); an empty table gives an empty
archive; other columns are ignored.
Of equal payloads of at least MIN_REVISIT bytes the largest page_id is the
response (a null id is the smallest; rows that repeat that id with that
payload are all responses), the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, HOT, column, partitions, scratch, staged

MIN_REVISIT = 1000

#: Ranges that lie at most GAP bytes apart are read at once, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20

INDEX = "page_id long, file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to long"

#: Records carry a fixed date, so that archives of the same pages are the same bytes.
DATE = "2000-01-01T00:00:00Z"


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _clean(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (b"" if revisit else payload)
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the payload's digest and size are computed where there is a payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")[2]
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest, size, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["X-Payload-Length"]), field["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {field['WARC-Record-ID']} doesn't have its digest")
    refers = field.get("WARC-Refers-To")
    return {"page_id": number(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None}


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives under path and returns the index, itself written to path/index."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    # Payloads stay where they are: only digests are grouped, and of those only the repeated ones come back.
    repeated = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("digest", "keep", "n")
    repeated = staged(repeated, "repeated-payloads")
    n = repeated.count()
    if n <= BROADCAST // 4:
        marked = rows.join(F.broadcast(repeated.drop("n")), "digest", "left")
    else:  # too many for that: those with most rows go to the rows, the others meet them in a merge join
        hot = repeated.filter(F.col("n") > F.lit(max(1000, rows.count() // HOT))).drop("n")
        here = rows.join(F.broadcast(hot), "digest")
        marked = here.unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(repeated.drop("n").hint("merge"), "digest", "left"))
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("keep")).alias("refers_to"))
    root = f"{path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        at = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                index: dict[str, list] = {f.split()[0]: [] for f in INDEX.split(", ")}
                ids, urls, bodies, sums, sizes, refs = (column(batch, c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to"))
                for i in range(batch.num_rows):
                    page, link, digest, size, refers = ids[i].as_py(), urls[i].as_py(), sums[i].as_py(), sizes[i].as_py(), refs[i].as_py()
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, link, bodies[i].as_py() or b"", digest, refers, size)) + packer.flush()
                    out.write(data)
                    for k, v in zip(index, (page, f"{root}/{name}", at, len(data), _clean(link), digest, size, "response" if refers is None else "revisit", refers), strict=True):
                        index[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(index, schema=_SCHEMA)

    marked.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


_SCHEMA = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in (f.split() for f in INDEX.split(", "))])


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for (null for a revisit)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    spark = index.sparkSession
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    to = pa.schema([(c, kinds[t]) for c, t in (f.split() for f in schema.split(", "))])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
        file, start, end, run = None, 0, 0, []
        for batch in batches:
            for f, a, n in zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (f != file or a - end > GAP or a + n - start > READ):
                    yield file, start, run
                    run = []
                if not run:
                    file, start, end = f, a, a
                run.append((a - start, n))
                end = max(end, a + n)
        if run:
            yield file, start, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for file, start, run in ranges(batches):
            if file != name:
                if source is not None:
                    source.close()
                fs, at = open_store(file)
                name, source = file, fs.open_input_file(at)
            data = source.read_at(max(a + n for a, n in run), start)
            found, size = [], 0
            for a, n in run:
                one = parse(zlib.decompress(data[a : a + n], 31))
                found.append({c: one[c] for c in to.names})
                size += one["payload_bytes"] if payloads else 0
                if size > READ:  # what was inflated goes on before more is
                    yield pa.RecordBatch.from_pylist(found, schema=to)
                    found, size = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=to)
        if source is not None:
            source.close()

    # A file's rows are cut into stretches, so that one large archive still spreads over tasks.
    stretch = F.floor(F.col("offset") / (8 * READ))
    rows = index.select("file", "offset", "length").repartition(partitions(spark), "file", stretch).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, schema)


def round_trip(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All pages written, then read back from the archives."""
    return read_archives(write_archives(pages, path or scratch(pages.sparkSession, "warc"), page_id, url, html))
