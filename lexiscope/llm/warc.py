"""WARC archives of captured pages, and their index by an external merge.

``write_archives`` makes one record per page: a response with an HTTP block,
or a revisit of the response with the same payload.  Spark's text writer puts
the records into gzip-compressed WARC 1.1 files of bounded size under any path
that Spark can write.  ``read_archives`` parses the files back by their declared
lengths; each file gives one capture run sorted by URL key, time and page.
``merge_runs`` deals the runs by ranges of that order and merges the slices of
each range with a loser tree: the result is globally ordered by partition.

Defined results: a null html is an empty payload; a null url has the empty key;
of equal payloads the smallest page_id is the response (all rows that carry
it), null ids only where no other has the payload; payloads under
``min_payload`` bytes are all responses; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import small_batches, stored, table
from lexiscope.session import scratch_path

VOLUME_BYTES = 16 << 20
RANGE_ROWS = 200_000
END = "\r\n\r\n"


def url_key(url: str) -> str:
    """Sort-friendly form of an address: host labels reversed, then path and query, lower-cased."""
    try:
        p = urlsplit(url.strip())
        host, port = p.hostname or "", p.port
    except ValueError:
        return url.strip().lower()
    labels = host[4:] if host.startswith("www.") else host
    key = ",".join(reversed(labels.split(".")))
    key += f":{port}" if port and port not in (80, 443) else ""
    return f"{key}){p.path or '/'}{'?' + p.query if p.query else ''}".lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(page: int | None, url: str | None, date: str, digest: str, size: int, refers_to: int | None,
                revisit: bool) -> str:
    """WARC fields and HTTP head of a record; a response's payload follows it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>",
              f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else size)}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~')}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "WARC/1.1\r\n" + "\r\n".join(fields) + END + http


def records_in(data: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, WARC fields, HTTP fields, payload) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = head_end + 4
        stop = start + int(fields["Content-Length"])
        http_end = data.index(b"\r\n\r\n", start) + 4
        http = dict(x.split(": ", 1) for x in data[start:http_end - 4].decode().split("\r\n")[1:])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not closed")
        yield at, stop + 4 - at, fields, http, data[http_end:stop]
        at = stop + 4


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: Column | None = None, min_payload: int = 0,
                   volume_bytes: int = VOLUME_BYTES) -> None:
    """Write the pages as WARC files under ``path``; without a ``date`` the page id counts seconds from 1970."""
    when = F.timestamp_seconds(F.coalesce(F.col(id_col).cast("long"), F.lit(0))) if date is None else date
    given = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
                         F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    given = given.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    # digests that occur again, written first: small, so the pages need not move to meet them
    again = stored(given.filter(size >= min_payload).groupBy("sha1")
                   .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("sha1", "first"))
    found = given.join(again, "sha1", "left")
    revisit = F.col("first").isNotNull() & (size >= min_payload) & ~F.col("page").eqNullSafe(F.col("first"))
    rows = found.select("page", "url", "html", "date", "sha1", "first", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches):
        volume, held = 0, 0
        for batch in batches:
            page, url, html, date, sha1, first, revisit = (batch.column(k).to_pylist() for k in range(7))
            volumes, records = [], []
            for k in range(batch.num_rows):
                n = len(html[k].encode())
                digest = base64.b32encode(bytes.fromhex(sha1[k])).decode()
                head = record_head(page[k], url[k], date[k], digest, n, first[k], revisit[k])
                if held and held + n > volume_bytes:
                    volume, held = volume + 1, 0
                held += n + len(head)
                volumes.append(volume)
                records.append(head + ("" if revisit[k] else html[k]))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(volumes, pa.int32())],
                                             names=["value", "volume"])

    (rows.mapInArrow(write, "value string, volume int").write.partitionBy("volume")
     .option("lineSep", END).option("compression", "gzip").text(path))


INDEX = ("url_key string, date string, page_id long, run string, offset long, length long, payload_bytes long, "
         "payload_digest string, record_type string, refers_to long")
_INDEX_TYPES = {"string": pa.string(), "long": pa.int64()}
_INDEX = pa.schema([(n, _INDEX_TYPES[t]) for n, t in (f.split(" ") for f in INDEX.split(", "))])
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _page(urn: str | None) -> int | None:
    m = _PAGE.fullmatch(urn or "")
    return int(m[1]) if m else None


def capture_order(row) -> tuple:
    """URL key, time, page (null last), place in its archive."""
    return (row[0], row[1], row[2] is None, row[2] or 0, row[3], row[4])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives under ``path``, one sorted run per file; digests are of the payloads read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                data = zlib.decompress(batch.column(1)[k].as_py(), 31)
                rows = []
                for at, length, fields, http, payload in records_in(data):
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"{name}: the payload at byte {at} does not match its digest")
                    size = int(http["Content-Length"]) if revisit else len(payload)
                    url = fields.get("WARC-Target-URI")
                    rows.append((url_key(url) if url else "", fields["WARC-Date"], _page(fields["WARC-Record-ID"]), name,
                                 at, length, size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                rows.sort(key=capture_order)
                yield from _index_batches(rows)

    return files.mapInArrow(read, INDEX)


def _index_batches(rows, size: int = 10_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _INDEX.types)], schema=_INDEX)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _INDEX.types)], schema=_INDEX)


def loser_tree(runs: list[list[tuple]], key) -> Iterator[tuple]:
    """Merge sorted runs: inner nodes keep the loser of their match, so a step replays one path."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k
    heads = [key(r[0]) if r else None for r in runs]  # None: the run has ended

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    winner = [0] * (2 * k)
    winner[k:] = range(k)
    losers = [0] * k
    for n in range(k - 1, 0, -1):
        a, b = winner[2 * n], winner[2 * n + 1]
        winner[n], losers[n] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while heads[best] is not None:
        yield runs[best][at[best]]
        at[best] += 1
        heads[best] = key(runs[best][at[best]]) if at[best] < len(runs[best]) else None
        n = (best + k) // 2
        while n:
            if beats(losers[n], best):
                best, losers[n] = losers[n], best
            n //= 2


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All capture rows in one order over partitions; ``runs`` should be a stored table, as it is counted.

    Ranges reach down to the single capture, so an address with very many
    captures is cut as well; a task holds about ``range_rows`` rows.
    """
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "date", F.col("page_id").asc_nulls_last(), "run", "offset")

    def merge(batches):
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                by_run.setdefault(row[3], []).append(row)
        for rows in by_run.values():  # a run's slice comes in order; make sure
            rows.sort(key=capture_order)
        yield from _index_batches(loser_tree(list(by_run.values()), capture_order))

    return dealt.mapInArrow(merge, INDEX)


def capture_index(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write the pages under ``path``, read them back and merge the runs."""
    write_archives(pages, path, **options)
    return merge_runs(stored(read_archives(pages.sparkSession, path)))


@small_batches
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(table(spark, sf_dir, "pages"), scratch_path(spark, f"warc-{uuid4().hex}"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date")
