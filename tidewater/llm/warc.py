"""WARC archives of pages, and their index merged from sorted capture runs.

Each record is a gzip member of its own, so that an archive can be sought by an
entry's offset. Reading an archive gives a run: its entries in order, stored so.
The merge cuts the stored runs, in their order, at the borders of key ranges and
into pieces. A range's task gets the pieces in order of their first entries and
merges the runs by a loser tree; it holds only pieces that overlap."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common, loser_tree
from tidewater.llm.common import join_small, small, stored, table

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: Compressed bytes of one archive; the record that passes them is its last.
ARCHIVE_BYTES = 16 << 20
#: Bytes that are decompressed at a time.
CHUNK = 1 << 16
#: The most entries of a key range, on average; entries of a piece of a run; the least
#: pieces that come into a merge together.
RANGE, PIECE, LEAST = 1 << 18, 64, 16
#: Capture time of page 0, where no column gives one; later pages follow by the second.
EPOCH = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"

_KINDS = {"url_key": "string", "captured": "long", "page_id": "long", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "archive": "string", "offset": "long"}
_ENTRY = ", ".join(f"{k} {v}" for k, v in _KINDS.items())
_SCHEMA = pa.schema([(k, pa.string() if v == "string" else pa.int64()) for k, v in _KINDS.items()])
#: A null id stands before all others.
_LOW = -(2**63) - 1


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels in reverse, then path and query; no scheme,
    fragment, port or leading www. Empty for none."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", url or "")
    if not m or not m[1]:
        return url or ""
    host, path = re.match(r"[^/?]*", m[1])[0], re.sub(r"^[^/?]*", "", m[1], count=1)
    host = host.partition(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + path


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(value): the text of each page's record without its closing line feeds.
    Payloads are compared by SHA-256; the one with the greatest page_id is
    written, others refer to it."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long"))
    p = p.withColumn("key", F.when(F.col("n") >= least, F.sha2(F.col("html").cast("binary"), 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url"))))
    first = p.filter(F.col("n") >= least).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "first")
    # a payload that a third of the pages have is no hot task: few payloads are sent to all, many are dealt out
    p = join_small(p, stored(first, "payloads"), ["key"]).withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    at = F.from_unixtime(F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000 + EPOCH, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.col("page_id"), F.lit(">"))), F.lit("")),
        line("WARC-Date", at),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("first"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, block).alias("value"))


def _members(batches):
    """(archive, member): each record as a gzip member without its last byte, which
    is 0: the highest of a size under 16 MB. A larger record has an empty member
    behind it."""
    archive = size = 0
    for batch in small(batches, 200):
        numbers, members = [], []
        for x in batch.column(0):
            data = gzip.compress(x.as_py().encode() + b"\r\n\r\n", 6, mtime=0)
            if data[-1]:
                data += gzip.compress(b"", mtime=0)
            numbers.append(archive)
            members.append(data[:-1])
            size += len(data)
            if size >= ARCHIVE_BYTES:
                archive, size = archive + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(members, pa.binary())], ["archive", "member"])


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Writes pages as gzipped WARC files into a new folder that Spark can write to.
    A task's archives are numbered; a file begins when the one before has
    ARCHIVE_BYTES. Spark's text writer, which writes bytes as they are, puts the
    last byte of each member behind it, and commits whole files only."""
    made = records(pages, **columns).mapInArrow(_members, "archive long, member binary")
    made.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(path)


def read_record(data: bytes, at: int) -> tuple[bytes, int]:
    """(the record whose gzip member begins at this byte, where the next begins)."""
    d, out = zlib.decompressobj(31), []
    try:
        while not d.eof and at < len(data):
            part = data[at : at + CHUNK]
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
    except zlib.error as e:
        raise ValueError(f"no gzip member before byte {at}") from e
    if not d.eof:
        raise ValueError(f"the member before byte {at} is cut off")
    return b"".join(out), at


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record, by its length only. Raises ValueError for
    what is no record."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(head["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) < n or data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)content-length: *([0-9]+)", http)
    head["payload-length"] = length[1].decode() if length else str(len(payload))
    return head, payload


def parse_archive(data: bytes):
    """(offset, headers, payload) of each record of an archive, one at a time."""
    at = 0
    while at < len(data):
        record, after = read_record(data, at)
        if record:
            yield at, *parse_record(record)
        at = after


def _entries(batches):
    """Of each archive its capture run: entries in order of key, time and id. The
    length of a revisit's payload is in its record, as is the digest."""
    from datetime import UTC, datetime

    number = lambda x: int(x.strip("<>").removeprefix(ID)) if x else None
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name, rows = path.as_py(), []
            for at, head, payload in parse_archive(content.as_py()):
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name}: the payload at byte {at} has another digest")
                time = int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                rows.append((url_key(head.get("warc-target-uri")), time, number(head.get("warc-record-id")), head["warc-type"], int(head["payload-length"]), digest, number(head.get("warc-refers-to")), "/".join(name.rsplit("/", 2)[1:]), at))
            rows.sort(key=_key)
            yield from _batches(rows)


def _key(row: tuple) -> tuple:
    return row[0], row[1], _LOW if row[2] is None else row[2]


def _batches(rows: list[tuple]):
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), _SCHEMA.types)], schema=_SCHEMA)


def _rows(batch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns)))


def read_archives(spark, path: str) -> DataFrame:
    """The entries of all archives in a folder, stored: each archive's are a run, in
    order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return stored(files.mapInArrow(_entries, _ENTRY), "runs")


def _pieces(borders: list[tuple]):
    """Of runs as they are stored, pieces that lie in one range of keys: (range, the
    first entry's key, the run, entries)."""

    def run(batches):
        for batch in batches:
            rows, out, begin = _rows(batch), [], 0
            where = [(bisect_right(borders, _key(r)), r[7]) for r in rows]
            for i in range(1, len(rows) + 1):
                # a run may end in the middle of a batch
                if i == len(rows) or i - begin == PIECE or where[i] != where[begin] or _key(rows[i]) < _key(rows[i - 1]):
                    part = batch.slice(begin, i - begin)
                    part = pa.RecordBatch.from_arrays(part.columns, schema=_SCHEMA)
                    out.append((where[begin][0], *rows[begin][:3], rows[begin][7], part.serialize().to_pybytes()))
                    begin = i
            c = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["range", "url_key", "captured", "page_id", "run", "entries"])

    return run


class _Cursor:
    """Where the merge stands in a piece of a run."""

    def __init__(self, order: tuple, number: int, rows: list[tuple]):
        self.order, self.number, self.rows, self.place = order, number, rows, 0

    def items(self):
        for j in range(self.place, len(self.rows)):
            yield (self.number, _key(self.rows[j]), self.order, j, self)


def merged(pieces):
    """The entries of pieces (range, first key, run, entries), which come in order of
    range and first key, in one order; equal keys in order of runs.

    One loser tree holds a cursor for each piece that has begun. It runs until it comes
    to the first key of the next piece; then that piece, and a share of those behind it
    that follows the cursors held, come in. So each entry passes the tree once, however
    many runs overlap, and the tree is set up anew once for as many pieces as a share of
    its cursors."""
    source, live, loaded = iter(pieces), [], 0
    ahead = next(source, None)
    while ahead is not None or live:
        for _ in range(max(LEAST, len(live) // 4)):
            if ahead is None:
                break
            number, _, run, rows = ahead
            live.append(_Cursor((run, loaded), number, rows))
            loaded, ahead = loaded + 1, next(source, None)
        bound = None if ahead is None else (ahead[0], ahead[1])
        for item in loser_tree.merge([c.items() for c in live]):
            if bound is not None and item[:2] >= bound:
                break
            cursor = item[4]
            cursor.place = item[3] + 1
            yield cursor.rows[item[3]]
        live = [c for c in live if c.place < len(c.rows)]


def _merge(batches):
    def pieces():
        for batch in batches:
            for number, url, captured, page, run, data in zip(*(batch.column(i) for i in range(6))):
                rows = _rows(pa.ipc.read_record_batch(pa.py_buffer(data.as_py()), _SCHEMA))
                yield number.as_py(), _key((url.as_py(), captured.as_py(), page.as_py())), run.as_py(), rows

    ready = []
    for row in merged(pieces()):
        ready.append(row)
        if len(ready) == 10_000:
            yield from _batches(ready)
            ready = []
    yield from _batches(ready)


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries of stored runs in one order of url_key, captured and page_id (nulls
    first): the capture history of each url, over the result's partitions in turn.

    Borders of ranges are drawn from a sample of all entries, about eight for each
    range; they may stand within one url's captures. Only the borders are sent to the
    driver and out; they number one for RANGE entries."""
    n, tasks = runs.count(), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, n // RANGE, min(tasks, n >> 10))
    every = max(1, n // (8 * ranges))
    drawn = runs.filter(F.pmod(F.xxhash64("archive", "offset"), F.lit(every)) == 0).select("url_key", "captured", "page_id").collect() if ranges > 1 else []
    keys = sorted(_key(tuple(r)) for r in drawn)
    borders = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    pieces = runs.select(*_KINDS).mapInArrow(_pieces(borders), "range long, url_key string, captured long, page_id long, run string, entries binary")
    order = ["range", "url_key", "captured", "page_id"]
    return pieces.repartitionByRange(ranges, "range").sortWithinPartitions(*order).mapInArrow(_merge, _ENTRY)


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Writes a WARC record for each row of pages, reads the archives back and
    returns their merged index: url_key, captured (seconds), page_id, record_type
    (response or revisit), payload_bytes and payload_digest (SHA-1) of the full
    payload, refers_to, archive, offset (of the record's gzip member).

    Null html: an empty payload. Null url: a record without target, key empty.
    Null page_id: a record without id, never referred to. Rows with equal
    payloads and the same, greatest page_id are all responses. A very long page is
    one record, taken whole. No rows: none.
    """
    spark = pages.sparkSession
    path = f"{common.work_dir(spark)}/tidewater/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    common._written.append((spark, path))
    if not pages.isEmpty():
        return merge_index(read_archives(spark, path))
    return spark.createDataFrame([], _ENTRY)


def op4(spark, sf_dir):
    out = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
f AS (SELECT sha256(html) AS k, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY ALL),
u AS (SELECT p.*, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND first <> page_id THEN first END AS refers_to,
  CASE WHEN coalesce(rest, '') = '' THEN coalesce(url, '') ELSE array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(rest, '^([^/?:]*)', 1)), '^www[.]', ''), '.')), ',')
    || ')' || regexp_extract(rest, '^[^/?]*(.*)$', 1) END AS url_key,
  (page_id % 1000000000 + 1577836800)::BIGINT AS captured
FROM u LEFT JOIN f ON f.k = sha256(u.html)
"""
