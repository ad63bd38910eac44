"""WARC archives with a merged capture index.

Records are written as WARC/1.1 by Spark's own text writer, so any file system it knows
will do: each record is a gzip member of its own, and an empty member stands after it
as the writer's line separator. Files are thus plain `.warc.gz` data, offsets are those of
the stored bytes, and Spark's text reader splits them between records: no file is ever held
whole. Of equal payloads the one with the smallest id is a response, the others are
revisits of it. Reading tasks sort their captures into runs of bounded size by URL key and
time; the runs are dealt by ranges of that key, and each range spools its slices of all runs
to disk and merges them by a loser tree, which gives the captures of every URL in one
global order.

Defined results: null html is an empty payload, a null URL is written as `urn:none`; payloads
under `least` bytes are all responses; a null id sorts after all others; of rows that repeat id and
payload one is the response, and the others are revisits of the same id; other columns are not read;
an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.llm.common import arrow_rows, free, fresh_path, partitions, written

LEAST_BYTES = 100
#: WARC-Date of captures whose table has no time.
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: a gzip member of nothing. No record can hold it: its second byte is not UTF-8, and deflated data hold it by chance once in 2^160 places.
BORDER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)
#: Captures of a run at most.
RUN_ROWS = 200_000


def _uuid(*columns) -> F.Column:
    h = F.md5(F.concat_ws(":", F.lit("page"), *[F.coalesce(c.cast("string"), F.lit("none")) for c in columns]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            packed = []
            for raw in batch.column(0).slice(start, 64):
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed.append(c.compress(raw.as_buffer()) + c.flush())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, least: int = LEAST_BYTES) -> None:
    time = F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(EPOCH)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.coalesce(time, F.lit(EPOCH)).alias("time"),
    )
    # A row's number tells rows apart that repeat everything; it is fixed by being written.
    rows = written(rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")), "warc-rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    holders = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(first).alias("h"), F.count("*").alias("n")).where("n > 1")
    holders = written(holders.select("digest", "bytes", F.col("h.id").alias("holder"), F.col("h.at").alias("holder_at")), "warc-holders")
    full = rows.join(holders.hint("merge"), ["digest", "bytes"], "left")
    eol = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("bytes"), F.lit(eol + eol))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{eol}WARC-Record-ID: "), _uuid(F.col("id"), F.col("at")),
        F.lit(f"{eol}WARC-Date: "), F.col("time"), F.lit(f"{eol}WARC-Target-URI: "), F.col("url"),
        F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit(f"{eol}X-Page-ID: "), F.col("id"))),
        F.lit(f"{eol}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{eol}WARC-Profile: {PROFILE}{eol}WARC-Refers-To: "), _uuid(F.col("holder"), F.col("holder_at")))).otherwise(""),
        F.when(F.col("revisit") & F.col("holder").isNotNull(), F.concat(F.lit(f"{eol}X-Refers-To-Page: "), F.col("holder"))).otherwise(""),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "), F.octet_length("block").cast("string"), F.lit(eol + eol),
    )
    revisit = F.coalesce(F.col("holder_at") != F.col("at"), F.lit(False))
    records = full.withColumn("revisit", revisit).withColumn("block", block).select(F.encode(F.concat(head, "block", F.lit(eol + eol)), "UTF-8").alias("value"))
    packed = records.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    packed.write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", BORDER.decode("latin-1")).text(folder)
    free(rows, holders)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def url_key(url: str) -> str:
    """Host labels from the top, then path and query, in lower case: captures of a site sort together."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def record(content: bytes) -> tuple[dict[bytes, bytes], memoryview]:
    """Headers and block of the record that a gzip member holds."""
    raw = gzip.decompress(content)
    end = raw.find(b"\r\n\r\n") + 4
    headers = {k.lower(): v for k, v in _HEADER.findall(raw, raw.find(b"\r\n") + 2, end - 2)}
    if end < 4 or not raw.startswith(b"WARC/1.") or b"content-length" not in headers:
        raise ValueError("no WARC record")
    stop = end + int(headers[b"content-length"])
    if raw[stop:] != b"\r\n\r\n":
        raise ValueError("the record has no end")
    return headers, memoryview(raw)[end:stop]


CAPTURE = pa.schema([
    ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("file", pa.string()), ("split", pa.int64()), ("within", pa.int64()), ("length", pa.int64()), ("run", pa.int64()), ("seq", pa.int64()),
])
_CAPTURE = "url_key string, time string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean, file string, split long, within long, length long, run long, seq long"


def _order(c: tuple) -> tuple:
    """Of a capture: URL key, time, identifier, place."""
    return c[0], c[1], c[2] is None, c[2] or 0, c[9], c[10], c[11]


def _captured(content: bytes) -> tuple:
    h, block = record(content)
    head_end = bytes(block[:4096]).index(b"\r\n\r\n") + 4
    http = {k.lower(): v for k, v in _HEADER.findall(bytes(block[:head_end]))}
    kind = h[b"warc-type"].decode()
    told = h[b"warc-payload-digest"].decode().removeprefix("sha256:")
    n = int(http[b"content-length"])
    payload = block[head_end:]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else told
    url = h[b"warc-target-uri"].decode("utf-8", "replace")
    page, refers = h.get(b"x-page-id"), h.get(b"x-refers-to-page")
    good = digest == told and (len(payload) == n if kind == "response" else not len(payload))
    return url_key(url), h[b"warc-date"].decode(), int(page) if page else None, url, kind, len(payload) if kind == "response" else n, digest, int(refers) if refers else None, good


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of a task's part of the files as sorted runs; within: bytes before a record in its split of a file."""
    add, take = arrow_rows(CAPTURE)
    run, found = TaskContext.get().partitionId() << 24, []
    here, within = None, 0

    def flush():
        found.sort(key=_order)
        for seq, c in enumerate(found):
            add(*c, run, seq)
            yield from take()
        found.clear()

    for batch in batches:
        for path, split, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
            if (path, split) != here:
                here, within = (path, split), 0
            content = content.as_py()
            found.append((*_captured(content), path, split, within, len(content)))
            within += len(content) + len(BORDER)
            if len(found) == RUN_ROWS:
                yield from flush()
                run += 1
    yield from flush()
    yield from take(True)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * k
        self.winner = self._build(1) if k else -1

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.keys[i], self.keys[j]
        return b is None or a is not None and (a, i) <= (b, j)

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        self.losers[node], win = (b, a) if self._beats(a, b) else (a, b)
        return win

    def __iter__(self):
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            node = (i + k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


class Spool:
    """Runs' batches in a file that vanishes with the task; one batch of a run is in memory at a time."""

    def __init__(self):
        self.file, self.places = tempfile.TemporaryFile(), {}

    def put(self, run: int, batch: pa.RecordBatch) -> None:
        raw = batch.serialize()
        self.places.setdefault(run, []).append((self.file.seek(0, 2), len(raw)))
        self.file.write(raw)

    def rows(self, run: int, schema: pa.Schema) -> Iterator[tuple]:
        for at, n in self.places[run]:
            self.file.seek(at)
            yield from zip(*(c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(self.file.read(n)), schema).columns))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the slices of runs in a range, which come run by run; adds the range and the place in it."""
    spool = Spool()
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            ids, start = batch.column(13).to_pylist(), 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[start]:
                    spool.put(ids[start], batch.slice(start, i - start))
                    start = i
    add, take = arrow_rows(CAPTURE.append(pa.field("part", pa.int32())).append(pa.field("at", pa.int64())))
    part = TaskContext.get().partitionId()
    for at, c in enumerate(LoserTree([spool.rows(r, CAPTURE) for r in sorted(spool.places)], _order)):
        add(*c, part, at)
        yield from take()
    yield from take(True)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All captures with file, offset and length of their gzip member; (part, at) is their global order by URL key and time."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BORDER.decode("latin-1")).text(folder)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    runs = written(lines.mapInArrow(_runs, _CAPTURE), "warc-runs")
    # Splits of a file follow each other: the bytes of those before one are where it starts. A row for each split.
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("file", "split").agg(F.sum(F.col("length") + len(BORDER)).alias("n")).select("file", "split", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    placed = runs.join(written(starts, "warc-starts").hint("merge"), ["file", "split"])
    dealt = placed.select(*[f for f in CAPTURE.names if f != "within"], (F.col("start") + F.col("within")).alias("within")).select(*CAPTURE.names)
    dealt = dealt.repartitionByRange(partitions(spark, runs), "url_key", "time", F.col("page_id").asc_nulls_last(), "file", "within").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(_merge, _CAPTURE + ", part int, at long").withColumnRenamed("within", "offset").drop("split", "run", "seq")


def archive_digests(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and gives the captures in their merged order."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    write_archives(pages, folder)
    return read_index(spark, folder)
