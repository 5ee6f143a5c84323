"""WARC archives and their capture index.

Pages are written as gzip-compressed WARC records, archive files of bounded size, into the shared folder; a page whose payload
another one also has is a revisit of the last of them. Reading an archive back gives a run of index entries, sorted by URL key
and time. The runs are dealt out by key ranges, and each range merges the slices of all runs with a loser tree that reads them
from a spool on disk, so the captures come out in global order whatever the number and size of the runs.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, join_by_hot_key, staged, work_path

#: An archive file is closed when it has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Up to so many revisits are broadcast (16 MB); beyond it pages and revisits are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A merge keeps runs in memory up to so many bytes, the rest in a file.
SPOOL_BYTES = 32 << 20
SPOOL_ROWS = 256
#: Runs that one loser tree merges; more are merged in several passes.
FAN_IN = 128
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host parts from the top-level domain down, then path and query; no scheme, fragment, www or port 80/443."""
    text = (url or "").strip().lower()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    if not host:
        return text
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def captured(page_id: int | None) -> datetime:
    """Capture time where the table has none: the pages one second apart, by id."""
    try:
        return EPOCH + timedelta(seconds=page_id or 0)
    except OverflowError:
        return EPOCH


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, as a gzip member of its own."""
    name = lambda x: f"<urn:x-page:{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head += [f"WARC-Date: {captured(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of every gzip member of a file; holds one member and a block of the file."""
    at, rest, done = 0, b"", False
    while True:
        unpacker, content, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest and not done:
                rest = stream.read(size)
                done = not rest
            if not rest:
                if used:
                    raise EOFError(f"the archive ends within the record at {at}")
                return
            content.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        yield at, used, b"".join(content)
        at += used


def parsed(content: bytes) -> dict[str, object]:
    """The fields of a record's header, in lower case, with its block as "block"."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields: dict[str, object] = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.lower()] = v.strip()
    fields["block"] = rest[: int(fields["content-length"])]
    return fields


def page_of(name: object) -> int | None:
    x = str(name).strip("<>").rpartition(":")[2] if name else "none"
    return None if x == "none" else int(x)


def entry(content: bytes) -> tuple:
    """(url key, time, page_id, payload bytes, digest, type, refers_to) of a record; a response's payload is digested again."""
    f = parsed(content)
    kind, sha, n = f["warc-type"], str(f["warc-payload-digest"]).removeprefix("sha1:"), int(f["x-payload-length"])
    if kind == "response":
        payload = f["block"].partition(b"\r\n\r\n")[2]
        if len(payload) != n or digest(payload) != sha:
            raise ValueError(f"record {f['warc-record-id']} does not hold the payload that it names")
    time = str(f["warc-date"]).translate(str.maketrans("", "", "-:TZ"))
    return url_key(f.get("warc-target-uri")), time, page_of(f["warc-record-id"]), n, sha, kind, page_of(f.get("warc-refers-to"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload, of at least so many bytes, another page with a larger id also has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha1(x).digest() for x in data], pa.binary()), pa.array(list(map(len, data)), pa.int64())], ["page_id", "sha1", "bytes"])

    rows = pages.select("page_id", "html").mapInArrow(run, "page_id long, sha1 binary, bytes long").where(F.col("bytes") >= least_bytes)
    rows = staged(rows, "digests")
    groups = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1")
    return join_by_hot_key(rows, groups, "sha1", "n", rows.count()).where("refers_to is not null and not page_id <=> refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, revisit: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages as records under the folder; one row per archive file: path, records, bytes. Files of attempts that
    did not succeed are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        out, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py())
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    few = revisit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.join(F.broadcast(revisit) if few else revisit, "page_id", "left").select("page_id", "url", "html", "refers_to")
    return rows.mapInArrow(run, "path string, records long, bytes long")


ENTRY = "run string, seq long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Index entries of the archive files (path): each file is a run, numbered in its own order of URL key, time and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    rows = [(*entry(content), at, length) for at, length, content in members(stream)]
                rows.sort(key=order)
                cols = list(zip(*rows)) if rows else [[]] * 9
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *[pa.array(x, t) for x, t in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ENTRY.split(", ")])

    # a task for each file, however few bytes their names have
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, ENTRY)


def order(row: tuple) -> tuple:
    """Sort key of an entry (url key, time, page_id, ...)."""
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each row out costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list[tuple | None] = [None] * self.k
        self.keys: list[tuple | None] = [None] * self.k
        for i in range(len(runs)):
            self.pull(i)
        self.tree = [-1] * self.k
        self.tree[0] = self.play(1) if self.k > 1 else 0

    def pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes out before run b's; a run at its end loses, and of equal heads the earlier run's wins."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        winner, self.tree[node] = (a, b) if self.beats(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        winner = self.tree[0]
        while self.heads[winner] is not None:
            yield self.heads[winner]
            self.pull(winner)
            node = (winner + self.k) // 2
            while node:
                if self.beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2


class Spool:
    """Runs kept in a temporary file beyond SPOOL_BYTES, in blocks of SPOOL_ROWS rows. A merge holds a block of FAN_IN runs,
    however many runs there are."""

    def __init__(self, memory: int = SPOOL_BYTES, fan_in: int = FAN_IN):
        self.fan_in = fan_in
        self.file = tempfile.SpooledTemporaryFile(max_size=memory)
        self.blocks: dict[str, list[int]] = {}
        self.rows: list[tuple] = []
        self.run: str | None = None

    def add(self, run: str, row: tuple) -> None:
        if self.rows and (run != self.run or len(self.rows) >= SPOOL_ROWS):
            self.flush()
        self.run = run
        self.rows.append(row)

    def flush(self) -> None:
        if self.rows:
            self.blocks.setdefault(self.run, []).append(self.file.seek(0, 2))
            pickle.dump(self.rows, self.file, protocol=5)
            self.rows = []

    def read(self, run: str) -> Iterator[tuple]:
        for at in self.blocks[run]:
            self.file.seek(at)
            yield from pickle.load(self.file)

    def merged(self) -> Iterator[tuple]:
        self.flush()
        runs, passes = sorted(self.blocks), 0
        while len(runs) > self.fan_in:
            # neighbours are merged to runs of the next pass, which keep their order: of equal rows the earlier run's come first
            passes, merged = passes + 1, []
            for lo in range(0, len(runs), self.fan_in):
                some = runs[lo : lo + self.fan_in]
                merged.append(f"pass {passes} run {lo:012d}")
                for row in LoserTree([self.read(x) for x in some], order):
                    self.add(merged[-1], row)
                self.flush()
                for x in some:
                    del self.blocks[x]
            runs = [x for x in merged if x in self.blocks]
        yield from LoserTree([self.read(x) for x in runs], order)
        self.file.close()


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in global order of URL key, time and page: the partitions follow each other, and place counts in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spool, schema, part, place = Spool(), None, TaskContext.get().partitionId(), 0
        for batch in batches:
            schema = batch.schema
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                spool.add(row[0], (*row[2:], row[0]))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*held))
            arrays = [pa.array(x, schema.field(i + 2).type) for i, x in enumerate(cols[:-1])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[-1], pa.string()), pa.array([part] * len(held), pa.int64()), pa.array(range(place, place + len(held)), pa.int64())], [*[f.name for f in schema][2:], "archive", "part", "place"])

        for row in spool.merged():
            held.append(row)
            if len(held) == 10_000:
                yield out()
                place, held = place + len(held), []
        if held:
            yield out()

    named = ", ".join(ENTRY.split(", ")[2:]) + ", archive string, part long, place long"
    return runs.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run", "seq").mapInArrow(run, named)


def capture_index(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives all pages, reads the archives back and returns their merged index, one row per page: url_key, captured,
    page_id, payload_bytes, payload_digest, record_type, refers_to, offset, length, archive, part, place.

    pages has page_id, url and html; other columns are ignored. A null html is an empty payload, a null url an empty key. Of
    records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is the response and the
    others revisit it; smaller ones are all responses. Repeated rows are records each, and of equal page_ids with equal
    payloads all are what one of them is. A row without page_id is a response unless its payload is another page's.
    Archives stay in the folder (by default one in the shared folder); an empty table makes none and gives no rows.
    """
    pages = columns(pages, "page_id", "url", "html")
    folder = folder or work_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = ("file:" if folder.startswith("file:") else "file://") + folder.removeprefix("file:")
    archives = staged(write_archives(pages, staged(revisits(pages, least_bytes), "revisits"), folder), "archives")
    return merge_runs(staged(read_runs(archives, folder), "runs"))
