"""WARC archives with a two-level capture index.

Pages are written as gzipped WARC records, a file for each partition, each record its own gzip member. The
index has a line for each capture, keyed by the URL with its host reversed. Lines are sorted over all shards
and packed into compressed blocks; a shard's sparse directory holds the first key and the place of each block,
and the first key of each shard routes a look-up. A look-up binary-searches the directory, reads one block's
byte range, searches the block, and reads one record's byte range.

Files are written through pyarrow's file systems into a folder that all executors share. A file's content and
name follow from its partition alone and it appears by renaming, so a task that runs again replaces it with
the same bytes."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import fresh_path, materialize, partitions, with_fields
from ledgerloom.llm.url_filters import host_of

#: Payloads from this size on that repeat become revisit records.
REVISIT_BYTES = 1000
BLOCK_LINES = 256
#: Records of one file that lie within so many bytes are fetched by one read.
READ_GAP = 1 << 16
DATE = "2020-01-01T00:00:00Z"
_CAPTURE = "key string, file string, offset long, length long"


def _put(root: str, name: str, data: bytes) -> None:
    """Writes a file and lets it appear whole."""
    store, path = pafs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


class _Writer:
    """A file written as it grows; it appears under its name at the end."""

    def __init__(self, root: str, name: str) -> None:
        self.store, self.path = pafs.FileSystem.from_uri(root)
        self.store.create_dir(self.path, recursive=True)
        self.name, self.own, self.offset = name, f"{self.path}/.{name}.{uuid.uuid4().hex}", 0
        self.out = self.store.open_output_stream(self.own)

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.out.write(data)
        self.offset += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.own, f"{self.path}/{self.name}")


def _line(value: str) -> str:
    """A header's value without line ends."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzipped record: a response with its payload, or a revisit with the HTTP header alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    head += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        other = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{other}>", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a gzipped record; the payload's digest is verified where it is there. The HTTP
    header's content length is under `size`."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    headers["size"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]
    if headers["WARC-Type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
        raise ValueError("a payload's digest is wrong")
    return headers, payload


def capture_key(url: Column, page_id: Column, digest: Column) -> Column:
    """Reversed host, the rest of the URL, then page and digest, which tell captures of one URL apart."""
    host = host_of(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1)
    surt = F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"\s", "%20")
    page = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat_ws(" ", surt, F.coalesce(page, F.lit("")), digest)


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under root; returns the captures (key, file,
    offset, length), read back from a table.

    Of records with equal payloads of REVISIT_BYTES or more that with the largest page_id is the response and
    the others revisit it (rows that repeat that page_id are responses too, as are those of a payload whose
    page_ids are all null); html null: empty payload."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    marked = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    key = capture_key(F.col("url"), F.col("page_id"), F.col("digest"))
    ready = marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to", key.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        out = None
        for b in batches:
            out = out or _Writer(root, name)
            cols = [b.column(i).to_pylist() for i in range(7)]
            places = [out.add(record(p, u, x, n, d, r)) for p, u, x, n, d, r in zip(*cols[:6], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(6), pa.array([name] * len(places), pa.string()), pa.array([a for a, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())], ["key", "file", "offset", "length"])
        if out:
            out.close()

    # The order within a file follows from the rows, so that a task run again writes the same offsets.
    return materialize(ready.sortWithinPartitions("key").mapInArrow(run, _CAPTURE), "captures")


def write_index(captures: DataFrame, root: str) -> list[tuple[str, int]]:
    """Writes the sorted index under root, a shard for each range of keys; returns (first key, shard) in
    order, one for each shard and so as many as the session has shuffle partitions at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        out, directory, lines = None, [], []

        def flush() -> None:
            nonlocal lines
            block = "\n".join("\t".join(map(str, x)) for x in lines).encode("utf-8", "surrogatepass")
            directory.append((lines[0][0], *out.add(zlib.compress(block, 6))))
            lines = []

        for b in batches:
            for x in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                out = out or _Writer(root, f"index-{shard:06d}.z")
                lines.append(x)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            _put(root, f"index-{shard:06d}.dir", zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([shard], pa.int32())], ["key", "shard"])

    n = partitions(captures.sparkSession)
    shards = captures.repartitionByRange(n, "key").sortWithinPartitions("key", "file", "offset").mapInArrow(run, "key string, shard int")
    return sorted(((r.key, r.shard) for r in materialize(shards, "shards").collect()), key=lambda x: x[0].encode("utf-8", "surrogatepass"))


class Index:
    """Look-ups in one shard; the last block read is kept, as look-ups come in order."""

    def __init__(self, root: str, shard: int) -> None:
        self.store, path = pafs.FileSystem.from_uri(root)
        with self.store.open_input_stream(f"{path}/index-{shard:06d}.dir", compression=None) as f:
            directory = json.loads(zlib.decompress(f.read()))
        self.firsts = [d[0].encode("utf-8", "surrogatepass") for d in directory]
        self.places = [(d[1], d[2]) for d in directory]
        self.file = self.store.open_input_file(f"{path}/index-{shard:06d}.z")
        self.held, self.keys, self.lines = -1, [], []

    def find(self, key: bytes) -> tuple[str, int, int]:
        """(file, offset, length) of a capture."""
        block = bisect.bisect_right(self.firsts, key) - 1
        if block != self.held:
            offset, length = self.places[max(block, 0)]
            text = zlib.decompress(self.file.read_at(length, offset))
            self.lines = [x.split(b"\t") for x in text.split(b"\n")]
            self.keys = [x[0] for x in self.lines]
            self.held = block
        at = bisect.bisect_left(self.keys, key)
        if at == len(self.keys) or self.keys[at] != key:
            raise KeyError(key)
        _, file, offset, length = self.lines[at]
        return file.decode(), int(offset), int(length)


def fetch(root: str, places: list[tuple[str, int, int]]) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of each place, file by file and with one read for neighbours."""
    store, path = pafs.FileSystem.from_uri(root)
    order = sorted(range(len(places)), key=lambda i: places[i])
    at = 0
    while at < len(order):
        file, begin, length = places[order[at]]
        end, stop = begin + length, at + 1
        while stop < len(order) and places[order[stop]][0] == file and places[order[stop]][1] <= end + READ_GAP and places[order[stop]][1] - begin < 1 << 23:
            end = max(end, places[order[stop]][1] + places[order[stop]][2])
            stop += 1
        with store.open_input_file(f"{path}/{file}") as f:
            data = f.read_at(end - begin, begin)
        for i in order[at:stop]:
            yield i, data[places[i][1] - begin : places[i][1] - begin + places[i][2]]
        at = stop


def look_up(wanted: DataFrame, archives: str, index: str, shards: list[tuple[str, int]]) -> DataFrame:
    """wanted (page_id, key): reads each capture back through the index: (page_id, payload_bytes,
    payload_digest, record_type, refers_to)."""
    firsts = [k.encode("utf-8", "surrogatepass") for k, _ in shards]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shards[max(bisect.bisect_right(firsts, k.encode("utf-8", "surrogatepass")) - 1, 0)][1] for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32())], ["page_id", "key", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index | None = None
        number = None
        for b in batches:
            for begin in range(0, b.num_rows, 512):
                part = b.slice(begin, 512)
                places = []
                for key, shard in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if own is None or shard != number:
                        own, number = Index(index, shard), shard
                    places.append(own.find(key.encode("utf-8", "surrogatepass")))
                rows: list = [None] * len(places)
                for i, member in fetch(archives, places):
                    head, payload = parse(member)
                    plain = head["WARC-Type"] == "response"
                    rows[i] = (len(payload) if plain else int(head["size"]), hashlib.sha1(payload).hexdigest() if plain else head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], None if plain else int(head["WARC-Refers-To-Page"]))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names)

    dealt = wanted.select("page_id", "key").mapInArrow(route, with_fields(wanted, "page_id", "key string, shard int"))
    placed = dealt.repartition(partitions(wanted.sparkSession), "shard").sortWithinPartitions("shard", "key")
    return placed.mapInArrow(run, with_fields(wanted, "page_id", "payload_bytes long, payload_digest string, record_type string, refers_to long"))


def archive_and_read(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes pages as archives with an index under root, then reads every page's record back through it.
    An empty table gives an empty result; repeated rows stay; further columns are not archived."""
    root = root or fresh_path(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, f"{root}/archives"), f"{root}/index")
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    wanted = pages.select("page_id", capture_key(F.col("url"), F.col("page_id"), digest).alias("key"))
    return look_up(wanted, f"{root}/archives", f"{root}/index", shards)


SQL = f"""with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= {REVISIT_BYTES} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when keeper is null or keeper = page_id then 'response' else 'revisit' end as record_type,
case when keeper <> page_id then keeper end as refers_to from p left join k using (payload_digest)"""
