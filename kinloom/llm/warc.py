"""WARC archives and their merged capture index.

Writing: one WARC/1.1 record a page, one gzip member a record, so that a stored
offset can be sought. (A record of 16 MB or more takes several members, in a
row.) Spark's own text sink writes the members: any file system Spark knows, with
its commit protocol, so a lost executor leaves no partial file. The sink's line
separator is the zero byte that ends every member below 16 MB. A file ends when
its members exceed ``FILE_BYTES``.

Identical payloads are archived once: of records with equal payloads of at least
``min_bytes`` bytes, that with the largest page_id is the response, the others
are revisits without a body that name it. The choice is a partial aggregate by
digest (a maximum), never a gathered group; only digests that occur more than
once are joined back, and that join splits hot digests (AQE).

Reading: every archive is parsed by Content-Length; each task's captures are
sorted by (URL key, timestamp, page), which spills where it must, and written: a
run. Bounds that cut all runs into ranges come from a sample of keys that the
executors put in order; a hot URL is split. A range gets
its part of every run as sorted blocks of at most ``BLOCK_ROWS`` captures, in the
order of the blocks' first keys, and merges the runs with one loser tree: one
comparison per level of the tree for every capture. A block is read only when
the merge reaches its first key, so a task holds the open blocks, not the range.
More than ``FAN_IN`` runs are merged in passes of so many at a time.
Ranges and their order together are the globally ordered capture history.

A null html is an empty payload; a null url has the key ``-``; a record of a null
page_id is a revisit if a payload equal to its own has an id, else a response;
rows with the same page_id are records of their own (of equal payloads, those of
the largest id are all responses). Further columns, whatever their names, are not
read. An empty table writes an empty archive folder and gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import map_arrow, shared_folder, stored
from kinloom.operators.golden import placed

#: Compressed bytes of an archive, about: a file takes the record that crosses this.
FILE_BYTES = 64 << 20
#: Captures of this table carry no time; they get consecutive seconds from here on.
EPOCH = 1_700_000_000
#: Captures of a block, of a range, and sampled keys of a range, about.
BLOCK_ROWS, RANGE_ROWS, SAMPLED = 4096, 500_000, 40
#: Runs that are merged at once.
FAN_IN = 256
#: Repeated digests (40 bytes each) that are broadcast at most.
BROADCAST_DIGESTS = 200_000
#: Members end with the high byte of their size, which is 0 below this.
_MEMBER_BYTES = 1 << 24
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CAPTURE = "urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_KEY = ("urlkey", "timestamp", "page_id")


def digest_of(payload: Column) -> Column:
    """SHA-1 of text as UTF-8, in base32: 20 bits, five hexadecimal digits, make four characters."""
    sha = F.sha1(payload)
    bits = [F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letter = lambda x, k: F.substr(F.lit(_BASE32), F.shiftright(x, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*(letter(x, k) for x in bits for k in range(4)))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, n_bytes, and refers_to: null for a response."""
    text = F.coalesce("html", F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), F.sha1(text).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    again = hashed.where(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "last")
    again = stored(again)
    if again.count() <= BROADCAST_DIGESTS:  # else a shuffle join, whose hot digests AQE splits
        again = F.broadcast(again)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return hashed.join(again, "sha", "left").select("page_id", "url", "html", digest_of(F.col("html")).alias("digest"), "n_bytes", refers.alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_text(epoch: int = EPOCH) -> Column:
    """The record of a row of plan_records()."""
    date = F.date_format(F.timestamp_seconds(F.lit(epoch) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = lambda k: F.concat(F.lit("<urn:page:"), k, F.lit(">"))
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(key)),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", name(F.col("refers_to").cast("string"))), _line("X-Payload-Length", F.col("n_bytes").cast("string")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
        F.lit("\r\n\r\n"),
    )


def members(record: bytes) -> bytes:
    """A record as gzip members, the last of them below 16 MB and so with a zero at its end, which is left out."""
    out = []
    for at in range(0, max(1, len(record)), _MEMBER_BYTES - 1):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[at : at + _MEMBER_BYTES - 1]) + packer.flush())
    return b"".join(out)[:-1]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """pages (page_id, url, html) as WARC files below path."""

    def run(batches):
        volume = size = 0
        for batch in batches:
            out = [members(x.encode("utf-8", "surrogatepass")) for x in batch.column("record").to_pylist()]
            at = []
            for x in out:
                at.append(volume)
                size += len(x) + 1
                if size >= file_bytes:
                    volume, size = volume + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], ["volume", "value"])

    records = map_arrow(plan_records(pages, min_bytes).select(record_text().alias("record")), run, "volume int, value binary")
    records.select("volume", F.col("value").cast("string").alias("value")).write.partitionBy("volume").option("lineSep", "\0").option("compression", "none").text(path)


def surt(url: str) -> str:
    """The sort key of a URL: host labels reversed, then the path and query."""
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url or "-"
    if not host:
        return url or "-"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + f"{port})" + rest.lower()


_HEAD_END = b"\r\n\r\n"


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Each record's headers (names in lower case), body, offset and length, in the order of the file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.find(_HEAD_END, at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.decode("ascii", "replace").strip().lower()] = value.strip().decode("utf-8", "surrogatepass")
        body, size = stop + 4, int(head["content-length"])
        end = body + size
        if data[end : end + 4] != _HEAD_END:
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, bytes(view[body:end]), at, end + 4 - at
        at = end + 4


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _rows(table: list[tuple]) -> pa.RecordBatch:
    kinds = [("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    columns = list(zip(*table)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def _order(row: tuple) -> tuple:
    return (row[0], row[1], -1 if row[2] is None else row[2])


#: Compressed bytes that a reader hands to the decompressor at once.
STEP = 64 << 10


def _member(view: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and where it ends. It is fed in pieces, so that what follows the member is not copied."""
    unpacker, out = zlib.decompressobj(31), []
    while not unpacker.eof and at < len(view):
        piece = view[at : at + STEP]
        out.append(unpacker.decompress(piece))
        at += len(piece) - len(unpacker.unused_data)
    return b"".join(out), at


def parse_members(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """The records of a gzip archive, with the offsets and lengths of their members in the file. Time follows the archive's size."""
    at, view = 0, memoryview(data)
    while at < len(data):
        begin = at
        record, at = _member(view, at)
        stop = record.find(_HEAD_END)
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", record[: stop + 2]) if stop >= 0 else None
        if size is not None:
            parts, have, need = [record], len(record), stop + 8 + int(size[1])
            while have < need and at < len(data):
                more, at = _member(view, at)
                parts.append(more)
                have += len(more)
            record = b"".join(parts)
        (head, body, _, _), *others = parse_archive(record)
        if others:
            raise ValueError(f"two records in the member at byte {begin}")
        yield head, body, begin, at - begin


def _capture(name: str, head: dict[str, str], body: bytes, at: int, size: int) -> tuple:
    """The capture of a record. The digest is of the bytes that were read; a revisit's is the one it states."""
    url, revisit = head.get("warc-target-uri", ""), head["warc-type"] == "revisit"
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = stated if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
    if digest != stated:
        raise ValueError(f"{name}, byte {at}: the payload does not have its digest")
    stamp = re.sub(r"\D", "", head["warc-date"])
    return (surt(url), stamp, _page(head["warc-record-id"]), url, int(head["x-payload-length"]) if revisit else len(body), digest, head["warc-type"], _page(head.get("warc-refers-to")), name, at, size)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path; plain archives are read too."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for record in (parse_members if data[:2] == b"\x1f\x8b" else parse_archive)(data):
                    rows.append(_capture(name, *record))
                    if len(rows) == BLOCK_ROWS:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return map_arrow(files, run, CAPTURE)


def sorted_runs(found: DataFrame) -> DataFrame:
    """Captures with run, the number of the task that sorted them; written, so that the runs are read in their order."""
    nulls_first = [F.col(c).asc_nulls_first() for c in _KEY]
    return stored(found.sortWithinPartitions(*nulls_first).withColumn("run", F.spark_partition_id()))


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the losers of their matches; the winner of all is replayed against them along one path, as is a leaf that is filled anew."""

    def __init__(self, runs: list[Iterator[tuple]], key=_order):
        self.runs, self.key = runs, key
        self.head: list[tuple | None] = [next(r, None) for r in runs]
        self.rank: list[tuple | None] = [None if h is None else key(h) for h in self.head]
        self.build()

    def build(self) -> None:
        self.k = max(1, len(self.head))
        self.loser = [-1] * self.k
        self.winner = self._play(1) if self.head else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.rank[a], self.rank[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def put(self, at: int, row: tuple | None) -> None:
        """A leaf's new row, None for none, and the matches on its way up."""
        self.head[at] = row
        self.rank[at] = None if row is None else self.key(row)
        path = []
        node = (at + self.k) // 2
        while node:
            path.append(node)
            node //= 2
        if at == self.winner:
            rivals = [self.loser[n] for n in path]
        else:  # from the top: who came up to each node, and who came from its other side
            rivals, came = [], self.winner
            for depth in range(len(path) - 1, -1, -1):
                below = path[depth - 1] if depth else at + self.k
                x = came + self.k
                while x > below:
                    x //= 2
                own = x == below
                rivals.append(self.loser[path[depth]] if own else came)
                came = came if own else self.loser[path[depth]]
            rivals.reverse()
        for node, rival in zip(path, rivals):
            if self._beats(rival, at):
                rival, at = at, rival
            self.loser[node] = rival
        self.winner = at

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.head[self.winner] is not None:
            at = self.winner
            yield self.head[at]
            self.put(at, next(self.runs[at], None))


class Merge:
    """A k-way merge of runs whose blocks come in the order of their first keys. One tree has a leaf for each run, which takes the run's next block when the merge reaches its first key; only such blocks are open."""

    def __init__(self, blocks: Iterator[tuple[int, list[tuple]]]):
        self.blocks = blocks
        self.next = next(blocks, None)
        self.most_open = 0

    def __iter__(self) -> Iterator[tuple]:
        tree, leaf = LoserTree([]), {}
        rows: list[deque] = []  # of each leaf, what follows its head
        open_ = 0
        while True:
            top = tree.rank[tree.winner] if tree.winner >= 0 else None
            while self.next is not None and (top is None or _order(self.next[1][0]) <= top):
                run, block = self.next
                self.next = next(self.blocks, None)
                open_ += len(block)
                self.most_open = max(self.most_open, open_)
                at = leaf.setdefault(run, len(leaf))
                if at == len(tree.head):  # leaves are added by doubling
                    more = max(1, len(tree.head))
                    tree.head += [None] * more
                    tree.rank += [None] * more
                    rows += [deque() for _ in range(more)]
                    tree.build()
                rows[at].extend(block)
                if tree.head[at] is None:
                    tree.put(at, rows[at].popleft())
                top = tree.rank[tree.winner]
            if top is None:
                return
            at = tree.winner
            yield tree.head[at]
            open_ -= 1
            tree.put(at, rows[at].popleft() if rows[at] else None)


def _bounds(runs: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Keys that cut all rows into so many ranges, about evenly. A sample of keys is put in order by the executors; only the bounds come to the driver."""
    share = min(1.0, 2 * SAMPLED * ranges / max(1, total))
    picked = runs.where(F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 30)) < int(share * (1 << 30))).select(*_KEY)
    ordered = placed(picked, *_KEY)
    every = max(1, ordered.count() // ranges)
    found = ordered.where(F.col("place") % every == 0).select(*_KEY).collect()
    return sorted(_order(tuple(r)) for r in found)[: ranges - 1]


def _merge_pass(runs: DataFrame, groups: int, total: int, block_rows: int, range_rows: int, fan_in: int) -> DataFrame:
    """Runs with their rows in one order for each fan_in of them, whose number is run from then on."""
    spark = runs.sparkSession
    ranges = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups), -(-total // range_rows // groups))
    ranges = min(ranges, max(1, total // block_rows))
    bounds = _bounds(runs, total, ranges) if ranges > 1 else []
    ranges = len(bounds) + 1

    def cut(batches):
        """A run, read in its order, as blocks of one range each."""
        held: list[tuple] = []
        place = None

        def block():
            sink = pa.BufferOutputStream()
            table = _rows([r[:11] for r in held])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(table)
            names = ("place", "run", "urlkey", "timestamp", "page_id", "blob")
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            values = (place[0] + ranges * (place[1] // fan_in), place[1], *held[0][:3], sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], list(names))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                at = (bisect.bisect_right(bounds, _order(row)), row[11])
                if held and (at != place or len(held) == block_rows or _order(row) < _order(held[-1])):
                    yield block()
                    held = []
                place = at
                held.append(row)
        if held:
            yield block()

    def merge(batches):
        group = 0

        def blocks():
            nonlocal group
            for batch in batches:
                for run, blob in zip(batch.column("run").to_pylist(), batch.column("blob").to_pylist()):
                    group = run // fan_in
                    yield run, list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(blob).read_next_batch().columns)))

        def made(rows):
            table = _rows(rows)
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(np.full(len(rows), group, np.int64))], [*table.schema.names, "run"])

        out = []
        for row in Merge(blocks()):
            out.append(row)
            if len(out) == BLOCK_ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    blocks = map_arrow(runs, cut, "place int, run long, urlkey string, timestamp string, page_id long, blob binary")
    dealt = blocks.repartitionById(ranges * groups, "place").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in _KEY))
    return map_arrow(dealt.select("run", "blob"), merge, f"{CAPTURE}, run long")


def merge_runs(runs: DataFrame, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The captures of all runs in one order: by URL key, timestamp and page. More runs than fan_in are first merged so many at a time, in as many passes as it takes, so that a range has blocks of so many runs at most."""
    total, most = runs.agg(F.count(F.lit(1)), F.max("run")).first()
    names = (most or 0) + 1
    while names > fan_in:
        names = -(-names // fan_in)
        runs = stored(_merge_pass(runs, names, total, block_rows, range_rows, fan_in))
    return _merge_pass(runs, 1, total, block_rows, range_rows, max(fan_in, names)).drop("run")


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    return merge_runs(sorted_runs(captures(spark, path)))


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages to a shared folder, reads and merges them, and returns a row per record."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    write_archives(pages, path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")
