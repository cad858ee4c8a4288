"""WARC archives with a two-level capture index.

Writing. Each task writes its rows as one .warc.gz, a gzip member a record, through pyarrow's file systems (file, hdfs,
s3, gs by the folder's scheme), under a name of its own. Records of equal payloads of at least `least_bytes` bytes are
one response, at the smallest page_id, and revisits of it without the payload. What the index lists is what counts: a
failed or repeated task leaves an archive that no index names.

Index. One line for each capture: its key (host labels reversed, comma-separated, then path, as in `com,example)/a?b`,
then page_id), archive, offset and length. Lines are range-partitioned and sorted by key. A partition is one shard: a
file of gzip blocks of `block_lines` lines, and beside it the sparse directory of its blocks (first key, offset, length).
Above that stands the list of shards with their first keys, one row for each range partition.

Lookup. Wanted keys are range-partitioned and sorted too, so a task's keys lie close together. A task binary-searches
the shard list, then the shard's directory, range-reads and unpacks that one block (kept until the keys leave it),
binary-searches it and emits archive, offset and length. These are grouped by stretches of an archive, and read in order
with range reads. A url that holds a third of all captures is spread by the page_id in the key.

Cases. Null html: empty payload. Null url: empty target, key `)/`. Null page_id: never the smallest of its payload (a
payload that only such rows have is response in each); kept and returned as null. Rows that repeat a page_id are
records of their own, each returned. Empty table: no archives, no rows. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, new_folder, only

CAPTURE = "key string, page_id long, archive string, offset long, length long"
SHARD = "shard string, first_key string, lines long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
CRLF = b"\r\n"
#: Bytes of an archive that one group of range reads covers.
STRETCH = 32 << 20
#: Records this close are fetched by one range read, of about so many bytes.
GAP, READ = 1 << 16, 4 << 20


def url_key(url: F.Column) -> F.Column:
    """com,example,www)/path?query in lower-case host labels."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def capture_key(url: F.Column, page_id: F.Column) -> F.Column:
    """The url key, a space, and page_id in twenty digits that sort as numbers do (negative ones first, null last)."""
    number = F.when(page_id.isNull(), F.lit("~")).when(page_id < 0, F.concat(F.lit("-"), F.lpad((F.least(page_id, F.lit(-1)) - F.lit(-(2**63))).cast("string"), 19, "0"))).otherwise(F.concat(F.lit("0"), F.lpad(page_id.cast("string"), 19, "0")))
    return F.concat(F.regexp_replace(url_key(url), r"[\s]", "%20"), F.lit(" "), number)


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to): which records revisit which page.

    Only (digest, smallest page_id) of payloads that occur more than once is joined, a row for each digest; copies of one
    payload can be split by the adaptive skew join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha2("html", 256), "n_bytes": F.octet_length("html").cast("long")})
    many = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(many, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("first_id") < F.col("page_id")), F.col("first_id"))).drop("first_id")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has no block; its payload's digest and length stand in the header."""
    kind = "response" if refers_to is None else "revisit"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = payload if refers_to is None else b""
    head |= {"Content-Type": "text/html", "Content-Length": str(len(block))}
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head.items()) + CRLF + block + CRLF + CRLF


def parse_record(data: bytes, keep: bool = True) -> tuple:
    """A row of RECORD from a record's bytes; digest and length of a response are taken from its payload anew.

    keep=False leaves out the payload itself.
    """
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    id_ = lambda name: int(v) if (v := field[name][len("<urn:page:") : -1]) else None
    payload = rest[: int(field["Content-Length"])]
    if field["WARC-Type"] == "revisit":
        return id_("WARC-Record-ID"), field["WARC-Target-URI"], int(field["X-Payload-Length"]), field["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", id_("WARC-Refers-To"), None
    digest = hashlib.sha256(payload).hexdigest()
    if field["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"payload of page {field['WARC-Record-ID']} doesn't fit its digest")
    return id_("WARC-Record-ID"), field["WARC-Target-URI"], len(payload), digest, "response", None, payload if keep else None


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _own_name(kind: str) -> str:
    """A name no other attempt uses."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, level: int = 3) -> DataFrame:
    """Writes the archives when it is evaluated; rows of CAPTURE. Cut (checkpoint) it before using it twice."""
    pages = only(pages, page_id="long", url="string", html="string")
    rows = with_roles(pages, least_bytes).withColumn("key", capture_key(F.col("url"), F.col("page_id")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at = None, "", 0
        try:
            for pdf in batches:
                found = []
                for key, page_id, url, html, digest, refers_to in zip(pdf.key, pdf.page_id, pdf.url, pdf.html, pdf.digest, pdf.refers_to, strict=True):
                    if out is None:
                        system, path = _open(folder)
                        name = f"{_own_name('part')}.warc.gz"
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    number = lambda x: None if pd.isna(x) else int(x)
                    member = gzip.compress(record_bytes(number(page_id), url, html.encode(), digest, number(refers_to)), level, mtime=0)
                    out.write(member)
                    found.append((key, number(page_id), name, at, len(member)))
                    at += len(member)
                yield _frame(found, ["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return rows.select("key", F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to")).mapInPandas(write, CAPTURE)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in {"page_id", "refers_to"} & set(columns):
        out[c] = pd.array([r[columns.index(c)] for r in rows], dtype="Int64")
    return out


def write_index(captures: DataFrame, folder: str, shards: int, block_lines: int = 512) -> DataFrame:
    """Writes the index when it is evaluated; rows of SHARD, one for each range partition that has lines."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: list[str] = []
        directory, total, at, out, name, first = [], 0, 0, None, "", ""

        def block() -> None:
            nonlocal lines, at
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            directory.append(f"{lines[0].split(chr(9))[0]}\t{at}\t{len(data)}")
            at, lines = at + len(data), []

        for pdf in batches:
            for row in zip(pdf.key, pdf.archive, pdf.offset, pdf.length, strict=True):
                if out is None:
                    system, path = _open(folder)
                    name, first = _own_name("index"), row[0]
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.gz", compression=None)
                lines.append("\t".join(map(str, row)))
                total += 1
                if len(lines) == block_lines:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            with system.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pd.DataFrame([(name, first, total)], columns=["shard", "first_key", "lines"])

    order = ["key", "archive", "offset"]
    return captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInPandas(write, SHARD)


class _Index:
    """One task's view of the index: at most one shard's directory and one block are held at a time."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.system, self.path = _open(folder)
        self.names, self.first = [s for s, _ in shards], [k for _, k in shards]
        self.shard, self.directory, self.keys, self.at, self.lines = None, [], [], None, []

    def _shard(self, shard: int) -> None:
        if self.shard != shard:
            with self.system.open_input_stream(f"{self.path}/{self.names[shard]}.directory", compression=None) as f:
                self.directory = [line.split("\t") for line in f.read().decode().split("\n")]
            self.keys, self.shard, self.at = [d[0] for d in self.directory], shard, None

    def _block(self, number: int) -> None:
        if self.at != number:
            _, offset, length = self.directory[number]
            with self.system.open_input_file(f"{self.path}/{self.names[self.shard]}.gz") as f:
                self.lines = [line.split("\t") for line in gzip.decompress(f.read_at(int(length), int(offset))).decode().split("\n")]
            self.at = number

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of each capture with this key, wherever the blocks and shards were cut."""
        shard = max(0, bisect.bisect_left(self.first, key) - 1)
        while shard < len(self.names) and (self.first[shard] <= key or shard == 0):
            self._shard(shard)
            number = max(0, bisect.bisect_left(self.keys, key) - 1)
            while number < len(self.directory) and self.keys[number] <= key:
                self._block(number)
                i = bisect.bisect_left(self.lines, [key])
                while i < len(self.lines) and self.lines[i][0] == key:
                    _, archive, offset, length = self.lines[i]
                    yield archive, int(offset), int(length)
                    i += 1
                number += 1
            shard += 1


def lookup(keys: DataFrame, folder: str, shards: DataFrame, tasks: int) -> DataFrame:
    """(archive, offset, length) of the captures with the wanted keys. keys: (key); each distinct one is looked up once.

    The shard list is one row for each range partition of the index, so its size is set by write_index(shards=...).
    """
    listed = sorted((r.first_key, r.shard) for r in shards.select("shard", "first_key").collect())
    listed = [(s, k) for k, s in listed]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = None
        for pdf in batches:
            index = index or _Index(folder, listed)
            yield pd.DataFrame([x for key in pdf.key for x in index.find(key)], columns=["archive", "offset", "length"]).astype({"archive": object, "offset": "int64", "length": "int64"})

    return keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInPandas(find, "archive string, offset long, length long")


def _runs(archives: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches from..to of records, sorted by place, that one range read fetches."""
    first = 0
    for i in range(1, len(offsets) + 1):
        near = i < len(offsets) and archives[i] == archives[first] and offsets[i] <= offsets[i - 1] + lengths[i - 1] + GAP and offsets[i] - offsets[first] < READ
        if not near:
            yield first, i
            first = i


def read_records(places: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Rows of RECORD at the given places, by range reads in order within stretches of an archive."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        file, name = None, ""
        try:
            for pdf in batches:
                archives, offsets, lengths = pdf.archive.tolist(), pdf.offset.tolist(), pdf.length.tolist()
                for a, b in _runs(archives, offsets, lengths) if len(pdf) else ():
                    if archives[a] != name:
                        if file is not None:
                            file.close()
                        file, name = system.open_input_file(f"{path}/{archives[a]}"), archives[a]
                    data = memoryview(file.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a]))
                    rows = [parse_record(zlib.decompress(data[offsets[i] - offsets[a] : offsets[i] - offsets[a] + lengths[i]], wbits=31), payload) for i in range(a, b)]
                    for i in range(0, len(rows), 500):
                        yield _frame(rows[i : i + 500], _names(RECORD))
        finally:
            if file is not None:
                file.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    return places.withColumn("stretch", stretch).repartition("archive", "stretch").sortWithinPartitions("archive", "offset").mapInPandas(read, RECORD)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, payload: bool = False, shards: int | None = None) -> DataFrame:
    """Writes archives and index into folder (a new one in the shared folder), then reads every page back by its key."""
    folder = folder or new_folder(spark, "warc")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    captures = cut(write_archives(pages, folder))
    index = cut(write_index(captures, folder, shards))
    wanted = only(pages, page_id="long", url="string").select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return read_records(lookup(wanted, folder, index, shards), folder, payload)
