r"""WARC archives: writing with Spark's text writer, reading through a Python data source.

Records are written by Spark itself, so that any file system works and task retries leave no halves: a
record is one line of text whose line end is the blank line pair that ends every record. The reader plans
partitions over files, takes predicates on record type and headers, parses headers first and passes over
the blocks of records that nobody wants.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from tickframe.llm.common import shared_dir, small, table, written
from tickframe.sources.frames import Unzipped

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, payload_length long, payload binary"
)
#: Bytes of small files that one task reads at least, where there are so many.
PACKED = 1 << 20
#: Columns that come from a header of the record, by the header's lower-case name.
_HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
#: What base32 writes for the numbers 0 to 31.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_GROUPS = 100_000


class FilePart(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    """Options: path (a file or folder, any URI that pyarrow opens), maxPartitionBytes, parallelism, mode (FAILFAST or PERMISSIVE).

    A record that is cut off or whose length is no number, a damaged gzip and bytes that start no record are errors or,
    in PERMISSIVE mode, end their file, whether the block is wanted or passed over.
    """

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.schema = schema
        self.path = options["path"]
        self.most = int(options.get("maxpartitionbytes", options.get("maxPartitionBytes", 128 << 20)))
        self.tasks = max(1, int(options.get("parallelism", 1)))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Predicates on headers are met here, before a block is read; others go back to Spark."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "known", IsNull: "unknown"}
        for f in filters:
            kind, name = kinds.get(type(f)), ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if kind and name in _HEADERS:
                self.tests.append((kind, _HEADERS[name], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, largest first, packed up to a share of all bytes, PACKED at least and maxPartitionBytes at most; a record never spans two tasks."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(
            (x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))),
            key=lambda x: (-x.size, x.path),
        )
        most = min(self.most, max(PACKED, sum(x.size for x in files) // self.tasks))
        parts, held, size = [], [], 0
        for x in files:
            if held and size + x.size > most:
                parts.append(FilePart(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return parts + [FilePart(held)] if held else parts or [FilePart([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            got = headers.get(name)
            if kind == "known" and got is None or kind == "unknown" and got is not None:
                return False
            if kind in ("equal", "in", "starts") and got is None:
                return False
            if kind == "equal" and got != value or kind == "in" and got not in value:
                return False
            if kind == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: FilePart) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.files:
            with system.open_input_file(path) as opened:
                raw = Unzipped(opened) if path.endswith(".gz") else opened
                stream = io.BufferedReader(raw, 1 << 20)
                try:
                    for row in self.records(stream):
                        rows.append(row)
                        size += len(row.get("payload") or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, target)
                            rows, size = [], 0
                except (EOFError, gzip.BadGzipFile, zlib.error) as error:
                    if not self.permissive:
                        raise ValueError(f"the archive {path} is cut off or damaged: {error}") from None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, target)

    def records(self, stream) -> Iterator[dict]:
        body_wanted = "payload" in self.columns or "payload_length" in self.columns
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                if self.permissive:
                    return
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            headers = _headers(stream)
            length = _length(headers.get("content-length", "0"))
            if length < 0:  # where the next record starts isn't known
                if self.permissive:
                    return
                raise ValueError(f"the record {headers.get('warc-record-id')} has the length {headers['content-length']!r}")
            wanted = self.wanted(headers)
            block = stream.read(length) if wanted and body_wanted else b""
            if len(block) < length and (block or not _skip(stream, length)):
                if self.permissive:
                    return
                raise ValueError(f"the record {headers.get('warc-record-id')} is cut off")
            if not wanted:
                continue
            row = {c: headers.get(h) for c, h in _HEADERS.items() if c in self.columns} | {"content_length": length}
            if not body_wanted:
                yield {c: row[c] for c in self.columns}
                continue
            payload, said = block, length
            if headers.get("content-type", "").startswith("application/http"):
                inner = io.BytesIO(block)
                inner.readline()
                said = _length(_headers(inner).get("content-length", ""))
                payload = block[inner.tell() :]
            row |= {"payload": payload, "payload_length": said if said >= 0 else len(payload)}
            yield {c: row[c] for c in self.columns}


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) and line.strip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _length(text: str) -> int:
    """A length from a header, -1 for what is none."""
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else -1


def _skip(stream: io.BufferedReader, length: int) -> bool:
    """Passes over a block without keeping it, by a seek where the file isn't compressed; whether it was there in full."""
    if length > 1 << 16 and not isinstance(stream.raw, Unzipped):
        stream.seek(length - 1, io.SEEK_CUR)
        return len(stream.read(1)) == 1
    while length > 0 and (got := len(stream.read(min(length, 1 << 20)))):
        length -= got
    return length == 0


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    """The records below path. A schema without payload reads no blocks; filters on headers are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    options = {"parallelism": str(2 * spark.sparkContext.defaultParallelism)} | options
    return spark.read.format("warc").schema(schema).options(path=path, **options).load()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, without padding: 160 bits are four groups of 40, or eight digits to base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * g, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least least_bytes bytes the one with the smallest key is a response
    and the others revisit it. Rows that repeat the smallest key are all responses; null keys come after
    all others. Only payloads that occur more than once are looked up; payloads themselves are never
    shuffled when those groups are few. Columns of pages with the names of the new ones are replaced.
    """
    pages = pages.drop("payload_bytes", "payload_digest", "record_type", "refers_to", "first_key")
    sized = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", base32_sha1(F.col(payload))
    )
    keys = sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    groups = written(
        keys.agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_key is not null").drop("n"),
        "warc-groups",
    )
    joined = sized.join(small(groups, BROADCAST_GROUPS), ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_key").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("first_key")))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("first_key"))
    )


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, key: str, url: str, payload: str, date: str) -> DataFrame:
    """One string column, record: a WARC/1.1 record for each row of with_revisits(). Control characters of urls are dropped."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    revisit = F.col("record_type") == "revisit"
    target = line("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", ""))
    refers = F.concat(
        line("WARC-Refers-To", _urn(F.col("refers_to"))),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col(key))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(target, F.lit("")),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col(payload))
    length = line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string"))
    return pages.select(F.concat(head, length, F.lit("\r\n"), http, body).alias("record"))


def write_warc(pages: DataFrame, path: str, key: str, url: str, payload: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes the rows of with_revisits() as gzipped WARC files, one per partition."""
    records(pages, key, url, payload, date).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC and reads them back. A null html is an empty payload; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_revisits(pages, "page_id", "payload"), path, "page_id", "url", "payload")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    head = "record_type string, record_id string, refers_to string"

    def shown(kind: str, columns: str, size: Column, digest: Column) -> DataFrame:
        read = read_warc(spark, path, f"{head}, {columns}").where(F.col("record_type") == kind)
        ids = (page(F.col(c)).alias(name) for c, name in (("record_id", "page_id"), ("refers_to", "refers_to")))
        return read.select(*ids, size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type")

    # each scan passes over the other kind's blocks: responses are judged by their payload, revisits by their headers
    responses = shown("response", "payload binary", F.octet_length("payload"), base32_sha1(F.col("payload")))
    said = F.substring("payload_digest", 6, 32)
    return responses.unionByName(shown("revisit", "payload_digest string, payload_length long", F.col("payload_length"), said))


SQL = r"""
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT hex, payload_bytes, min(page_id) AS first_id FROM sized GROUP BY ALL
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id OR page_id IS NULL AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id OR page_id IS NULL THEN first_id END AS refers_to
FROM sized JOIN firsts USING (hex, payload_bytes)
"""
