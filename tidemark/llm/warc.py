"""WARC archives with a two-level capture index.

Each task lays its records down in archives of about FILE_BYTES in the shared folder, one gzip member for each record, and
gives the captures with their byte ranges; an archive's name is new for each attempt, so a task that runs again leaves
at most a file that no capture names. The index sorts captures by the reversed-host url key and packs them in
compressed blocks; each block's first and last key are the sparse directory. A look-up binary-searches the directory and the
blocks that can hold the key, and then reads the records' byte ranges. The query reads all its pages that way.

The shared folder is opened by pyarrow's file systems (file, hdfs, s3, gs). The directory, one row for BLOCK_ROWS captures, is
read by each task that looks up keys.

Null html is an empty payload, a null url an empty target. Payloads under MIN_REVISIT bytes are never revisits. Of equal payloads the
smallest page id is the response, of rows that share it one; rows without a page id revisit it, and are responses where
no equal row has an id. Repeated rows each give a record; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import saved, shared_folder

MIN_REVISIT, FILE_BYTES, RANGE_BYTES, BLOCK_ROWS, END = 100, 64 << 20, 8 << 20, 1000, b"\r\n\r\n"
CAPTURE = "key string, archive string, offset long, length long"


def url_key(url):
    """Reversed host, a bracket, then the rest of the url: com,example,www)/path."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def records(pages: DataFrame) -> DataFrame:
    """key, head and body of one record for each page: response, or revisit of the equal payload with the smallest id."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url_key(F.col("url")).alias("key"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"),
    )
    per_id = p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.min("row").alias("row"))
    lead = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "rows"))).alias("lead")
    first = per_id.groupBy("digest").agg(F.sum("rows").alias("copies"), lead).filter("copies > 1 and lead is not null").select("digest", "lead")
    p = p.join(first, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("lead.page_id")) | (F.col("lead.rows") > 1) & (F.col("row") != F.col("lead.row"))
    again = F.col("lead").isNotNull() & other & (F.col("n") >= MIN_REVISIT)
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Bytes: "), F.col("n").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("lead.page_id").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return p.select("key", head.alias("head"), body.alias("body"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the captures are the url key and byte range of each record."""

    def each(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for key, head, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(1, wbits=31)
                member = pack.compress(head.encode() + body.encode() + END) + pack.flush()
                out.write(member)
                rows.append((key, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())], names=["key", "archive", "offset", "length"])
        if out:
            out.close()

    return saved(records(pages).mapInArrow(each, CAPTURE))


def index(captures: DataFrame) -> DataFrame:
    """Compressed blocks of captures in url-key order: name, first key, last key, packed lines."""
    caps = captures.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")

    def pack(frames):
        part, n = TaskContext.get().partitionId(), 0
        for f in frames:
            for i in range(0, len(f), BLOCK_ROWS):
                own = f.iloc[i : i + BLOCK_ROWS]
                lines = "\n".join("\t".join(map(str, r)) for r in own.itertuples(index=False))
                yield pd.DataFrame({"block_id": [f"{part}-{n}"], "first_key": [own["key"].iloc[0]], "last_key": [own["key"].iloc[-1]], "block": [zlib.compress(lines.encode())]})
                n += 1

    # a tab or line feed in a url would break a line
    return caps.withColumn("key", F.translate("key", "\t\n", "  ")).mapInPandas(pack, "block_id string, first_key string, last_key string, block binary")


class Directory:
    """The sparse directory of one index: binary search for the blocks that can hold a key."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = sorted(rows, key=lambda r: (r[0].encode(), r[1].encode(), r[2]))
        self.first = [r[0].encode() for r in self.rows]
        self.last = [r[1].encode() for r in self.rows]

    @classmethod
    def load(cls, folder: str) -> Directory:
        import pyarrow.dataset as ds

        store, root = fs.FileSystem.from_uri(folder)
        names = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet")]
        return cls([(r["first_key"], r["last_key"], r["block_id"]) for r in ds.dataset(names, filesystem=store, format="parquet").to_table().to_pylist()] if names else [])

    def blocks(self, key: str) -> list[str]:
        k = key.encode()
        return [r[2] for r in self.rows[bisect.bisect_left(self.last, k) : bisect.bisect_right(self.first, k)]]


class Block:
    """One block of captures, decoded once for all keys that are looked up in it."""

    def __init__(self, block: bytes):
        self.lines = [x.split("\t") for x in zlib.decompress(block).decode().split("\n")]
        self.keys = [x[0].encode() for x in self.lines]

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of a key's captures, by binary search."""
        k = key.encode()
        return [(x[1], int(x[2]), int(x[3])) for x in self.lines[bisect.bisect_left(self.keys, k) : bisect.bisect_right(self.keys, k)]]


def search(block: bytes, key: str) -> list[tuple[str, int, int]]:
    """(archive, offset, length) of a key's captures in one block."""
    return Block(block).captures(key)


def pick(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The captures of all wanted keys in their block."""
    rows = []
    if len(wanted) and len(blocks):
        block = Block(blocks["block"].iloc[0])
        rows = [(k, *c) for k in wanted["key"] for c in block.captures(k)]
    return pd.DataFrame(rows, columns=["key", "archive", "offset", "length"])


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The captures of distinct url keys."""

    def find(frames):
        directory = Directory.load(f"{folder}/directory")
        for f in frames:
            rows = [(k, b) for k in f["key"] for b in directory.blocks(k)]
            yield pd.DataFrame(rows, columns=["key", "block_id"])

    wanted = keys.select(F.translate("key", "\t\n", "  ").alias("key")).distinct().mapInPandas(find, "key string, block_id string")
    blocks = spark.read.parquet(f"{folder}/index").select("block_id", "block")
    return wanted.groupBy("block_id").cogroup(blocks.groupBy("block_id")).applyInPandas(pick, CAPTURE)


FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ?(.*?)\r?$")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, sound boolean"


def page_of(x: str | None) -> int | None:
    return int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:->" else None


def parse(record: bytes) -> tuple:
    """page_id, url, payload bytes, digest, type, refers_to and soundness of one record."""
    cut = record.index(END)
    head = {k.decode(): v.decode("utf-8", "replace") for k, v in FIELD.findall(record[:cut])}
    body = record[cut + 4 : cut + 4 + int(head["Content-Length"])]
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].split(":")[1]
    sound = record[cut + 4 + len(body) :] == END and (kind == "revisit" or hashlib.sha256(body).hexdigest() == digest)
    n = int(head["X-Payload-Bytes"]) if kind == "revisit" else len(body)
    return page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, kind, page_of(head.get("WARC-Refers-To")), sound


def read_ranges(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures by range reads; sound says whether a record is whole and a response's payload has its digest."""

    def each(frames):
        store, root = fs.FileSystem.from_uri(folder)
        name, data = None, None
        for f in frames:
            rows = []
            for archive, offset, length in zip(f["archive"], f["offset"], f["length"], strict=True):
                if archive != name:
                    name, data = archive, store.open_input_file(f"{root}/{archive}")
                page_id, url, n, digest, kind, refers_to, sound = parse(zlib.decompress(data.read_at(int(length), int(offset)), wbits=31))
                rows.append((page_id, url, n, digest, kind, refers_to, archive, offset, length, sound))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"refers_to": "Int64", "page_id": "Int64"})

    near = captures.repartition("archive", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive", "offset")
    return near.mapInPandas(each, RECORD)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index, then read all pages back through the index."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    captures = write(pages, f"{folder}/archives")
    index(captures).write.parquet(f"{folder}/index")
    spark.read.parquet(f"{folder}/index").select("block_id", "first_key", "last_key").write.parquet(f"{folder}/directory")
    found = lookup(spark, folder, pages.select(url_key(F.col("url")).alias("key")))
    return read_ranges(found, f"{folder}/archives")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


ORACLE = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, octet_length(encode(h)) as n, sha256(h) as s from p),
 m as (select s, min(page_id) as lead from d where n >= 100 group by s)
 select page_id, cast(n as bigint) as payload_bytes, d.s as payload_digest, case when n >= 100 and lead <> page_id then 'revisit' else 'response' end as record_type,
 case when n >= 100 and lead <> page_id then lead end as refers_to, true as sound from d left join m on d.s = m.s"""
