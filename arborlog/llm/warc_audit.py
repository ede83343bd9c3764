"""WARC records and a Merkle audit of replicas.

A WARC file is a row for each record: file, offset, the record's bytes. Records are hashed; the records that start in
the same range of ``RANGE`` bytes are hashed in order into one node, each ``FANOUT`` neighbouring nodes into a node of the
next level, up to one root for each file; files are hashed in groups of ``FANOUT`` up to one root for the replica. The roots
are compared first: two replicas with equal roots are equal. Else only the children of nodes that differ are compared on the next
level down, until the ranges that differ, whose records alone are compared. Every group of the tree is bounded by the range and the fanout, however large a file is.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

RANGE = 1 << 18
FANOUT = 16
#: Pages in a file.
FILE_PAGES = 1000
NONE = "0" * 64
#: Bytes of a gzip file that are given to the decompressor at a time.
PIECE = 1 << 20


# --- records ---


def record_text(url: Column, page_id: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text: header, blank line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(page_id, file, offset, length, sha256): a record for each page, laid out by id in files of ``file_pages`` ids.

    A null url or html counts as empty; pages without an id are left out, as they have no place. Pages with the same
    id follow one another by the hash of the record.
    """
    rec = record_text(pages["url"], pages["page_id"], pages["html"])
    rows = pages.where(pages["page_id"].isNotNull()).select(pages["page_id"].cast("long").alias("page_id"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("sha256"))
    rows = rows.withColumn("file", F.floor(F.col("page_id") / file_pages).cast("long"))
    before = Window.partitionBy("file").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "sha256")


def members(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(offset, stop, content, status) of the gzip members of a file, in one pass; after a broken one, from the next that can be read."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts, pos = zlib.decompressobj(wbits=31), [], at
        try:
            while not d.eof and pos < len(data):
                part = view[pos : pos + PIECE]
                parts.append(d.decompress(part))
                pos += len(part) - len(d.unused_data)
            status = "ok" if d.eof else "cut"
        except zlib.error:
            status = "broken"
        if status != "ok":
            found = data.find(b"\x1f\x8b\x08", at + 1)
            pos = found if found >= 0 else len(data)
        yield at, pos, b"".join(parts) if status != "broken" else b"", status
        at = pos


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes, str]]:
    """(offset, headers, payload, record, status) of each record of a WARC file; gzip members may hold one record each.

    What isn't a record has a row of its own with status "broken", from where it begins up to the next record; a record
    that ends before its length is "cut". So an audit loses nothing behind a damaged place.
    """
    if data[:2] == b"\x1f\x8b":
        for at, stop, one, status in members(data):
            if status == "broken" or not one:
                yield at, {}, b"", data[at:stop], "broken"
                continue
            for _, headers, payload, rec, inner in parse(one):
                yield at, headers, payload, rec, inner if status == "ok" else status
        return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        headers = dict((x.split(":", 1)[0].strip().lower(), x.split(":", 1)[1].strip()) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x) if end >= 0 else {}
        if not headers.get("content-length", "").isdigit():
            stop = data.find(b"WARC/1.", at + 1)
            stop = stop if stop >= 0 else len(data)
            yield at, {}, b"", data[at:stop], "broken"
            at = stop
            continue
        stop = end + 4 + int(headers["content-length"])
        tail = 4 if data.startswith(b"\r\n\r\n", stop) else 0
        yield at, headers, data[end + 4 : stop], data[at : stop + tail], "ok" if stop <= len(data) else "cut"
        at = stop + tail


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, uri, kind, payload, sha256, status) of the records of plain or gzip WARC files; one task reads a file, of under 2 GB, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for offset, h, payload, rec, status in parse(data):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (offset, pa.int64()), (h.get("warc-target-uri"), pa.string()), (h.get("warc-type"), pa.string()), (payload, pa.binary()), (hashlib.sha256(rec).hexdigest(), pa.string()), (status, pa.string()))], names=["file", "offset", "uri", "kind", "payload", "sha256", "status"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, uri string, kind string, payload binary, sha256 string, status string")


def packed(recs: list[bytes], compress: bool = False) -> bytes:
    """A WARC file of the records."""
    return b"".join(gzip.compress(r, mtime=0) if compress else r for r in recs)


# --- trees ---


def _node(items: Column) -> Column:
    """The hash of (order, hash) pairs in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(items), lambda x: x["h"]), ""), 256)


def _pair(*key: str) -> Column:
    return F.struct(*[F.col(k).alias(f"o{i}") for i, k in enumerate(key)], F.concat(*[x for k in key for x in (F.col(k).cast("string"), F.lit(":"))], F.col("hash"), F.lit(";")).alias("h"))


def ranges(recs: DataFrame, size: int = RANGE) -> DataFrame:
    """The lowest level, (file, node, hash): the records that start in each range of offsets, hashed in order."""
    leaf = F.struct(F.col("offset").alias("o"), F.concat(F.col("offset").cast("string"), F.lit(":"), F.col("length").cast("string"), F.lit(":"), F.col("sha256"), F.lit(";")).alias("h"))
    return recs.groupBy("file", F.floor(F.col("offset") / size).cast("long").alias("node")).agg(_node(F.collect_list(leaf)).alias("hash"))


def tree(level: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """From the ranges up to the file roots: (file, node, hash) of each level."""
    out = [level]
    for _ in range(levels):
        level = level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(_node(F.collect_list(_pair("node"))).alias("hash"))
        out.append(level)
    return out


def _group(depth: int, fanout: int) -> Column:
    return F.pmod(F.xxhash64("file"), F.lit(fanout**depth)).cast("long")


def forest(files: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """From the file roots up to the root of the replica: (group, hash) of each level; ``fanout`` groups, by a hash of the file, make one of the next."""
    level = files.groupBy(_group(depth, fanout).alias("group")).agg(_node(F.collect_list(_pair("file"))).alias("hash"))
    out = [level]
    for k in range(depth - 1, -1, -1):
        level = level.groupBy((F.col("group") % fanout**k).alias("g")).agg(_node(F.collect_list(_pair("group"))).alias("hash")).withColumnRenamed("g", "group")
        out.append(level)
    return out


def _levels(n: int, fanout: int) -> int:
    k = 0
    while n >= fanout**k:
        k += 1
    return k


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.alias("a").join(b.alias("b"), keys, "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select(*keys)


def audit(primary: DataFrame, replica: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, primary_sha256, replica_sha256, status) of each record that isn't the same in both.

    Both have (file, offset, length, sha256). status: corrupt (other bytes at the same offset), missing (only the primary has
    a record there) or extra. The roots of the replicas are compared first: equal replicas, two empty ones too, give no rows and nothing else
    is read. Else only children of differing groups, files and nodes are compared. Rows without a file or offset have no place and
    are left out; repeated records of one offset are compared as a list.
    """
    sides = [saved(x.select("file", "offset", "length", "sha256").where("file is not null and offset is not null")) for x in (primary, replica)]
    found = [x.agg(F.max("offset"), F.count_distinct("file")).first() for x in sides]
    levels = _levels(max(x[0] or 0 for x in found) // size, fanout)
    depth = _levels(max(x[1] for x in found) // fanout, fanout)
    trees = [tree(saved(ranges(x, size)), fanout, levels) for x in sides]
    tops = [saved(t[-1].select("file", "hash")) for t in trees]
    forests = [forest(t, fanout, depth) for t in tops]
    kind = "file string, offset long, primary_sha256 string, replica_sha256 string, status string".replace("file string", f"file {sides[0].schema['file'].dataType.simpleString()}")
    bad = saved(_differ(forests[0][-1], forests[1][-1], ["group"]))
    if bad.isEmpty():
        return sides[0].sparkSession.createDataFrame([], kind)
    for k in range(1, depth + 1):
        a, b = (f[-1 - k].join(bad.withColumnRenamed("group", "up"), F.col("group") % fanout ** (k - 1) == F.col("up"), "left_semi") for f in forests)
        bad = saved(_differ(a, b, ["group"]))
    a, b = (t.join(bad, _group(depth, fanout) == F.col("group"), "left_semi") for t in tops)
    bad = saved(_differ(a, b, ["file"])).withColumn("node", F.lit(0).cast("long"))
    for k in range(levels - 1, -1, -1):
        under = F.floor(F.col("node") / fanout).cast("long")
        a, b = (t[k].withColumn("up", under).join(bad.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").drop("up") for t in trees)
        bad = saved(_differ(a, b, ["file", "node"]))
    inside = [x.withColumn("node", F.floor(F.col("offset") / size).cast("long")).join(bad, ["file", "node"], "left_semi").groupBy("file", "offset").agg(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))).alias("h")) for x in sides]
    both = inside[0].alias("a").join(inside[1].alias("b"), ["file", "offset"], "full").where(~F.col("a.h").eqNullSafe(F.col("b.h")))
    status = F.when(F.col("b.h").isNull(), "missing").when(F.col("a.h").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", F.col("a.h").alias("primary_sha256"), F.col("b.h").alias("replica_sha256"), status.alias("status"))


def root(recs: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> str:
    """The root of a replica; that of an empty one is 64 zeros."""
    offset, files = recs.agg(F.max("offset"), F.count_distinct("file")).first()
    top = tree(ranges(recs, size), fanout, _levels((offset or 0) // size, fanout))[-1].select("file", "hash")
    found = forest(top, fanout, _levels(files // fanout, fanout))[-1].first()
    return found["hash"] if found else NONE


def fixity(recs: DataFrame, replica: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Each record of the primary with what the audit says of it."""
    found = audit(recs, replica, size, fanout).select("file", "offset", F.col("status").alias("s"))
    return recs.join(found, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "sha256", F.coalesce("s", F.lit("ok")).alias("status"))


def replica(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """The records of a second copy on a failing disk, for use where only one copy is at hand.

    For ids that a fixed hash picks, the record's first character of payload is another, or the record can't be read.
    Lengths don't change, so all others are where they were.
    """
    pick = F.conv(F.substring(F.md5(pages["page_id"].cast("string")), 1, 4), 16, 10).cast("int")
    html = F.when(pick % 53 == 7, F.overlay("html", F.translate(F.substring("html", 1, 1), "<abc", ">xyz"), F.lit(1))).otherwise(F.col("html"))
    lost = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 101 == 11
    return records(pages.withColumn("html", html), file_pages).where(~lost)


def oracle(file_pages: int = FILE_PAGES) -> str:
    rec = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, html, {rec} AS rec FROM pages WHERE page_id IS NOT NULL)
SELECT page_id, (page_id // {file_pages})::BIGINT AS file,
  coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // {file_pages} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  strlen(rec)::BIGINT AS length, sha256(rec) AS sha256,
  CASE WHEN pick % 101 = 11 THEN 'missing' WHEN pick % 53 = 7 AND html[1] IN ('<', 'a', 'b', 'c') THEN 'corrupt' ELSE 'ok' END AS status
FROM (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT AS pick FROM r)"""
