"""WARC archives of pages, and a two-level capture index to read them back.

Tasks write the pages of a scan as gzip members, one per record, into archives of their own; the payload never moves. What
is a revisit of what is decided before, from digests alone, and looked up while writing. Captures are sorted by the
reversed host of their address (``com,example,www)/path``) into compressed blocks with a sparse directory
(:mod:`roompulse.llm.blockindex`); reading searches the directory, then a block, and fetches the byte range of the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roompulse.llm import blockindex
from roompulse.llm.blockindex import GZIP, BlockIndex, Reader, Store, packed
from roompulse.session import staged, staging_folder

LEAST_BYTES = 0                     # smaller payloads are never revisits
ARCHIVE_BYTES = 1 << 30             # an archive is closed when it has as many
DATE = "1970-01-01T00:00:00Z"       # pages carry no time of capture
LEVEL = 6
DIGEST_LINES = 128                  # digests come in no order, so their blocks are small

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
END = b"\r\n\r\n"

_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", re.S)
_PORT = re.compile(r":(80|443)?$")
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")


class Archive(NamedTuple):
    """Written archives and their index."""

    folder: str
    index: BlockIndex


def _escaped(url: str) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def surt(url: str | None) -> str:
    """Sort key of an address: host labels reversed, then path and query; scheme, user, default port and fragment go."""
    host, rest = _URL.match(_escaped(url or "").strip()).groups()
    host = _PORT.sub("", host.rpartition("@")[2].lower())
    if not host.startswith("["):
        name, colon, port = host.partition(":")
        host = ",".join(reversed(name.split("."))) + colon + port
    return f"{host}){rest or '/'}"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name_of(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key_of(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(key: int | None, url: str | None, payload: bytes, digest: str, first: tuple | None = None,
           date: str = DATE) -> bytes:
    """One record: a response, or a revisit of ``first`` (its key and address)."""
    http = HTTP.format(len(payload)).encode()
    block = http if first else http + payload
    head = {"WARC-Type": "revisit" if first else "response", "WARC-Record-ID": _name_of(key), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = _escaped(url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if first:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name_of(first[0]), "WARC-Refers-To-Date": date}
        if first[1] is not None:
            head["WARC-Refers-To-Target-URI"] = _escaped(first[1])
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + END


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; the payload of a revisit is empty."""
    top, _, rest = data.partition(END)
    version, *lines = top.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"no WARC record: {version[:20]!r}")
    head = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)
    block = rest[:int(head["Content-Length"])]
    if rest[len(block):] != END:
        raise ValueError(f"record {head['WARC-Record-ID']} is cut off")
    return head, block.partition(END)[2]


def _firsts(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(key, value)``: SHA-1 of every payload that comes more than once, and the page that is its response."""
    seen = pages.select("id", "url", F.sha1(F.col("html").cast("binary")).alias("key"),
                        F.octet_length("html").alias("size")).filter(F.col("size") >= least_bytes)
    return (seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("first"))
            .filter("n > 1").select("key", F.to_json("first").alias("value")))


_CAPTURE = "key string, value string"


def _archiver(folder: str, firsts: BlockIndex, least_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, known = Store(folder), Reader(firsts)
        name, out, at = None, None, 0
        for batch in batches:
            keys, values = [], []
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            payloads = [x.encode() for x in batch.column(2).to_pylist()]
            sums = [hashlib.sha1(p).hexdigest().encode() for p in payloads]
            again = known.get(s for s, p in zip(sums, payloads) if len(p) >= least_bytes) if firsts.names else {}
            for key, url, payload, total in zip(ids, urls, payloads, sums):
                first = json.loads(again[total]) if total in again else None
                first = first and (first.get("id"), first.get("url"))
                first = None if first is None or first[0] == key else first
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.create(name)
                    about = b"software: roompulse\r\nformat: WARC File Format 1.1\r\n"
                    info = packed(VERSION + (f"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\n"
                                             f"WARC-Date: {date}\r\nContent-Type: application/warc-fields\r\n"
                                             f"Content-Length: {len(about)}\r\n\r\n").encode() + about + END, level)
                    at += out.write(info)
                digest = digest_of(payload)
                data = packed(record(key, url, payload, digest, first, date), level)
                out.write(data)
                keys.append(surt(url))
                values.append(json.dumps({
                    "id": key, "type": "revisit" if first else "response", "digest": digest, "length": len(data),
                    "offset": at, "file": name}))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "value": pa.array(values, pa.string())})
        if out is not None:
            out.close()
    return run


def archived(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
             least_bytes: int = LEAST_BYTES, level: int = LEVEL, date: str = DATE) -> Archive:
    """Write one record per row of ``pages`` under ``folder`` (by default in the shared folder) and index them.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest key is a response and the
    others revisit it; rows that share that key are all responses. A null key is smaller than any other, a null payload
    is empty, a null address has the sort key of an empty one. Blanks and control characters in addresses are written as
    percent codes. Payloads of any length are kept whole; no rows give an index without parts.
    """
    folder = folder or f"{staging_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    firsts = blockindex.build(_firsts(rows, least_bytes), f"{folder}/digests", DIGEST_LINES)
    captures = staged(rows.mapInArrow(_archiver(f"{folder}/archives", firsts, least_bytes, level, date), _CAPTURE), "warc-captures")
    return Archive(folder, blockindex.build(captures, f"{folder}/captures"))


def _keys(urls: DataFrame, url: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])
    return urls.select(F.col(url).alias("url")).mapInArrow(run, "key string")


def captures(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """Index lines of all captures of the addresses: ``(key, id, type, digest, length, offset, file)``."""
    found = blockindex.look_up(archive.index, _keys(urls, url))
    fields = F.from_json("value", "id bigint, type string, digest string, length bigint, offset bigint, file string")
    return found.select("key", fields.alias("c")).select("key", "c.*")


_RECORD = ("id bigint, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to bigint, "
           "refers_url string")


def _fetcher(folder: str, payload: bool):
    def run(batches):
        store = Store(folder)
        for batch in batches:
            rows, bodies = [], []
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                head, body = parsed(zlib.decompress(store.read(name, at, size), GZIP))
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                first = head.get("WARC-Refers-To")
                if first is None and digest_of(body) != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} in {name} does not match its digest")
                rows.append((_key_of(head["WARC-Record-ID"]), head["WARC-Type"], head.get("WARC-Target-URI"), digest,
                             None if first else len(body), _key_of(first) if first else None,
                             head.get("WARC-Refers-To-Target-URI")))
                bodies.append(None if first else body)
            names = [x.split(" ")[0] for x in _RECORD.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            if payload:
                columns.append(pa.array(bodies, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["payload"] * payload])
        store.close()
    return run


def fetched(archive: Archive, found: DataFrame, payload: bool = False) -> DataFrame:
    """The records of captures, read by byte range in the order of the archives; digests are checked.

    ``(id, record_type, url, payload_digest, payload_bytes, refers_to, refers_url)``, and the ``payload`` if wanted; a
    revisit has neither payload nor its size.
    """
    order = found.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return order.mapInArrow(_fetcher(f"{archive.folder}/archives", payload), _RECORD + ", payload binary" * payload)


def read_back(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """All captures of the addresses with size and digest of their full payloads.

    ``(id, record_type, payload_digest, payload_bytes, refers_to)``. A revisit takes the size from the response it refers to,
    which is looked up in the index by its own address.
    """
    rows = staged(fetched(archive, captures(archive, urls, url)), "warc-records")
    wanted = rows.filter("record_type = 'revisit'").select("refers_to", "refers_url", "payload_digest").distinct()
    wanted = staged(wanted, "warc-wanted")
    responses = captures(archive, wanted, "refers_url").filter("type = 'response'").join(
        wanted.select(F.col("refers_to").alias("id"), F.col("payload_digest").alias("digest")).distinct(), ["id", "digest"], "left_semi")
    full = staged(fetched(archive, responses).groupBy("id", "payload_digest").agg(
        F.max("payload_bytes").alias("full_bytes")), "warc-responses")
    return rows.alias("p").join(full.alias("r"), (F.col("p.refers_to") == F.col("r.id"))
                                & (F.col("p.payload_digest") == F.col("r.payload_digest")), "left").select(
        "p.id", "p.record_type", "p.payload_digest",
        F.coalesce("p.payload_bytes", "r.full_bytes").alias("payload_bytes"), "p.refers_to")
