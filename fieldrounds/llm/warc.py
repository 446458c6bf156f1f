"""WARC archives with dictionary-compressed records.

A Zstandard dictionary is built once from a bounded, seeded sample of the records. Every archive file starts with it in
a skippable frame, so the file can be read alone, and each record is a frame of its own, so any record can be read at its offset.
Tasks write files under the shared folder through the file system of its address, each under a name no other
attempt uses; only files that a finished task reports are in the manifest, so a lost task leaves no half archive in it.

Equal payloads (by SHA-256) of at least ``least`` bytes are stored once: the record with the smallest page id is the
response, others are revisits that name it and carry length and digest of the full payload. Reading takes length and digest of a response from the payload
that was read, and fails if the record's head says otherwise; ``check_revisits`` compares revisits with the responses they name.

Cases: a null html is an empty payload; a null url leaves out the target header; a null page id is written as ``none``, is never
the one referred to while its group has another id, and reads back as null. Rows that repeat the smallest id are each a response. An
empty table gives no record. Only the named columns are read. A very long html needs the memory of one record, packed and unpacked, in a task.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, stored
from .common import lowest_part

MAGIC = 0x184D2A5D          # fixed value: the skippable frame that holds a dictionary in a Zstandard WARC file
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 800, 8192, 65536
ARCHIVE_BYTES = 256 << 20   # an archive is closed once its payloads reach this
DATE = "2000-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_of_hex(h: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits are 20 bits, four characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """Each page with its payload's digest and whether it is a response or a revisit of which page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key"))
    ids = (keyed.where(F.octet_length("payload") >= least).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
           .where("n > 1").select(F.col("key").alias("_key"), "first_id"))
    joined = keyed.join(ids, F.col("key") == F.col("_key"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", base32_of_hex(F.sha1("payload")).alias("digest"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def _identity(page_id) -> str:
    return "<urn:page:none>" if pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    again = not pd.isna(refers_to)
    head = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_identity(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if again:
        head += [f"WARC-Refers-To: {_identity(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if again else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """``page_id, length and digest of the full payload, type, refers_to, stored payload`` of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    h = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda name: None if h.get(name, "<urn:page:none>") == "<urn:page:none>" else int(h[name][len("<urn:page:"):-1])
    n = int(h["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length and content differ")
    body, digest, refers_to = rest[:n], h["WARC-Payload-Digest"][len("sha1:"):], number("WARC-Refers-To")
    size = int(h["X-Payload-Length"])
    if h["WARC-Type"] == "response":
        size, told = len(body), size
        digest, said = base64.b32encode(hashlib.sha1(body).digest()).decode(), digest
        if (size, digest) != (told, said):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} is not the one that was archived")
    elif body:
        raise ValueError(f"{h['WARC-Record-ID']} is a revisit and has a payload")
    return number("WARC-Record-ID"), size, digest, h["WARC-Type"], refers_to, body


def check_revisits(records: DataFrame) -> DataFrame:
    """``records`` (as read), after a look whether every revisit names a response with its length and digest; raises if one does not.

    What revisits say of one response is first made distinct, so that a page that most others repeat is one row.
    """
    c = F.col
    said = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_bytes", "payload_digest").agg(F.count("*").alias("n"))
    there = records.where("record_type = 'response'").select(c("page_id").alias("_id"), c("payload_bytes").alias("_bytes"), c("payload_digest").alias("_digest")).distinct()
    same = c("refers_to").eqNullSafe(c("_id")) & (c("payload_bytes") == c("_bytes")) & (c("payload_digest") == c("_digest"))
    wrong = said.join(there, same, "left_anti").limit(1).collect()
    if wrong:
        raise ValueError(f"a revisit of page {wrong[0]['refers_to']} is not of the payload archived there")
    return records


def build_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most ``SAMPLE_RECORDS`` payload beginnings, first in a seeded order.

    It only shapes the compression; every payload is archived whole. Where the samples are too few to train one, it is their text itself behind the
    head that all records share, so that every archive has a dictionary.
    """
    import zstandard

    rows = (pages.select(F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, SAMPLE_BYTES).alias("p"), F.xxhash64("page_id").alias("h"))
            .where(lowest_part(F.col("h"), SAMPLE_RECORDS, pages.count())).orderBy("h", "p").limit(SAMPLE_RECORDS).collect())
    samples = [bytes(r["p"]) for r in rows if r["p"]]
    head = record_bytes(0, "http://", b"", "", None)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b"".join([*samples, head])[-DICT_BYTES:]
    except zstandard.ZstdError:                  # samples too short or too alike to train on
        return b"".join([*samples, head])[-DICT_BYTES:]


def write(pages: DataFrame, folder: str, dictionary: bytes, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return the manifest: ``path, records, bytes``."""
    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared)
        out, path, done = None, "", (0, 0, 0)
        for b in batches:
            for row in b.itertuples(index=False):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, done = where.open_output_stream(path, compression=None), (0, 0, 0)   # not by the name: frames are made here
                    if dictionary:
                        out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                frame = packer.compress(record_bytes(row.page_id, row.url, row.payload, row.digest, row.refers_to))
                out.write(frame)
                done = (done[0] + 1, done[1] + len(frame), done[2] + len(row.payload))
                if done[2] >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [done[0]], "bytes": [done[1]]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [done[0]], "bytes": [done[1]]})
    return stored(planned(pages, least).mapInPandas(archive, "path string, records long, bytes long"), "manifest")


def _frames(data: memoryview, unpacker, step: int = 1 << 20):
    """The records of an archive body, frame by frame."""
    at = 0
    while at < len(data):
        one = unpacker.decompressobj()
        parts, start = [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"the archive ends within the frame at {start}")
            chunk = bytes(data[at:at + step])
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``manifest``."""
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for b in batches:
            for path in b["path"]:
                with where.open_input_file(path) as f:
                    data = memoryview(f.read())
                shared = None
                if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == MAGIC:
                    n = struct.unpack("<I", data[4:8])[0]
                    shared, data = zstandard.ZstdCompressionDict(bytes(data[8:8 + n])), data[8 + n:]
                unpacker, rows = zstandard.ZstdDecompressor(dict_data=shared), []
                for raw in _frames(data, unpacker, 16384):
                    got = parse_record(raw)
                    rows.append(got if with_payload else (*got[:5], None))
                    if len(rows) == 2000:
                        yield _typed(rows, names)
                        rows = []
                if rows:
                    yield _typed(rows, names)
    # One task per archive: small manifest files would else be read by one task.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInPandas(records, RECORDS)


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
