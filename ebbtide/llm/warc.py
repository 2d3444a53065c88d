"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by sidecar index.

A monolithic archive is one gzip stream over many records; nothing in it can be reached without
inflating all that comes before. The normaliser inflates such a file once, as a stream, writes each
record as a gzip member of its own, and an index of where each member starts and how long it
is. One file is one task's work, because a gzip stream has no other entry; the writer
therefore closes an archive after a stated number of payload bytes.

Archives travel as rows of a binary column, so they can be kept in any store that Spark reads or writes; the index
is a table of its own beside them. Archives that break off or hold something else give the records before the
break, and their name and the reason to a dead-letter table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, durable_buckets
from .decontaminate import BLOCK, marked
from .text import bounded

ARCHIVE_BYTES = 8 << 20  # payload after which the writer starts another archive
PIECE = 1 << 16
LEVEL = 3
GZIP = 31  # zlib's window bits for the gzip format

#: Fixed values. Headers that are read here, as they are written; senders may write them in any case.
NAMES = {x.lower(): x for x in ("Content-Length", "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "X-Payload-Length")}

ARCHIVE = "archive string, content binary"
INDEX = "archive string, nth long, at long, length long, record_id string, record_type string"
RECORD = "archive string, nth long, headers map<string,string>, payload binary"


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC/1.0 record; line ends in header values are percent-encoded."""
    clean = {k: v.replace("\r", "%0D").replace("\n", "%0A") for k, v in headers.items()}
    clean["Content-Length"] = str(len(payload))
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members, in bounded pieces. A broken stream raises."""
    unzip = zlib.decompressobj(GZIP)
    fresh = True
    for piece in pieces:
        while piece:
            fresh = False
            yield unzip.decompress(piece, PIECE * 16)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, PIECE * 16)
            piece = unzip.unused_data
            if unzip.eof:
                unzip, fresh = zlib.decompressobj(GZIP), True
            else:
                break
    if not fresh:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, raw record) of each record in plain WARC content; holds one record at a time."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        got = next(pieces, None)
        if got is None:
            ended = True
            return False
        held.extend(got)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if bytes(held).strip():
                    raise ValueError("a WARC record ends early")
                return
        lines = bytes(held[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("Content-Length", "").isdigit():
            raise ValueError("a WARC record has no length")
        full = end + 4 + int(headers["Content-Length"]) + 4
        while len(held) < full:
            if not more():
                raise ValueError("a WARC record ends early")
        yield headers, bytes(held[:full])
        del held[:full]


def payload_of(raw: bytes) -> bytes:
    return raw[raw.index(b"\r\n\r\n") + 4 : -4]


def normalise(read: Iterator[bytes], write: Callable[[bytes], None]) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite one gzip archive member by member; yields (start, length, headers) of each as it is written."""
    at = 0
    for headers, raw in records(inflated(read)):
        zip_ = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        member = zip_.compress(raw) + zip_.flush()
        write(member)
        yield at, len(member), headers
        at += len(member)


def _pieces(content: bytes) -> Iterator[bytes]:
    return (content[at : at + PIECE] for at in range(0, len(content), PIECE))


def write_archives(rows: DataFrame, prefix: str = "part") -> DataFrame:
    """(record_id, uri, record_type, refers_to, digest, payload_bytes, payload) -> (archive, content), one gzip stream each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        zip_, out = None, bytearray()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"{prefix}-{part:05d}-{n:06d}.warc.gz"], "content": [bytes(out + zip_.flush())]})

        for batch in batches:
            for x in batch.to_pylist():
                if zip_ is None:
                    zip_, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), bytearray(), 0
                headers = {
                    "WARC-Type": x["record_type"],
                    "WARC-Record-ID": f"<urn:page:{x['record_id']}>",
                    "WARC-Target-URI": x["uri"] or "",
                    "WARC-Payload-Digest": f"sha1:{x['digest']}",
                    "X-Payload-Length": str(x["payload_bytes"]),
                    "Content-Type": "text/html; charset=utf-8",
                }
                if x["record_type"] == "revisit":
                    headers |= {"WARC-Refers-To": f"<urn:page:{x['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
                payload = x["payload"] or b""
                out += zip_.compress(record(headers, payload))
                size += len(payload) + 512
                if size >= ARCHIVE_BYTES:
                    yield close()
                    zip_, n = None, n + 1
        if zip_ is not None:
            yield close()

    return bounded(rows).select("record_id", "uri", "record_type", "refers_to", "digest", "payload_bytes", "payload").mapInArrow(of, ARCHIVE)


def normalise_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Monolithic (archive, content) -> the same archives with a member per record, their index, and (archive, reason)
    of those that broke, with the records before the break in the first two.

    All come from one pass. The archives are kept bucketed by name, so that readers bring index entries to them and
    not the other way round; the index is a table of its own. Archives already in members, or empty, pass too.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, index, reason = bytearray(), [], None
                try:
                    for n, (at, size, h) in enumerate(normalise(_pieces(content.as_py() or b""), out.extend)):
                        index.append({"nth": n, "at": at, "length": size, "record_id": h.get("WARC-Record-ID"), "record_type": h.get("WARC-Type")})
                except (ValueError, zlib.error) as broken:
                    reason = str(broken)
                yield pa.RecordBatch.from_pydict(
                    {"archive": [name], "content": [bytes(out)], "entries": [index], "reason": [reason]},
                    schema=pa.schema([("archive", pa.string()), ("content", pa.binary()), ("entries", entries), ("reason", pa.string())]),
                )

    entries = pa.list_(pa.struct([("nth", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
    kind = "archive string, content binary, entries array<struct<nth:long,at:long,length:long,record_id:string,record_type:string>>, reason string"
    both = durable_buckets(archives.select("archive", "content").mapInArrow(of, kind), "archive", "none")
    return both.select("archive", "content"), durable(both.select("archive", F.inline("entries"))), both.where("reason is not null").select("archive", "reason")


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """Each indexed member, cut out of its archive by offset and inflated alone: (archive, nth, headers, payload)."""
    wanted = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("at", "length", "nth"))).alias("members"))  # of one archive

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, members in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = content.as_buffer()
                for first in range(0, len(members), 256):
                    out = {"archive": [], "nth": [], "headers": [], "payload": []}
                    for m in members[first : first + 256]:
                        raw = zlib.decompress(data[m["at"] : m["at"] + m["length"]], GZIP)
                        headers, raw = next(records(iter([raw])))
                        out["archive"].append(name)
                        out["nth"].append(m["nth"])
                        out["headers"].append(list(headers.items()))
                        out["payload"].append(payload_of(raw))
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("archive", pa.string()), ("nth", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]))

    return archives.join(wanted.hint("shuffle_hash"), "archive").select("archive", "content", "members").mapInArrow(of, RECORD)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest):
    """A 160-bit hex digest in base 32, in DataFrame functions: four words of 40 bits, eight letters each."""
    letters = F.array(*map(F.lit, ALPHABET))
    out = []
    for word in range(4):
        value = F.conv(F.substring(digest, 10 * word + 1, 10), 16, 10).cast("long")
        out += [F.get(letters, F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(8)]
    return F.concat(*out)


def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as records to write: of equal payloads the largest id is the response, the others revisit it, without payload.

    Null html is empty. Null ids rank below all others; rows that repeat an id and a payload are alike
    and have one type. Equality is by length and SHA-1, as the revisit profile has it. Only digests are shuffled:
    responses are marked in the table of bodies where it stands, and revisits need no body.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), html.alias("payload"))
    known = numbered.withColumns({"block": F.expr(f"row div {BLOCK}"), "payload_bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    rows = durable_buckets(known, "block", "zstd")
    slim = rows.select("row", "record_id", "uri", "payload_bytes", "sha")
    first = durable(slim.groupBy("sha", "payload_bytes").agg(F.max("record_id").alias("first_id")))
    typed = durable(slim.join(first, ["sha", "payload_bytes"]).withColumn("own", F.col("record_id").eqNullSafe(F.col("first_id"))))
    columns = ["record_id", "uri", "record_type", "refers_to", base32_of_hex(F.col("sha")).alias("digest"), "payload_bytes", "payload"]
    responses = marked(rows, typed.where("own").select("row")).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    revisits = typed.where("not own").withColumns({"record_type": F.lit("revisit"), "refers_to": F.col("first_id"), "payload": F.lit(None).cast("binary")})
    return responses.select(*columns).unionAll(revisits.select(*columns))


def page_archive_rows(pages: DataFrame) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and read every record back by the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, archive, nth). What a response stores is
    measured anew; a revisit has its own headers.
    """
    whole = durable(write_archives(page_records(pages)), "none")
    archives, index, _ = normalise_archives(whole)
    got = read_records(archives, index)
    number = lambda name: F.regexp_extract(F.col("headers")[name], r"<urn:page:(-?\d+)>", 1)
    answer = F.col("headers")["WARC-Type"] == "response"
    return got.select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        F.when(answer, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).alias("payload_bytes"),
        F.when(answer, base32_of_hex(F.sha1("payload"))).otherwise(F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
        F.col("headers")["WARC-Type"].alias("record_type"),
        F.when(~answer, F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long")).alias("refers_to"),
        "archive",
        "nth",
    )
