"""Zstandard WARC archives: one frame per record behind a leading skippable frame with the dictionary.

Writing.  Spark's text writer puts the bytes of a string column into a file as they are and a
separator after each row.  Each row here is one zstd frame and the separator is an empty skippable
frame, whose eight bytes are ASCII; so every part file is a valid .warc.zst archive, written through
any file system Spark knows with its commit protocol, and retried tasks leave no halves.  A task begins
a new archive, in a folder of its number, when one has ARCHIVE_BYTES, so none is larger by more than a
record.  The first row of a task's archives is the skippable frame 0x184D2A5D with a dictionary trained
on that task's first records (a bounded sample, DICTIONARY_SAMPLE bytes; it affects sizes only).

Of records with equal payloads of at least `least` bytes, that with the largest id is a response and
the others are revisits without payload that refer to it.  Digests find them: (digest, largest id)
is aggregated before the shuffle and joined back, and a digest that a third of all rows share is one
row on that side of the join, so the other can be split.  Shorter payloads are keyed by their row.

Reading.  The binaryFile source hands whole archives to Python (a partition of it is one archive, or
several of spark.sql.files.maxPartitionBytes together), which finds a frame's end from its block
headers before it decodes that frame.  Version line, header syntax, mandatory fields, Content-Length,
the final CRLFs, the dictionary's id and block and payload digests are checked; a fault raises, or
with strict=False gives a row with `error`, and the archive's next record goes on: after a frame that
is whole but wrong, the one behind it; after one without a proper end, the next that begins like one.

Defined results: null html is an empty payload; a null id is always a response, named null; null urls leave WARC-Target-URI out; bytes of urls
that a header can't hold are percent-encoded; rows with one id and equal payloads of at least
`least` bytes are each a response; an empty table gives archives without records; long payloads are
held one at a time, next to their archive; only id, url and html are read, so further columns may have
any name.
"""

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame, 0x184D2A50: the separator between records.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES, DICTIONARY_SAMPLE = 16 << 10, 1 << 20
LEVEL = 3
ARCHIVE_BYTES = 32 << 20
#: The one header that a record may have several times.
REPEATED = "warc-concurrent-to"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
RECORD_SCHEMA = "archive string, offset bigint, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, error string"


class WarcError(ValueError):
    pass


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest(stated: str) -> bytes | None:
    """The SHA-1 that a digest header states, in base 32 or hex; None for other algorithms."""
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        raise WarcError(f"digest {stated[:80]!r}") from None


def build_record(record_id: str, url: str | None, payload: bytes, payload_sha1: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: a response, or with refers_to a revisit, which has no payload."""
    body = b"" if refers_to else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + body
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(payload_sha1).decode()), ("WARC-Block-Digest", _sha1(block))]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, with every length and digest checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    key = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and key:  # a folded line goes on
            fields[key.lower()] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", key):
            raise WarcError(f"bad header line {line[:80]!r}")
        if key.lower() in fields:
            if key.lower() != REPEATED:
                raise WarcError(f"header {key} twice")
            value = f"{fields[REPEATED]} {value}"
        fields[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise WarcError(f"no {key}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {fields['content-length']} but {len(rest) - 4} bytes and the end {rest[-4:]!r}")
    block = rest[:-4]
    if (stated := _digest(fields.get("warc-block-digest", ""))) and stated != hashlib.sha1(block).digest():
        raise WarcError("block digest")
    kind = fields["warc-type"]
    out = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": None, "payload": None, "payload_bytes": len(block), "payload_digest": None}
    digest = _digest(fields.get("warc-payload-digest", ""))
    if kind in ("response", "revisit"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not gap or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP header")
        if kind == "response":
            if length and int(length[1]) != len(payload):
                raise WarcError(f"payload of {len(payload)} bytes, {int(length[1])} stated")
            if digest and digest != hashlib.sha1(payload).digest():
                raise WarcError("payload digest")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        else:
            if payload or "warc-refers-to" not in fields or not digest:
                raise WarcError("a revisit with a payload, or without what it refers to")
            out |= {"refers_to": fields["warc-refers-to"].strip("<>"), "payload_bytes": int(length[1]) if length else None, "payload_digest": digest.hex()}
    return out


def _frame_end(data, at: int) -> int:
    """Where the zstd frame at `at` ends, from its block headers."""
    import zstandard

    p = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError("truncated frame")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * p.has_checksum
    if end > len(data):
        raise WarcError("truncated frame")
    return end


def _begins(data, at: int) -> bool:
    """Whether a frame or a skippable frame begins at `at`."""
    magic = int.from_bytes(data[at : at + 4], "little")
    return magic == FRAME_MAGIC or magic & 0xFFFFFFF0 == 0x184D2A50


def frames(data: bytes, strict: bool = True) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, None) of each frame with data; a leading skippable frame gives the dictionary.

    A fault raises, or if not strict gives (offset, None, what it is), and the next frame follows.
    """
    import zstandard

    view, at, d = memoryview(data), 0, None
    decode = zstandard.ZstdDecompressor()
    while at < len(view):
        content, found, end = None, False, None
        try:
            if at + 8 > len(view):
                raise WarcError("truncated frame")
            magic, size = struct.unpack_from("<II", view, at)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if at + 8 + size > len(view):
                    raise WarcError("truncated skippable frame")
                end = at + 8 + size
                if magic == DICTIONARY_MAGIC and at == 0:
                    raw = bytes(view[8:end])
                    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    d = zstandard.ZstdCompressionDict(raw)
                    decode = zstandard.ZstdDecompressor(dict_data=d)
            elif magic == FRAME_MAGIC:
                end = _frame_end(view, at)
                need = zstandard.get_frame_parameters(view[at : at + 18]).dict_id
                if need and (d is None or d.dict_id() != need):
                    raise WarcError(f"dictionary {need} is missing")
                content, found = decode.decompressobj().decompress(view[at:end]), True
            else:
                raise WarcError(f"no frame at {at}")
        except Exception as e:
            if strict:
                raise
            yield at, None, f"{type(e).__name__}: {e}"
            if end is not None and end < len(view) and not _begins(view, end):
                end = None  # the end that its block headers tell is not one: a part of it is missing
        if found:
            yield at, content, None
        if end is None:  # the next place that begins like a frame
            next_at = data.find(struct.pack("<I", FRAME_MAGIC), at + 1)
            end = next_at if next_at >= 0 else len(view)
        at = end


def _archive(batches: Iterator[pd.DataFrame], level: int, most: int) -> Iterator[pd.DataFrame]:
    """One partition -> the frames of its archives (archive, nth, value), the dictionary first in each."""
    import zstandard

    packer, waiting, held = None, [], 0
    head, archive, nth, size = b"", 0, 0, 0

    def start() -> Iterator[bytes]:
        nonlocal packer, head
        d = None
        samples = [r[:8192] for r in waiting if r]
        if len(samples) >= 8 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES // 4:
            try:
                d = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
            except zstandard.ZstdError:  # samples that have nothing in common give none
                d = None
        packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        if d:
            head = struct.pack("<II", DICTIONARY_MAGIC, len(d.as_bytes())) + d.as_bytes()
        for r in waiting:
            yield packer.compress(r)
        waiting.clear()

    def rolled(found: list[bytes]) -> pd.DataFrame:
        nonlocal archive, nth, size
        rows = []
        for x in found:
            if size >= most:
                archive, nth, size = archive + 1, 0, 0
            if nth == 0 and head:
                rows.append((archive, -1, head))
            rows.append((archive, nth, x))
            nth, size = nth + 1, size + len(x)
        return pd.DataFrame(rows, columns=["archive", "nth", "value"])

    for b in batches:
        out = []
        for page, url, html, sha1, refers in zip(b["_id"], b["_url"], b["_html"], b["_sha1"], b["_refers"]):
            record = build_record(f"{RECORD}{page or 'null'}", url, (html or "").encode("utf-8", "surrogatepass"), bytes.fromhex(sha1), f"{RECORD}{refers}" if refers else None)
            if packer:
                out.append(packer.compress(record))
            else:
                waiting.append(record)
                held += len(record)
                if held >= DICTIONARY_SAMPLE:
                    out += start()
        if out:
            yield rolled(out)
    if not packer and waiting:
        yield rolled([*start()])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row to archives in `path`."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_key"), F.col(id_col).cast("string").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"), F.sha1(F.encode(html, "UTF-8")).alias("_sha1"))
    long = F.octet_length("_html") >= least
    large = rows.where(long).groupBy("_sha1").agg(F.max("_key").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_sha1").alias("_of"), "_last")
    # Short payloads have a key of their own, so that their many copies never meet.
    rows = rows.withColumn("_on", F.when(long, F.col("_sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("_id", "_url", F.monotonically_increasing_id()))))
    joined = rows.join(large, F.col("_on") == F.col("_of"), "left")
    refers = F.when(F.col("_last") != F.col("_key"), F.col("_last").cast("string"))
    ready = joined.select("_id", "_url", "_html", "_sha1", refers.alias("_refers"))
    packed = ready.mapInPandas(lambda it: _archive(it, level, archive_bytes), "archive int, nth bigint, value binary")
    packed = packed.sortWithinPartitions("archive", "nth").select("archive", F.col("value").cast("string").alias("value"))
    packed.write.mode("overwrite").partitionBy("archive").option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of all archives in `path` (RECORD_SCHEMA); payload=False leaves payloads out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
        for b in batches:
            for archive, data in zip(b["path"], b["content"]):
                rows, held = [], 0
                for offset, content, error in frames(data, strict):
                    row = dict.fromkeys(names) | {"archive": archive, "offset": offset, "error": error}
                    if error is None:
                        try:
                            row |= parse_record(content)
                        except Exception as e:
                            if strict:
                                raise
                            row["error"] = f"{type(e).__name__}: {e}"
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(work, RECORD_SCHEMA)
