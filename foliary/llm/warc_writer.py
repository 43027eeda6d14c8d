"""WARC output compressed with a shared Zstandard dictionary.

Each task writes archives of its own. It trains a dictionary on its first records (a bounded sample), writes it in a
leading skippable frame (magic 0x184D2A5D), then compresses every record in a frame of its own, so that any record can be
read alone with its offset and the file's dictionary. Records with equal payloads become one response and revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise, open_fs, shared_dir

#: Magic number of the frame that holds the dictionary: one of the sixteen skippable ones.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 4 << 20, 64 << 10, 3


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """id, url, html, payload_digest, record_type, refers_to (id and url of the response) per row.

    Of rows with equal payloads of at least ``least`` bytes those with the largest id are responses (null ids count as smallest; rows that
    tie are all responses); the others revisit it. Smaller payloads are all responses. A null payload is an empty one.
    Other columns are not read. A payload that many rows share is handled in salted parts.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))

    def sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [digest(x.as_buffer().to_pybytes()) for x in b.column("html").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d)], [*b.schema.names, "payload_digest"])

    rows = rows.mapInArrow(sha, "id bigint, url string, html string, payload_digest string")
    top = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "url"))
    out = attach(rows, ["payload_digest"], [("top", top)], [F.max("top")], F.hash("id", "url"))
    again = (F.octet_length("html") >= least) & F.col("top.has") & ~F.col("id").eqNullSafe(F.col("top.id"))
    return out.select(
        "id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top.id")).alias("refers_to"), F.when(again, F.col("top.url")).alias("refers_url")
    )


def _uid(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _line(text: str | None) -> str:
    return "".join(c if c not in "\r\n" else " " for c in (text or "")).strip()


def record(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its WARC-Payload-Digest and length are those of the full payload."""
    body = row["html"].encode() if row["record_type"] == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_uid(row['id'])}",
        f"WARC-Target-URI: {_line(row['url'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-Payload-Length: {len(row['html'].encode())}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_uid(row['refers_to'])}",
            f"WARC-Refers-To-Target-URI: {_line(row['refers_url'])}",
        ]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def write_archives(records: DataFrame, out: str, sample: int = SAMPLE_BYTES, dictionary: int = DICTIONARY_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``records`` (as of :func:`plan_records`) below the URI ``out``. Returns file, records: those of successful attempts.

    The dictionary is trained on at most ``sample`` bytes of the first records of a file; with too few to train on, it is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        rows = (record(r) for b in batches for i in range(0, b.num_rows, 200) for r in b.slice(i, 200).to_pylist())
        first, size = [], 0
        for r in rows:
            first.append(r)
            size += len(r)
            if size >= sample:
                break
        if not first:
            return
        try:
            trained = zstandard.train_dictionary(min(dictionary, max(size // 8, 256)), first).as_bytes()
        except zstandard.ZstdError:
            trained = b""
        made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True)
        fs, folder = open_fs(out)
        fs.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.zst", 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
            for part in (first, rows):
                for r in part:
                    f.write(made.compress(r))
                    n += 1
        yield pa.RecordBatch.from_pylist([{"file": name, "records": n}], pa.schema([("file", pa.string()), ("records", pa.int64())]))

    # the records are spread over salted digests already: no further shuffle of the payloads
    return materialise(records.mapInArrow(run, "file string, records bigint"), "archives")


def read_file(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive: the dictionary of the leading frame, then frame by frame."""
    import zstandard

    magic, n = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]) if n else None)
    view = memoryview(raw)[8 + n :]
    while view:
        one = made.decompressobj()
        data = one.decompress(view)
        yield parse(data)
        view = view[len(view) - len(one.unused_data) :]


def read_archives(files: DataFrame, out: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, checked (a response's block has that digest) per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("checked", pa.bool_())])
        number = lambda u: None if u in (None, "<urn:page:null>") else int(u[10:-1])
        fs, folder = open_fs(out)
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_file(f"{folder}/{name}") as f:
                    raw = f.read()
                rows = []
                for h, block in read_file(raw):
                    d = h["warc-payload-digest"].removeprefix("sha1:")
                    whole = h["warc-type"] == "response"
                    rows.append((number(h["warc-record-id"]), h["warc-target-uri"], int(h["warc-payload-length"]), digest(block) if whole else d, h["warc-type"], number(h.get("warc-refers-to")), not whole or (digest(block) == d and len(block) == int(h["warc-payload-length"]))))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, checked boolean")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    out = shared_dir(spark, "warc")
    files = write_archives(plan_records(pages, id_col, url_col, payload_col, least), out)
    return read_archives(files, out)
