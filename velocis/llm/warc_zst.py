"""WARC archives in Zstandard (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds the dictionary (itself a
Zstandard frame), then has one frame per record. The writer is Spark's own
text sink with a line separator that *is* an empty skippable frame, so files
go through the commit protocol to any store Spark can write; a row is the
bytes of one frame. The reader takes ``binaryFile`` rows, loads the dictionary
from the leading frame, walks the frames by their headers, decodes each on its
own and validates record headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velocis.llm.common import about, materialise, shuffle_partitions
from velocis.session import scratch_path, ship_code

# Fixed values of the formats.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame, 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on about so many pages (by hash), of each so many bytes.
DICTIONARY_PAGES, DICTIONARY_SAMPLE, DICTIONARY_BYTES = 256, 16 << 10, 32 << 10
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_FROM = 100


class WarcError(ValueError):
    """A frame or record that breaks the format."""


# ---- frames -----------------------------------------------------------------

def frames(buf: bytes):
    """``(magic, start, end)`` of each frame; skippable frames give their content's place."""
    pos, n = 0, len(buf)
    while pos < n:
        if n - pos < 8:
            raise WarcError(f"truncated frame at byte {pos}")
        magic = int.from_bytes(buf[pos:pos + 4], "little")
        if magic in SKIPPABLE:
            end = pos + 8 + int.from_bytes(buf[pos + 4:pos + 8], "little")
            start = pos + 8
        elif magic == ZSTD_MAGIC:
            start, end = pos, _frame_end(buf, pos)
        else:
            raise WarcError(f"no frame at byte {pos}")
        if end > n:
            raise WarcError(f"truncated frame at byte {pos}")
        yield magic, start, end
        pos = end


def _frame_end(buf: bytes, pos: int) -> int:
    flags = buf[pos + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    p = pos + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(buf[p:p + 3], "little")
        if p + 3 > len(buf) or block >> 1 & 3 == 3:
            raise WarcError(f"bad block at byte {p}")
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return p + 4 * checksum


def train_dictionary(samples: list) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES, or none if there is too little to learn from."""
    import zstandard
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


# ---- records ----------------------------------------------------------------

def record(kind: str, headers: list, block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
            ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit (HTTP header only) of that page's record."""
    from urllib.parse import quote
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n")
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
               ("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", headers, http.encode() + payload)
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return record("revisit", headers, http.encode())


def parse_record(raw: bytes) -> dict:
    """One record, validated: version line, header syntax, lengths and digests."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k or k != k.strip():
            raise WarcError("bad header line")
        h[k.decode("ascii", "strict").lower()] = v.strip().decode("utf-8")
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in h:
            raise WarcError(f"no {k}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("length differs from Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and h["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("block digest differs")
    out = {"type": h["warc-type"], "id": h["warc-record-id"], "uri": h.get("warc-target-uri"), "headers": h,
           "refers_to": h.get("warc-refers-to"), "payload": None, "bytes": None, "digest": None}
    if out["type"] in ("response", "revisit"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        n = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not http.startswith(b"HTTP/") or not sep or len(n) != 1 or not n[0].isdigit():
            raise WarcError("no HTTP response in the block")
        out["bytes"] = int(n[0])
        algorithm, _, out["digest"] = h.get("warc-payload-digest", "").partition(":")
        if algorithm != "sha256":
            raise WarcError("no SHA-256 payload digest")
        if out["type"] == "revisit":
            if payload or out["refers_to"] is None:
                raise WarcError("a revisit needs WARC-Refers-To and no payload")
        elif len(payload) != out["bytes"] or hashlib.sha256(payload).hexdigest() != out["digest"]:
            raise WarcError("payload differs from its length or digest")
        else:
            out["payload"] = payload
    return out


def read_archive(buf: bytes):
    """``(record, error)`` for each record frame; a file that breaks off ends with an error."""
    import zstandard
    plain = decoder = zstandard.ZstdDecompressor()
    try:
        for i, (magic, start, end) in enumerate(frames(buf)):
            if magic != ZSTD_MAGIC:
                if i == 0 and magic == DICTIONARY_MAGIC:
                    body = buf[start:end]
                    if body[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
                        body = plain.decompress(body)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                continue
            try:
                yield parse_record(decoder.decompress(buf[start:end])), None
            except (WarcError, zstandard.ZstdError, UnicodeDecodeError) as e:
                yield None, f"byte {start}: {e}"
    except (WarcError, IndexError, zstandard.ZstdError) as e:
        yield None, str(e)


# ---- over the cluster -------------------------------------------------------

def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, payload)`` with ``digest`` and ``refers_to``: of equal payloads of
    at least REVISIT_FROM bytes the smallest id is the response, rows with other ids revisit it."""
    d = pages.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    first = materialise(d.where(F.col("n") >= REVISIT_FROM).groupBy("digest", "n")
                        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
                        .where("rows > 1 AND first IS NOT NULL").select("digest", "n", "first"), "warc-first")
    return d.join(first, ["digest", "n"], "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")),
                            F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record per row of ``pages`` into archives of about
    ``archive_bytes`` of payload below ``path``; returns ``path``.

    Null html is an empty payload, a null url leaves the target out, a null id
    is written ``null``: it revisits like any other row but is never referred
    to. Rows that repeat the smallest id of their payload are all responses.
    Other columns are ignored; an empty table gives archives without pages.
    """
    spark = pages.sparkSession
    ship_code(spark)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    total = p.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
    sample = about(p.where(F.octet_length("payload") > 0), DICTIONARY_PAGES, "payload", "page_id") \
        .select(F.expr(f"substring(payload, 1, {DICTIONARY_SAMPLE})").alias("s")).collect()
    dictionary = train_dictionary(sorted(bytes(r["s"]) for r in sample))
    files = max(shuffle_partitions(spark), -(-total // archive_bytes))

    def records(batches):
        import pyarrow as pa
        import zstandard
        from velocis.llm.warc_zst import dictionary_frame, page_record, record
        kw = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        z = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **kw)
        info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        lead = ([dictionary_frame(dictionary)] if dictionary else []) + [z.compress(info)]
        for b in batches:
            out, lead = lead, []
            for r in b.to_pylist():
                out.append(z.compress(page_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"],
                                                  date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = with_revisits(p.withColumn("rid", F.monotonically_increasing_id())).repartition(files, "rid") \
        .select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(records, "frame binary").select(F.col("frame").cast("string").alias("value")) \
        .write.option("lineSep", SEPARATOR).option("compression", "none").text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True, on_error: str = "raise") -> DataFrame:
    """Archives below ``path`` -> one row per response or revisit record:
    ``file, record_id, refers_to, target_uri, record_type, payload_bytes,
    payload_digest, payload, error``. A revisit has the length and digest of the
    full payload but no payload. A broken record or file raises, or with
    ``on_error="row"`` gives a row with ``error`` and what follows it is read."""
    ship_code(spark)

    def parse(batches):
        import pyarrow as pa
        from velocis.llm.warc_zst import WarcError, read_archive
        names = ["file", "record_id", "refers_to", "target_uri", "record_type", "payload_bytes", "payload_digest",
                 "payload", "error"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for f, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                for r, error in read_archive(content.as_py()):
                    if error and on_error == "raise":
                        raise WarcError(f"{f}: {error}")
                    if error:
                        rows.append((f, None, None, None, None, None, None, None, error))
                    elif r["type"] in ("response", "revisit"):
                        rows.append((f, r["id"], r["refers_to"], r["uri"], r["type"], r["bytes"], r["digest"],
                                     r["payload"] if payloads else None, None))
                        size += len(r["payload"] or b"") if payloads else 0
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, record_id string, refers_to string, target_uri string, "
                                   "record_type string, payload_bytes long, payload_digest string, payload binary, "
                                   "error string")


def page_of(urn: str) -> Column:
    """The page id in a record id, null for pages without one."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(.*)>$', 1) AS BIGINT)")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared checkpoint folder and read them
    back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}"))
    return read_archives(spark, path, payloads=False).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"))


ORACLE = f"""
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r THEN first END AS refers_to
FROM (SELECT *, strlen(coalesce(html, '')) >= {REVISIT_FROM} AND page_id IS DISTINCT FROM first AS r
      FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
