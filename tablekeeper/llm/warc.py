"""Legacy archive converter: ARC files (versions 1 and 2) to WARC records, and WARC reading.

An ARC file starts with a version block whose first line names the version and whose second line names the
fields of the URL records' header lines; each record is one such line followed by the declared number of
bytes. Version 1 has five fields, version 2 ten; the length is the last one in both.

Each URL record becomes a WARC ``response`` record with a synthesised identifier, timestamp, content type
and SHA-1 digests. Records of equal payloads are then linked: the one with the largest page id stays a
response and the others become ``revisit`` records without payload.

Defined results: a NULL html is an empty payload; a NULL url is written as ``urn:none``; blanks and control
characters in a URL are percent-encoded; repeated page ids with equal payloads are all written, and if they
have the largest id they are all responses; a NULL page id is written as ``-1`` and read back as NULL; pages
below the size limit are never linked; an empty table gives no records; other columns are ignored.
"""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tablekeeper.llm.tables import load, staged
from tablekeeper.session import work_dir

LEAST_LINKED = 1000
#: Bytes aimed at for one archive file, and records in one ARC archive made from pages.
ARCHIVE_BYTES = 16 << 20
ARC_RECORDS = 64

# Field lines and block of the ARC version header, and names of the WARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_DATE = "20240101000000"


# --- ARC -----------------------------------------------------------------------------------------

def clean_url(url):
    """The URL without characters that end a header field."""
    if not url:
        return "urn:none"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def arc_archive(name, version, records):
    """Bytes of an ARC archive of (url, ip, date, content type, status, body) records."""
    about = f"{version} 0 tablekeeper\n{ARC_FIELDS[version]}\n".encode()
    fixed = f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain"
    extra = " 200 - - 0 " + name if version == 2 else ""
    parts = [f"{fixed}{extra} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, parts))
    for url, ip, date, kind, status, body in records:
        line = f"{url} {ip} {date} {kind}"
        if version == 2:
            line += f" {status} {hashlib.sha1(body).hexdigest()} - {at} {name}"
        for part in (f"{line} {len(body)}\n".encode(), body, b"\n"):
            parts.append(part)
            at += len(part)
    return b"".join(parts)


def parse_arc(content):
    """Yield a dict (``url``, ``ip``, ``date``, ``type``, ``status``, ``body``) per URL record.

    Raises ValueError where the version is unknown, a header line has another number of fields than the
    version says, or the file ends before the declared length.
    """
    if not content:
        return
    names, at = None, 0
    while at < len(content):
        if content[at:at + 1] == b"\n":  # ends the record before
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} has no end")
        fields = content[at:end].decode("utf-8", "replace").split(" ")
        start = end + 1
        try:
            stop = start + int(fields[-1])
        except ValueError:
            raise ValueError(f"header line at {at} has no length") from None
        if stop > len(content) or stop < start:
            raise ValueError(f"record at {at} is cut off")
        body = content[start:stop]
        if names is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = ARC_FIELDS[version].split(" ")
        else:
            if len(fields) != len(names):
                raise ValueError(f"header line at {at} has {len(fields)} fields, not {len(names)}")
            row = dict(zip(names, fields))
            yield {
                "url": row["URL"], "ip": row["IP-address"], "date": row["Archive-date"],
                "type": row["Content-type"], "status": row.get("Result-code"), "body": body,
            }
        at = stop


def split_http(body):
    """(headers as a dict of lower-case names, payload) of an HTTP response."""
    head, _, payload = body.partition(b"\r\n\r\n")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in fields}, payload


# --- WARC ----------------------------------------------------------------------------------------

def record_id(page):
    """Identifier that holds the page id in its last 64 bits (UUID of the free version 8)."""
    low = page & (2**64 - 1)
    text = f"{0x7461626C656B8EE9:016x}{low:016x}"
    return f"<urn:uuid:{text[:8]}-{text[8:12]}-{text[12:16]}-{text[16:20]}-{text[20:]}>"


def page_of(identifier):
    """Page id of an identifier made by ``record_id``."""
    low = int(identifier.strip("<>").rpartition(":")[2].replace("-", "")[16:], 16)
    return low - 2**64 if low >= 2**63 else low


def warc_date(date):
    """ARC's 14 digits as a WARC timestamp; shorter ones are filled up, others are the epoch."""
    if not date.isdigit() or len(date) < 4:
        return "1970-01-01T00:00:00Z"
    date = (date + "00000101000000"[len(date):])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(row, page, refers_to=None):
    """A record of ARC fields, without the two line ends that close it."""
    head, _, payload = row["body"].partition(b"\r\n\r\n")
    block = head + b"\r\n\r\n" + (payload if refers_to is None else b"")
    lines = [
        WARC_VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {warc_date(row['date'])}",
        f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: {_sha1(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(content):
    """Yield (headers as a dict, block) per record, by the declared lengths."""
    at, size = 0, len(content)
    while at < size:
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        yield fields, content[start:stop]
        at = stop + 4


# --- Spark ---------------------------------------------------------------------------------------

def pages_to_arcs(pages):
    """ARC archives (``name``, ``content``) of up to ARC_RECORDS pages; versions 1 and 2 alternate."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            done, count = False, 0
            while not done:
                records = []
                for page, url, html in rows:
                    payload = (html or "").encode()
                    kind = "text/html"
                    head = (
                        f"HTTP/1.0 200 OK\r\nContent-Type: {kind}; charset=utf-8\r\n"
                        f"X-Page-Id: {-1 if page is None else page}\r\nX-Page-Known: {int(page is not None)}\r\n"
                        f"Content-Length: {len(payload)}\r\n\r\n"
                    ).encode()
                    records.append((clean_url(url), "0.0.0.0", ARC_DATE, kind, 200, head + payload))
                    if len(records) == ARC_RECORDS:
                        break
                else:
                    done = True
                if records:
                    count += 1
                    name = f"pages-{count}.arc"
                    yield pa.RecordBatch.from_pydict(
                        {"name": [name], "content": [arc_archive(name, 1 + count % 2, records)]}
                    )

    return pages.select("page_id", "url", "html").mapInArrow(run, "name string, content binary")


def arc_records(arcs):
    """URL records of ARC archives: ``page_id`` (from the stored HTTP header), ``known``, ARC fields, body,
    and the payload's size and digest."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                out = {k: [] for k in ("page_id", "known", "url", "ip", "date", "payload_bytes", "digest", "body")}
                for row in parse_arc(content.as_py()):
                    http, payload = split_http(row["body"])
                    out["page_id"].append(int(http["x-page-id"]))
                    out["known"].append(http["x-page-known"] == "1")
                    out["payload_bytes"].append(len(payload))
                    out["digest"].append(hashlib.sha1(payload).hexdigest())
                    for name in ("url", "ip", "date", "body"):
                        out[name].append(row[name])
                types = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
                         pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out.values(), types)], list(out)
                )

    return arcs.select("content").mapInArrow(
        run, "page_id long, known boolean, url string, ip string, date string, payload_bytes long, "
             "digest string, body binary"
    )


def links(records, least=LEAST_LINKED):
    """(``page_id``, ``digest``, ``refers_to``) of the records that become revisits.

    Works on narrow rows. One payload may be that of a third of all records: the largest ids are found by
    partial aggregates, and the join back has one row on its other side, so that Spark can split it.
    """
    slim = records.where(F.col("known") & (F.col("payload_bytes") >= least)).select("page_id", "digest")
    chosen = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return (
        slim.join(chosen.where("n > 1").drop("n"), "digest")
        .where("page_id < refers_to").distinct()
    )


def write_warcs(arcs, folder, least=LEAST_LINKED, archive_bytes=ARCHIVE_BYTES):
    """Convert ARC archives and write WARC archives of about ``archive_bytes`` into ``folder``.

    The archives are parsed for narrow rows (ids, sizes, digests), which are staged, and once more for the records. These
    are spread by page id and digest, those without id one by one; however many records share an id, a file
    holds at most four times the usual number. The files are those of Spark's text writer, whose line end
    is set to the two line ends that close a WARC record, and compressed.
    """
    records = arc_records(arcs)
    slim = staged(records.select("page_id", "known", "payload_bytes", "digest"), "digests")
    size, count = slim.agg(F.sum("payload_bytes"), F.count("*")).first()
    files = max(1, -(-(size or 0) // archive_bytes))
    # A record without id refers to nothing, so that its key may be any.
    key = F.when(F.col("known"), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string"))
    rows = (
        records.withColumn("key", key).repartition(files, "page_id", "key")
        .join(links(slim, least).withColumnRenamed("digest", "key"), ["page_id", "key"], "left")
        .select("page_id", "url", "ip", "date", "body", F.when(F.col("known"), F.col("refers_to")).alias("refers_to"))
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ARC_RECORDS):
                yield pa.RecordBatch.from_pydict({"record": [
                    warc_record(row, row["page_id"], row["refers_to"])
                    for row in batch.slice(at, ARC_RECORDS).to_pylist()
                ]})

    (
        rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 4 * max(1, -(-count // files)))
        .text(folder, compression="gzip")
    )


def read_warcs(spark, folder):
    """One row per record of the WARC archives in ``folder``.

    Files are read by declared lengths. The payload size of a revisit comes from the stored HTTP header,
    which keeps the length of the payload that it stands for.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for fields, block in parse_warc(gzip.decompress(content.as_py())):
                    http, payload = split_http(block)
                    revisit = fields["warc-type"] == "revisit"
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if not revisit and digest != hashlib.sha1(payload).hexdigest():
                        raise ValueError("payload and digest differ")
                    known = http["x-page-known"] == "1"
                    out["page_id"].append(page_of(fields["warc-record-id"]) if known else None)
                    out["payload_bytes"].append(int(http["content-length"]) if revisit else len(payload))
                    out["payload_digest"].append(digest)
                    out["record_type"].append(fields["warc-type"])
                    out["refers_to"].append(page_of(fields["warc-refers-to"]) if revisit else None)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out.values(), types)], list(out)
                )

    return files.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def op10_arc_to_warc(spark, folder):
    """``pages`` as ARC archives, converted to WARC archives in the shared folder and read back."""
    out = work_dir(spark, "warc")
    write_warcs(pages_to_arcs(load(spark, folder, "pages")), out)
    return read_warcs(spark, out)


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
