"""WARC archives: writer with revisit records, and a sequential reader.

Each record is a gzip member of its own; an archive begins with a warcinfo record. Record ids are made from the archive's
path and the record's number, so they are unique; the page's id is in a header field of our own (``X-Page-ID``). The reader
takes a file in blocks, inflates incrementally with zlib, frames records by Content-Length (never by searching for the next
header) and verifies the payload digests of responses. It also reads archives of others: record types that aren't asked
for are passed over, digests may be absent, of another algorithm and in base 32, bodies may be chunked or have no length.

Of rows with equal payloads of at least ``min_revisit_bytes`` those with the smallest id are responses; the others are
revisit records (identical-payload-digest profile) that hold the HTTP header alone and refer to that id and its address.

Defined cases: null html is an empty payload; a missing address is ``urn:page:`` and the id; rows that share the smallest
id are all responses; a null id sorts after all others and is written without ``X-Page-ID``; empty tables write no archive;
other columns are ignored. A damaged archive (a digest, length or record end that doesn't hold, a file that ends within a
record or gzip member) raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_map, cut, join_split, new_path, partitions, pieces, table
from tilewright.llm.token_store import open_fs

BLOCK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
KINDS = ("response", "revisit")


def classify(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit_bytes: int = 100) -> DataFrame:
    """page_id, payload, payload_digest, url, refers_to and refers_url (null for responses).

    The first id of each digest comes from a pre-aggregated groupBy, so a payload that a third of the rows share is
    reduced within each task; only digests that occur twice are written and joined, and the rows of the most frequent ones
    are dealt out by id (``join_split``).
    """
    number = F.col(id_col).cast("long")
    url = F.coalesce(F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(number.cast("string"), F.lit("none"))))
    rows = pages.select(number.alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), url.alias("url")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
    )
    again = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    found = join_split(rows, cut(first, "first-payloads"), "payload_digest", F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    return found.select("page_id", "payload", "payload_digest", "url", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"))


def _record(head: list[str], body: bytes) -> bytes:
    return ("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def info_record(record_id: str, name: str) -> bytes:
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, payload: bytes, digest: str, refers_to: int | None, *, record_id: str, url: str, refers_url: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = lambda s: "".join(s.split())  # noqa: E731  # an address has no white space; it would break the header
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {clean(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if refers_to is None:
        return _record(head, http + payload)
    return _record([*head, f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"], http)


def _id(of: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, of)}"


def write_archives(classified: DataFrame, path: str, level: int = 1) -> list[str]:
    """Write one archive per partition below ``path``; returns the archives' paths (one for each task)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, fs, n = TaskContext.get(), None, None, 0
        for b in pieces(batches):
            if out is None:
                fs, root = open_fs(path)
                fs.create_dir(root, recursive=True)
                name = f"part-{task.partitionId():06d}.warc.gz"
                hidden = f"{root}/.{task.stageId()}-{task.taskAttemptId()}-{name}"
                out = fs.open_output_stream(hidden, compression=None)
                out.write(zlib.compress(info_record(_id(f"{path}/{name}#info"), name), level, 31))
            for page, payload, digest, url, to, to_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = record(page, payload.encode(), digest, to, record_id=_id(f"{path}/{name}#{n}"), url=url, refers_url=to_url)
                out.write(zlib.compress(one, level, 31))
                n += 1
        if out is not None:
            out.close()
            fs.move(hidden, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "n": pa.array([n], pa.int64())})

    done = arrow_map(classified.select("page_id", "payload", "payload_digest", "url", "refers_to", "refers_url"), write, "path string, n long")
    return sorted(r["path"] for r in done.collect())


class Inflated:
    """The inflated bytes of a file of gzip members, read in blocks."""

    def __init__(self, raw):
        self.raw, self.z, self.have, self.rest, self.over, self.within = raw, zlib.decompressobj(31), bytearray(), b"", False, False

    def _more(self) -> bool:
        while not self.over:
            data = self.rest or self.raw.read(BLOCK)
            self.rest = b""
            if not data:
                self.over = True
                if self.within:
                    raise ValueError("the archive ends within a gzip member")
                break
            try:
                got = self.z.decompress(data, BLOCK)
            except zlib.error as e:
                raise ValueError(f"the archive is damaged: {e}") from e
            self.rest, self.within = self.z.unconsumed_tail, not self.z.eof
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.have += got
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        begin = 0
        while (at := self.have.find(end, begin)) < 0:
            begin = max(0, len(self.have) - len(end) + 1)
            if not self._more():
                if self.have:
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.have[: at + len(end)])
        del self.have[: at + len(end)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in parts."""
        while n:
            if not self.have and not self._more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.have[:n])
            del self.have[: len(part)]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def _http(body: Iterator[bytes]) -> tuple[dict[str, str], Iterator[bytes]]:
    """The header's fields and the parts after it; a block without an end of the header is all header."""
    have = bytearray()
    for part in body:
        have += part
        if (at := have.find(b"\r\n\r\n")) >= 0:

            def after(first: bytes = bytes(have[at + 4 :])) -> Iterator[bytes]:
                yield first
                yield from body

            return _fields(bytes(have[:at])), after()
    return _fields(bytes(have)), iter(())


def _dechunked(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The data of a chunked body."""
    have, left = bytearray(), None
    for part in parts:
        have += part
        while have:
            if left is None:
                if (at := have.find(b"\r\n")) < 0:
                    break
                left = int(bytes(have[:at]).split(b";")[0] or b"0", 16)
                del have[: at + 2]
                if not left:
                    return
            n = min(left, len(have))
            if n:
                yield bytes(have[:n])
                del have[:n]
                left -= n
            if not left:
                if len(have) < 2:
                    break
                del have[:2]
                left = None


def _holds(digest: str, hashes: list) -> bool:
    """Whether a declared digest, hexadecimal or base 32, is one of the computed ones."""
    value = digest.rpartition(":")[2]
    return any(value.lower() == h.hexdigest() or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=") for h in hashes)


def read_records(raw, keep_payload: bool = False, kinds: Collection[str] = KINDS) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of ``kinds`` in order.

    The digest of a payload that is there is its SHA-256; of a revisit the declared one, and its length the HTTP header's.
    """
    src = Inflated(raw)
    while (head := src.until(b"\r\n\r\n")) is not None:
        f, parts = _fields(head), []
        body, kind = src.take(int(f["content-length"])), f.get("warc-type", "")
        if kind in kinds:
            http, payload = _http(body) if f.get("content-type", "").startswith("application/http") else ({}, body)
            declared = f.get("warc-payload-digest", "")
            algorithm = declared.rpartition(":")[0].lower()
            sha, seen, chunked = hashlib.sha256(), 0, "chunked" in http.get("transfer-encoding", "").lower()
            checks = [hashlib.new(algorithm) for _ in range(1 + chunked)] if algorithm in hashlib.algorithms_guaranteed and not algorithm.startswith("shake") else []

            def tapped(payload=payload, checks=checks) -> Iterator[bytes]:
                for part in payload:
                    for h in checks[1:]:
                        h.update(part)
                    yield part

            for part in _dechunked(tapped()) if chunked else payload:
                sha.update(part)
                for h in checks[:1]:
                    h.update(part)
                seen += len(part)
                parts += [part] if keep_payload else []
            length = int(http["content-length"]) if http.get("content-length", "").isdigit() and not chunked else None
        for _ in body:
            pass
        if b"".join(src.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        if kind not in kinds:
            continue
        number = lambda k: int(f[k]) if f.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
        if kind == "revisit":
            yield number("x-page-id"), length, declared.removeprefix("sha256:"), kind, number("x-refers-to-page-id"), None
            continue
        if "warc-truncated" not in f and (length not in (None, seen) or checks and not _holds(declared, checks)):
            raise ValueError(f"payload digest or length of {f.get('warc-record-id')} doesn't hold")
        yield number("x-page-id"), seen, sha.hexdigest(), kind, number("x-refers-to-page-id"), b"".join(parts) if keep_payload else None


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headers and verified digests of all records, one task for each archive at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, at = open_fs(p)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw:
                    for r in read_records(raw):
                        rows.append(r[:5])
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, min(len(paths), partitions(spark)))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(read, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(classify(table(spark, sf_dir, "pages")), new_path(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
