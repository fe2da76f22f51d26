"""Operator 1, WARC: a deterministic sharded writer, and its reader.

Records are range-sorted by page id, so a shard is a run of ids and the archive's order is global. The
borders between shards come from exact byte sums over ranges of ids (a heavy range is counted again in finer
ones), not from a sample: the same pages give the same shards, files and bytes in every session. Each task
streams its sorted rows into gzip members (one per record) and rolls to a new file once the compressed
size passes ``roll_bytes``. Headers are built from the record alone (ids and dates are derived, not drawn),
and payload and block digests are computed from the bytes written.

Task attempts write under temporary names; a task's result is its manifest rows. The commit writes the list
of renames first (``commit.json``), renames, and renames the manifest into place last. Every step may be
repeated, so ``resume_commit`` finishes what a lost driver began; a new write to the same place removes what
an unfinished one left. An archive without ``manifest.json`` isn't complete, and one with it is never
overwritten.

Of rows with equal payloads of ``revisit_bytes`` or more, the smallest id is written as response and the
others as revisits that refer to it. Only digests are aggregated and joined for this; who revisits
whom reaches the writer as marker rows that sort just before their records, so payloads are moved once. A
marker names page id and digest: of rows with one id and different payloads each is judged alone.

Edge cases: null html is the empty payload; a null id sorts first, is always a response and is read
back as null; a null url is written as an empty target; rows repeated with the id of the response are
responses; an empty table makes an archive of no files; extra columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scratch_path

MANIFEST_SCHEMA = "shard int, seq int, temporary string, file string, records long, bytes long, sha256 string, first_id long, last_id long"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_digest_ok boolean, file string, offset long"


@dataclass(frozen=True)
class WarcConfig:
    roll_bytes: int = 1 << 30
    level: int = 6
    revisit_bytes: int = 100
    date: str = "1970-01-01T00:00:00Z"  # no crawl time in the table: one fixed date keeps files reproducible
    namespace: str = "urn:ebbflow:page:"
    shard_bytes: int = 16 << 20  # payload bytes of a shard, unless that makes more than ``most_shards``
    most_shards: int = 20_000


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record(cfg: WarcConfig, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha256(payload).digest()
    hexed = digest.hex()
    page = "" if page_id is None else str(page_id)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{cfg.namespace}{page}:{hexed}:{url}")
    safe = url.replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {cfg.date}", f"WARC-Target-URI: {safe}", f"WARC-Page-ID: {page}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{base64.b32encode(digest).decode()}", f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=level, mtime=0) as f:
        f.write(record)
    return out.getvalue()


def _write_shards(batches: Iterator[pa.RecordBatch], root: str, cfg: WarcConfig) -> Iterator[pa.RecordBatch]:
    attempt = uuid.uuid4().hex
    fs, base = _files(root)
    made: list[dict] = []
    stream = sha = None
    marked: tuple = (None, None, None)

    def close() -> None:
        stream.close()
        made[-1]["sha256"] = sha.hexdigest()

    for batch in batches:
        for shard, page_id, digest, marker, refers, url, html in zip(*(batch.column(k).to_pylist() for k in ("shard", "page_id", "digest", "is_page", "refers_to", "url", "html")), strict=True):
            if not marker:
                marked = (page_id, digest, refers)
                continue
            payload = (html or "").encode("utf-8", "surrogatepass")
            member = _member(_record(cfg, page_id, url or "", payload, marked[2] if marked[:2] == (page_id, digest) else None), cfg.level)
            if stream is None or made[-1]["shard"] != shard or made[-1]["bytes"] >= cfg.roll_bytes:
                if stream is not None:
                    close()
                seq = made[-1]["seq"] + 1 if made and made[-1]["shard"] == shard else 0
                name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                made.append({"shard": shard, "seq": seq, "temporary": f"_temporary/{name}.{attempt}", "file": name, "records": 0, "bytes": 0, "sha256": "", "first_id": page_id, "last_id": page_id})
                fs.create_dir(f"{base}/_temporary", recursive=True)
                stream, sha = fs.open_output_stream(f"{base}/{made[-1]['temporary']}", compression=None), hashlib.sha256()
            stream.write(member)
            sha.update(member)
            made[-1] |= {"records": made[-1]["records"] + 1, "bytes": made[-1]["bytes"] + len(member), "last_id": page_id}
    if stream is not None:
        close()
    names = ["shard", "seq", "temporary", "file", "records", "bytes", "sha256", "first_id", "last_id"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in zip(names, kinds, strict=True)], names)


def _slim(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha2(html, 256)).alias("digest"), F.col(url_col).cast("string").alias("url"), html.alias("html"))


def shard_starts(sizes: DataFrame, shards: int, fine: int = 6) -> list[int]:
    """First ids of the second shard and on, by exact sums of ``bytes`` over ranges of ``page_id``.

    Ranges are ids without their low bits. The driver receives some thousand sums, and of each range that is
    heavier than a shard (at most ``shards`` of them) 2 ** ``fine`` more, until ranges are light or single ids.
    """
    whole = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if whole[0] is None or shards < 2:
        return []
    least = max(1, whole[2] // shards)
    shift = max(0, (whole[1] - whole[0]).bit_length() - (4 * shards).bit_length())
    cells: list[tuple[int, int]] = []
    rows = sizes
    while True:
        key = F.shiftright("page_id", shift)
        found = [(r.cell, r.n) for r in rows.groupBy(key.alias("cell")).agg(F.sum("bytes").alias("n")).collect()]
        heavy = [c for c, n in found if n > least and shift]
        cells += [(c << shift, n) for c, n in found if n <= least or not shift]
        if not heavy:
            break
        rows = rows.where(key.isin(heavy))
        shift = max(0, shift - fine)
    starts, held, shard = [], 0, 0
    for at, n in sorted(cells):  # a range goes to the shard that holds the middle of its bytes
        now = min(shards - 1, int((held + n / 2) * shards / whole[2]))
        if now > shard:
            starts += [at] if held else []
            shard = now
        held += n
    return starts


def _shard(spark: SparkSession, rows: DataFrame, starts: list[int]) -> DataFrame:
    """``rows`` with the number of the shard that holds their page id (null ids: 0).

    Ranges of ids that hold a border are looked up in a table of at most as many rows as there are borders;
    a range without one belongs to the shard of the border below it, found in the same table.
    """
    if not starts:
        return rows.withColumn("shard", F.lit(0))
    shift = max(0, (starts[-1] - starts[0]).bit_length() - (4 * len(starts)).bit_length())
    first, last = starts[0] >> shift, starts[-1] >> shift
    table = [(c, bisect_right(starts, (c << shift) - 1), [s for s in starts[bisect_right(starts, (c << shift) - 1) : bisect_right(starts, ((c + 1) << shift) - 1)]]) for c in range(first, last + 1)]
    cells = spark.createDataFrame(table, "cell long, below int, inner array<long>")  # at most 8 rows a border
    cell = F.least(F.greatest(F.shiftright("page_id", shift), F.lit(first)), F.lit(last))
    joined = rows.join(F.broadcast(cells), cell == F.col("cell"), "left")
    within = F.size(F.filter("inner", lambda s: s <= F.col("page_id")))
    return joined.withColumn("shard", F.coalesce(F.col("below") + within, F.lit(0))).drop("cell", "below", "inner")


def plan_records(pages: DataFrame, cfg: WarcConfig = WarcConfig(), shards: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, int]:
    """Pages and the revisit markers before them, as the writer takes them (unsorted), and the number of shards."""
    slim = _slim(pages, id_col, url_col, html_col)
    sizes = checkpointed(slim.select("page_id", "digest", F.octet_length("html").cast("long").alias("bytes")))
    named = sizes.where("page_id IS NOT NULL")
    large = named.where(F.col("bytes") >= cfg.revisit_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    markers = large.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    if shards is None:
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        shards = min(cfg.most_shards, max(1, -(-total // cfg.shard_bytes)))
    starts = shard_starts(named.select("page_id", (F.col("bytes") + 300).alias("bytes")), shards)
    none = F.lit(None)
    marks = markers.select("page_id", "digest", F.lit(False).alias("is_page"), "refers_to", none.cast("string").alias("url"), none.cast("string").alias("html"))
    rows = marks.unionByName(slim.select("page_id", "digest", F.lit(True).alias("is_page"), none.cast("long").alias("refers_to"), "url", "html"))
    return _shard(pages.sparkSession, rows, starts), len(starts) + 1


def _put(fs, base: str, name: str, content: bytes) -> None:
    with fs.open_output_stream(f"{base}/{name}.tmp") as out:
        out.write(content)
    fs.move(f"{base}/{name}.tmp", f"{base}/{name}")


def _exists(fs, path: str) -> bool:
    return fs.get_file_info(path).type.name != "NotFound"


def _clean(fs, base: str) -> None:
    """Removes what an unfinished write left: files of its list of renames, and temporary ones."""
    if _exists(fs, f"{base}/commit.json"):
        for m in _read_json(fs, f"{base}/commit.json"):
            if _exists(fs, f"{base}/{m['file']}"):
                fs.delete_file(f"{base}/{m['file']}")
        fs.delete_file(f"{base}/commit.json")
    if _exists(fs, f"{base}/_temporary"):
        fs.delete_dir(f"{base}/_temporary")


def _read_json(fs, path: str):
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def resume_commit(root: str) -> list[dict]:
    """Finishes the commit whose list of renames is written; returns the manifest. May be repeated."""
    fs, base = _files(root)
    if not _exists(fs, f"{base}/commit.json"):
        return _read_json(fs, f"{base}/manifest.json")
    listed = _read_json(fs, f"{base}/commit.json")

    def rename(m: dict) -> None:
        if _exists(fs, f"{base}/{m['temporary']}"):
            fs.move(f"{base}/{m['temporary']}", f"{base}/{m['file']}")
        elif not _exists(fs, f"{base}/{m['file']}"):
            raise FileNotFoundError(f"neither {m['temporary']} nor {m['file']}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, listed))
    manifest = [{k: v for k, v in m.items() if k != "temporary"} for m in listed]
    _put(fs, base, "manifest.json", json.dumps(manifest, sort_keys=True).encode())
    fs.delete_file(f"{base}/commit.json")
    if _exists(fs, f"{base}/_temporary"):
        fs.delete_dir(f"{base}/_temporary")
    return manifest


def write_archive(pages: DataFrame, root: str, cfg: WarcConfig = WarcConfig(), shards: int | None = None, **columns: str) -> list[dict]:
    """Writes the archive under ``root`` (a URI all executors reach); returns its manifest, a row per file."""
    fs, base = _files(root)
    fs.create_dir(base, recursive=True)
    if _exists(fs, f"{base}/manifest.json"):
        raise FileExistsError(f"{root} holds an archive")
    _clean(fs, base)
    records, count = plan_records(pages, cfg, shards, **columns)
    # one task per shard by its number; sorted by all that tells records apart, so ties have one order
    ordered = records.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    made = [r.asDict() for r in ordered.mapInArrow(lambda it: _write_shards(it, root, cfg), MANIFEST_SCHEMA).collect()]  # a row per file
    made.sort(key=lambda m: (m["shard"], m["seq"]))
    _put(fs, base, "commit.json", json.dumps(made, sort_keys=True).encode())
    return resume_commit(root)


def read_manifest(root: str) -> list[dict]:
    fs, base = _files(root)
    return _read_json(fs, f"{base}/manifest.json")


def _members(stream, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, reading the file in pieces."""
    data, offset = b"", 0
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                data = stream.read(step)
                if not data:
                    raise ValueError("archive ends inside a record")
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield offset, b"".join(parts)
        offset += used


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":", 1)[1]).hex()
    kind = fields["WARC-Type"]
    ok = fields["WARC-Block-Digest"].split(":", 1)[1] == base64.b32encode(hashlib.sha256(block).digest()).decode()
    if kind == "response":
        ok = ok and hashlib.sha256(payload).hexdigest() == digest and len(payload) == int(fields["WARC-Payload-Length"])
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "payload": payload if kind == "response" else None, "record_digest_ok": ok}


def _read_files(batches: Iterator[pa.RecordBatch], root: str, with_payload: bool, batch_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    fs, base = _files(root)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_digest_ok", pa.bool_()), ("file", pa.string()), ("offset", pa.int64())])
    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows, held = [], 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                for offset, raw in _members(f):
                    row = parse_record(raw) | {"file": name, "offset": offset}
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += 300 + len(row["payload"] or b"")
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """A row per record of a committed archive; a task reads whole files, record by record."""
    files = [(m["file"],) for m in read_manifest(root)]
    names = spark.createDataFrame(files, "file string").repartition(max(1, len(files)))
    return names.mapInArrow(lambda it: _read_files(it, root, with_payload), READ_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes ``pages`` to a fresh archive in the shared folder and reads it back."""
    root = scratch_path(spark, "warc")
    write_archive(pages, root, cfg)
    return read_archive(spark, root, with_payload=False)
