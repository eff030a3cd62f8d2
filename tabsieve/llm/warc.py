"""WARC archives: write, normalise monolithic gzip streams to one member per record, index and read back."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm.batches import map_rows
from tabsieve.session import broadcast_if, materialise, partitions, shared_folder, spread_lookup

#: A writer starts a new archive after so many bytes of records, which bounds the work of normalising one.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from an archive at a time.
CHUNK = 1 << 20
#: Bytes of an archive that one read task takes.
READ_BYTES = 16 << 20
#: Header fields in the order written.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    """File system and path for a folder any executor can reach (file:, hdfs:, s3: … as pyarrow knows them)."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def mark_revisits(df: DataFrame, id_col: str, payload: Column, min_bytes: int = 1000) -> DataFrame:
    """Adds ``_payload`` (binary, null as empty), ``_digest`` (bare hex SHA-1) and ``_refers`` to ``df``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the
    response; ``_refers`` holds its id for the others and null for responses. Rows that share the largest
    id are all responses, and so are rows without an id when no row of the group has one.
    """
    rows = df.withColumn("_payload", F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))).withColumn("_digest", F.sha1("_payload"))
    groups = materialise(rows.where(F.octet_length("_payload") >= min_bytes).groupBy("_digest")
                         .agg(F.max(id_col).alias("_response"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    total = groups.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    answers = groups.select("_digest", "_response")
    if broadcast_if(answers, total[0] * 96) is not answers:
        found = rows.join(F.broadcast(answers), "_digest", "left")
    else:
        found = spread_lookup(rows, answers, ["_digest"], groups.select("_digest", "_rows"), total[1], "left")
    return found.withColumn("_refers", F.when(~F.col(id_col).eqNullSafe(F.col("_response")), F.col("_response"))).drop("_response")


def _record(kind: str, record: str, url: str | None, digest: str, length: int, body: bytes, extra: dict[str, str]) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": record, "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(length), **extra,
               "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def write_archives(df: DataFrame, folder: str, id_col: str, url_col: str | None) -> DataFrame:
    """Write rows of ``mark_revisits`` as monolithic gzip archives below ``folder``: (path, records) per archive.

    Every task streams its own archives under names no other attempt uses; only archives named in the
    stored result count, so a task that runs again leaves nothing that is read. Bodies of revisits are
    left out, as their digest and length say what they were.
    """
    folder = _uri(folder)

    def make():
        state: dict = {}

        def close():
            if not state:
                return []
            state["out"].write(state["gz"].flush())
            state["out"].close()
            made = [(state["path"], state["n"])]
            state.clear()
            return made

        def row(*values) -> Iterable[tuple]:
            if not values:
                return close()
            ident, url, payload, digest, refers = values
            if not state:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                state.update(path=f"{folder}/{name}", n=0, bytes=0, out=store.open_output_stream(f"{root}/{name}", compression=None),
                             gz=zlib.compressobj(1, zlib.DEFLATED, 31))
            extra = {} if ident is None else {"X-Source-ID": str(ident)}
            record = f"<urn:uuid:{uuid.uuid4()}>"
            if refers is None:
                data = _record("response", record, url, digest, len(payload), payload, extra)
            else:
                data = _record("revisit", record, url, digest, len(payload), b"",
                               {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Source-ID": str(refers), **extra})
            state["out"].write(state["gz"].compress(data))
            state["n"] += 1
            state["bytes"] += len(data)
            return close() if state["bytes"] >= ARCHIVE_BYTES else []
        return row

    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col), url.alias("_url"), "_payload", "_digest", "_refers")
    return materialise(map_rows(rows, "path string, records long", make, finish=True))


class _Inflated(io.RawIOBase):
    """The inflated bytes of a gzip stream of any number of members, in one forward pass."""

    def __init__(self, source):
        self.source, self.inflater, self.rest = source, zlib.decompressobj(47), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while True:
            if not self.rest:
                self.rest = self.source.read(CHUNK)
                if not self.rest:
                    return 0
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(47)
            data = self.inflater.decompress(self.rest, len(buffer))
            self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if data:
                buffer[:len(data)] = data
                return len(data)


def read_record(stream) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields, body and raw bytes of the next record; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    raw.append(line)
    length = int(fields["content-length"])
    body = stream.read(length)
    if len(body) != length:
        raise ValueError("a record ends before its Content-Length")
    return fields, body, b"".join([*raw, body, b"\r\n\r\n"])


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite every archive of ``archives`` (column ``path``) with one gzip member per record and a sidecar index.

    The source is inflated once, front to back, one record at a time; it may hold one gzip member or many.
    Beside ``x.warc.gz`` appear ``x.<attempt>.members.warc.gz`` and its index ``….idx`` of JSON lines
    ``record, type, offset, length``. Returns (path, index, records) per archive; an archive without
    records gives empty files.
    """
    def make():
        def row(path) -> Iterator[tuple]:
            store, name = _store(path)
            to = f"{re.sub(r'[.]warc([.]gz)?$', '', name)}.{uuid.uuid4().hex[:12]}.members.warc.gz"
            base = path[:len(path) - len(name)] if path.endswith(name) else ""
            offset = n = 0
            with (store.open_input_stream(name, compression=None) as source, store.open_output_stream(to, compression=None) as out,
                  store.open_output_stream(f"{to}.idx", compression=None) as index):
                stream = io.BufferedReader(_Inflated(source), CHUNK)
                while (found := read_record(stream)) is not None:
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = gz.compress(found[2]) + gz.flush()
                    out.write(member)
                    index.write((json.dumps({"record": found[0].get("warc-record-id"), "type": found[0].get("warc-type"),
                                             "offset": offset, "length": len(member)}) + "\n").encode())
                    offset += len(member)
                    n += 1
            yield base + to, f"{base}{to}.idx", n
        return row

    n = max(1, archives.count())
    return materialise(map_rows(archives.select("path").repartition(n), "path string, index string, records long", make))


def read_index(spark: SparkSession, members: DataFrame) -> DataFrame:
    """``path, record, type, offset, length`` from the sidecar indexes of ``members`` (result of ``normalise``)."""
    folder = members.select("index").first()
    shape = "record string, type string, offset long, length long"
    if folder is None:
        return spark.createDataFrame([], f"path string, {shape}")
    root = folder[0].rsplit("/", 1)[0]
    lines = (spark.read.schema(shape).option("pathGlobFilter", "*.idx").json(root)
             .select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("_file"), "*"))
    known = members.select("path", F.regexp_extract("index", "[^/]+$", 0).alias("_file"))
    return lines.join(known, "_file").drop("_file")


def read_records(index: DataFrame) -> DataFrame:
    """Records at the places an index gives: id, type, length, digest, refers-to and body of each.

    Members are read by offset, so an archive is split over as many tasks as its records ask for.
    Digest and length of a response are taken from the body that was read and must agree with its header.
    """
    shape = ("source_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")

    def make():
        held: dict = {}

        def row(path, offset, length) -> Iterator[tuple]:
            if held.get("path") != path:
                if held:
                    held["file"].close()
                store, name = _store(path)
                held.update(path=path, file=store.open_input_file(name))
            held["file"].seek(offset)
            member = held["file"].read(length)
            fields, body, _ = read_record(io.BytesIO(zlib.decompress(member, 31)))
            digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
            if fields["warc-type"] == "response":
                if (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its header")
            yield (fields.get("x-source-id"), fields["warc-type"], fields.get("warc-target-uri"), size, digest,
                   fields.get("x-refers-to-source-id"), body)
        return row

    spread = index.withColumn("_turn", F.expr(f"offset div {READ_BYTES}"))
    # An index is far smaller than its archives, so the number of tasks follows the bytes they read.
    tasks = min(max(1, spread.select("path", "_turn").distinct().count()), 32 * partitions(index.sparkSession))
    placed = spread.repartition(tasks, "path", "_turn").sortWithinPartitions("path", "offset")
    return map_rows(placed.select("path", "offset", "length"), shape, make)


def archive_round_trip(df: DataFrame, id_col: str, url_col: str | None, payload: Column, min_bytes: int = 1000,
                       folder: str | None = None) -> DataFrame:
    """Write ``df`` as archives, normalise them and read every record back (columns of ``read_records``).

    Null payloads are empty, null urls leave the target out, null ids come back as null, repeated rows stay;
    other columns are ignored; an empty table gives no archives and an empty result.
    """
    spark = df.sparkSession
    columns = [F.col(id_col)] + ([F.col(url_col)] if url_col and url_col != id_col else []) + [payload.cast("binary").alias("_body")]
    marked = mark_revisits(df.select(*columns), id_col, F.col("_body"), min_bytes).drop("_body")
    archives = write_archives(marked, folder or shared_folder(spark), id_col, url_col)
    return read_records(read_index(spark, normalise(archives)))
