"""WARC: a deterministic sharded writer and its reader.

Records are range-sorted by page, dealt to shards, and each record is a gzip member of its own, with headers and
digests made anew from the payload. A task writes its shards under temporary names, each opened by a warcinfo record, and rolls to
the next file once the compressed size passes a limit; it returns manifest rows. The files then get their final names, one
task for each, what lost attempts left is removed, and the manifest is put in place last, by a rename: without it there is no archive,
so a run that stops anywhere leaves none that is broken. Record ids derive from the page, so reruns write the same
bytes; the date of all records is a parameter, as pages have none.

Nulls, ties, empty inputs: a null html is an empty payload, a null url is written as "unknown:"; pages without
page_id are responses unless an equal payload has one; rows that repeat a page_id with the same payload are
responses alike when it is the smallest; an empty table writes an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.llm.shared import delete, scratch, small, stash

MANIFEST = "part string, shard int, temporary string, file string, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, shard_file string, intact boolean"


def file_system(uri: str):
    """The pyarrow file system of a folder's URI, and the folder's path there: local, HDFS, S3 and others alike."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return found, path.rstrip("/")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages -> page_id, url, payload, payload_bytes, sha1, record_type, refers_to.

    Of equal payloads of at least least_bytes, the smallest page_id is the response. The minimum is taken for
    each digest before anything is shuffled. Only digests that repeat are joined back: by broadcast, so that payloads stay where
    they are, or if there are too many, by a join that Spark can split where a digest is hot.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("response"), F.count("*").alias("n"))
    copied = small(stash(first.where("n > 1 and response is not null").select("sha1", "response"), "copied"), 200_000)
    rows = rows.join(copied, "sha1", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull(), F.lit(False))
    return rows.select("page_id", "url", "payload", "payload_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record, as a gzip member. A revisit holds no payload, but its digest and length."""
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    digest, body = base32_digest(payload), b"" if kind == "revisit" else payload
    head = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Target-URI": (url or "unknown:").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_digest(body)}", "Content-Type": "text/html; charset=utf-8"}
    if kind == "revisit":
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}
    head |= {"X-Url-Null": "1"} if url is None else {}
    head |= {"X-Page": "" if page_id is None else str(page_id), "X-Payload-Bytes": str(len(payload)), "Content-Length": str(len(body))}
    return member(head, body)


def member(head: dict[str, str], body: bytes) -> bytes:
    block = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(block) + packer.flush()


def warcinfo(file: str, date: str) -> bytes:
    """The record that opens each shard."""
    body = b"software: quarrylog\r\nformat: WARC File Format 1.1\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{file}')}>", "WARC-Date": date, "WARC-Filename": file, "WARC-Block-Digest": f"sha1:{base32_digest(body)}", "Content-Type": "application/warc-fields"}
    return member(head | {"Content-Length": str(len(body))}, body)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 1 << 30, rows_per_task: int = 200_000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archive under folder and returns its manifest, which is also kept at folder/manifest."""
    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // rows_per_task))
    rows = duplicates(pages, least_bytes).repartitionByRange(tasks, "page_id", "sha1", "url").sortWithinPartitions("page_id", "sha1", "url")

    def write_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, top = file_system(folder)
        part, attempt = f"{TaskContext.get().partitionId():06d}", uuid.uuid4().hex[:8]
        done, out, state = [], None, None

        def close() -> None:
            out.close()
            done.append((part, state["shard"], state["temporary"], f"shard-{part}-{state['shard']:04d}.warc.gz", state["n"], state["bytes"], state["sha"].hexdigest()))

        def put(data: bytes) -> None:
            out.write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        for batch in batches:
            for row in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                data = record(page_id, None if row.url is None else row.url, bytes(row.payload), row.record_type, refers_to, date)
                if out is None or state["bytes"] + len(data) > roll_bytes and state["n"]:
                    if out is not None:
                        close()
                    state = {"shard": len(done), "temporary": f"_tmp-{part}-{len(done):04d}-{attempt}", "n": 0, "bytes": 0, "sha": hashlib.sha256()}
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{state['temporary']}", compression=None)
                    put(warcinfo(f"shard-{part}-{len(done):04d}.warc.gz", date))
                put(data)
                state["n"] += 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    hide(spark, folder)
    written = stash(rows.mapInPandas(write_shards, MANIFEST), "warc-written")
    publish(spark, written, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def hide(spark: SparkSession, folder: str) -> None:
    """Without its manifest an archive is not there: one that is written anew goes first."""
    delete(spark, f"{folder}/manifest")


def by_file(manifest: DataFrame) -> DataFrame:
    """One task for each shard, up to 10000 tasks."""
    return manifest.repartitionByRange(max(1, min(10_000, manifest.count())), "file")


def publish(spark: SparkSession, written: DataFrame, folder: str) -> None:
    """Gives the files their final names, checks them, removes what no record of written names, then puts the manifest in place."""

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = file_system(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if store.get_file_info(f"{top}/{row.temporary}").is_file:  # else a first attempt of this task has moved it
                    if store.get_file_info(f"{top}/{row.file}").is_file:  # of an earlier archive
                        store.delete_file(f"{top}/{row.file}")
                    store.move(f"{top}/{row.temporary}", f"{top}/{row.file}")
                assert store.get_file_info(f"{top}/{row.file}").size == row.n_bytes, row.file
            yield batch[["file"]]

    by_file(written).mapInPandas(commit, "file string").write.mode("overwrite").format("noop").save()
    store, top = file_system(folder)
    store.create_dir(top, recursive=True)
    from pyarrow import fs

    there = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(top)) if i.is_file and (i.base_name.startswith("_tmp-") or i.base_name.endswith(".warc.gz"))]
    for row in spark.createDataFrame(there, "file string").join(written.select("file"), "file", "left_anti").toLocalIterator():  # of lost attempts
        store.delete_file(f"{top}/{row['file']}")
    written.write.mode("overwrite").parquet(f"{folder}/_manifest")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    if not path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(f"{folder}/_manifest"), path(f"{folder}/manifest")):
        raise OSError(f"the manifest of {folder} could not be put in place")


def parse(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one member in memory at a time."""
    data, unpack, member = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not data and not (data := stream.read(chunk)):
            if member:
                raise ValueError("the archive ends within a record")
            return
        member += unpack.decompress(data)
        data = b""
        if unpack.eof:
            data, unpack = unpack.unused_data, zlib.decompressobj(31)
            head, _, rest = bytes(member).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            if rest[len(block) :] != b"\r\n\r\n":
                raise ValueError("a record does not end as it must")
            yield fields, block
            member = bytearray()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a written archive. payload is null for revisits; intact: digests and lengths hold."""
    schema = T._parse_datatype_string(RECORD)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = file_system(folder)
        for batch in batches:
            for name in batch["file"]:
                rows, size = [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for h, block in parse(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        revisit, page = h["WARC-Type"] == "revisit", h["X-Page"]
                        intact = h["WARC-Block-Digest"] == f"sha1:{base32_digest(block)}" and (revisit or h["WARC-Payload-Digest"] == h["WARC-Block-Digest"] and int(h["X-Payload-Bytes"]) == len(block))
                        rows.append((int(page) if page else None, None if "X-Url-Null" in h else h["WARC-Target-URI"], None if revisit else block, int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], int(h["X-Refers-To-Page"]) if revisit else None, name, intact))
                        size += len(block)
                        if size > 16 << 20 or len(rows) >= 5000:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema.names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return by_file(manifest.select("file")).mapInPandas(records, RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to a new archive in the shared folder, reads it back and gives each record's digest columns."""
    folder = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
