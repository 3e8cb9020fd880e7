"""Alerts to chat webhooks from micro-batches, each at most once for a batch that is replayed.

A ledger holds what was sent, one folder for each batch id. A batch is cut into deliveries with keys made of the batch id and the alert; those
whose key the ledger has are left out. A task sends its share and records each answer in a file of its own as soon as it has it, so what a lost
attempt has sent is known to the next one; between the answer and the record a crash can still repeat one call, whose key the receiver
sees in a header. When all are done the batch's folder gets a mark, and a replay of it sends nothing.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What addresses of chat services hold, by kind.
KINDS = {"wechat": ("qyapi.weixin", "wecom"), "dingtalk": ("dingtalk", "oapi.dingtalk"), "feishu": ("feishu", "lark")}
SENT = "key string, alert_id string, url string, ok boolean, answer string"


def kind_of(url: Column) -> Column:
    """Which chat service an address belongs to; generic for others, null for none."""
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit(None))
    for kind, parts in KINDS.items():
        for part in parts:
            out = out.when(url.contains(part), kind)
    return out.otherwise("generic")


def payload(url: Column, text: Column, message_type: str = "markdown", title: str = "告警通知") -> Column:
    """The JSON body that the service at an address expects."""
    content = F.to_json(F.struct(F.lit(message_type).alias("msgtype"), F.struct(text.alias("content")).alias(message_type)))
    titled = F.to_json(F.struct(F.lit(message_type).alias("msgtype"), F.struct(F.lit(title).alias("title"), text.alias("text")).alias(message_type)))
    plain = F.to_json(F.struct(F.lit("text").alias("msg_type"), F.struct(text.alias("text")).alias("content")))
    kind = kind_of(url)
    return F.when(kind == "dingtalk", titled).when(kind == "feishu", plain).when(kind.isNotNull(), content)


def accepted(answer: str) -> bool:
    """Whether a service's answer says that it took the message: code 0 in one of its spellings; no code is none."""
    try:
        said = json.loads(answer)
    except ValueError:
        return False
    if not isinstance(said, dict):
        return False
    return said.get("errcode", said.get("code", 0)) == 0 or said.get("StatusCode") == 0


def post(url: str, body: str, key: str, timeout: float = 10.0) -> tuple[bool, str]:
    """Sends one message; (taken, answer or error)."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json; charset=utf-8", "Idempotency-Key": key})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            answer = response.read(10_000).decode(errors="replace")
    except (OSError, ValueError) as e:
        return False, str(e)[:500]
    return accepted(answer), answer


def store_of(uri: str):
    """The pyarrow file system of a folder that driver and executors share, and the folder's path there."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return found, path.rstrip("/")


def sent(spark: SparkSession, ledger: str) -> DataFrame:
    """All that was sent: key, alert_id, url, ok, answer."""
    store, top = store_of(ledger)
    store.create_dir(top, recursive=True)
    return spark.read.schema(SENT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(ledger)


def sink(ledger: str, send: Callable[[str, str, str], tuple[bool, str]] = post, parallel: int = 8) -> Callable[[DataFrame, int], None]:
    """A function for to_batches: sends each row (alert_id, url, text) of a micro-batch once and records it under ledger, a folder that all executors share.

    Rows without an address are left out; rows that repeat an alert and address within a batch are one. A call that fails is recorded as such and
    not tried again by a replay: whoever wants that reads the ledger.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store, top = store_of(ledger)
        folder = f"{top}/batch={batch_id}"
        store.create_dir(folder, recursive=True)
        if store.get_file_info(f"{folder}/_done").is_file:
            return
        key = F.sha2(F.concat_ws("\u0001", F.lit(str(batch_id)), F.col("alert_id").cast("string"), F.col("url")), 256)
        rows = batch.select(F.col("alert_id").cast("string").alias("alert_id"), "url", payload(F.col("url"), F.col("text")).alias("body")).where("body is not null")
        rows = rows.withColumn("key", key).groupBy("key").agg(*[F.min(c).alias(c) for c in ("alert_id", "url", "body")])
        rows = rows.join(sent(spark, ledger).where(F.input_file_name().contains(f"/batch={batch_id}/")).select("key").distinct(), "key", "left_anti")

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, _ = store_of(ledger)
            for frame in batches:
                for r in frame.itertuples(index=False):
                    name = f"{folder}/{r.key}.json"
                    if not store.get_file_info(name).is_file:  # else an attempt of this task that was lost has sent it
                        ok, answer = send(r.url, r.body, r.key)
                        with store.open_output_stream(name) as out:
                            out.write(json.dumps({"key": r.key, "alert_id": r.alert_id, "url": r.url, "ok": ok, "answer": answer}).encode() + b"\n")
                yield frame[["key"]]

        rows.repartition(parallel, "key").mapInPandas(call, "key string").write.mode("overwrite").format("noop").save()
        with store.open_output_stream(f"{folder}/_done") as out:
            out.write(b"")

    return deliver
