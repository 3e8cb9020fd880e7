"""Streams with keyed state against the same in batch."""

import datetime
import http.server
import json
import os
import random
import threading

from pyspark.sql import functions as F

from quarrylog.operators import timeseries
from quarrylog.streaming import stateful, webhooks

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def stream_of(spark, folder, schema, batches):
    """A stream that gives these batches one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def results(stream, checkpoint):
    got = []
    stateful.to_batches(stream, lambda batch, _: got.extend(batch.collect()), checkpoint, every=None).start().awaitTermination()
    return got


def test_rate_limit_equals_batch(spark, tmp_path):
    """Requests in disorder within the lateness, ties, a busy key with rejected requests, and keys that pause; the last batch only moves the watermark."""
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), i, at(rng.choice([rng.uniform(0, 40), rng.randrange(0, 60), rng.uniform(200, 230)]))) for i in range(300)]
    rows.sort(key=lambda r: r[2])
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for x, y in zip(batches[::2], batches[1::2], strict=False):  # late ones
        if (y[0][2] - x[-1][2]).total_seconds() < 4:
            x[-3:], y[:3] = y[:3], x[-3:]
    schema = "key string, id long, ts timestamp"
    stream = stream_of(spark, str(tmp_path / "in"), schema, [*batches, [("z", -1, at(1000))], [("z", -2, at(2000))]])
    got = {(r["key"], r["id"]): (r["ts"], r["in_window"], r["limited"]) for r in results(stateful.rate_limit(stream, 5, 10, "30 seconds"), str(tmp_path / "state"))}
    batch = timeseries.rate_flags(spark.createDataFrame(rows, schema), 5, 10, "key").collect()
    want = {(r["key"], r["id"]): (r["ts"], r["in_window"], r["limited"]) for r in batch}
    assert {k: v for k, v in got.items() if k[0] != "z"} == want
    assert any(x[2] for x in want.values()) and not all(x[2] for x in want.values())


def test_fingerprints_return_after_their_time_to_live(spark, tmp_path):
    schema = "ts timestamp, log_id long, service int, message string"
    row = lambda s, i, m="x.IOException: p": (at(s), i, 1, m)
    hour = 3600
    batches = [
        [row(0, 1), row(10, 2), row(0, 3, "x.KeyError: q")],
        [row(5 * hour, 4), row(5 * hour + 599, 40, "x.LateError: z")],  # still known
        [row(5 * hour, 5), row(6 * hour - 1, 6)],  # late, but within the lateness
        [row(6 * hour, 7), row(6 * hour + 5, 8)],  # its time is over: new again, once
        [row(6 * hour - 60, 9)],  # late, and older than the sighting on record
        [row(30 * hour, 10, "x.KeyError: q")],
    ]
    got = results(stateful.new_sightings(stream_of(spark, str(tmp_path / "in"), schema, batches), "6 hours", "90 minutes"), str(tmp_path / "state"))
    assert sorted(r["log_id"] for r in got) == [1, 3, 7, 10, 40]
    assert {r["log_id"]: r["ts"] for r in got}[7] == at(6 * hour)


def test_first_sightings_in_one_batch_equal_windows(spark, tmp_path):
    """In one batch new sightings are what opens windows of the time to live."""
    rng = random.Random(4)
    rows = [(at(rng.randrange(0, 80_000)), i, i % 3, f"x.Error{rng.randrange(4)}: m") for i in range(400)]
    schema = "ts timestamp, log_id long, service int, message string"
    got = results(stateful.new_sightings(stream_of(spark, str(tmp_path / "in"), schema, [rows]), "2 hours"), str(tmp_path / "state"))
    marked = spark.createDataFrame(rows, schema).withColumn("fingerprint", stateful.X.fingerprint(F.col("service").cast("string"), F.col("message")))
    want = timeseries.first_in_window(marked, 7200, "fingerprint").collect()
    assert sorted((r["fingerprint"], r["ts"]) for r in got) == sorted((r["fingerprint"], r["opened"]) for r in want)


class Receiver(http.server.BaseHTTPRequestHandler):
    """Keeps what is posted; answers by path."""

    got: list = []

    def do_POST(self):  # noqa: N802
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Receiver.got.append((self.path, self.headers["Idempotency-Key"], json.loads(body)))
        if "broken" in self.path:
            self.send_error(500)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"errcode": 93000}' if "refused" in self.path else b'{"errcode": 0}')

    def log_message(self, *args):
        pass


def test_a_replayed_batch_sends_nothing_twice(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [(i, f"{base}/{kind}", f"text {i}") for i, kind in enumerate(["dingtalk", "feishu", "qyapi.weixin", "other", "refused", "broken", "other"])]
    rows += [(6, f"{base}/other", "text 6"), (7, None, "no address"), (8, "", "none either"), (9, "http://127.0.0.1:1/nobody", "x")]
    ledger = str(tmp_path / "ledger")
    deliver = webhooks.sink(ledger)
    batch = spark.createDataFrame(rows, "alert_id long, url string, text string")
    try:
        deliver(batch, 0)
        assert len(Receiver.got) == 7
        first = {r["alert_id"]: r["ok"] for r in webhooks.sent(spark, ledger).collect()}
        assert first == {str(i): i not in (4, 5, 9) for i in (*range(7), 9)}
        deliver(batch, 0)  # the stream starts anew before it has noted the batch
        assert len(Receiver.got) == 7
        os.remove(f"{ledger}/batch=0/_done")  # or stopped before the batch was whole
        os.remove(f"{ledger}/batch=0/{Receiver.got[0][1]}.json")
        deliver(batch, 0)
        assert len(Receiver.got) == 8 and Receiver.got[7] in Receiver.got[:7]
        deliver(batch.limit(1), 1)  # another batch is sent again
        assert len(Receiver.got) == 9
        bodies = {path: body for path, _, body in Receiver.got}
        assert bodies["/dingtalk"]["markdown"] == {"title": "告警通知", "text": "text 0"} and bodies["/feishu"] == {"msg_type": "text", "content": {"text": "text 1"}}
        assert bodies["/qyapi.weixin"] == {"msgtype": "markdown", "markdown": {"content": "text 2"}} and bodies["/refused"]["msgtype"] == "markdown"
    finally:
        server.shutdown()


def test_a_stream_of_alerts_is_sent_once(spark, tmp_path):
    calls, ledger, checkpoint = str(tmp_path / "calls"), str(tmp_path / "ledger"), str(tmp_path / "state")
    os.mkdir(calls)

    def send(url, body, key):
        open(f"{calls}/{key}-{os.urandom(4).hex()}", "w").close()
        return True, body

    schema = "alert_id long, url string, text string"
    batches = [[(i, "https://x/wecom", f"t{i}")] for i in range(3)]
    stream = stream_of(spark, str(tmp_path / "in"), schema, batches)
    run = lambda: stateful.to_batches(stream, webhooks.sink(ledger, send), checkpoint, every=None).start().awaitTermination()
    run()
    assert len(os.listdir(calls)) == 3
    last = max(int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")  # the stream stopped after sending, before its commit
    run()
    assert len(os.listdir(calls)) == 3


def test_counts_equal_batch_without_rows_that_are_too_late(spark, tmp_path):
    """Tumbling and sliding windows against a batch; a row within the lateness counts, one after it doesn't."""
    rng = random.Random(8)
    schema = "ts timestamp, level string"
    rows = sorted((at(rng.randrange(0, 3600)), rng.choice(["ERROR", "INFO"])) for _ in range(300))
    half = len(rows) // 2
    late, too_late = (rows[half][0] - datetime.timedelta(minutes=5), "LATE"), (at(0), "GONE")
    batches = [rows[:half], [*rows[half:], late], [too_late], [(at(90_000), "END")]]
    for i, slide in enumerate((None, "5 minutes")):
        stream = stream_of(spark, str(tmp_path / f"in{i}"), schema, batches)
        got = {(r["bucket"], r["level"]): r["count"] for r in results(stateful.counts(stream, "10 minutes", "10 minutes", slide), str(tmp_path / f"state{i}"))}
        window = F.window("ts", "10 minutes", slide) if slide else F.window("ts", "10 minutes")
        whole = spark.createDataFrame([*rows, late], schema).groupBy(window.alias("w"), "level").count()
        assert got == {(r["w"]["start"], r["level"]): r["count"] for r in whole.collect()}


def test_alert_windows_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    schema = "ts timestamp, key string"
    rows = [(at(rng.randrange(0, 6000)), rng.choice("abc")) for _ in range(120)]
    stream = stream_of(spark, str(tmp_path / "in"), schema, [rows, [(at(50_000), "z")], [(at(60_000), "z")]])
    got = {(r["key"], r["opened"]): r["alerts"] for r in results(stateful.alert_windows(stream, 300), str(tmp_path / "state"))}
    batch = timeseries.first_in_window(spark.createDataFrame(rows, schema), 300, "key").collect()
    want = {(r["key"], int(r["opened"].replace(tzinfo=datetime.timezone.utc).timestamp())): r["alerts"] for r in batch}
    assert {k: n for k, n in got.items() if k[0] != "z"} == want
