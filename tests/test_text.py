import hashlib
import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.operators import priority as P


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_stated_levels(spark):
    lines = ["2024-04-23 10:00:00,123 [155] ERROR App.Core.UserService - Failed", "[2024-04-23 10:00:00.123] [main] [FATAL] Application crashed", "[error] lowercase", "nothing", None]
    assert each(spark, X.message_level, lines) == ["ERROR", "FATAL", "ERROR", None, None]


def test_noise_and_shallow(spark):
    lines = ['{"status": true, "message": "获取成功"}', '{"status": true, "Exception": "NullRef"}', "[ERROR] User preference updated successfully", "[ERROR] java.lang.NullPointerException: x", "[INFO] all is well", "[INFO] 请求失败 again"]
    assert each(spark, X.drop_reason, lines) == ["noise", None, "shallow", None, "level", None]


def test_normalized_levels(spark):
    assert each(spark, X.normalize_level, ["ERR", "fatal", "VERBOSE", "warn", "Custom", None]) == ["error", "critical", "debug", "warning", "custom", None]


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("用户手机号 13912345678 登录失败", "139****5678"),
        ("身份证号 110101199001011234", "110101********1234"),
        ("邮箱 zhangsan@example.com 注册", "zha****@example.com"),
        ("卡号 6222021234567890123 ok", "6222********0123"),
        ("phone=13812345678 called", "phone=138****5678"),
        ("the password: hunter2secret!", "hun****ret!"),
        ("guid=abcdefghij", "guid=abc****ghij"),
    ],
)
def test_masks(spark, text, part):
    (once,) = each(spark, X.mask_sensitive, [text])
    assert part in once
    assert each(spark, X.mask_sensitive, [once]) == [once]


def test_leaves_what_is_not_sensitive(spark):
    same = ["request_id=550e8400-e29b-41d4-a716-446655440000", "Connected to 192.168.1.100:8080", "", "short", None]
    assert each(spark, X.mask_sensitive, same) == same


def test_mask_widths(spark):
    assert each(spark, X.mask_value, ["123456789", "abcd", "abcdefgh", "a" * 17]) == ["123****6789", "****", "a****h", "aaaa****aaaa"]


def test_fingerprints(spark):
    f = lambda c: X.fingerprint(F.lit("b"), c)
    a, b, c, d, e = each(spark, f, ["java.io.IOException: x\n at a", "java.io.IOException: x\n at b", "plain", "", None])
    assert a == b and a.startswith("b:java.io.IOException:")
    assert len(c.split(":")[1]) == 16
    assert (d, e) == ("", "")


def test_signatures(spark):
    log = "x.BException: y\n at a.b.C.m(F.java:1)\nCaused by: x.AError\n at a.b.C.m(F.java:9)"
    assert each(spark, X.error_signature, [log]) == ["EXCEPTIONS: x.AError, x.BException | STACK: a.b.C.m"]
    assert each(spark, X.error_signature, ["[t] [ERROR] it broke\nok"]) == ["ERRORS: it broke"]
    assert each(spark, X.normalize_signature, ["At 2024-01-01T00:00:00Z id 123456  HOST:80 0xFF"]) == ["at id host"]


def test_classes_are_found_as_by_the_plain_pattern(spark):
    plain = re.compile(r"([\w.]+(?:Exception|Error|Throwable|Fault))", re.ASCII)
    pick = random.Random(7)
    parts = ("Error", "Exception", "Fault", "Throwable", "Err", "E", ".", "a", "_", "9", " ", "\n", "$", "\u00e9", "\U0001f600", "\u5f02")
    texts = ["Error", "ErrorError x", ".Error", "a.ErrorX.Fault.b Error Fault", *("".join(pick.choices(parts, k=12)) for _ in range(500))]
    assert each(spark, lambda c: F.to_json(F.regexp_extract_all(c, F.lit(X.V.EXCEPTION_CLASS), F.lit(1))), texts) == [json.dumps(plain.findall(t), separators=(",", ":")) for t in texts]


def test_long_words_take_time_in_proportion(spark):
    word, began = "x.Y" * 40_000, time.monotonic()
    assert each(spark, X.error_signature, [word, f"{word} a.BError {word}"]) == [word[:300], "EXCEPTIONS: a.BError"]
    assert each(spark, X.dedup_key, [word]) == [word[:200]]
    assert time.monotonic() - began < 20


def test_fingerprints_of_long_lines(spark):
    rows, began = spark.range(0, 40_000, 1, 1).select(F.concat(F.lit("line "), F.repeat((F.col("id") % 9).cast("string"), 300)).alias("v")), time.monotonic()
    found = {r[0] for r in rows.groupBy(X.fingerprint(F.lit("b"), F.col("v"))).count().collect()}
    assert found == {"b:" + hashlib.md5(("line " + str(k) * 195).encode()).hexdigest()[:16] for k in range(9)}
    assert time.monotonic() - began < 25


def test_fingerprints_make_their_message_once(spark):
    message = F.concat(F.lit("marker "), F.col("id").cast("string"))
    plan = spark.range(3).select(X.fingerprint(F.lit("s"), message, "fp:").alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marker") == 1
    texts = ["a.b.KindError: x\n at q", "Error", " Fault x.Fault", "\nfirst", "errors", "Err" + "or" * 300, "\u5f02 x.Throwable", "y" * 199 + ".Error"]

    def own(t: str) -> str:
        line = t.split("\n")[0][:200]
        m, d = re.search(r"([\w.]+(?:Exception|Error|Throwable|Fault))", line, re.ASCII), hashlib.md5(line.encode()).hexdigest()
        return f"fp:s:{m[1]}:{d[:12]}" if m else f"fp:s:{d[:16]}"

    assert each(spark, lambda c: X.fingerprint(F.lit("s"), c, "fp:"), [*texts, "", None]) == [*map(own, texts), "", ""]


def test_stack_lines(spark):
    assert each(spark, X.is_stack_line, ["  at a.b(C.java:1)", "Caused by: x", "... 12 more", "started at noon"]) == [True, True, True, False]
    assert each(spark, X.has_stack, ["x\n  at a.b(C.java:1)", "x", ""]) == [True, False, False]


def test_timestamps(spark):
    times = ["2024-01-01T00:00:01.500Z", "2024-01-01T00:00:01Z", "2024-01-01T08:00:00+08:00", "2024-01-01 00:00:00", "12.5", "garbage", None]
    assert each(spark, X.parse_timestamp, times) == [1704067201.5, 1704067201.0, 1704067200.0, 1704067200.0, 12.5, 0.0, 0.0]


def test_chunks(spark):
    assert each(spark, lambda c: X.chunks(c, 4, 1), ["abcdefgh", "", None]) == [["abcd", "defg", "gh"], [], []]


def test_priority_cases(spark):
    row = spark.range(1)
    score = lambda *a: row.select(P.score(*map(F.lit, a))).first()[0]
    first, second = score("critical", 0.95, 100, 10, 8, True, 0, False, 1, 0.0), score("info", 0.5, 5, 10, 3, False, 0, False, 1, 0.0)
    assert first == 94.5
    assert row.select(P.priority(F.lit(first)), P.priority(F.lit(second))).first()[:] == ("P0", "P2")


def test_results_of_a_model(spark):
    answers = ['```json\n{"severity": "error", "content": "c", "error_signals": ["ab", "timeout", "timeout"]}\n```', "not json", "[]"]
    a, b, c = each(spark, P.parse_results, answers)
    assert (a[0]["severity"], a[0]["signals"], a[0]["confidence"]) == ("error", ["timeout"], 0.5)
    assert b is None or b == []
    assert c == []


def test_addresses_as_with_the_plain_pattern(spark):
    """Runs are read once, and matches that follow each other are found as before."""
    import random

    plain = r"([a-zA-Z0-9._%+-]{1,3})[a-zA-Z0-9._%+-]*(@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})".replace("\\\\", "\\")
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "x.co", "@", ".", "-", " ", "ab.cde", "é", "1"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    same = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", plain, "<$1****$2>").alias("a"), F.regexp_replace("t", X.V.EMAIL, "<$1****$2>").alias("b"))
    assert same.where("a <> b").count() == 0 and same.where("contains(a, '<')").count() > 300


def test_long_runs_are_masked_in_linear_time(spark):
    import time

    rows = spark.createDataFrame([("a" * 1_000_000 + " x@y.zz ",), ("7" * 1_000_000,), ("@" + "b" * 1_000_000,)], "t string")
    rows.select(X.mask_formats(F.col("t"))).collect()
    began = time.time()
    got = [r[0] for r in rows.select(X.mask_formats(F.col("t"))).collect()]
    assert time.time() - began < 5 and got[0].endswith("x****@y.zz ") and got[1] == "7" * 1_000_000

