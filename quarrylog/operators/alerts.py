"""Texts of alerts as column functions: labels for priority and history, the three templates, and grades of a model's answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V


def label(priority: Column, score: Column, hits: Column, first_seen: Column, regressed: Column, resolved_at: Column) -> Column:
    """What stands before a finding: its priority and score, then whether it came back (and since when it was resolved), is new, or how often it was seen."""
    p = F.coalesce(priority, F.lit("P1"))
    head = F.concat(X.lookup(p, V.PRIORITY_ICONS, ""), F.lit(" ["), p, F.lit("|"), F.coalesce(score, F.lit(0)).cast("string"), F.lit("分] "))
    back = F.concat(F.lit("🔄 [回归] 上次修复于 "), F.substring(F.coalesce(resolved_at.cast("string"), F.lit("")), 1, 10), F.lit(" | "))
    known = F.concat(F.lit("📋 [已知问题|第"), hits.cast("string"), F.lit("次] "))
    return F.concat(head, F.when(F.coalesce(regressed, F.lit(False)), back).when(F.coalesce(first_seen, F.lit(False)), "🆕 [首次发现] ").when(hits > 1, known).otherwise(""))


def _lines(*lines) -> Column:
    """Lines joined, those that are null left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _field(name: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"**{name}**: "), value.cast("string"), F.lit(unit))


def _source(domain: Column, host: Column) -> Column:
    return F.coalesce(X.nullif_empty(domain), X.nullif_empty(host), F.lit("未知"))


def error_alert(line: Column, domain: Column, branch: Column, host: Column, language: Column, count: Column, summary: Column, period: Column, platform: str = "日志") -> Column:
    """Sent for error logs where no model looks at them."""
    stage = F.concat(X.lookup(branch, V.BRANCH_ICONS), F.lit(" "), X.lookup(branch, V.BRANCH_NAMES))
    return _lines(
        "## ⚠️ 日志异常告警", "", _field("业务线", line), _field("站点", _source(domain, host)), F.when(stage.isNotNull(), _field("环境", stage)), _field("语言", F.coalesce(X.lookup(language, V.LANGUAGE_NAMES), language)), _field("时间范围", period), _field("异常日志数", count, " 条"),
        "", "---", "", "**异常摘要**:", F.substring(summary, 1, 1500), "", "---", f"> 请及时排查处理。登录 {platform} 平台查看完整日志。",
    )


def analysis_alert(line: Column, domain: Column, branch: Column, host: Column, severity: Column, content: Column, task_id: Column, count: Column, platform: str = "日志") -> Column:
    """Sent for what a model's analysis found."""
    stage = X.lookup(branch, V.BRANCH_NAMES)
    where = F.concat(_source(domain, host), F.when(stage.isNotNull(), F.concat(F.lit(" ("), stage, F.lit(")"))).otherwise(""))
    return _lines(
        F.concat(F.lit("## "), X.lookup(severity, V.SEVERITY_ICONS, "⚪"), F.lit(f" {platform} AI 分析告警")), "", _field("告警级别", F.upper(severity)), _field("业务线", line), _field("站点", where), _field("分析日志数", count, " 条"), _field("任务ID", F.substring(task_id.cast("string"), 1, 8), "..."),
        "", "---", "", "**AI 分析结论**:", F.substring(content, 1, 2000), "", "---", f"> 请及时处理。登录 {platform} 平台查看完整分析报告。",
    )


def failure_alert(line: Column, domain: Column, error: Column, task_id: Column) -> Column:
    """Sent when an analysis itself has failed."""
    return _lines(
        "## 🛑 AI 分析流程异常", "", _field("业务线", line), _field("站点", _source(domain, F.lit(""))), _field("任务ID", F.substring(task_id.cast("string"), 1, 8), "..."), "", "---", "", "**错误信息**:", "```", F.substring(error, 1, 1000), "```", "", "---",
        "> ⚠️ 分析管道执行未能完成", "> 请检查报错查明是基础设施依赖（如 ElasticSearch、网络等）故障，还是 AI 模型调用异常。", "> 当前该业务线的错误日志将仅通过原始日志摘要通知。",
    )


def graded(content: Column, confidence: Column, logs: Column) -> Column:
    """A struct of score (0 to 100: length, few generic phrases, advice, confidence), grade (high from 70, medium from 40, low) and retry (low, and of three logs or more)."""
    text = F.coalesce(content, F.lit(""))
    n = F.char_length(F.trim(text))
    generic = reduce(lambda a, b: a + b, [F.lower(text).contains(p.lower()).cast("int") for p in V.GENERIC_PHRASES])
    advice = reduce(lambda a, b: a + b, [text.rlike(f"(?i){p}").cast("int") for p in V.ACTIONABLE])
    length = F.when(n >= 200, 30).when(n >= 50, F.floor(15 + 15 * (n - 50) / 150)).otherwise(F.floor(15 * n / 50))
    sure = F.when(confidence >= 0.8, 20).when(confidence >= 0.5, 12).otherwise(5)
    total = length + F.when(generic == 0, 25).when(generic == 1, 15).otherwise(5) + F.when(advice >= 3, 25).when(advice >= 1, 15).otherwise(5) + sure
    score = F.when(text == "", 0).otherwise(F.least(total, F.lit(100))).cast("int")
    # the array names the score, so that it is made once
    return F.get(F.transform(F.array(score), lambda s: F.struct(s.alias("score"), F.when(s >= 70, "high").when(s >= 40, "medium").otherwise("low").alias("grade"), ((text == "") | (s < 40) & (F.coalesce(logs, F.lit(0)) >= 3)).alias("retry"))), F.lit(0))


def trend_alert(severity: Column, line: Column, ratio: Column, threshold: Column, recent: Column, baseline: Column) -> Column:
    """Sent when errors come faster and faster."""
    return _lines(
        F.concat(F.lit("## "), F.when(severity == "critical", "🔴").otherwise("🟡"), F.lit(" 错误趋势预警")), "", _field("业务线", line), F.concat(F.lit("**加速倍率**: "), F.format_string("%.1fx", ratio), F.lit(" (阈值: "), threshold.cast("string"), F.lit("x)")),
        _field("最近窗口错误数", recent), _field("基线平均", baseline), "", "---", "", "> ⚠️ 错误率正在加速增长，建议立即排查是否有新发布或基础设施异常。",
    )


def history_sections(issues: DataFrame, key: str) -> DataFrame:
    """issues (key, place, severity, verified, resolved, signature, hits, content), a few for each key -> key, section: what is known of a line, best first."""
    marks = F.concat_ws(", ", F.upper(F.coalesce("severity", F.lit("info"))), F.when(F.col("verified"), "已验证"), F.when(F.col("resolved"), "已修复"))
    conclusion = F.substring(F.substring_index(F.substring("content", 1, 300), "\n", 1), 1, 200)
    entry = F.concat(F.col("place").cast("string"), F.lit(". ["), marks, F.lit("] "), F.substring(F.coalesce("signature", F.lit("")), 1, 120), F.when(F.col("hits") > 1, F.concat(F.lit(" (累计 "), F.col("hits").cast("string"), F.lit(" 次)"))).otherwise(""), F.when(F.coalesce(conclusion, F.lit("")) != "", F.concat(F.lit("\n   结论: "), conclusion)).otherwise(""))
    listed = issues.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("t"))
    return listed.select(key, F.concat(F.lit("## 该服务的历史分析记录\n以下是过去分析中的关键发现：\n\n"), F.col("t"), F.lit("\n\n请参考但基于当前日志做独立判断。已修复问题再次出现属于回归。")).alias("section"))


def correlation_sections(found: DataFrame, key: str) -> DataFrame:
    """found (key, name, direction, errors, samples), a few for each key -> key, section: which connected services failed as well, upstream first, then by name, with three samples each."""
    head = F.concat(F.lit("### "), F.when(F.col("direction") == "upstream", "上游服务").otherwise("下游服务"), F.lit(": "), F.col("name").cast("string"), F.lit(" ("), F.col("errors").cast("string"), F.lit(" 条错误)"))
    shown = F.transform(F.slice("samples", 1, 3), lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s))
    block = F.array_join(F.concat(F.array(head), shown, F.array(F.lit(""))), "\n")
    listed = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("direction") != "upstream").alias("a"), "name", block.alias("b")))), lambda x: x["b"]), "\n").alias("t"))
    return listed.select(key, F.concat(F.lit("\n\n## 跨服务关联异常\n以下关联服务在同一时间窗口内也出现了错误，请综合分析是否存在级联故障：\n\n"), F.col("t")).alias("section"))


def change_sections(points: DataFrame, key: str, most: int = 5) -> DataFrame:
    """points (key, trend, bucket, count, z, before_rate, after_rate) -> key, section: the first changes of the error rate in time."""
    line = F.concat(F.lit("- **"), F.col("bucket").cast("string"), F.lit("**: 错误率从 "), F.col("before_rate").cast("string"), F.lit("/min 突增到 "), F.col("after_rate").cast("string"), F.lit("/min (z-score="), F.col("z").cast("string"), F.lit(", 当前桶="), F.col("count").cast("string"), F.lit("条)"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("bucket"))
    shown = points.withColumn("place", first).where(F.col("place") <= most)
    listed = shown.groupBy(key).agg(F.first("trend").alias("trend"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return listed.select(key, F.concat(F.lit("\n\n## 错误率变点检测\n整体趋势: **"), F.col("trend"), F.lit("**\n\n以下时间点检测到统计显著的错误率突变：\n\n"), F.col("t"), F.lit("\n\n请结合以上错误率变化分析是否与部署、配置变更或流量突增有关。")).alias("section"))
