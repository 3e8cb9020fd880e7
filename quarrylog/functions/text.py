"""Column functions over log messages: levels, noise, stack lines, signatures, fingerprints, masks, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylog.functions import values as V


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, phrases) -> Column:
    """Whether any phrase stands in c: one pass with an alternation, as a chain of contains outgrows a generated method."""
    return F.coalesce(c.rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def named(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is made once for a row, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(c: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def message_level(line: Column) -> Column:
    """The level that a line states, upper case, or null."""
    return F.upper(F.coalesce(*[nullif_empty(F.regexp_extract(line, p, 1)) for p in V.LEVEL_PATTERNS]))


def normalize_level(raw: Column) -> Column:
    """ERR is error, FATAL critical, TRACE and VERBOSE debug; any other level in lower case."""
    up = F.upper(F.trim(raw))
    named = {"ERR": "error", "ERROR": "error", "FATAL": "critical", "CRITICAL": "critical", "WARN": "warning", "WARNING": "warning", "TRACE": "debug", "VERBOSE": "debug", "DEBUG": "debug", "INFO": "info", "INFORMATION": "info"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[up], F.lower(raw))


def extract_level(level: Column, log_level: Column, severity: Column, loglevel: Column, filetype: Column, message: Column) -> Column:
    """The first level that is given: the four fields in order, the file type, a level stated in the message; else empty."""
    fields = [normalize_level(nullif_empty(c)) for c in (level, log_level, severity, loglevel)]
    stated = F.coalesce(*[nullif_empty(F.regexp_extract(message, V.LEVEL_PATTERNS[i], 1)) for i in (1, 0)])
    return F.coalesce(*fields, lookup(filetype, V.FILETYPE_LEVEL), normalize_level(stated), F.lit(""))


def pipeline_level(fields: tuple[Column, ...], log_level: Column, filetype: Column, message: Column) -> Column:
    """As extract_level, in upper case and UNKNOWN where there is none; the first of the fields that is there at all decides, even if it is empty."""
    stated = F.coalesce(*[nullif_empty(F.regexp_extract(message, V.LEVEL_PATTERNS[i], 1)) for i in (1, 0)])
    own = F.coalesce(*map(normalize_level, fields), normalize_level(nullif_empty(log_level)), lookup(filetype, V.FILETYPE_LEVEL), normalize_level(stated))
    return F.coalesce(F.upper(own), F.lit("UNKNOWN"))


def message_of(*fields: Column, whole: Column) -> Column:
    """The first non-empty field, else the start of the whole document."""
    return F.coalesce(*map(nullif_empty, fields), F.substring(whole, 1, 500))


METADATA = {"domain": "$.gy.domain", "pod_name": "$.gy.podname", "branch": "$.gy.branch", "filetype": "$.gy.filetype", "image_version": "$.image.version", "host_name": "$.host.name"}


def metadata(source: Column) -> Column:
    """A JSON document's origin as a struct of strings, empty where a field or its object is missing; the document is parsed once."""
    return F.transform(F.array(F.try_parse_json(source)), lambda v: F.struct(*[F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")).alias(name) for name, path in METADATA.items()]))[0]


def format_line(ts: Column, level: Column, message: Column, **meta: Column) -> Column:
    parts = F.concat_ws(", ", *[F.when(nullif_empty(c).isNotNull(), F.concat(F.lit(f"{k}:"), c)) for k, c in meta.items()])
    return F.concat(F.lit("["), ts, F.lit("] ["), F.upper(level), F.lit("] "), F.when(parts != "", F.concat(F.lit("["), parts, F.lit("] "))).otherwise(""), message)


def is_real_error(line: Column) -> Column:
    return any_of(line.rlike(p) for p in V.REAL_ERRORS) | contains_any(line, V.FAULT_WORDS)


def is_noise(line: Column) -> Column:
    """Two signs of noise are noise; one is, unless a word of failure is there too."""
    signs = reduce(lambda a, b: a + b, (line.rlike(p).cast("int") for p in V.NOISE))
    doubt = line.rlike(r"(?i)exception|error|fail|timeout|refused") | contains_any(line, ("异常", "失败"))
    return (signs >= 2) | ((signs == 1) & ~doubt)


def is_shallow(line: Column, level: Column) -> Column:
    """An ERROR line without any pattern of a real error."""
    return (level == "ERROR") & ~any_of(line.rlike(p) for p in V.REAL_ERRORS)


def drop_reason(line: Column, threshold: str = "ERROR") -> Column:
    """Why the quality filter drops a line: level, noise, shallow, or null for lines that stay."""
    least = V.LEVEL_RANK.get(threshold.upper(), 4)
    level = message_level(line)
    low = (lookup(level, V.LEVEL_RANK) < least) & ~is_real_error(line)
    return F.when(F.coalesce(low, F.lit(False)), "level").when(is_noise(line), "noise").when(F.coalesce(is_shallow(line, level), F.lit(False)) & F.lit(least >= 4), "shallow")


def is_stack_line(line: Column) -> Column:
    start = F.ltrim(line)
    return any_of(start.startswith(p) for p in V.STACK_PREFIXES) | line.rlike(V.STACK_FRAME) | start.rlike(r"^\.\.\. \d+ (more|common)")


def has_stack(message: Column) -> Column:
    """A continuation line among the lines after the first."""
    lines = F.split(message, "\n")
    return F.exists(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), is_stack_line)


def exception_class(text: Column) -> Column:
    return nullif_empty(F.regexp_extract(text, V.EXCEPTION_CLASS, 1))


def first_line(message: Column, length: int) -> Column:
    return F.substring(F.substring_index(message, "\n", 1), 1, length)


def fingerprint(scope: Column, message: Column, prefix: str = "") -> Column:
    """prefix, then scope:class:hash of the first line, or scope:longer hash where there is no exception class; empty for no message."""

    def body(line: Column) -> Column:
        known = exception_class(F.when(any_of(line.contains(e) for e in V.CLASS_ENDINGS), line))  # most lines have none of them, and a search for words is fast
        return F.coalesce(F.concat(known, F.lit(":"), F.substring(F.md5(line), 1, 12)), F.substring(F.md5(line), 1, 16))

    def whole(m: Column) -> Column:
        return F.when(F.coalesce(m, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix), scope, F.lit(":"), named(first_line(m, 200), body)))

    return named(message, whole)


def group_key(message: Column) -> Column:
    """The exception class, else the first line with ids, addresses and numbers blanked."""
    line = F.substring(F.substring_index(message, "\n", 1), 1, 120)
    blank = F.regexp_replace(line, r"\b[0-9a-f]{8,}[-0-9a-f]*\b", "<ID>")
    blank = F.regexp_replace(blank, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>")
    blank = F.substring(F.regexp_replace(blank, r"\d+", "<N>"), 1, 80)
    return F.when(F.coalesce(message, F.lit("")) == "", "__empty__").otherwise(F.coalesce(exception_class(message), blank))


def dedup_key(message: Column) -> Column:
    return F.coalesce(F.concat(exception_class(message), F.lit(":"), first_line(message, 200)), F.substring(message, 1, 200))


def normalize_signature(content: Column) -> Column:
    text = reduce(lambda c, p: F.regexp_replace(c, p, ""), V.VOLATILE, F.trim(content))
    return F.lower(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 120))


def error_signature(log: Column) -> Column:
    """Sorted exception classes and the first 8 frames, of a line its first; without classes the first 3 error lines; else the first 300 characters."""
    lines = F.split(log, "\n")
    classes = F.array_sort(F.array_distinct(F.regexp_extract_all(log, F.lit(V.EXCEPTION_CLASS), F.lit(1))))
    frames = F.slice(F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, V.FRAME_METHOD, 1)), lambda m: m != "")), 1, 8)
    errors = F.slice(F.filter(lines, lambda x: F.upper(x).contains("[ERROR]") | F.upper(x).contains("[FATAL]")), 1, 3)
    errors = F.transform(errors, lambda x: F.substring(F.trim(F.regexp_replace(x, r"^\[.*?\]\s*\[.*?\]\s*(\[.*?\]\s*)?", "")), 1, 150))
    known = F.concat(F.lit("EXCEPTIONS: "), F.array_join(classes, ", "), F.when(F.size(frames) > 0, F.concat(F.lit(" | STACK: "), F.array_join(frames, " → "))).otherwise(""))
    return F.when(F.size(classes) > 0, known).when(F.size(errors) > 0, F.concat(F.lit("ERRORS: "), F.array_join(errors, " | "))).otherwise(F.substring(log, 1, 300))


def mask_value(v: Column) -> Column:
    n = F.char_length(v)
    keep = lambda a, b: F.concat(F.substring(v, 1, a), F.lit("****"), F.right(v, F.lit(b)))
    return F.when(n <= 4, "****").when(n <= 8, keep(1, 1)).when(n <= 16, keep(3, 4)).otherwise(keep(4, 4))


def mask_formats(text: Column) -> Column:
    """Phones, identity cards, e-mail addresses and bank cards, by their form, one after another.

    Each step looks first whether the text can hold its form, so most texts are read for digits and "@" only.
    """
    digits = lambda n: lambda c: c.rlike(f"[0-9]{{{n}}}")
    steps = ((digits(11), V.PHONE, "$1****$2"), (digits(17), V.ID_CARD, "$1********$2"), (lambda c: c.contains("@"), V.EMAIL, "$1****$2"), (digits(16), V.BANK_CARD, "$1********$2"))

    def step(c: Column, s: tuple) -> Column:
        # the array gives the input a name, so that it is made once
        return F.get(F.transform(F.array(c), lambda x: F.when(s[0](x), F.regexp_replace(x, *s[1:])).otherwise(x)), F.lit(0))

    return reduce(step, steps, text)


PAIR = re.compile(r"""([A-Za-z_]+)["']?\s*[:=]\s*["']?""")


def mask_pairs(text: str) -> str:
    """Masks the values of sensitive keys. A key may be the end of a longer word; of several the longest counts. The first place where the value stands in the pair is replaced."""
    out, at, spot = [], 0, 0
    while m := PAIR.search(text, spot):
        spot = m.end()
        word = m[1].lower()
        key = next((word[i:] for i in range(len(word)) if word[i:] in KEYS), None)
        value = VALUE.match(text, m.end())
        if key is None or value is None:
            continue
        begin = m.end(1) - len(key)
        begin -= begin > at and text[begin - 1] in "\"'"
        end = value.end() + (text[value.end() : value.end() + 1] in ("'", '"'))
        out += [text[at:begin], text[begin:end].replace(value[1], masked_value(value[1]), 1)]
        at = spot = end
    return "".join([*out, text[at:]])


KEYS, VALUE = frozenset(V.SENSITIVE_KEYS), re.compile(V.VALUE)


def masked_value(v: str) -> str:
    if re.match(r"1[3-9]\d{9}$", v):
        return f"{v[:3]}****{v[-4:]}"
    a, b = (0, 0) if len(v) <= 4 else (1, 1) if len(v) <= 8 else (3, 4) if len(v) <= 16 else (4, 4)
    return f"{v[:a]}****{v[len(v) - b :]}"


def mask_sensitive(text: Column) -> Column:
    """Key-value pairs first, then the formats. Only texts with a pair go through Python, as what a value becomes depends on its length; those under 10 characters stay."""

    @F.pandas_udf("string")
    def pairs(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask_pairs(t))

    masked = F.coalesce(pairs(F.when(text.rlike(r"[A-Za-z_][\"']?\s*[:=]"), text)), text)
    return F.when(F.char_length(text) < 10, text).otherwise(mask_formats(masked))


def parse_timestamp(c: Column) -> Column:
    """Seconds since 1970 of a number or of one of six forms, UTC where none is said; 0.0 for anything else."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])
    return F.coalesce(F.unix_micros(parsed) / 1e6, c.try_cast("double"), F.lit(0.0))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of size characters, each starting size - overlap after the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.char_length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def shorten(text: Column, most: int = 8000, head: int = 3500, tail: int = 2000) -> Column:
    """Head and tail of longer texts, with how many characters were left out between."""
    omitted = (F.char_length(text) - head - tail).cast("string")
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n\n... ("), omitted, F.lit(" chars omitted) ...\n\n"), F.right(text, F.lit(tail)))).otherwise(text)


def cut_with_mark(text: Column, most: int = 32_000) -> Column:
    """The first characters of longer texts, and a mark that there were more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)
