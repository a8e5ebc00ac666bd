"""Scalar functions over text and paths, as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def tokens(text: Column) -> Column:
    """Words and numbers, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(fixed.TOKEN), F.lit(0)), F.lower)


def occurrences(text: Column, literal: str) -> Column:
    """How often ``literal`` occurs, without overlap, case-sensitively."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def needles(query: str) -> list[str]:
    """What find_line looks for: the query, then its words of over three letters, longest first."""
    return [query.strip().lower(), *sorted((w for w in query.lower().split() if len(w) > 3), key=lambda w: -len(w))]


def find_line(text: Column, needle: str) -> Column:
    """struct(line_no, line): the first line that holds the needle, or else its longest word of over three letters; null if none does."""
    low = F.lower(text)
    return _line_at(text, F.coalesce(*(F.when(p > 0, p) for p in (F.locate(w, low) for w in needles(needle)))))


def find_first_line(text: Column, needles: Column) -> Column:
    """As find_line, with an array of what to look for in each row."""
    places = F.transform(needles, lambda w: F.position(w, F.lower(text)))
    return _line_at(text, F.get(F.filter(places, lambda p: p > 0), F.lit(0)))


def _line_at(text: Column, at: Column) -> Column:
    number = F.length(F.substring(text, F.lit(1), at - 1)) - F.length(F.replace(F.substring(text, F.lit(1), at - 1), F.lit("\n"), F.lit(""))) + 1
    line = F.substring(F.get(F.split(text, "\n"), number - 1), 1, 400)
    return F.when(at.isNotNull(), F.struct(number.cast("int").alias("line_no"), line.alias("line")))


def snippet(text: Column) -> Column:
    return F.replace(F.substring(text, 1, 300), F.lit("\n"), F.lit(" ⏎ "))


def human_bytes(n: Column) -> Column:
    """1023 B, 1.5 KB, 12 MB: one decimal below ten, none for bytes."""
    unit = F.when(n >= 1 << 30, F.lit("GB")).when(n >= 1 << 20, F.lit("MB")).when(n >= 1 << 10, F.lit("KB")).otherwise("B")
    v = F.when(n >= 1 << 30, n / (1 << 30)).when(n >= 1 << 20, n / (1 << 20)).when(n >= 1 << 10, n / (1 << 10)).otherwise(n.cast("double"))
    return F.when((v < 10) & (unit != "B"), F.format_string("%.1f %s", F.bround(v, 1), unit)).otherwise(F.format_string("%.0f %s", F.bround(v, 0), unit))


def human_time(s: Column) -> Column:
    """12s, 5m, 4h 12m."""
    s = s.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))


def redact(value: Column, keep: int = 4) -> Column:
    return F.when(F.length(value) <= keep, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.substring(value, 1, keep), F.repeat(F.lit("*"), F.least(F.lit(28), F.length(value) - keep))))


def find_secrets(text: Column, limit: int = 20) -> Column:
    """array(struct(kind, found)) in order of kind, then place."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), _tagged(kind)) for kind, rx in fixed.SECRETS.items()]
    none = F.array().cast("array<struct<kind:string,found:string>>")
    return F.when(text.rlike(_SECRET_PART), F.slice(F.flatten(F.array(*each)), 1, limit)).otherwise(F.when(text.isNotNull(), none))


#: Every secret holds one of these; texts without one are not searched kind by kind.
_SECRET_PART = "(?i)PRIVATE KEY-----|sk-|AKIA|gh[pousr]_|xox[baprs]-|AIza|hf_|eyJ|API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIAL|://"


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found"))


def suffix_label(path: Column, table: dict[str, tuple[str, ...]], default: str | None) -> Column:
    """The first label of ``table`` one of whose suffixes ends the path, in lower case."""
    low, out = F.lower(path), None
    for label, exts in table.items():
        rx = "(" + "|".join(e.replace(".", "\\.") for e in exts) + ")$"
        out = F.when(low.rlike(rx), label) if out is None else out.when(low.rlike(rx), label)
    return out.otherwise(F.lit(default))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """Language label by extension, or else by name; ``text`` by default."""
    name = F.lower(base_name(path))
    named = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, suffix_label(path, fixed.LANGUAGE_EXTS, None))  # a leading dot begins no extension
    by_name = F.when(name == "dockerfile", "docker").when(name == "makefile", "make").when(name == "cmakelists.txt", "cmake").when(name.startswith(".env"), "env")
    return F.coalesce(named, by_name, F.lit("text"))


def embed_kind(path: Column) -> Column:
    return suffix_label(path, fixed.KIND_EXTS, "other")


def prose_in_code(text: Column) -> Column:
    """Block comments, full-line comments and trailing comments of at least 13 characters, joined by newlines."""
    found = [F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in (r"(?s)/\*(.*?)\*/", r"(?m)^[ \t]*(?://|#)(.{13,})$", r"(?m);[ \t]*//(.{13,})$")]
    clean = F.transform(F.flatten(F.array(*found)), lambda c: F.trim(F.regexp_replace(c, r"(?m)^[ \t]*[*/#]+[ \t]?", "")))
    return F.array_join(F.filter(clean, lambda c: c != ""), "\n")


def embed_target(path: Column, text: Column) -> Column:
    """Text worth embedding: none of structural files and logs, the comments of code (if at least 40 characters), else all."""
    kind, prose = embed_kind(path), prose_in_code(text)
    return F.when(kind.isin("structural", "log"), "").when(kind == "code", F.when(F.length(prose) >= 40, prose).otherwise("")).otherwise(text)


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk, in one walk: every step looks at one window only."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = min(at + size, n)
        last = text.rfind("\n", at, stop) if stop - at == size else -1
        end = last if last - at > size // 2 else stop
        out.append((at, end))
        at = n if end == n else max(end - overlap, at + 1)
    return out


def chunks(text: Column, size: int = 1400, overlap: int = 200) -> Column:
    """array(struct(off, chunk)): windows of ``size`` characters that end at a newline past their middle if there is one; null for a null text.

    In Arrow batches, in time proportional to the text.
    """

    @F.arrow_udf("array<struct<off:int,chunk:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        ends, offs, parts = [0], [], []
        for t in texts.to_pylist():
            for a, b in cuts(t or "", size, overlap):
                offs.append(a)
                parts.append(t[a:b])
            ends.append(len(offs))
        pieces = pa.StructArray.from_arrays([pa.array(offs, pa.int32()), pa.array(parts, pa.string())], ["off", "chunk"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces, mask=texts.is_null())

    return cut(text)


def token_chunks(ids: Column, size: int = 435, stride: int = 375) -> Column:
    """array(struct(off, ids)): windows of ``size`` ids, one every ``stride``, over the ids that any tokenizer gave; short texts are whole."""
    starts = F.when(F.size(ids) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(ids) - 1 - (size - stride), F.lit(stride)))
    return F.when(F.size(ids) > 0, F.transform(starts, lambda a: F.struct(a.alias("off"), F.slice(ids, a + 1, F.lit(size)).alias("ids")))).otherwise(F.array().cast("array<struct<off:int,ids:array<bigint>>>"))


def split_identifiers(text: Column) -> Column:
    """camelCase, snake_case and dotted names of at least six characters as words; shorter names stay as they are."""
    name = "[A-Za-z_][A-Za-z0-9_.]*"
    apart = lambda w: F.regexp_replace(F.regexp_replace(w, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_.]+", " ")
    words = F.transform(F.regexp_extract_all(text, F.lit(name), F.lit(0)), lambda w: F.when(F.length(w) >= 6, apart(w)).otherwise(w))
    between = F.split(text, name, -1)  # one part more than there are names
    return F.array_join(F.zip_with(between, words, lambda a, w: F.concat(a, F.coalesce(w, F.lit("")))), "")


def content_words(text: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)).cast("array<string>"))


def fingerprint(mtime: Column, text: Column) -> Column:
    return F.concat(F.format_string("%.3f", mtime), F.lit(":"), F.length(text))
