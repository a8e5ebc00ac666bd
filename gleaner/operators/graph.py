"""Code graph: definitions and calls of source files, and the joins over them.

One pass over a file gives its definitions and its calls as rows of one table,
so that files are read and parsed once. An edge belongs to the definition that
encloses it: the last one at or above its line with no unindented line that
defines nothing in between. A definition's own name is no call.

What defines a name is read from each language's grammar: a line is split into
words and marks, modifiers before the keyword are skipped, and the keyword says
what the name behind it is. Java, where a method has no keyword, is a type, a
name and an open bracket on a line that ends in an open brace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import fixed
from gleaner.functions import text as X

ROW = "doc_id long, path string, is_call boolean, id long, name string, kind string, line int, sig string"
#: Definitions and calls that a task gives at a time; a file's are not divided.
ROWS = 5000
_PIECE = re.compile(r"[A-Za-z_$][\w$]*|\d\w*|[^\s\w]")
_STRINGS = re.compile(r"/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*", re.S)
_PYTHON_STRINGS = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_HASH = re.compile(r"#[^\n]*")

FUNCTION, CLASS = "function", "class"
#: By language: words that may stand before a definition's keyword, and the keywords with what they define.
GRAMMAR: dict[str, tuple[set[str], dict[str, str]]] = {
    "python": ({"async"}, {"def": FUNCTION, "class": CLASS}),
    "php": ({"public", "private", "protected", "static", "final", "abstract", "readonly"}, {"function": FUNCTION, "class": CLASS, "interface": CLASS, "trait": CLASS, "enum": CLASS}),
    "js": ({"export", "default", "async", "abstract", "declare"}, {"function": FUNCTION, "class": CLASS, "interface": CLASS, "const": "value", "let": "value", "var": "value"}),
    "java": ({"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "sealed"}, {"class": CLASS, "interface": CLASS, "enum": CLASS, "record": CLASS}),
    "go": (set(), {"func": FUNCTION, "type": "type"}),
    "rust": ({"pub", "async", "const", "unsafe", "extern"}, {"fn": FUNCTION, "struct": CLASS, "enum": CLASS, "trait": CLASS}),
}


def _past(words: list[str], at: int, opened: str, closed: str) -> int:
    """Place behind a bracketed run that begins at ``at``; ``at`` itself if none does."""
    if words[at : at + 1] != [opened]:
        return at
    depth = 0
    for i in range(at, len(words)):
        depth += (words[i] == opened) - (words[i] == closed)
        if depth == 0:
            return i + 1
    return len(words)


def _is_name(word: str) -> bool:
    return word[:1].isalpha() or word[:1] in "_$"


def definition(line: str, lang: str) -> tuple[str, str] | None:
    """(name, function or class) that a line of code without comments and strings defines."""
    before, keywords = GRAMMAR[lang]
    words = _PIECE.findall(line)
    fold = str.lower if lang == "php" else str
    at = 0
    while at < len(words) and fold(words[at]) in before and fold(words[at]) not in keywords:
        at += 1
        if lang == "rust":
            at = _past(words, at, "(", ")")  # pub(crate)
    kind = keywords.get(fold(words[at])) if at < len(words) else None
    if kind is None:
        return _method(words, at) if lang == "java" else None
    at += 1
    if lang == "go" and kind == FUNCTION:
        at = _past(words, at, "(", ")")  # the receiver
    if words[at : at + 1] == ["*"]:
        at += 1  # a generator
    if lang == "php" and words[at : at + 1] == ["&"]:
        at += 1
    name = words[at] if at < len(words) and _is_name(words[at]) else None
    if name is None:
        return None
    rest = words[at + 1 :]
    if kind == "type":
        rest = rest[_past(rest, 0, "[", "]") :]
        return (name, CLASS) if rest[:1] in (["struct"], ["interface"]) else None
    if kind == "value":  # const f = (a) => .. or = function ..
        if rest[:1] != ["="]:
            return None
        rest = rest[1:]
        rest = rest[1:] if rest[:1] == ["async"] else rest
        return (name, FUNCTION) if rest[:1] in (["function"], ["("]) else None
    if kind == FUNCTION and lang != "rust":
        rest = rest[_past(rest, 0, "<", ">") :]
        rest = rest[_past(rest, 0, "[", "]") :]
        return (name, FUNCTION) if rest[:1] == ["("] else None
    if kind == CLASS and lang == "python":
        return (name, CLASS) if rest[:1] in (["("], [":"], ["["]) else None
    return name, kind


def _method(words: list[str], at: int) -> tuple[str, str] | None:
    """A Java method that opens its body on this line: a type before its name, brackets behind it."""
    at = _past(words, at, "<", ">")
    bracket = next((i for i in range(at, len(words)) if words[i] == "("), None)
    if bracket is None or bracket - at < 2 or words[-1] != "{" or ";" in words or not _is_name(words[bracket - 1]):
        return None
    kinds = words[at : bracket - 1]
    if not all(_is_name(w) or w in "<>[],.?&@" for w in kinds) or not (_is_name(kinds[-1]) or kinds[-1] in (">", "]")) or kinds[0] in ("new", "return", "else", "throw"):
        return None
    return words[bracket - 1], FUNCTION


def plain(code: str, lang: str) -> str:
    """Code without comments and the insides of strings, line by line as before."""

    def cover(m: re.Match) -> str:
        s = m.group()
        inner = "\n" * s.count("\n")
        return inner or " " if s[0] == "/" else s[0] + inner + s[0]

    code = (_PYTHON_STRINGS if lang == "python" else _STRINGS).sub(cover, code)
    return _HASH.sub("", code) if lang in ("php", "python") else code


_CALL, _WORDS = re.compile(fixed.CALL), frozenset(fixed.KEYWORDS)


def parse(code: str, lang: str) -> tuple[list[tuple[str, str, int, str]], list[tuple[int | None, str, int]]]:
    """Symbols (name, kind, line, signature) and calls (number of the enclosing symbol or None, name, line)."""
    symbols: list[tuple[str, str, int, str]] = []
    calls: list[tuple[int | None, str, int]] = []
    raw = code.split("\n")
    inside: int | None = None
    for n, line in enumerate(plain(code, lang).split("\n"), 1):
        found = definition(line, lang)
        if found and found[0] in _WORDS:
            found = None
        if found:
            symbols.append((*found, n, raw[n - 1].strip()[:200]))
            inside = len(symbols) - 1
        elif line[:1].strip() and line[0] not in "})]":
            inside = None
        skip = found[0] if found else None
        for m in _CALL.finditer(line):
            if m.group(1) == skip:
                skip = None  # the definition itself
            elif m.group(1) not in _WORDS:
                calls.append((inside, m.group(1), n))
    return symbols, calls


def symbol_id(path: str, line: int, name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{line}\0{name}") >> 1


def extract(docs: DataFrame) -> DataFrame:
    """Definitions and calls (``is_call``; id: of the definition, or of the one that encloses the call) of every source file, parsed once."""
    lang = X.suffix_label(F.col("path"), fixed.GRAPH_EXTS, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
        def given(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                doc, path, text, code = (batch.column(c)[at].as_py() for c in ("doc_id", "path", "text", "code"))
                symbols, calls = parse(text, code)
                ids = [symbol_id(path, line, name) for name, _, line, _ in symbols]
                rows += [(doc, path, False, i, *s) for i, s in zip(ids, symbols, strict=True)]
                rows += [(doc, path, True, None if i is None else ids[i], name, None, line, None) for i, name, line in calls]
                if len(rows) >= ROWS:  # what is held does not grow with the files of a batch
                    yield given(rows)
                    rows = []
            yield given(rows)

    return docs.select(F.col("doc_id").cast("long"), "path", "text", lang.alias("code")).where("code is not null and text is not null and path is not null").mapInArrow(run, ROW)


def symbols_of(rows: DataFrame) -> DataFrame:
    """id, doc_id, path, name, kind, line, sig from the rows of ``extract``."""
    return rows.where("not is_call").select("id", "doc_id", "path", "name", "kind", "line", "sig")


def edges_of(rows: DataFrame) -> DataFrame:
    """Calls from the rows of ``extract``: src (null at file scope), src_path, dst_name, line."""
    return rows.where("is_call").select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.col("name").alias("dst_name"), "line")


def symbols(docs: DataFrame) -> DataFrame:
    return symbols_of(extract(docs))


def edges(docs: DataFrame) -> DataFrame:
    return edges_of(extract(docs))


def replace_files(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``extract`` with those of the files in ``docs`` taken anew."""
    return remove_paths(rows, docs.select("path")).unionByName(extract(docs))


def remove_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("path").distinct(), "path", "left_anti").select(rows.columns)


def find(symbol: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Definitions of exactly that name."""
    return symbol.where(F.col("name") == name).orderBy("path", "line").limit(limit)


def callers(edge: DataFrame, symbol: DataFrame, name: str, limit: int = 40) -> DataFrame:
    """Who calls ``name``: path, line, caller (null at file scope)."""
    hit = edge.where(F.col("dst_name") == name).alias("e").join(symbol.alias("s"), F.col("e.src") == F.col("s.id"), "left")
    return hit.select(F.col("e.src_path").alias("path"), "e.line", F.col("s.name").alias("caller")).orderBy("line", "path", "caller").limit(limit)


def callees(edge: DataFrame, symbol: DataFrame, name: str, limit: int = 40) -> DataFrame:
    hit = symbol.where(F.col("name") == name).alias("s").join(edge.alias("e"), F.col("e.src") == F.col("s.id"))
    return hit.select(F.col("e.src_path").alias("path"), "e.line", F.col("e.dst_name").alias("callee")).orderBy("line", "path", "callee").limit(limit)


def resolution(edge: DataFrame, symbol: DataFrame) -> DataFrame:
    """Counts of symbols, edges and files, and the share of edges whose name is defined somewhere."""
    known = symbol.select(F.col("name").alias("dst_name")).distinct()
    e = edge.agg(F.count("*").alias("edges"))
    r = edge.join(known, "dst_name", "left_semi").agg(F.count("*").alias("resolved"))
    s = symbol.agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files"))
    one = lambda df: df.withColumn("one", F.lit(1))
    out = one(s).join(one(e), "one").join(one(r), "one").drop("one")
    return out.withColumn("resolved_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("resolved"), F.col("edges")), F.lit(0.0)), 1))


def ambiguous(symbol: DataFrame, most: int = fixed.MAX_DEFINITIONS) -> DataFrame:
    """Names defined in more than ``most`` files: too general to seed a search."""
    return symbol.groupBy("name").agg(F.countDistinct("path").alias("files")).where(F.col("files") > most)


def names_in(query: str) -> list[str]:
    """The identifiers that a query asks about."""
    return [w for w in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", query)) if len(w) > 1 and w not in fixed.KEYWORDS]


def graph_search(edge: DataFrame, symbol: DataFrame, query: str, limit: int = 25, most: int = fixed.MAX_DEFINITIONS) -> DataFrame:
    """Definitions of the query's identifiers, then calls of any of them: path, line, name, relation, via.

    Names defined in more than ``most`` files are left out of the definitions (``ambiguous``
    says which), but their calls count; names that are defined nowhere here have calls too.
    ``via`` is the definition that encloses a call. Each (path, line) comes once.
    """
    names = names_in(query)
    good = symbol.where(F.col("name").isin(names)).join(ambiguous(symbol.where(F.col("name").isin(names)), most), "name", "left_anti")
    defs = good.select("path", "line", "name", F.lit("definition").alias("relation"), F.lit(None).cast("string").alias("via"))
    calls = edge.where(F.col("dst_name").isin(names)).alias("e").join(symbol.select(F.col("id").alias("src"), F.col("name").alias("via")).alias("s"), F.col("e.src") == F.col("s.src"), "left")
    uses = calls.select(F.col("e.src_path").alias("path"), "e.line", F.col("e.dst_name").alias("name"), F.lit("caller").alias("relation"), "via")
    first = Window.partitionBy("path", "line").orderBy(F.desc("relation"), "name")
    return defs.unionByName(uses).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy(F.desc("relation"), "path", "line").limit(limit)
