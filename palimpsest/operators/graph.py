"""The code graph: nodes, references, stack traces and symbol extraction."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def query_nodes(nodes: DataFrame, node_type: str | None = None, name_like: str | None = None, file_path: str | None = None, limit: int = 100) -> DataFrame:
    """Nodes by type, name (LIKE, ignoring case) and file, in order of file and line; at most 500."""
    out = nodes
    if node_type:
        out = out.where(F.col("node_type") == node_type)
    if name_like:
        out = out.where(F.col("name").ilike(name_like.replace("\\", "\\\\")))
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    return out.orderBy("file_path", "start_line", "node_id").limit(max(1, min(limit, 500)))


def definitions(nodes: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Nodes named like a symbol or containing it, exact ones first."""
    s = symbol.replace("\\", "\\\\")
    return nodes.where((F.col("name") == symbol) | F.col("name").ilike(f"%{s}%")).orderBy((F.col("name") != symbol).cast("int"), "name", "node_id").limit(limit)


def references(targets: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """(target_id, source_id, name, file_path): at most `limit` distinct nodes that point to each target."""
    rows = targets.select(F.col("node_id").alias("target_id")).join(edges, "target_id").select("target_id", "source_id")
    rows = rows.join(nodes.select(F.col("node_id").alias("source_id"), "name", "file_path"), "source_id").distinct()
    w = Window.partitionBy("target_id").orderBy("source_id", "file_path")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r").select("target_id", "source_id", "name", "file_path")


def neighbours(edges: DataFrame, nodes: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(node_id, direction, peer_id, edge_type, peer_name): edges out of and into each node; unknown peers have no name."""
    ids = node_ids.select("node_id").distinct()
    outgoing = edges.select(F.col("source_id").alias("node_id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("peer_id"), "edge_type")
    incoming = edges.select(F.col("target_id").alias("node_id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("peer_id"), "edge_type")
    rows = outgoing.unionByName(incoming).join(ids, "node_id")
    return rows.join(nodes.select(F.col("node_id").alias("peer_id"), F.col("name").alias("peer_name")), "peer_id", "left").select("node_id", "direction", "peer_id", "edge_type", "peer_name")


# What frames look like in three kinds of traces.
PYTHON_FRAME = r'File "([^"]+)", line (\d+)'
SCRIPT_FRAME = r"at (?:[^(\n]*\()?([^:)\n]+):(\d+):(\d+)"


def frames(df: DataFrame, key: str, trace: str) -> DataFrame:
    """(key, pos, file, line, language): every frame, Python's first, then scripts', then Rust's and Go's.

    Frames of node_modules and internal/ are dropped among scripts; a Rust or Go frame counts as both.
    """
    t = F.col(trace)
    pair = lambda pattern: F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("file"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("line"))
    tag = lambda a, name: F.transform(a, lambda x: F.struct(x["file"].alias("file"), x["line"].cast("int").alias("line"), F.lit(name).alias("language")))
    script = pair(SCRIPT_FRAME)
    own = F.filter(script, lambda x: ~x["file"].contains("node_modules") & ~x["file"].startswith("internal/"))
    native = F.filter(script, lambda x: x["file"].rlike(r"\.(rs|go)$"))
    every = F.concat(tag(pair(PYTHON_FRAME), "python"), tag(own, "javascript"), tag(native, "rust_or_go"))
    return df.where(t.isNotNull()).select(key, F.posexplode(every).alias("pos", "f")).select(key, "pos", "f.file", "f.line", "f.language")


def frame_context(found: DataFrame, spans: DataFrame, key: list[str], around: int = 5) -> DataFrame:
    """Frames with the first chunk (by internal_id) of their file whose lines overlap; frames without one stay.

    `spans`: file, start_line, end_line, chunk_id, internal_id. An equal join on file with the range as a residual; the first is
    taken by a partial aggregate.
    """
    s = spans.withColumnRenamed("file", "span_file")
    near = (F.col("file") == F.col("span_file")) & (F.coalesce("start_line", F.lit(0)) <= F.col("line") + around) & (F.coalesce("end_line", F.lit(999_999)) >= F.col("line") - around)
    rows = found.join(s, near, "left")
    return rows.groupBy(*key, "file", "line", "language").agg(F.min_by("chunk_id", F.struct("internal_id", "chunk_id")).alias("chunk_id"))


def inject_rules(chunks: DataFrame, rules: list[tuple[str, str, int]], path: str, text: str) -> DataFrame:
    """The text with a line per matching rule before it, higher priorities first.

    `rules` are (pattern, text, priority), a small list held by the driver; patterns become expressions once.
    """
    from ..functions.glob import rule_regex

    head = F.lit("")
    for pattern, said, _ in sorted(rules, key=lambda r: (-r[2], r[0])):
        head = F.concat(head, F.when(F.col(path).rlike(rule_regex(pattern)), f"[Repo Constraint]: {said}\n").otherwise(""))
    return chunks.withColumn(text, F.when(F.col(path).isNull() | (head == ""), F.col(text)).otherwise(F.concat(head, F.lit("\n"), F.col(text))))


def apply_rules(chunks: DataFrame, rules: DataFrame, path: str, text: str) -> DataFrame:
    """As `inject_rules` for a bounded list of chunks and a table of rules (rule_id, file_pattern, rule_text, priority) of any size.

    The chunks, a page of answers, go to the rules. Chunks without a path, and without a rule, stay as they are.
    """
    from ..functions.glob import rule_regex

    import pandas as pd

    def regexes(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else rule_regex(p))

    regexes.__annotations__ = {"patterns": pd.Series, "return": pd.Series}
    ship(chunks.sparkSession)
    one = chunks.select(F.col(path).alias("__path")).where("__path is not null").distinct()
    known = rules.select("rule_id", "rule_text", "priority", F.pandas_udf(regexes, "string")("file_pattern").alias("__regex"))
    hit = known.join(F.broadcast(one), F.expr("__path rlike __regex")).groupBy("__path").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "rule_id", "rule_text"))).alias("__rules"))
    head = F.array_join(F.transform("__rules", lambda r: F.concat(F.lit("[Repo Constraint]: "), r["rule_text"], F.lit("\n"))), "")
    out = chunks.join(hit, F.col(path) == F.col("__path"), "left")
    return out.withColumn(text, F.when(F.col("__rules").isNull(), F.col(text)).otherwise(F.concat(head, F.lit("\n"), F.col(text)))).drop("__path", "__rules")


def symbol_files(queries: DataFrame, key: str, text: str, nodes: DataFrame, each: int = 50) -> DataFrame:
    """(key, file_path): files with a node whose name contains a symbol of the query, of each symbol the first `each` nodes by file and line.

    A query has at most 256 symbols; they go to the nodes, which are read once.
    """
    from ..functions.text import candidate_symbols

    syms = queries.select(F.col(key).alias("__key"), F.explode(F.slice(F.array_distinct(candidate_symbols(F.col(text))), 1, 256)).alias("__sym"))
    hit = nodes.join(F.broadcast(syms), F.lower("name").contains(F.lower("__sym")))
    w = Window.partitionBy("__key", "__sym").orderBy("file_path", "start_line", "node_id")
    rows = hit.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= each)
    return rows.select(F.col("__key").alias(key), "file_path").distinct()


def lifted(hits: DataFrame, files: DataFrame, boost: float = 0.03) -> DataFrame:
    """Hits (score: lower is better, file_path) with graph_match, and a score, higher is better, that chunks of `files` get `boost` on top of."""
    marked = files.select(F.col("file_path").alias("__f")).distinct().withColumn("__hit", F.lit(1))
    rows = hits.join(marked, F.col("file_path") == F.col("__f"), "left")
    return rows.withColumn("graph_match", F.col("__hit").isNotNull()).withColumn("score", F.round(-F.col("score") + boost * F.coalesce("__hit", F.lit(0)), 6)).drop("__f", "__hit")


def python_symbols(source: str | None) -> list[tuple[str, str, int, int]]:
    """(type, name, first line, last line) of functions and classes, breadth first; nothing where the source is no Python."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(kinds[type(n)], n.name, n.lineno, n.end_lineno or n.lineno) for n in ast.walk(tree) if type(n) in kinds]


_POLYGLOT = re.compile(
    r"^[ \t]*(?:(?:export|default|pub|public|private|protected|internal|static|final|abstract|async|inline|virtual|override|unsafe|extern)\s+)*"
    r"(?:(?P<cls>class|struct|interface|trait|enum|impl|record|type)\s+(?P<c>[A-Za-z_]\w*)"
    r"|(?:fn|func|function|def)\s+(?:\([^)]*\)\s*)?(?P<f>[A-Za-z_]\w*)\s*[(<]"
    r"|(?:[A-Za-z_][\w<>\[\],.:*&]*\s+)+[*&]?(?P<m>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:throws [\w, ]+)?\{)",
    re.M,
)
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof"}


#: Comments and literals, of which only the line breaks count; a quote of Rust may be a lifetime.
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_HIDDEN_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,8}?|[^'\\\n])'", re.S)
_C_FUNCTION = r"^[ \t]*(?:[A-Za-z_][\w:<>,&*\[\]]*[ \t*&]+)+(?P<f>~?[A-Za-z_][\w:]*)[ \t]*\([^;{}]*\)[^;{}()]*\{"
_METHOD = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*|\[[^\]\n]*\]\s*)*(?:[A-Za-z_][\w<>\[\],.?]*[ \t]+)+(?P<f>[A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}()=]*[{;]"
#: What declares a function or a class in a language, by extension; `register_language` adds to it.
LANGUAGES: dict[str, re.Pattern] = {}


def register_language(extensions: tuple[str, ...], function: str = "", cls: str = "") -> None:
    """Patterns with a group f or c for the name; either may be empty. They see sources without comments and literals."""
    pattern = re.compile("|".join(f"(?:{x})" for x in (function, cls) if x), re.M)
    LANGUAGES.update(dict.fromkeys(extensions, pattern))


register_language((".rs",), r"\bfn\s+(?P<f>\w+)", r"\b(?:struct|enum|trait)\s+(?P<c>\w+)|^[ \t]*(?:unsafe\s+)?impl(?:\s*<[^>{]*>)?\s+(?:[^{};]*?\bfor\s+)?(?P<i>\w+)")
register_language((".go",), r"^func\s+(?:\([^)]*\)\s*)?(?P<f>\w+)", r"^[ \t]*type\s+(?P<c>\w+)")
register_language((".c",), _C_FUNCTION, r"\bstruct\s+(?P<c>\w+)\s*\{")
register_language((".cpp",), _C_FUNCTION, r"\b(?:class|struct)\s+(?P<c>\w+)[^;{}()]*\{")
register_language((".h", ".hpp"), "", r"\b(?:class|struct)\s+(?P<c>\w+)[^;{}()]*\{")
register_language((".java", ".cs"), _METHOD, r"\b(?:class|interface|enum|record|struct)\s+(?P<c>\w+)")
register_language((".js", ".jsx"), r"\bfunction\s*\*?\s*(?P<f>\w+)\s*\(", r"\bclass\s+(?P<c>\w+)")
register_language((".ts", ".tsx"), r"\bfunction\s*\*?\s*(?P<f>\w+)\s*[(<]", r"\b(?:class|interface)\s+(?P<c>\w+)")


def polyglot_symbols(source: str | None, extension: str = "") -> list[tuple[str, str, int, int]]:
    """As `python_symbols` for brace languages, by the declarations of the extension's language or, where it is unknown, of any.

    Comments and literals declare nothing, and their braces don't count. The last line is where the braces close.
    """
    hidden = _HIDDEN_RUST if extension == ".rs" else _HIDDEN
    text = hidden.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source or "")
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    braces = [(m.start(), 1 if m.group() == "{" else -1) for m in re.finditer(r"[{}]", text)]
    places = [i for i, _ in braces]
    out = []
    for m in LANGUAGES.get(extension, _POLYGLOT).finditer(text):
        found = m.groupdict()
        cls = found.get("c") or found.get("i")
        name = cls or found.get("f") or found.get("m")
        if not name or name in _NO_NAMES or not cls and re.match(r"\s*(?:return|new|else|throw|await)\b", m.group()):
            continue
        at = m.start(next(g for g in ("c", "i", "f", "m") if found.get(g)))
        semicolon = text.find(";", m.end() - 1)
        depth, end = 0, m.end()
        for i in range(bisect.bisect_left(places, at), len(braces)):
            if depth == 0 and 0 <= semicolon < braces[i][0]:
                break  # declared, without a body
            depth += braces[i][1]
            if depth <= 0:
                end = braces[i][0]
                break
        else:
            end = len(text) if depth > 0 else end
        out.append(("class" if cls else "function", name, bisect.bisect_left(breaks, at) + 1, bisect.bisect_left(breaks, end) + 1))
    return out


def extract_symbols(df: DataFrame, path: str, text: str, key: list[str] | None = None, extractor=None) -> DataFrame:
    """(key, path, node_type, name, start_line, end_line); Python by its syntax tree, other languages by patterns."""
    ship(df.sparkSession)
    key = key or []
    cols = [*key, path, text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols[:-1]) + ", node_type string, name string, start_line int, end_line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (p, t) in enumerate(zip(b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist())):
                kind = "." + (p or "").rpartition(".")[2].lower()
                found = extractor(t) if extractor else python_symbols(t) if kind == ".py" else polyglot_symbols(t, kind)
                rows += [(i, *s) for s in found]
            c = list(zip(*rows)) if rows else [[]] * 5
            at = pa.array(c[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(at) for j in range(len(cols) - 1)], pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], [*cols[:-1], "node_type", "name", "start_line", "end_line"])

    return df.select(*cols).mapInArrow(run, schema)
