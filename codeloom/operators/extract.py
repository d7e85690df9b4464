"""Source files to chunks: definitions with their lines, documentation, calls, parameters, imports and routes.

Python files go through the language's own parser; other languages through a scanner of
declarations and balanced brackets, for which no grammar is needed.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files that are not indexed.
IGNORED = r"(?:^|/)(?:\.[^/]+|node_modules|dist|build|out|target|vendor|coverage|__pycache__)/|\.bundle\.|\.min\."
MAX_BYTES = 500_000
#: Language of each extension.
LANGUAGES = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "java": "java", "rs": "rust",
    "c": "c", "h": "c", "cs": "csharp", "rb": "ruby", "php": "php", "css": "css", "sh": "bash", "bash": "bash", "swift": "swift", "kt": "kotlin", "cpp": "cpp", "hpp": "cpp",
}

_CHUNK = pa.schema([
    ("id", pa.string()), ("file_path", pa.string()), ("node_type", pa.string()), ("name", pa.string()), ("docstring", pa.string()), ("code_snippet", pa.string()), ("content_hash", pa.string()),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("calls", pa.list_(pa.string())), ("params", pa.list_(pa.string())), ("return_type", pa.string()), ("class_context", pa.string()),
    ("decorators", pa.list_(pa.string())), ("extends", pa.list_(pa.string())),
    ("call_sites", pa.list_(pa.struct([(f, pa.string()) for f in ("name", "recv", "recv_type", "recv_via_call", "recv_resolved_type")]))),
])
CHUNK_DDL = "id string, file_path string, node_type string, name string, docstring string, code_snippet string, content_hash string, start_line int, end_line int, calls array<string>, params array<string>, return_type string, class_context string, decorators array<string>, extends array<string>, call_sites array<struct<name:string,recv:string,recv_type:string,recv_via_call:string,recv_resolved_type:string>>"

_DECLARATION = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|static|final|abstract|async|pub|unsafe|inline|extern|override|open|internal)\s+)*"
    r"(?:(?P<kind>class|interface|struct|enum|trait|impl|function|func|fn|def|module|object|record)\b\s*\*?\s*(?:\([^()]*\)\s*)?(?P<name>[\w$]+)"
    r"|(?:const|let|var)\s+(?P<bound>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>)"
    r"|(?P<typed>[A-Za-z_][\w<>\[\], .*&:?]*?[\s*&]+(?P<tname>[A-Za-z_]\w*))\s*(?=\([^;{}]*\)\s*(?:throws [\w., ]+)?\{))", re.M
)
_STOP = frozenset("if for while switch catch return else new do try function await typeof super this require import print".split())
_CALL = re.compile(r"(?<![\w$.])(?:([\w$]+)\s*\.\s*)?([A-Za-z_$][\w$]*)\s*\(")
_IMPORT = {
    "javascript": (r"import\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"export\s+[^'\";]*?\s+from\s+['\"]([^'\"]+)['\"]"),
    "python": (r"^\s*from\s+([.\w]+)\s+import\b", r"^\s*import\s+([\w.]+)"), "go": (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$",), "java": (r"^\s*import\s+(?:static\s+)?([\w.]+)",),
    "rust": (r"^\s*use\s+((?:crate|self|super)[\w:]*)", r"^\s*mod\s+(\w+)\s*;"), "c": (r"^\s*#include\s+\"([^\"]+)\"",), "bash": (r"^\s*(?:source|\.)\s+(\S+)",), "ruby": (r"require(?:_relative)?\s+['\"]([^'\"]+)['\"]",),
    "csharp": (r"^\s*using\s+([\w.]+)\s*;",), "php": (r"^\s*use\s+([\w\\]+)",), "css": (r"@import\s+(?:url\()?['\"]([^'\"]+)['\"]",), "swift": (r"^\s*import\s+(\w+)",), "kotlin": (r"^\s*import\s+([\w.]+)",),
}
_ROUTES = (
    ("express", re.compile(r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)['\"`]\s*,(?:[^,()]*,)*\s*([\w.$]+)\s*\)")),
    ("flask", re.compile(r"@(?:app|router|bp|blueprint)\.(get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(\w+)")),
    ("nestjs", re.compile(r"@(Get|Post|Put|Patch|Delete)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?(\w+)\s*\(")),
    ("spring", re.compile(r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@[^\n]*\n\s*)*(?:public|private|protected)?[\w<>\[\], ?]*?\s(\w+)\s*\(")),
)


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def chunk_id(path: str, row: int, column: int) -> str:
    return hashlib.sha256(f"{path}::{row}::{column}".encode()).hexdigest()[:24]


def call_sites(code: str) -> list[tuple[str, str]]:
    """Distinct (name, receiver) of the calls in a text; short and control words are noise."""
    found = dict.fromkeys((m.group(2), m.group(1) or "") for m in _CALL.finditer(code) if len(m.group(2)) > 2 and m.group(2) not in _STOP)
    return list(found)


_NEW = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?::\s*[\w.<>\[\]]+\s*)?(?::=|=)\s*(?:await\s+)?(?:new\s+|&)?([A-Z]\w*)\s*[({]")
_TYPED_NAME = re.compile(r"\b([a-z_$][\w$]*)\s*:\s*([A-Z]\w*)\b|\b([A-Z]\w*)(?:<[^<>]*>)?\s+([a-z_]\w*)\s*[=;,)]")
_FROM_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?::=|=)\s*(?:await\s+)?(?:[\w$]+\.)*([a-z_$][\w$]*)\s*\(")


def local_types(code: str) -> tuple[dict[str, str], dict[str, str]]:
    """Types of local names by construction or annotation, and the calls others come from; names bound differently are dropped."""
    bound: dict[str, set[str]] = {}
    for m in _NEW.finditer(code):
        bound.setdefault(m.group(1), set()).add(m.group(2))
    for m in _TYPED_NAME.finditer(code):
        bound.setdefault(m.group(1) or m.group(4), set()).add(m.group(2) or m.group(3))
    via: dict[str, set[str]] = {}
    for m in _FROM_CALL.finditer(code):
        if m.group(2) not in _STOP:
            via.setdefault(m.group(1), set()).add(m.group(2))
    one = lambda d: {k: next(iter(v)) for k, v in d.items() if len(v) == 1}
    types = one(bound)
    return types, {k: v for k, v in one(via).items() if k not in bound}


def typed_call_sites(code: str) -> list[dict[str, str | None]]:
    """Call sites with the type of their receiver, or the call that it comes from, where that is clear."""
    types, via = local_types(code)
    return [{"name": n, "recv": "this" if r == "self" else r, "recv_type": types.get(r), "recv_via_call": via.get(r), "recv_resolved_type": None} for n, r in call_sites(code)]


def _row(path: str, lines: list[str], kind: str, name: str | None, doc: str, start: int, end: int, column: int, cls: str, params: list[str], returns: str, decorators: list[str], bases: list[str]) -> tuple:
    code = "\n".join(lines[start:end])
    names = list(dict.fromkeys(n for n, _ in call_sites(code) if n != name))
    return (
        chunk_id(path, start, column), path, kind, name or f"{path.rsplit('/', 1)[-1].split('.')[0]}_{kind}", doc, code, hashlib.sha256((doc + code).encode()).hexdigest(),
        start + 1, end, names, params, returns, cls, decorators, bases, typed_call_sites(code),
    )


def _python_chunks(path: str, source: str) -> Iterator[tuple]:
    lines, tree = source.split("\n"), ast.parse(source)

    def visit(node: ast.AST, cls: str) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
                decorators = [ast.unparse(d).split("(")[0] for d in n.decorator_list]
                doc = ast.get_docstring(n) or ""
                if isinstance(n, ast.ClassDef):
                    yield _row(path, lines, "class_definition", n.name, doc, start, n.end_lineno or start + 1, n.col_offset, cls, [], "", decorators, [ast.unparse(b) for b in n.bases])
                    yield from visit(n, n.name)
                else:
                    a = n.args
                    params = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs) if len(p.arg) > 1 and p.arg != "self"]
                    yield _row(path, lines, "function_definition", n.name, doc, start, n.end_lineno or start + 1, n.col_offset, cls, params, ast.unparse(n.returns) if n.returns else "", decorators, [])
                    yield from visit(n, cls)

    yield from visit(tree, "")


def _block_end(source: str, at: int) -> int:
    """Position after the braces that open next, or the end of the statement."""
    depth = 0
    for m in re.compile(r"[{};]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", re.S).finditer(source, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == ";" and depth == 0:
            return m.end()
    return len(source)


def _scanned_chunks(path: str, source: str) -> Iterator[tuple]:
    lines = source.split("\n")
    classes: list[tuple[int, str]] = []
    for m in _DECLARATION.finditer(source):
        name = m.group("name") or m.group("bound") or m.group("tname")
        if not name or name in _STOP or (m.group("typed") or "").split()[:1] in (["return"], ["else"], ["new"], ["throw"]):
            continue
        kind = f"{m.group('kind') or 'function'}_declaration"
        indent = len(m.group()) - len(m.group().lstrip())
        end = _block_end(source, m.end())
        first, last = source.count("\n", 0, m.start() + indent), source.count("\n", 0, end) + 1
        if last - first < 3:
            continue
        classes = [c for c in classes if c[0] > m.start()]
        cls = classes[-1][1] if classes else ""
        if m.group("kind") in ("class", "interface", "struct", "trait", "impl", "object", "record"):
            classes.append((end, name))
        above, doc = first, []
        while above and re.match(r"\s*(?://|/?\*|#)", lines[above - 1]):
            above -= 1
            doc.insert(0, re.sub(r"^\s*(?:///?|/\*\*?|\*/|\*|#+)\s?|\s*\*/\s*$", "", lines[above]))
        open_at = source.find("(", m.end() - 1)
        inside = source[open_at + 1 : source.find(")", open_at)] if 0 <= open_at < end and m.group("kind") not in ("class", "interface") else ""
        params = [p for p in dict.fromkeys(re.findall(r"[A-Za-z_$][\w$]*", inside)) if len(p) > 1]
        bases = re.findall(r"(?:extends|implements|:)\s*([A-Z][\w.]*)", source[m.end() : source.find("{", m.end())] if m.group("kind") == "class" else "")
        yield _row(path, lines, kind, name, "\n".join(d for d in doc if d).strip(), first, last, indent, cls, params, "", [], bases)


def chunks_of(path: str, source: str) -> list[tuple]:
    """Rows of CHUNK_DDL of one file; a file that its parser refuses is scanned instead."""
    language = language_of(path)
    if not language or not source.strip():
        return []
    if language == "python":
        try:
            return list(_python_chunks(path, source))
        except (SyntaxError, ValueError, RecursionError):
            pass
    return list(_scanned_chunks(path, source))


def extract_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (file_path, content); unknown languages, ignored paths, blank and oversized files give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, source in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()) for r in (*chunks_of(path, source), *_re_export_rows(path, source))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_CHUNK), _CHUNK)], schema=_CHUNK)

    return indexable(files).select("file_path", "content").mapInArrow(run, CHUNK_DDL)


def _re_export_rows(path: str, source: str) -> Iterator[tuple]:
    for id, name, doc, code, first, last in re_exports(path, source):
        yield id, path, "re_export", name, doc, code, hashlib.sha256((doc + code).encode()).hexdigest(), first, last, [], [], "", "", [], [], []


def indexable(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_path").isNotNull() & F.col("content").isNotNull() & ~F.col("file_path").rlike(IGNORED) & (F.length("content") <= MAX_BYTES) & (F.trim("content") != ""))


def extract_imports(files: DataFrame) -> DataFrame:
    """file_path, raw: what each file imports, as written, in the JVM."""
    ext = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    found = None
    for language, patterns in _IMPORT.items():
        names = [e for e, lang in LANGUAGES.items() if lang == language or (language == "javascript" and lang == "typescript") or (language == "c" and lang == "cpp")]
        all_of = F.concat(*(F.regexp_extract_all("content", F.lit(f"(?m){p}"), 1) for p in patterns))
        found = F.when(ext.isin(*names), all_of) if found is None else found.when(ext.isin(*names), all_of)
    return indexable(files).select("file_path", F.explode(F.array_distinct(found)).alias("raw"))


_RE_EXPORT = re.compile(r"^from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n]+)", re.M)
_ALIAS = re.compile(r"([\w.]+)\s+as\s+(\w+)")


def re_exports(path: str, source: str) -> list[tuple[str, str, str, str, int, int]]:
    """id, name, docstring, code, first and last line of the names a Python file imports in order to export them (``import X as X``)."""
    out = []
    for m in _RE_EXPORT.finditer(source) if path.endswith(".py") else ():
        row = source.count("\n", 0, m.start())
        for a in _ALIAS.finditer(source, m.start(2), m.end()):
            if a.group(1).split(".")[-1] == a.group(2):
                column = a.start() - (source.rfind("\n", 0, a.start()) + 1)
                out.append((chunk_id(path, row, column), a.group(2), f"Public re-export of {a.group(2)} from {m.group(1)}.", m.group()[:300], row + 1, row + 1 + m.group().count("\n")))
    return out


_BARREL = re.compile(r"export\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['\"](\.[^'\"]*)['\"]")


def barrel_exports(files: DataFrame) -> DataFrame:
    """file_path, name, raw of the names that script files hand on from others (``*`` for all of them); raw as written, for resolve_imports."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()):
                if language_of(path) in ("javascript", "typescript"):
                    for m in _BARREL.finditer(source):
                        names = ["*"] if m.group(1)[0] == "*" else [re.split(r"\s+as\s+", n.strip())[-1] for n in m.group(1)[1:-1].split(",") if n.strip()]
                        rows += [(path, name.removeprefix("type "), m.group(2)) for name in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], ["file_path", "name", "raw"])

    return indexable(files).select("file_path", "content").mapInArrow(run, "file_path string, name string, raw string")


_RETURN = re.compile(r"\breturn\s+(?:await\s+)?(new\s+)?&?((?:[\w$]+\.)*)([A-Za-z_$][\w$]*)\s*([({])")
_ANY_RETURN = re.compile(r"\breturn\b[^\n;]*")


def return_via(code: str) -> tuple[str | None, str | None]:
    """The type that a function returns an instance of, or the function whose result it returns; neither unless all clear returns agree."""
    types, calls = set(), set()
    for m in _ANY_RETURN.finditer(code):
        if found := _RETURN.match(m.group()):
            new, owner, name, bracket = found.groups()
            if new or (name[0].isupper() and not owner):
                types.add(name)
            elif bracket == "(" and not owner and name not in _STOP:
                calls.add(name)
    if len(types) == 1 and not calls:
        return next(iter(types)), None
    return (None, next(iter(calls))) if len(calls) == 1 and not types else (None, None)


#: What is tried, in this order, for an import that is a path.
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".java", ".rs", ".c", ".h", ".rb", ".php", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, dep: imports that name a file of the repository; of several candidates the first that exists.

    Relative paths are taken from the importing file, dotted names and others from the root.
    """
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    dotted = F.when(F.col("raw").rlike(r"^\.+[A-Za-z_]*$|^[A-Za-z_][\w.]*$") & F.col("file_path").endswith(".py"), True).otherwise(False)
    level = F.length(F.regexp_extract("raw", r"^(\.*)", 1))
    module = F.regexp_replace(F.regexp_replace("raw", r"^\.+", ""), r"\.", "/")
    path = F.when(dotted & (level > 0), F.concat(folder, F.repeat(F.lit("../"), level - 1), module)).when(dotted, module).when(F.col("raw").startswith("."), F.concat(folder, "raw")).when(F.col("file_path").endswith(".java"), F.regexp_replace("raw", r"\.", "/")).otherwise(F.regexp_replace("raw", "^crate::|::", "/"))
    clean = F.regexp_replace(path, r"(?<=^|/)\./", "")
    for _ in range(6):
        clean = F.regexp_replace(clean, r"(?<=^|/)(?!\.\./)[^/]+/\.\./", "")
    clean = F.regexp_replace(F.regexp_replace(clean, "/{2,}", "/"), "^/", "")
    options = F.array(*(F.struct(F.lit(i).alias("o"), F.concat(F.col("p"), F.lit(x)).alias("dep")) for i, x in enumerate(PROBES)), F.struct(F.lit(99).alias("o"), F.regexp_replace("p", r"\.js$", ".ts").alias("dep")))
    tried = imports.withColumn("p", clean).select("file_path", "raw", F.explode(options).alias("c")).select("file_path", "raw", "c.o", "c.dep")
    hits = tried.join(files.select(F.col("file_path").alias("dep")).distinct(), "dep")
    best = hits.groupBy("file_path", "raw").agg(F.min(F.struct("o", "dep")).alias("b"))
    return best.select(F.col("file_path").alias("file"), F.col("b.dep").alias("dep")).where("file <> dep").distinct()


def routes_of(path: str, source: str) -> list[tuple[str, str, str, str, int, str]]:
    """method, path, handler, file, line, framework of the HTTP routes that a file declares."""
    prefix = m.group(1) if (m := re.search(r"@(?:Controller|RequestMapping)\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"]", source)) else ""
    out = []
    for framework, pattern in _ROUTES:
        for m in pattern.finditer(source):
            method = "ANY" if m.group(1) in ("all", "route") else m.group(1).upper()
            base = prefix if framework in ("nestjs", "spring") else ""
            whole = re.sub(r"/{2,}", "/", f"/{base}/{m.group(2) or ''}")
            out.append((method, whole.rstrip("/") or "/", m.group(3).split(".")[-1], path, source.count("\n", 0, m.start()) + 1, framework))
    return out


def extract_routes(files: DataFrame) -> DataFrame:
    """method, path, handler_name, file_path, line, framework."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, source in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()) for r in routes_of(path, source)]
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], ["method", "path", "handler_name", "file_path", "line", "framework"])

    return indexable(files).select("file_path", "content").mapInArrow(run, "method string, path string, handler_name string, file_path string, line int, framework string")


def link_handlers(routes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Routes with the first chunk of the handler's name in their file."""
    first = chunks.groupBy("file_path", F.col("name").alias("handler_name")).agg(F.min(F.struct("start_line", "id")).alias("h"))
    return routes.join(first, ["file_path", "handler_name"], "left").withColumn("handler_chunk_id", F.col("h.id")).drop("h")
