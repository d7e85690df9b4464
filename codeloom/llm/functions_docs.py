"""Functions and methods paired with their own descriptions, from island grammars per language.

Only documentation, annotations, signatures and balanced brackets are parsed; the rest of the
code is skipped. See :func:`documented_functions`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- islands ----------------------------------------------------------------------------------

_STRINGS = r"\"(?:\\.|[^\"\\\n\r])*\"|'(?:\\.|[^'\\\n\r])*'"
_C_COMMENTS = r"//[^\n\r]*|/\*.*?(?:\*/|\Z)"
_C_ISLAND = re.compile(rf"{_C_COMMENTS}|{_STRINGS}|`(?:\\.|[^`\\])*`", re.S)
_RUST_ISLAND = re.compile(rf"{_C_COMMENTS}|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n\r])'", re.S)  # a lone quote begins a lifetime
_HASH_ISLAND = re.compile(rf"{_C_COMMENTS}|#(?!\[)[^\n\r]*|{_STRINGS}", re.S)
_RUBY_ISLAND = re.compile(rf"#(?!\{{)[^\n\r]*|{_STRINGS}")
_PY_ISLAND = re.compile(
    r"#[^\n\r]*|\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n\r])*\"|'(?:\\.|[^'\\\n\r])*'"
    r"|(?<![\w.])(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\])?\(", re.S
)
_PY_DOCSTRING = re.compile(r"[^\S\n\r]*(?:#[^\n\r]*)?(?:\s*(?:#[^\n\r]*[\n\r])?)*?\s*[rRuU]?(\"\"\"(?P<a>(?:\\.|.)*?)\"\"\"|'''(?P<b>(?:\\.|.)*?)'''|\"(?P<c>(?:\\.|[^\"\\\n\r])*)\"(?!\")|'(?P<d>(?:\\.|[^'\\\n\r])*)'(?!'))\s*?(?:[\n\r;#]|\Z)", re.S)
_GAP = re.compile(r"[^\S\n\r]*(?:\r\n|\n|\r)?[^\S\n\r]*\Z")
_SPACE = re.compile(r"\s*")

_CONTROL = frozenset("if for while switch catch with do else return throw new await yield typeof delete case in of super function sizeof assert synchronized using lock defer go select elif except raise and or not".split())
_NOT_TYPED = frozenset("class interface enum struct union record typedef return throw new else if for while switch do case goto import package define namespace using delegate event".split())

_JS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*([\w$]+)?")
_JS_BOUND = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+([\w$]+)\s*(?::(?:[^=;{}]|=>)*?)?|(?:(?:public|private|protected|static|readonly)\s+)*([\w$#]+)\s*(?::(?:[^=;{}()]|=>)*?)?|(?:[\w$]+\.)+([\w$]+))\s*[=:](?![=>])\s*(?:async\s+)?"
    r"(?:(?P<function>function\b\s*\*?\s*[\w$]*)|(?P<bare>[\w$]+\s*=>)|(?P<arrow>(?=[<(])))"
)
_JS_DEFAULT_ARROW = re.compile(r"export\s+default\s+(?:async\s+)?(?=[<(])")
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?\s*(#?[\w$]+|\[[^\]\n]*\])")
_GO_FUNCTION = re.compile(r"func\s+(?:\([^()]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()")
_GO_BODY = re.compile(r"[^\S\n\r]*(?:\([^{}]*?\)|[^{}()\n\r;]*|[^{}\n\r;]*?)[^\S\n\r]*\{")
_RUST_FUNCTION = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)")
_PHP_FUNCTION = re.compile(r"(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*function\s+&?\s*(\w+)", re.I)
_KOTLIN_FUNCTION = re.compile(r"(?:(?:public|private|protected|internal|open|override|abstract|final|suspend|inline|operator|infix|tailrec|external|actual|expect)\s+)*fun\b\s*")
_KOTLIN_NAME = re.compile(r"(?:[\w?]+(?:<[^()]*?>)?\??\.)*(\w+|`[^`\n]+`)")
_SWIFT_FUNCTION = re.compile(r"(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|convenience|required|async|nonisolated)(?:\(\w+\))?\s+)*(?:func\s+([\w]+|[-+*/%<>=!&|^~]+)|(init)[?!]?(?=\s*[(<]))")
_RUBY_FUNCTION = re.compile(r"(?:(?:private|protected|public|module_function|private_class_method)\s+)?def\s+(?:(?:self|[A-Z]\w*)\.)?([\w]+[?!=]?|[-+*/%<>=!~\[\]]+)")

JS, GO, TYPED, PYTHON, RUST, PHP, KOTLIN, SWIFT, RUBY = "js", "go", "typed", "python", "rust", "php", "kotlin", "swift", "ruby"
#: The grammar for each file extension.
LANGUAGES = {
    "ts": JS, "tsx": JS, "js": JS, "jsx": JS, "mjs": JS, "cjs": JS, "mts": JS, "cts": JS, "go": GO, "java": TYPED, "c": TYPED, "h": TYPED, "cc": TYPED, "cpp": TYPED, "cxx": TYPED, "hpp": TYPED, "hh": TYPED, "cs": TYPED,
    "py": PYTHON, "pyi": PYTHON, "rs": RUST, "php": PHP, "kt": KOTLIN, "kts": KOTLIN, "swift": SWIFT, "rb": RUBY,
}
_ISLANDS = {RUST: _RUST_ISLAND, PHP: _HASH_ISLAND, RUBY: _RUBY_ISLAND}

_BRACKETS = {
    "c": re.compile(rf"[()\[\]{{}}]|{_STRINGS}|`(?:\\.|[^`\\])*`|//[^\n\r]*|/\*.*?\*/", re.S),
    RUST: re.compile(r"[()\[\]{}]|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n\r])'|//[^\n\r]*|/\*.*?\*/", re.S),
    PYTHON: re.compile(rf"[()\[\]{{}}]|\"\"\".*?\"\"\"|'''.*?'''|{_STRINGS}|#[^\n\r]*", re.S),
}
_RUST_STRINGS = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n\r])'"
_ANGLES = {k: re.compile(rf"[<>(){{}};]|=>|->|{strings}", re.S) for k, strings in (("c", _STRINGS), (RUST, _RUST_STRINGS))}
_TYPE_PART = {k: re.compile(rf"[()\[\]{{}}<>;\n\r]|=>|->|{strings}|[^\s()\[\]{{}}<>;=\"-]+|[=-]", re.S) for k, strings in (("c", _STRINGS), (RUST, _RUST_STRINGS))}
_ANNOTATION = re.compile(r"\s*(?:@(?!interface\b)[\w.:]+|(?=#?!?\[))")


def _balanced(code: str, at: int, language: str = "c") -> int:
    """Position after the bracket that closes the one at ``at``; -1 if it stays open or is closed by another kind."""
    opening = code[at]
    closing = {"(": ")", "[": "]", "{": "}"}[opening]
    depth = 0
    for m in _BRACKETS.get(language, _BRACKETS["c"]).finditer(code, at):
        c = m.group()
        if c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def _angles(code: str, at: int, language: str = "c") -> int:
    """Position after the ``>`` that closes the ``<`` at ``at``; arrows don't close, brackets are skipped; -1 if it stays open."""
    depth = 0
    while m := _ANGLES.get(language, _ANGLES["c"]).search(code, at):
        c = m.group()
        at = m.end()
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if depth == 0:
                return at
        elif c in "({":
            if (at := _balanced(code, m.start(), language)) < 0:
                return -1
        elif c in ")};":
            return -1
    return -1


def _skip_annotations(code: str, at: int, brackets: bool = False) -> int:
    """Position after annotations: @name(...), and, with ``brackets``, [...] or #[...]."""
    while m := _ANNOTATION.match(code, at):
        end = m.end()
        if code[m.start() : end].strip():
            at = end
            if code[at : at + 1] == "(" and (at := _balanced(code, at)) < 0:
                return len(code)
            continue
        opening = code.find("[", end)
        if not brackets or (at := _balanced(code, opening)) < 0:
            at = end
            break
    return _SPACE.match(code, at).end()


def _parameters(code: str, at: int, language: str = "c") -> int:
    """Position after a list of parameters, type parameters first; -1 if there is none."""
    at = _SPACE.match(code, at).end()
    if code[at : at + 1] == "<":
        if (at := _angles(code, at, language)) < 0:
            return -1
        at = _SPACE.match(code, at).end()
    return _balanced(code, at, language) if code[at : at + 1] == "(" else -1


def _type_end(code: str, at: int, stops: tuple[str, ...], language: str = "c") -> tuple[str, int]:
    """What ends the type (or clause) at ``at``, one of ``stops`` outside brackets, and the position after it; '' if something else does."""
    filled, needed = False, True
    while m := _TYPE_PART.get(language, _TYPE_PART["c"]).search(code, at):
        c, start = m.group(), m.start()
        at = m.end()
        if c in stops and not (c == "{" and needed and "where" not in stops) and not (c == "=>" and not filled):
            return c, at
        if c in ";" or c in ")]}":
            return "", at
        if c in "\n\r":
            if "\n" in stops and filled:
                return "\n", at
            continue
        if c == "<":
            if (at := _angles(code, start, language)) < 0:
                return "", len(code)
        elif c in "([{":
            if (at := _balanced(code, start, language)) < 0:
                return "", len(code)
        filled, needed = True, c in ("|", "&", "=>", "->", ":", ",", "=", "extends", "keyof", "typeof", "is")
    return "", len(code)


def _js_body(code: str, at: int, arrow: bool) -> int:
    """Position after what opens the body behind a list of parameters; -1 if none follows."""
    at = _SPACE.match(code, at).end()
    opening = "=>" if arrow else "{"
    if code.startswith(opening, at):
        return at + len(opening)
    if code[at : at + 1] != ":":
        return -1
    found, end = _type_end(code, at + 1, (opening,))
    return end if found else -1


def _js_signature(code: str, at: int) -> tuple[str | None, int] | None:
    for pattern in (_JS_FUNCTION, _JS_BOUND, _JS_DEFAULT_ARROW, _JS_METHOD):
        if not (m := pattern.match(code, at)):
            continue
        name = next((g for g in m.groups()[:3] if g), None) if pattern is not _JS_DEFAULT_ARROW else None
        if pattern is _JS_BOUND and m.group("bare"):
            return name, m.end()
        if pattern is _JS_METHOD and name in _CONTROL:
            return None
        arrow = pattern is _JS_DEFAULT_ARROW or (pattern is _JS_BOUND and m.group("arrow") is not None)
        end = _parameters(code, m.end())
        if end > 0 and (body := _js_body(code, end, arrow)) > 0:
            return name, body
        if end > 0 and not arrow and name and pattern is not _JS_BOUND and (found := _overload(code, end, name)):
            return found
        if pattern is _JS_FUNCTION:
            return None
    return None


def _overload(code: str, at: int, name: str) -> tuple[str | None, int] | None:
    """The function of the same name whose signature follows one without a body."""
    at = _SPACE.match(code, at).end()
    if code[at : at + 1] == ":":
        found, at = _type_end(code, at + 1, (";", "\n"))
    elif code[at : at + 1] == ";":
        found, at = ";", at + 1
    else:
        return None
    if not found:
        return None
    following = _js_signature(code, _SPACE.match(code, at).end())
    return following if following and following[0] == name else None


_TYPED_TOKEN = re.compile(r"\s*(operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w[\w\s*&]*?)(?=\s*\()|~?[A-Za-z_]\w*|::|\.\.\.|[.*&?,^]|\[[\s,]*\]|<)")
_TYPED_SUFFIX = re.compile(r"\s*(?:(?:const|noexcept|override|final|mutable|volatile|unchecked|try)\b|&&?|throws\s+[\w.,\s<>?@]+?(?=\s*\{)|__attribute__(?=\s*\(\())")
_INITIALISER = re.compile(r"\s*(?:[:,])\s*[A-Za-z_][\w:]*\s*(?:<[^(){};]*>\s*)?(?=[({])")


def _typed_signature(code: str, at: int) -> tuple[str | None, int] | None:
    """Java, C, C++, C#: types and modifiers, a name, which may be qualified, parameters, what may stand behind them, and a body."""
    words: list[str] = []
    last = ""
    for _ in range(60):
        if not (m := _TYPED_TOKEN.match(code, at)):
            break
        token, at = m.group(1), m.end()
        if token == "<":
            if (at := _angles(code, m.end() - 1)) < 0:
                return None
        elif token[0].isalpha() or token[0] in "_~":
            if token in _NOT_TYPED:
                return None
            if token == "template":
                opening = _SPACE.match(code, at).end()
                if code[opening : opening + 1] != "<" or (at := _angles(code, opening)) < 0:
                    return None
                if (constraint := re.compile(r"\s*requires\b").match(code, at)):
                    at = constraint.end()
                continue
            words.append(token)
            last = token
    start = _SPACE.match(code, at).end()
    if not words or code[start : start + 1] != "(" or last in _CONTROL or not re.match(r"[\w>)\]~=+\-*/%<!&|^ ]", code[start - 1]):
        return None
    if (at := _balanced(code, start)) < 0:
        return None
    while m := _TYPED_SUFFIX.match(code, at):
        at = m.end()
        opening = _SPACE.match(code, at).end()
        if m.group().strip() in ("noexcept", "__attribute__") and code[opening : opening + 1] == "(" and (at := _balanced(code, opening)) < 0:
            return None
    at = _SPACE.match(code, at).end()
    if code.startswith("->", at) or code.startswith("where", at):
        found, at = _type_end(code, at + 2, ("{", "=>", "where") if code.startswith("where", at) else ("{",))
        return (last, at) if found in ("{", "=>") else None
    while m := _INITIALISER.match(code, at):
        opening = m.end()
        if (at := _balanced(code, opening)) < 0:
            return None
    at = _SPACE.match(code, at).end()
    if code.startswith("=>", at):
        return last, at + 2
    return (last, at + 1) if code[at : at + 1] == "{" else None


def signature(code: str, at: int, language: str) -> tuple[str | None, int] | None:
    """Name (null if it has none) and end of the signature of a function with a body that starts at ``at``, annotations first."""
    at = _skip_annotations(code, at, language in (TYPED, RUST, PHP))
    if language == PYTHON:
        m = _PY_ISLAND.match(code, at)
        return (m.group(1), m.end()) if m and m.group(1) else None
    if language == JS:
        return _js_signature(code, at)
    if language == TYPED:
        return _typed_signature(code, at)
    if language == GO:
        if m := _GO_FUNCTION.match(code, at):
            end = _balanced(code, m.end())
            body = _GO_BODY.match(code, end) if end > 0 else None
            return (m.group(1), body.end()) if body else None
        return None
    if language == RUBY:
        m = _RUBY_FUNCTION.match(code, at)
        return (m.group(1), m.end()) if m else None
    if language == KOTLIN:
        if not (m := _KOTLIN_FUNCTION.match(code, at)):
            return None
        at = m.end()
        if code[at : at + 1] == "<":
            if (at := _angles(code, at)) < 0:
                return None
            at = _SPACE.match(code, at).end()
        if not (m := _KOTLIN_NAME.match(code, at)) or (end := _parameters(code, m.end())) < 0:
            return None
        at = _SPACE.match(code, end).end()
        if code[at : at + 1] in ("{", "="):
            return m.group(1), at + 1
        found, at = _type_end(code, at + 1, ("{", "=", "\n")) if code[at : at + 1] == ":" else ("", at)
        return (m.group(1), at) if found in ("{", "=") else None
    m = {RUST: _RUST_FUNCTION, PHP: _PHP_FUNCTION, SWIFT: _SWIFT_FUNCTION}[language].match(code, at)
    if not m or (end := _parameters(code, m.end(), language)) < 0:
        return None
    found, at = _type_end(code, end, ("{", "where"), language)
    if found == "where":
        found, at = _type_end(code, at, ("{", "where"), language)
    return (next(g for g in m.groups() if g), at) if found == "{" else None


def _body_end(code: str, start: int, end: int, language: str) -> int:
    """End of the function whose signature is code[start:end]."""
    if language in (PYTHON, RUBY):
        line = code.rfind("\n", 0, start) + 1
        indent = start - line if code[line:start].isspace() or line == start else 0
        if language == RUBY:
            m = re.compile(r"\n[^\S\n\r]{0,%d}end\b" % indent).search(code, end)
            first = code.find("\n", end)
            one = re.compile(r"[;\s]end\b").search(code, end, first if first > 0 else len(code))
            return one.end() if one else m.end() if m else len(code)
        m = re.compile(r"\n(?=[^\S\n\r]{0,%d}[^\s#)\]}])" % indent).search(code, end)
        return m.start() if m else len(code)
    if code[end - 1] == "{":
        found = _balanced(code, end - 1, language)
        return found if found > 0 else len(code)
    at = _SPACE.match(code, end).end()
    if code[at : at + 1] == "{":
        found = _balanced(code, at, language)
        return found if found > 0 else len(code)
    stop = re.compile(r";|\n\s*\n|\Z").search(code, end)
    return stop.end()


def functions(code: str, language: str) -> Iterator[tuple[str | None, int, int, list[str]]]:
    """Name, start, end of signature and raw comments of each function that has comments right before it or a docstring."""
    if language == PYTHON:
        yield from _python_functions(code)
        return
    marks = ("#",) if language == RUBY else ("//", "/*", "#") if language == PHP else ("//", "/*")
    if not any(m in code for m in marks):
        return
    group: list[str] = []
    end = 0
    for m in _ISLANDS.get(language, _C_ISLAND).finditer(code):
        text = m.group()
        comment = text.startswith(marks)
        if group and not (comment and _GAP.match(code[end : m.start()]) and _own_line(code, m.start())):
            if found := _after(code, end, language):
                yield *found, group
            group = []
        if comment and (group or _own_line(code, m.start())):
            group, end = [*group, text], m.end()
    if group and (found := _after(code, end, language)):
        yield *found, group


def _own_line(code: str, at: int) -> bool:
    line = max(code.rfind("\n", 0, at), code.rfind("\r", 0, at)) + 1
    return line == at or code[line:at].isspace()


def _after(code: str, end: int, language: str) -> tuple[str | None, int, int] | None:
    """The function that starts right after ``end``, without a blank line between."""
    start = _SPACE.match(code, end).end()
    if len(re.findall(r"\r\n|\n|\r", code[end:start])) > 1:
        return None
    found = signature(code, start, language)
    return (found[0], start, found[1]) if found else None


def _python_functions(code: str) -> Iterator[tuple[str | None, int, int, list[str]]]:
    if "def" not in code:
        return
    comments: list[str] = []
    end = after = 0
    for m in _PY_ISLAND.finditer(code):
        if m.group(1):
            start = m.start()
            between = code[end:start]
            above = comments if comments and re.fullmatch(r"[^\S\n\r]*(?:\r\n|\n|\r)(?:[^\S\n\r]*@[^\n\r]*(?:\r\n|\n|\r))*[^\S\n\r]*", between) else []
            if start < after:
                continue  # within the parameters of a function
            after = max(after, _balanced(code, m.end() - 1, PYTHON))
            colon = _python_colon(code, after) if after > start else -1
            if colon > 0:
                found = list(above)
                if (doc := _PY_DOCSTRING.match(code, colon)) and _docstring_follows(code, colon, doc.start(1)):
                    found.append(doc.group(1))
                if found:
                    yield m.group(1), start, colon, found
            comments = []
        elif m.group().startswith("#") and _own_line(code, m.start()):
            comments = [*comments, m.group()] if comments and _GAP.match(code[end : m.start()]) else [m.group()]
            end = m.end()
        elif comments and "@" not in code[end : m.start()]:
            comments = []


def _python_colon(code: str, at: int) -> int:
    """Position after the colon that ends a signature, whatever colons its annotation holds; -1 if the line ends first."""
    stop = re.compile(rf"[:\n\r(\[{{]|{_STRINGS}")
    while m := stop.search(code, at):
        c = m.group()
        if c == ":":
            return m.end()
        if c in "\n\r":
            return -1
        at = _balanced(code, m.start(), PYTHON) if c in "([{" else m.end()
        if at < 0:
            return -1
    return -1


def _docstring_follows(code: str, colon: int, at: int) -> bool:
    return all(not line.strip() or line.strip().startswith("#") or line.strip() in ("r", "u", "R", "U") for line in code[colon:at].splitlines())


# -- descriptions -------------------------------------------------------------------------------

_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\w)|///?/?!?|#+[:!]?|--+(?=\s))\s?|\s*\*+/\s*$")
_QUOTES = re.compile(r"^(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$")


def clean(raw: str) -> list[str]:
    """Lines of a comment or docstring without comment marks."""
    if raw[:1] in "\"'":
        return [line.strip() for line in _QUOTES.sub("", raw).splitlines()]
    lines = []
    for line in raw.splitlines():
        line = _MARK.sub("", line)
        lines.append(_MARK.sub("", line).strip() if line.lstrip().startswith("*") else line.strip())
    return lines


_RULE = re.compile(r"^[\W_]*$")
_SECTION = re.compile(r"^(?:#?\s*(?:end)?region\b.*|[-=~*#>_+.·─━═]{2,}\s*\w+(?:\s+\w+){0,3}\s*[-=~*#<_+.·─━═]*|(?:MARK|pragma mark)\b.*)$", re.I)
_TOOL = re.compile(
    r"^[@#:]?\s*(?:eslint\b|eslint-|noqa\b|prettier-|ts-(?:ignore|nocheck|expect-error|check)|nolint|istanbul\b|c8 ignore|v8 ignore|clang-(?:format|tidy)|pylint\b|type:\s*ignore|mypy\b|flake8\b|pyright\b|ruff\b|isort\b|fmt:|yapf\b|black\b:|pragma\b"
    r"|nosec\b|nosonar\b|checkstyle\b|noinspection\b|suppresswarnings\b|formatter:|go:\w+|\+build\b|jshint\b|jslint\b|jscs\b|global\s+\w+|globals\b|tslint\b|biome-|deno-|rome-|codecov\b|coverage\b:|cspell\b|spell-checker\b|webpack\w*:|@?vite-ignore|lint\b|sourcery\b|doctest:|language=|vim?:|-\*-|cppcheck-|lcov_excl|gcov_excl|codeql|sonar\b|snyk\b|semgrep\b|detect-secrets|allowlist|skipcq|hadolint|shellcheck|stylelint|markdownlint|autopep8|line \d+ \")", re.I
)
_LICENCE = re.compile(
    r"spdx-|copyright|\(c\)\s|©\s*\d|all rights reserved|\blicen[cs]ed?\b.*\b(?:under|see|file|terms|upstream|mit|bsd|apache|gpl)|^@?licen[cs]e\b|released under the|permission to use|permission is hereby|provided that (?:this|the) (?:notice|above)|this notice is kept|without warranty|redistribut\w+ .*permitted|©.*\b(?:19|20)\d\d", re.I
)
_ORIGIN = re.compile(
    r"auto[\s_-]*generated|machine[\s-]*(?:made|generated)|\bgenerated (?:by|from|with|using|automatically)|^@generated\b|automatically (?:created|generated)|do not (?:edit|modify|change)|don't edit|changes will be lost|(?:imported|copied|vendored|taken) from (?:upstream|\S+ v?\d)"
    r"|(?:bundled|vendored) (?:copy|version) of|^@?[\w.-]+ (?:- )?(?:version |v)?\d+\.\d+(?:\.\d+)?\b.{0,60}$|自动生成|自動生成|automatisch (?:erzeugt|erstellt|generiert)|nicht (?:ändern|bearbeiten)|ne pas modifier|(?:produit|généré) (?:par|automatiquement)|generado (?:por|automáticamente)|no (?:editar|modificar)|não (?:editar|modificar)|сгенерирован", re.I
)
_DISABLED = re.compile(r"^(?:(?:export|default|async|public|private|protected|static|final)\s+)*(?:def|function|func|fn)\s+\w+\s*\(")
_DATE = re.compile(r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\.? \d{1,2},? \d{4}\b", re.I)
_POINTER = re.compile(r"^(?:\{?@(?:inherit\w*|link|see|ref|copydoc)\b.*|(?:see|cf\.?|siehe|voir|ver|véase|vea|refer to|as|same as|like|ditto)\s+(?:also\s+)?(?:the\s+)?(?:above|below|here|there|oben|unten|ci-dessus|ci-dessous|arriba|abajo|acima|previous|next|docs?|documentation|wiki|readme|spec|issue|ticket|super(?:class)?|base|parent|interface|https?:\S+|#\d+|[\w./#-]+)(?:\s+(?:for (?:details|more|info\w*)|above|below|one|class|file|section))?\.?|ditto\.?|见上|见下|参见.{0,8}|同上|上記参照|下記参照|см\. (?:выше|ниже))\.?$", re.I)
_TAG = re.compile(r"^(?:[@\\](\w+)|:(\w+)(?:\s+[^:]*)?:)\s*(.*)$")
_PARAM_LINE = re.compile(r"^(?:\{[^}]*\}\s*)?\[?[\w.$=]+\]?\s*[-–:]?\s*")
#: Tags that introduce prose, tags whose first word is a name, and tags that only label.
_PROSE = frozenset("description desc summary brief details remarks note deprecated".split())
_NAMED = frozenset("param params arg argument property prop template tparam throws throw exception raises typeparam".split())
_LABELS = frozenset("type types rtype vartype author authors since version date license licence copyright see link todo category group module class function func method name memberof override private public protected internal static readonly abstract api ignore hidden generated file fileoverview package ingroup defgroup inheritdoc copydoc export exports async".split())
_XML_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CODE = re.compile(
    r"^(?:[\w$.\[\]\"']+\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?(?:\.[\w$]+(?:\([^()]*\))?)*\s*(?:[-+*/%|&^]?=(?!=)|:=)\s*\S.*"
    r"|(?:await\s+|return\s+|yield\s+|throw\s+|raise\s+)?[\w$.]+\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\.[\w$]+\([^()]*\))*\s*;?"
    r"|return\b[^.]*;?|(?:(?:async|export|public|private|static|final|const|let|var|func|function|def|class|import|from|package|int|void|char|type|struct)\s+)+[\w$<>\[\]*.]+.*[;:({})=,].*|(?:const|let|var|import|from)\s.*"
    r"|(?:if|for|while|switch|elif|else if|catch|with|try|else|else:|try:)\b.*[{:;)]|[})\];,]+|(?:break|continue|pass|return)\s*;?|\w+\+\+;?|.*[;{]|.*\}\s*;?)$"
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")

#: Words that tell nothing about a function.
_EMPTY_WORDS = frozenset("""
a an the this that these those it its is are was be been being to of for in on at by with from as and or not no nor do does did done will would can could may might should shall must has have had
function func fn method methods helper helpers utility util utils routine procedure subroutine constructor ctor getter setter get set getters setters accessor mutator main handler handlers callback
class module member param params parameter parameters argument arguments arg args return returns returned value values object default implementation implements override overrides overridden stub generated auto
todo fixme xxx hack tbd tbc wip na n docs doc docstring documentation documented document description describe describes descriptive desc comment comments placeholder text lorem ipsum dolor sit amet fill me please add write here what later follow follows following missing
none nothing null undefined self explanatory obvious bla blah foo bar baz asdf test untitled unnamed temp temporary draft pending empty see above below used use uses using called call calls simple simply just basic internal private public protected static api deprecated
need needs needed update updated insert your some something stuff thing things more info information explain explained explanation summary coming soon work progress later moved created added edited changed modified removed date author since version
à compléter a completer completar por beschreibung folgt noch dokumentieren ausstehend à faire afaire documenter descripción descrição pendiente pendente descrizione completare da opis uzupełnić uzupełnienia do описание дополнить добавить позже todo
""".split())
#: Words used for one another in names.
_SAME = {w: group.split()[0] for group in (
    "get fetch retrieve obtain read load return", "set assign put", "remove delete drop erase", "create make build construct new generate", "update change modify", "save store write persist", "find search look lookup locate", "check validate verify", "send emit dispatch", "parse read", "convert transform turn", "compute calculate", "list enumerate", "init initialize initialise initializer", "open start", "close end stop", "handle process", "render draw display show", "format print",
) for w in group.split()}
_CJK_EMPTY = re.compile(r"^[\s\W]*(?:待补充|待完善|待定|暂无(?:说明|描述)?|说明|描述|补充|无|函数|方法|後で書く|説明|未記入|未定|追記予定|추후|작성|설명|없음|추가|예정)+[\s\W]*$")


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    for end in ("izations", "ization", "ations", "ation", "ings", "ing", "ies", "ed", "es", "er", "ers", "or", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: len(word) - len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word.rstrip("eyi") if len(word.rstrip("eyi")) >= 3 else word


def _words(text: str) -> list[str]:
    return [p.lower() for w in _WORD.findall(text) for p in (_CAMEL.findall(w) if w.isascii() else [w])]


def _name_words(name: str) -> set[str]:
    words = set(_words(name.replace("_", " ")))
    return {_stem(_SAME.get(w, w)) for w in words} | {_stem(w) for w in words} | {name.lower()}


def informative(line: str, name_words: set[str]) -> int:
    """Words of a line that tell something beyond the name."""
    if re.search(r"[぀-ヿ一-鿿가-힯]", line):
        return 0 if _CJK_EMPTY.match(line) else len(re.findall(r"[぀-ヿ一-鿿]", line)) // 2 + 2 * len(re.findall(r"[가-힯]+", line))
    left = 0
    for w in _words(line.replace("_", " ")):
        if w in _EMPTY_WORDS or w.isdigit() or len(w) == 1:
            continue
        s = _SAME.get(w) or _SAME.get(w.rstrip("s")) or w
        if _stem(w) in name_words or _stem(s) in name_words:
            continue
        left += 1
    return left


def telling_lines(raw: list[str], name: str) -> list[str]:
    """The lines of comments that tell more about the function than its name; none if they are trivial."""
    name_words = _name_words(name)
    out = []
    for comment in raw:
        for line in clean(comment):
            line = line.strip()
            if _RULE.match(line) or _SECTION.match(line) or _TOOL.match(line) or _LICENCE.search(line) or _ORIGIN.search(line) or _POINTER.match(line):
                continue
            if _DISABLED.match(line):
                out.clear()  # what came before describes a disabled function
                continue
            text = re.sub(r"^(?:todo|fixme|xxx|hack)\b(?:\([^)]*\))?[:\s-]*", "\0", line, flags=re.I)
            if text.startswith("\0"):
                continue  # a reminder
            if m := _TAG.match(line):
                tag, rest = (m.group(1) or m.group(2)).lower(), m.group(3)
                if tag in _LABELS:
                    continue
                text = rest if tag in _PROSE else _PARAM_LINE.sub("", rest, count=1) if tag in _NAMED and not m.group(2) else re.sub(r"^\{[^}]*\}\s*", "", rest)
            if _CODE.match(text):
                continue
            text = _DATE.sub(" ", _XML_TAG.sub(" ", text))
            least = 1 if out else 2
            if informative(text, name_words) >= least:
                out.append(line)
    return out


# -- operator -----------------------------------------------------------------------------------

_DDL = "chunk_id string, func_name string, docstring string, code_snippet string, start_char bigint"
_FUNCTION_NODES = frozenset("function_declaration function_definition method_declaration method_definition decorated_definition constructor_declaration function_item generator_function_declaration arrow_function function_expression".split())
_MAYBE_NODES = frozenset("lexical_declaration variable_declaration export_statement expression_statement".split())
_LEADING = re.compile(r"(?:\s*(?://[^\n\r]*|/\*.*?\*/|#[^\n\r]*))*\s*", re.S)


def chunk_pairs(chunk_id: str, file_path: str, node_type: str | None, name: str | None, docstring: str | None, code: str) -> Iterator[tuple[str, str | None, str, str, int]]:
    """Rows of _DDL of one chunk."""
    language = LANGUAGES.get(file_path.rsplit(".", 1)[-1].lower() if file_path else "")
    if not language or not code:
        return
    single: tuple[str | None, int, int] | None = None
    if docstring and docstring.strip() and not docstring.startswith("[File Context]") and (node_type in _FUNCTION_NODES or node_type in _MAYBE_NODES):
        start = _LEADING.match(code).end()
        if found := signature(code, start, language):
            single = (found[0], start, found[1])
    seen_single = False
    for func, start, end, raw in functions(code, language):
        own = list(raw)
        if single and end >= single[2] and not seen_single and _skip_annotations(code, start) == _skip_annotations(code, single[1]):
            seen_single = True
            own = [docstring, *own]
        label = func or name
        if label and (lines := telling_lines(own, label)):
            yield chunk_id, label, "\n".join(lines), code[start : _body_end(code, start, end, language)], start
    if single and not seen_single:
        label = single[0] or name
        if label and (lines := telling_lines([docstring], label)):
            yield chunk_id, label, "\n".join(lines), code[single[1] : _body_end(code, single[1], single[2], language)], single[1]


def documented_functions(chunks: DataFrame) -> DataFrame:
    """Pairs of code and description of all functions of current versions: _DDL.

    A function has a body and a description of its own: comments right before it (annotations may
    lie between), a Python docstring, or, for a chunk that is one function, the chunk's docstring
    unless it is inherited. Descriptions that tell nothing beyond the name are dropped. Rows
    repeated exactly give one pair. Null or empty code, unknown extensions and functions without
    any name give nothing; a null id stays null. No shuffle before the pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in chunk_pairs(*values)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                    ["chunk_id", "func_name", "docstring", "code_snippet", "start_char"],
                )

    current = chunks.where("removed_at is null and code_snippet is not null and file_path is not null")
    return current.select("id", "file_path", "node_type", "name", "docstring", "code_snippet").mapInArrow(run, _DDL).dropDuplicates(["chunk_id", "func_name", "start_char", "docstring"])
