"""Symbols and references from source text, by patterns.

A language is a table of declaration patterns over text whose strings and comments are blanked out with spaces, so
positions stay those of the file. Each call-like match outside declarations becomes a reference of the innermost
function around it, or of <top-level>. JavaScript and TypeScript also have property reads and writes.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

TOP = "<top-level>"
_ID = r"[A-Za-z_]\w*"
_JS = r"[A-Za-z_$][\w$]*"
#: No declaration is named so.
CONTROL = frozenset("if for while switch return else do catch match foreach elif until".split())
#: Names of each language that are no calls.
KEYWORDS = {
    "go": "if for range switch select go defer return func make new append len cap panic recover close delete copy print println complex real imag",
    "javascript": "if for while switch return new typeof instanceof await yield throw try catch finally delete void import export require",
    "typescript": "if for while switch return new typeof instanceof await yield throw try catch finally delete void import export require keyof",
    "python": "if for while with return yield raise assert print len range enumerate zip map filter list dict set tuple str int float bool type isinstance hasattr getattr setattr delattr open input super",
    "php": "if for foreach while switch return new echo print isset empty array unset include require include_once require_once die exit",
    "lua": "if then elseif else for while repeat until do end function local return break goto in and or not nil true false",
    "c": "if for while switch return sizeof typeof goto break continue malloc calloc realloc free printf fprintf sprintf scanf memcpy memset strlen strcmp strcpy strcat",
    "cpp": "if for while switch return new delete sizeof typeof typeid throw try catch static_cast dynamic_cast const_cast reinterpret_cast decltype noexcept",
    "zig": "if for while switch return break continue unreachable defer errdefer try catch orelse comptime inline assert expect expectEqual expectError",
    "rust": "if for while loop match return break continue panic assert assert_eq vec Box Rc Arc Some None Ok Err println print format",
    "java": "if else for while do switch case default break continue return throw try catch finally new instanceof this super assert synchronized println print printf valueOf toString equals hashCode length size get set add remove isEmpty contains containsKey containsValue put clear toArray",
    "csharp": "if else for foreach while do switch case default break continue return throw try catch finally new nameof typeof using get set init value await yield lock this base add remove toString equals getHashCode",
    "pascal": "if then else case of for to downto while do repeat until with goto try except finally raise on not and or xor in is as div mod shl shr nil true false self inherited result writeln write readln read inc dec length setlength high low sizeof assigned new dispose freemem getmem exit break continue halt ord chr pred succ copy delete insert pos trunc round abs sqr sqrt",
    "fsharp": "let in if then else elif match with for while do done try finally raise yield return fun function when as of mutable rec inline private public internal module namespace open type not true false null new and or begin end upcast downcast lazy assert base this use async task failwith failwithf sprintf printfn printf ignore string int float box unbox typeof nameof",
}


@dataclass(frozen=True)
class Language:
    name: str
    declarations: list[tuple[str, str]]  # kind and pattern with groups name and perhaps receiver
    comments: tuple[str, ...] = (r"//[^\n]*", r"/\*.*?\*/")
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`[^`]*`")
    body: str = "{"
    call: str = _ID
    compiled: list = field(default_factory=list)

    def patterns(self) -> list[tuple[str, re.Pattern]]:
        if not self.compiled:
            self.compiled.extend((k, re.compile(p, re.MULTILINE | re.ASCII)) for k, p in self.declarations)
        return self.compiled


def _n(ident: str = _ID) -> str:
    return f"(?P<name>{ident})"


_js = [
    ("function", rf"\bfunction\s*\*?\s*{_n(_JS)}\s*(?:<[^>]*>\s*)?\("),
    ("function", rf"\b(?:const|let|var)\s+{_n(_JS)}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_JS}\s*=>)"),
    ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b){_n(_JS)}\s*\([^)\n]*\)\s*(?::[^{{\n]+)?\{{"),
    ("class", rf"\bclass\s+{_n(_JS)}\b[^{{\n]*\{{"),
]
_ts = [*_js, ("interface", rf"\binterface\s+{_n(_JS)}\b[^{{]*\{{"), ("type", rf"^[ \t]*(?:export\s+)?type\s+{_n(_JS)}\s*(?:<[^>]*>)?\s*=")]
_mods = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|partial|synchronized|native|default|unsafe|extern|readonly|new)\s+)"
_jvm_method = rf"^[ \t]*{_mods}*(?!(?:return|new|else|throw|case|await)\b)(?:<[^>]+>\s+)?[\w.<>\[\],? ]*[\w>\]?]\s+{_n()}\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]"
_c_function = rf"^(?!(?:return|else|typedef|if|for|while|switch)\b)(?:[A-Za-z_][\w:<>,*& ]*[\s*&])(?:(?P<receiver>{_ID})::)?{_n('~?' + _ID)}\s*\([^;{{)]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"
LANGUAGES = {
    "go": Language("go", [("function", rf"^func\s+{_n()}\s*[\[(]"), ("method", rf"^func\s+\(\s*(?:{_ID}\s+)?\*?(?P<receiver>{_ID})(?:\[[^\]]*\])?\s*\)\s*{_n()}\s*\("), ("interface", rf"^type\s+{_n('[A-Z]' + chr(92) + 'w*')}\s+interface\s*\{{"), ("type", rf"^type\s+{_n('[A-Z]' + chr(92) + 'w*')}\s+(?!interface\b)[^=\s]")]),
    "javascript": Language("javascript", _js, call=_JS),
    "typescript": Language("typescript", _ts, call=_JS),
    "python": Language("python", [("function", rf"^(?:async\s+)?def\s+{_n()}\s*\("), ("method", rf"^[ \t]+(?:async\s+)?def\s+{_n()}\s*\("), ("class", rf"^[ \t]*class\s+{_n()}\s*[(:]")], (r"#[^\n]*",), (r'"""(?:.|\n)*?"""', r"'''(?:.|\n)*?'''", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"), "indent"),
    "java": Language("java", [("method", _jvm_method), ("class", rf"\b(?:class|record)\s+{_n()}"), ("interface", rf"\binterface\s+{_n()}"), ("type", rf"\benum\s+{_n()}")], body="eof"),
    "csharp": Language("csharp", [("method", _jvm_method), ("class", rf"\b(?:class|record)\s+{_n()}"), ("interface", rf"\binterface\s+{_n()}"), ("type", rf"\b(?:enum|struct)\s+{_n()}")], body="eof"),
    "rust": Language("rust", [("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"\w+\")?)\s+)*fn\s+{_n()}"), ("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_n()}"), ("interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_n()}"), ("type", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:enum|type)\s+{_n()}")], strings=(r'"(?:\\.|[^"\\])*"',)),
    "php": Language("php", [("function", rf"\bfunction\s+&?{_n()}\s*\("), ("class", rf"\b(?:class|trait)\s+{_n()}"), ("interface", rf"\binterface\s+{_n()}")], (r"//[^\n]*", r"#[^\n]*", r"/\*.*?\*/")),
    "c": Language("c", [("function", _c_function), ("class", rf"^(?:typedef\s+)?struct\s+{_n()}\s*\{{"), ("type", rf"^typedef\b[^;{{]*\b{_n()}\s*;|^enum\s+(?P<name2>{_ID})\s*\{{")]),
    "cpp": Language("cpp", [("function", _c_function), ("class", rf"^[ \t]*(?:class|struct)\s+{_n()}\b[^;]*\{{"), ("type", rf"^[ \t]*(?:using\s+{_n()}\s*=|enum(?:\s+class)?\s+(?P<name2>{_ID}))")]),
    "ruby": Language("ruby", [("method", rf"^[ \t]*def\s+(?:self\.)?{_n(_ID + '[?!]?')}"), ("class", rf"^[ \t]*(?:class|module)\s+{_n()}")], (r"#[^\n]*",), (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"), "indent"),
    "lua": Language("lua", [("function", rf"^[ \t]*(?:local\s+)?function\s+{_n()}\s*\("), ("method", rf"^[ \t]*function\s+(?P<receiver>{_ID})[.:]{_n()}\s*\("), ("function", rf"^[ \t]*(?:local\s+)?{_n()}\s*=\s*function\b")], (r"--\[(=*)\[.*?\]\1\]", r"--[^\n]*"), (r"\[\[.*?\]\]", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"), "indent"),
    "zig": Language("zig", [("function", rf"^[ \t]*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+{_n()}\s*\("), ("class", rf"^[ \t]*(?:pub\s+)?const\s+{_n()}\s*=\s*(?:extern\s+|packed\s+)?struct\b"), ("type", rf"^[ \t]*(?:pub\s+)?const\s+{_n()}\s*=\s*(?:enum|union|error)\b")], (r"//[^\n]*",), (r'"(?:\\.|[^"\\\n])*"',)),
    "fsharp": Language("fsharp", [("function", rf"^[ \t]*let\s+(?:rec\s+|inline\s+|private\s+)*{_n()}\s+(?!=)[^=\n]+="), ("method", rf"^[ \t]*(?:static\s+)?member\s+(?:\w+\.)?{_n()}"), ("type", rf"^[ \t]*type\s+{_n()}")], (r"//[^\n]*", r"\(\*.*?\*\)"), (r'"""(?:.|\n)*?"""', r'"(?:\\.|[^"\\\n])*"'), "indent"),
    "pascal": Language("pascal", [("function", rf"^[ \t]*(?:class\s+)?(?:function|procedure|constructor|destructor)\s+(?:(?P<receiver>{_ID})\.)?{_n()}"), ("class", rf"^[ \t]*{_n()}\s*=\s*class\b"), ("type", rf"^[ \t]*{_n()}\s*=\s*record\b")], (r"//[^\n]*", r"\{.*?\}", r"\(\*.*?\*\)"), (r"'[^'\n]*'",), "eof"),
}
EXTENSIONS = {"go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "typescript", "py": "python", "java": "java", "cs": "csharp", "rs": "rust", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "lua": "lua", "zig": "zig", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "pas": "pascal", "dpr": "pascal"}


def language_of(path: str) -> Language | None:
    return LANGUAGES.get(EXTENSIONS.get(path.rpartition(".")[2].lower(), ""))


def blanked(text: str, lang: Language) -> str:
    """The text with comments and strings as spaces, line breaks kept."""
    rx = re.compile("|".join(f"(?:{p})" for p in (*lang.strings, *lang.comments)), re.DOTALL) if lang.name != "lua" else re.compile("|".join((lang.comments[0], *(f"(?:{p})" for p in (*lang.strings, lang.comments[1])))), re.DOTALL)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _breaks(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c == "\n"]


def _line(breaks: list[int], at: int) -> int:
    return bisect.bisect_left(breaks, at) + 1


def _end(text: str, at: int, body: str) -> int:
    """Where the declaration that begins at ``at`` ends."""
    if body == "eof":
        return len(text)
    if body == "{":
        depth = 0
        for m in re.compile(r"[{}]").finditer(text, at):
            depth += 1 if m.group() == "{" else -1
            if depth <= 0:
                return m.end() if depth == 0 else m.start()
        return len(text)
    start = text.rfind("\n", 0, at) + 1
    indent = len(text[start:]) - len(text[start:].lstrip(" \t"))
    pos = text.find("\n", at)
    while 0 <= pos < len(text) - 1:
        nxt = text.find("\n", pos + 1)
        line = text[pos + 1 : nxt if nxt >= 0 else len(text)]
        if line.strip() and len(line) - len(line.lstrip(" \t")) <= indent and not re.match(r"\s*(?:end\b|else|elif|except|finally|[)\]}])", line):
            return pos + 1
        pos = nxt
    return len(text)


def exported(name: str, language: str) -> bool:
    return name[:1].isupper() if language == "go" else not name.startswith("_") if language == "python" else True


def _signature(text: str, at: int) -> str:
    line = text[text.rfind("\n", 0, at + 1) + 1 if text[at : at + 1] != "\n" else at + 1 :].split("\n", 1)[0].strip().rstrip("{").strip()
    return line if len(line) <= 150 else line[:150] + "..."


def declarations(path: str, text: str, infer_end_line: bool = True) -> list[dict]:
    """Symbols in order of kind and place, with positions."""
    lang = language_of(path)
    if lang is None:
        return []
    plain = blanked(text, lang)
    breaks, out, taken = _breaks(text), [], set()
    for kind, rx in lang.patterns():
        for m in rx.finditer(plain):
            g = m.groupdict()
            name = g.get("name") or g.get("name2")
            at = m.start("name") if g.get("name") else m.start("name2")
            if not name or (name, at) in taken or name in CONTROL:
                continue
            taken.add((name, at))
            head = m.start() + len(m.group()) - len(m.group().lstrip())
            end = _end(plain, m.start() if lang.body != "indent" else at, lang.body)
            line = _line(breaks, head)
            out.append({"name": name, "kind": kind, "file": path, "line": line, "end_line": _line(breaks, max(head, end - 1)) if infer_end_line else 0, "signature": _signature(text, head), "receiver": g.get("receiver") or "", "exported": exported(name, lang.name), "language": lang.name, "start": head, "end": end, "at": at})
    return out


def references(path: str, text: str) -> list[dict]:
    """Calls outside declarations, keywords, strings and comments, with their callers; for JS and TS also reads and writes."""
    lang = language_of(path)
    if lang is None:
        return []
    plain, breaks, lines = blanked(text, lang), _breaks(text), text.split("\n")
    found = declarations(path, text)
    names_at = {d["at"] for d in found}
    functions = sorted((d for d in found if d["kind"] in ("function", "method")), key=lambda d: d["start"])
    starts = [d["start"] for d in functions]
    outer, stack = [], []  # of each function the next one outwards: nearest before it that ends later
    for i, d in enumerate(functions):
        while stack and functions[stack[-1]]["end"] <= d["end"]:
            stack.pop()
        outer.append(stack[-1] if stack else -1)
        stack.append(i)
    keywords = set(KEYWORDS.get(lang.name, "").split())
    if lang.name in ("javascript", "typescript", "php"):
        keywords.add("function")  # a declaration without a name
    out, seen = [], set()

    def add(name: str, at: int, kind: str) -> None:
        caller, i = None, bisect.bisect_right(starts, at) - 1
        while i >= 0 and not caller:  # outwards from the nearest function that begins before
            if at < functions[i]["end"]:
                caller = functions[i]
            i = outer[i]
        line = _line(breaks, at)
        who = (caller["name"], path, caller["line"]) if caller else (TOP, path, 0)
        key = (name, kind, path, who[0], line, who[2])
        if key not in seen:
            seen.add(key)
            context = lines[line - 1].strip()
            out.append({"symbol_name": name, "kind": kind, "file": path, "line": line, "column": at - (breaks[line - 2] + 1 if line > 1 else 0) + 1, "context": context if len(context) <= 200 else context[:200] + "...", "caller_name": who[0], "caller_file": who[1], "caller_line": who[2]})

    generic = r"(?:::)?(?:<[^<>()]*>)?!?" if lang.name in ("rust", "typescript", "java", "csharp", "cpp") else ""
    for m in re.compile(rf"(?<![\w$])({lang.call}){generic}\s*\(", re.ASCII).finditer(plain):
        method = plain.endswith((".", "->", "::"), 0, m.start())
        if m.start(1) not in names_at and (method or m.group(1) not in keywords):
            add(m.group(1), m.start(1), "call")
    if lang.name in ("javascript", "typescript"):
        for m in re.compile(rf"(?<=[\w$)\]])(?:\?)?\.({_JS})\b(?!\s*\()(\s*(?:[-+*/%&|^]|\*\*|<<|>>|&&|\|\||\?\?)?=(?![=>])|\s*(?:\+\+|--))?", re.ASCII).finditer(plain):
            add(m.group(1), m.start(1), "write" if m.group(2) else "read")
        for m in re.compile(rf"(?<=[\w$)\]])\[(['\"])({_JS})\1\](\s*=(?![=>]))?").finditer(text):
            if plain[m.start()] == "[":
                add(m.group(2), m.start(2), "write" if m.group(3) else "read")
    return out


def precise_declarations(path: str, text: str) -> list[dict]:
    """Symbols of a Python file from its syntax tree, with true ends and docstrings; by patterns for what doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [d | {"docstring": ""} for d in declarations(path, text)]
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner else "function"
                line = lines[child.lineno - 1].strip().rstrip(":").strip()
                inner = child.name if kind == "class" else ""
                out.append({"name": child.name, "kind": kind, "file": path, "line": child.lineno, "end_line": child.end_lineno, "signature": line if len(line) <= 150 else line[:150] + "...", "receiver": owner, "exported": exported(child.name, "python"), "language": "python", "docstring": ast.get_docstring(child) or ""})
            visit(child, inner)

    visit(tree, "")
    return out


def precise_references(path: str, text: str) -> list[dict]:
    """Calls of a Python file from its syntax tree, with the innermost function around each; by patterns for what doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return references(path, text)
    lines, keywords, out, seen = text.split("\n"), set(KEYWORDS["python"].split()), [], set()

    def visit(node: ast.AST, caller: tuple[str, int]) -> None:
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            line = f.end_lineno
            if name and not (isinstance(f, ast.Name) and name in keywords) and (name, line, caller) not in seen:
                seen.add((name, line, caller))
                context, column = lines[line - 1].strip(), len(lines[line - 1].encode()[: f.end_col_offset].decode("utf-8", "replace")) - len(name) + 1
                out.append({"symbol_name": name, "kind": "call", "file": path, "line": line, "column": column, "context": context if len(context) <= 200 else context[:200] + "...", "caller_name": caller[0], "caller_file": path, "caller_line": caller[1]})
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in [*node.decorator_list, *node.args.defaults, *(x for x in node.args.kw_defaults if x)]:
                visit(d, caller)  # evaluated outside
            for child in node.body:
                visit(child, (node.name, node.lineno))
            return
        for child in ast.iter_child_nodes(node):
            visit(child, caller)

    visit(tree, (TOP, 0))
    return out


def _precise(path: str) -> bool:
    return path.lower().endswith(".py")


SYMBOLS = ["name", "kind", "file", "line", "end_line", "signature", "receiver", "exported", "language"]
REFS = ["symbol_name", "kind", "file", "line", "column", "context", "caller_name", "caller_file", "caller_line"]
_KINDS = {"line": ("int", pa.int32()), "end_line": ("int", pa.int32()), "column": ("int", pa.int32()), "caller_line": ("int", pa.int32()), "exported": ("boolean", pa.bool_())}


def _mapped(fn):
    """The function on the scripts of single-file components, with the lines of the component."""

    def of(path: str, text: str, *more) -> list[dict]:
        if not path.lower().endswith(".vue"):
            return fn(path, text, *more)
        script, lines = vue_script(text)
        out = fn(path, script, *more)
        for r in out:
            for c in ("line", "end_line", "caller_line"):
                if r.get(c):
                    r[c] = lines[r[c] - 1] if r[c] <= len(lines) else 0
        return out

    return of


def _extract(files: DataFrame, names: list[str], fn) -> DataFrame:
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [r for p, t in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in fn(p or "", t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS.get(n, ("", pa.string()))[1]) for n in names], names)

    return files.select("path", "content").mapInArrow(each, ", ".join(f"`{n}` {_KINDS.get(n, ('string',))[0]}" for n in names))


def extract_symbols(files: DataFrame, infer_end_line: bool = False, precise: bool = False) -> DataFrame:
    """Symbols of files (path, content); end_line is 0 unless inferred. precise: by syntax tree where there is one (Python), with docstrings."""
    if precise:
        by_pattern = lambda p, t: [d | {"docstring": ""} for d in _mapped(declarations)(p, t, True)]
        return _extract(files, [*SYMBOLS, "docstring"], lambda p, t: precise_declarations(p, t) if _precise(p) else by_pattern(p, t))
    return _extract(files, SYMBOLS, lambda p, t: _mapped(declarations)(p, t, infer_end_line))


def extract_references(files: DataFrame, precise: bool = False) -> DataFrame:
    if precise:
        return _extract(files, REFS, lambda p, t: precise_references(p, t) if _precise(p) else _mapped(references)(p, t))
    return _extract(files, REFS, _mapped(references))


def call_edges_v2(refs: DataFrame) -> DataFrame:
    """Call references as edges, <top-level> callers too, one for each caller, callee and line."""
    x = refs.where("kind = 'call'").selectExpr("caller_name AS caller", "symbol_name AS callee", "file", "line")
    return x.dropDuplicates(["caller", "callee", "file", "line"])


def vue_script(text: str) -> tuple[str, list[int]]:
    """The script blocks of a single-file component and the expressions of v-bind in its styles; source line of each line."""
    out, lines = [], []
    for m in re.compile(r"<script\b[^>]*>\n?(.*?)</script>", re.DOTALL | re.IGNORECASE).finditer(text):
        first = text.count("\n", 0, m.start(1)) + 1
        for i, line in enumerate(m.group(1).rstrip("\n").split("\n")):
            out.append(line), lines.append(first + i)
    for m in re.compile(r"<style\b[^>]*>(.*?)</style>", re.DOTALL | re.IGNORECASE).finditer(text):
        for b in re.compile(r"v-bind\(").finditer(text, m.start(1), m.end(1)):
            depth, i = 1, b.end()
            while i < m.end(1) and depth:
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                i += 1
            if not depth:
                out.append(f"void ({text[b.end() : i - 1].strip().strip(chr(39) + chr(34))});")
                lines.append(text.count("\n", 0, b.start()) + 1)
    return "\n".join(out), lines
