"""Path expressions and predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are indexed.
EXTENSIONS = """
.go .js .ts .jsx .tsx .py .rb .java .c .cpp .cc .h .hpp .cs .php .rs .swift .kt .scala .vue .svelte .html .css .scss .less
.sql .sh .bash .zsh .yaml .yml .json .xml .md .txt .toml .ini .cfg .conf .env .lua .r .dart .ex .exs .erl .clj .hs .ml .fs
.elm .nim .zig .proto .tf .hcl .pas .dpr
""".split()
MINIFIED = [".min.js", ".min.css", ".bundle.js", ".bundle.css"]
MAX_BYTES = 1 << 20


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; "." without one."""
    d = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), ".").when(d == "", "/").otherwise(d)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(base(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"\.[^.]*$", "")


def is_supported(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def is_minified(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, (F.endswith(low, F.lit(s)) for s in MINIFIED))


def is_binary(content: Column) -> Column:
    """Bytes that are no UTF-8 or hold NUL."""
    text = content.cast("string")
    return ~F.is_valid_utf8(text) | (F.position(F.lit("\0"), text) > 0)


def has_prefix(path: Column, prefix: str) -> Column:
    return path.startswith(prefix)


def glob_regex(pattern: str) -> str:
    """A shell glob as a regex: * and ? stay within a path part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            out += "[" + pattern[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_pattern(path: Column, pattern: str) -> Column:
    """The glob on the whole path, else the pattern without ** / and * as a substring."""
    rest = pattern.replace("**/", "").replace("*", "")
    return F.rlike(path, F.lit(glob_regex(pattern))) | F.contains(path, F.lit(rest))


def in_scopes(feature_path: Column, scopes: list[str]) -> Column:
    low = F.lower(feature_path)
    return reduce(lambda a, b: a | b, (F.startswith(low, F.lit(s.lower())) for s in scopes), F.lit(not scopes))


def classify_file(path: Column) -> tuple[Column, Column]:
    """Area and category: the first directory, and the second or the file's stem; root for top-level files."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/", ""), "/")
    n = F.size(parts)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    area = F.when(n == 1, "root").otherwise(first)
    category = F.when(n == 1, stem(first)).when(n == 2, stem(second)).otherwise(second)
    return area, category


def longest_root(path: str, roots: list[str]) -> tuple[str, str] | None:
    """The longest root that holds the path, and the rest."""
    fits = [r for r in roots if path == r or path.startswith(r.rstrip("/") + "/")]
    if not fits:
        return None
    root = max(fits, key=len)
    return root, path[len(root) :].lstrip("/")


def in_projects(path: Column, workspace: str, projects: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(path, F.lit(f"{workspace}/{p}/")) for p in projects), F.lit(not projects))
