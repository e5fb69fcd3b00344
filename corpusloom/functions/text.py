"""Column expressions on lines and paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of the line scan by extension; all other files are "unknown".
SCAN_LANGUAGES = {
    "python": [".py", ".pyw", ".pyx", ".pxd"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx", ".vue", ".svelte"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "java": [".java", ".kt", ".kts", ".scala"],
    "ruby": [".rb"],
    "php": [".php", ".phtml"],
    "rust": [".rs"],
    "c": [".c", ".cpp", ".cc", ".cxx", ".h", ".hpp"],
    "csharp": [".cs"],
    "shell": [".sh", ".bash", ".zsh", ".fish"],
    "text": [".txt", ".toml", ".yaml", ".yml", ".json", ".cfg", ".ini", ".conf"],
    "dockerfile": [".dockerfile"],
    "markdown": [".md"],
}
# The language of the deep analysis by extension.
DEEP_LANGUAGES = {
    "python": [".py", ".pyw", ".pyx", ".pxd"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "java": [".java", ".kt", ".kts"],
    "ruby": [".rb"],
    "php": [".php", ".phtml"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "csharp": [".cs"],
    "bash": [".sh", ".bash", ".zsh"],
}
# Whose sources and sinks a language of the deep analysis has; others have those of python.
TAINT_LANGUAGES = {
    "python": "python", "javascript": "javascript", "js": "javascript", "typescript": "javascript", "ts": "javascript", "tsx": "javascript",
    "go": "go", "java": "java", "ruby": "ruby", "php": "php", "rust": "rust", "c": "c", "cpp": "c", "csharp": "csharp", "shell": "shell", "bash": "shell",
}


LEADING_RUN = r"\w+"


#: Patterns and what is searched for instead, with the same result in less time.
INSTEAD: dict[str, str] = {}


def search(line: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where the pattern occurs: Unicode classes and borders, and only \\n ends a line."""
    return F.rlike(line, F.lit(f"(?{'i' if ignore_case else ''}Ud){INSTEAD.get(pattern, pattern)}"))


def any_of(patterns: Iterable[str]) -> str:
    """One of the patterns occurs just where one of these does.

    A run of word characters that begins a pattern may be one character long; tried from each character of a long word, it would cost its length squared.
    """
    shorter = (INSTEAD[p] if p in INSTEAD else p[:2] + p[3:] if p.startswith(LEADING_RUN) else p for p in dict.fromkeys(patterns))
    return "|".join(f"(?:{p})" for p in shorter)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?Ud)^\s+|(?<!\s)\s+\z", "")


def shown(line: Column) -> Column:
    return F.substring(stripped(line), 1, 200)


def entropy(text: Column) -> Column:
    """Bits for each character; 0 for the empty text."""
    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text)
    shares = F.transform(characters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n.cast("double"))
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; leading dots begin no extension."""
    return F.regexp_extract(F.lower(basename(path)), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def _by_extension(path: Column, languages: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for lang, extensions in languages.items() for e in extensions for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def _dockerfile(path: Column) -> Column:
    return F.startswith(F.lower(basename(path)), F.lit("dockerfile"))


def scan_language(path: Column) -> Column:
    return F.when(_dockerfile(path), "dockerfile").otherwise(F.coalesce(_by_extension(path, SCAN_LANGUAGES), F.lit("unknown")))


def deep_language(path: Column) -> Column:
    return F.coalesce(_by_extension(path, DEEP_LANGUAGES), F.when(_dockerfile(path), F.lit("dockerfile")))


def taint_language(language: Column) -> Column:
    pairs = [F.lit(x) for pair in TAINT_LANGUAGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.lit("python"))


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression for whole paths: * stays in a folder, ** crosses folders, ? is one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, f"\\{c}" if c in "\\.[]{}()+-^$|" else c), i + 1
    return rf"(?s)\A{out}\z"
