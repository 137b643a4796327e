"""Language detection and the symbol-capable set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import _c

# Extension -> language id.
EXTENSIONS = {
    "java": "java",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "jsx": "tsx", "tsx": "tsx",
    "py": "python", "pyi": "python",
    "go": "go",
    "cs": "csharp",
    "kt": "kotlin", "kts": "kotlin",
    "rb": "ruby",
    "rs": "rust",
    "php": "php",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "html": "html", "htm": "html",
    "css": "css",
    "scss": "scss", "sass": "scss",
    "sql": "sql",
    "sh": "shell", "bash": "shell", "zsh": "shell",
    "yml": "yaml", "yaml": "yaml",
    "json": "json",
    "md": "markdown", "markdown": "markdown",
}

BRACE_LANGUAGES = ("java", "javascript", "typescript", "tsx", "go")
SCRIPT_LANGUAGES = ("javascript", "typescript", "tsx")
SYMBOL_LANGUAGES = BRACE_LANGUAGES + ("python",)


def language_of(path) -> Column:
    """FN-1: by extension through a literal map (no join needed for 38 rows)."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    extension = F.lower(F.regexp_extract(_c(path), r"\.([^.]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("unknown"))


def supports_symbols(language) -> Column:
    return _c(language).isin(*SYMBOL_LANGUAGES)


def is_external_import(target, language) -> Column:
    """FN-20: a script import that is not relative lies outside the project."""
    return _c(language).isin(*SCRIPT_LANGUAGES) & ~_c(target).startswith(".")
