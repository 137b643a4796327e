"""Path expressions: hygiene filters, safety rules, suffixes, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import _c, let, strip

# Folders, suffixes and names that never enter the corpus.
IGNORED_DIRECTORIES = (
    "node_modules", ".git", ".idea", ".vscode", "target", "build", "dist", "__pycache__",
)
IGNORED_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".ico", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".zip", ".tar", ".gz", ".rar",
    ".exe", ".dll", ".so", ".dylib",
    ".class", ".jar", ".war",
    ".mp3", ".mp4", ".avi", ".mov",
    ".woff", ".woff2", ".ttf", ".eot",
)
SECRET_NAMES = (
    ".env", ".netrc", ".npmrc", ".pypirc", ".git-credentials",
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
    "credentials", "credentials.json",
    "secrets.json", "secrets.yml", "secrets.yaml",
)
SECRET_PREFIX = ".env."
SECRET_SUFFIXES = (
    ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore",
    ".tfvars", ".tfstate", ".tfstate.backup",
)


def _alternation(words) -> str:
    return "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)


IGNORED_DIRECTORY_RE = rf"(^|/)({_alternation(IGNORED_DIRECTORIES)})/"
IGNORED_SUFFIX_RE = rf"({_alternation(IGNORED_SUFFIXES)})$"
SECRET_SUFFIX_RE = rf"({_alternation(SECRET_SUFFIXES)})$"


def in_ignored_directory(path) -> Column:
    """FLT-1 (case-sensitive)."""
    return _c(path).rlike(IGNORED_DIRECTORY_RE)


def has_ignored_suffix(path) -> Column:
    """FLT-2 (case-insensitive)."""
    return F.lower(_c(path)).rlike(IGNORED_SUFFIX_RE)


def is_secret_file(path) -> Column:
    """FLT-3: by base name; both slash directions separate."""
    base = F.regexp_extract(F.lower(_c(path)), r"([^/\\]*)$", 1)
    return base.isin(*SECRET_NAMES) | base.startswith(SECRET_PREFIX) | base.rlike(SECRET_SUFFIX_RE)


def is_ignored(path) -> Column:
    return in_ignored_directory(path) | has_ignored_suffix(path) | is_secret_file(path)


def escapes_root(path) -> Column:
    """True when folding ``.`` and ``..`` leaves the archive root.

    The walk depth after segment i is the count of plain segments minus the
    count of ``..`` so far; the path escapes when that is ever negative, and
    an absolute path always does.
    """
    steps = F.transform(
        F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != ".")),
        lambda s: F.when(s == "..", -1).otherwise(1),
    )
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, step: F.struct(
            (acc["depth"] + step).alias("depth"),
            F.least(acc["low"], acc["depth"] + step).alias("low"),
        ),
    )
    return _c(path).startswith("/") | (walk["low"] < 0)


def _segments(path) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def safe_tool_path(path) -> Column:
    """FLT-5: normalised relative path, empty for the root, null if unsafe."""
    raw = F.replace(strip(F.coalesce(_c(path), F.lit(""))), F.lit("\\"), F.lit("/"))
    segments = _segments(raw)
    kept = F.filter(segments, lambda s: (s != "") & (s != "."))
    unsafe = (
        raw.startswith("/")
        | ((F.length(raw) > 1) & (F.substring(raw, 2, 1) == ":"))
        | F.array_contains(segments, "..")
    )
    return (
        F.when((raw == "") | (raw == "."), "")
        .when(unsafe, F.lit(None).cast("string"))
        .when(F.size(kept) == 0, ".")
        .otherwise(F.array_join(kept, "/"))
    )


def safe_backend_path(path) -> Column:
    """FLT-6: stricter rule, any colon is refused and ``.`` is not folded."""
    flat = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    unsafe = (
        _c(path).isNull()
        | (strip(path) == "")
        | flat.startswith("/")
        | flat.contains(":")
        | F.array_contains(_segments(_c(path)), "..")
    )
    return F.when(~unsafe, flat)


def safe_path(path, rule: str = "tools") -> Column:
    return safe_backend_path(path) if rule == "backend" else safe_tool_path(path)


def citation_key(path) -> Column:
    """FN-13: forward slashes, then every leading dot and slash removed."""
    return F.ltrim(F.replace(_c(path), F.lit("\\"), F.lit("/")), F.lit("./"))


def base_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def directory_of(path) -> Column:
    """Text before the last slash, empty without one."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def segment_suffixes(path) -> Column:
    """Every suffix that starts at a segment: ``a/b/c`` -> a/b/c, b/c, c."""
    return let(F.split(_c(path), "/"), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def char_suffixes(text) -> Column:
    """Every non-empty suffix; makes an unaligned ``endswith`` an equi-join."""
    return let(_c(text), lambda whole: F.when(
        F.length(whole) > 0,
        F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.substr(whole, i)),
    ).otherwise(F.array().cast("array<string>")))


def fold_dots(path) -> Column:
    """Fold ``.`` and ``..`` of a relative path (leading ``..`` are kept)."""
    kept = F.aggregate(
        F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(kept, "/")


def natural_key(name) -> Column:
    """RET-13: sort key with numeric collation, digit runs padded to 20."""
    pieces = F.regexp_extract_all(F.lower(_c(name)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.when(
            p.rlike(r"^\d"), F.concat(F.repeat(F.lit("0"), 20 - F.least(F.length(p), F.lit(20))), p)
        ).otherwise(p)), "")
