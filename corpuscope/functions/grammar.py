"""Fixed values of the source grammars, and expressions over one code line.

The patterns decide which lines are declarations, imports, calls or dynamic
calls, so they must equal the ones the index was defined with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.languages import BRACE_LANGUAGES, SCRIPT_LANGUAGES
from corpuscope.functions.text import _c, strip

# ---- fixed values: declarations -------------------------------------------
JAVA_TYPE = (
    r"^(?:@\w+(?:\([^)]*\))?\s*)*"
    r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*"
    r"(class|interface|enum|record)\s+(\w+)"
)
JAVA_METHOD = (
    r"^(?:@\w+(?:\([^)]*\))?\s*)*"
    r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
    r"[\w<>\[\],.?]+\s+(\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w\s,.<>]+)?\{?\s*$"
)
JS_CLASS = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
JS_INTERFACE = r"^(?:export\s+)?(?:declare\s+)?interface\s+(\w+)"
JS_FUNCTION = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"
JS_ARROW = (
    r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?"
    r"(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"
)
JS_OBJECT_ARROW = r"^\s*(\w+)\s*:\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"
JS_METHOD = (
    r"^\s*(?:(?:public|private|protected|static|async|readonly|override|declare)\s+)*"
    r"(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]|,.\s]+)?\{\s*$"
)
GO_FUNC = r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("
PY_CLASS = r"^(\s*)class\s+(\w+)"
PY_DEF = r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\("
PY_DECORATOR = r"^\s*@[\w.]+"

BRACE_STATEMENT_WORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "catch", "try", "finally", "return",
    "throw", "assert", "yield", "await", "new", "typeof", "instanceof", "delete", "package",
    "import", "using", "namespace", "module", "require",
)
PY_STATEMENT_WORDS = (
    "if", "elif", "else", "for", "while", "with", "try", "except", "finally", "return", "yield",
    "raise", "assert", "del", "print", "import", "from", "await", "lambda", "match", "case",
    "pass", "break", "continue",
)

# ---- fixed values: imports and calls --------------------------------------
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([\w.$*]+)\s*;"
JS_IMPORT_FROM = r"""^\s*import\s+.*?from\s+['"]([^'"]+)['"]"""
JS_IMPORT_BARE = r"""^\s*import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""
GO_IMPORT = r"""^\s*import\s+(?:\w+\s+)?"([^"]+)"\s*$"""
PY_FROM_IMPORT = r"^\s*from\s+([.\w]+)\s+import\b"
PY_IMPORT = r"^\s*import\s+([\w.]+)"

BRACE_CALL = r"\b([A-Za-z_$][\w$]*)\s*(?:\.\s*([A-Za-z_$][\w$]*))?\s*\("
PY_CALL = r"\b([A-Za-z_]\w*)\s*(?:\.\s*([A-Za-z_]\w*))?\s*\("
BRACE_DYNAMIC = (
    r"\beval\s*\(|\.apply\s*\(|\.call\s*\(|\bFunction\s*\(|"
    r"\bClass\.forName\s*\(|\.invoke\s*\(|\.getMethod\s*\(|\.getDeclaredMethod\s*\(|"
    r"\?\s*\.\s*\(|\]\s*\(|\bnewInstance\s*\(|\bmethod_missing\b"
)
PY_DYNAMIC = (
    r"\bgetattr\s*\(|\bsetattr\s*\(|\beval\s*\(|\bexec\s*\(|\bglobals\s*\(|"
    r"\blocals\s*\(|\b__getattr__\b|\bapply\s*\(|\bimport_module\s*\("
)
BRACE_CALL_NOISE = (
    "if", "else", "for", "while", "do", "switch", "catch", "return", "throw", "new", "assert",
    "typeof", "instanceof", "delete", "await", "yield", "super", "this", "function", "require",
    "import", "print", "println", "printf", "sizeof",
)
PY_CALL_NOISE = (
    "if", "elif", "else", "for", "while", "with", "return", "yield", "raise", "assert", "print",
    "len", "isinstance", "range", "super", "int", "str", "float", "bool", "list", "dict", "set",
    "tuple", "open", "enumerate", "zip",
)
CONTAINER_KINDS = ("class", "interface", "enum")
# ---------------------------------------------------------------------------


def _starts_with_word(text: Column, words, extra: str) -> Column:
    return text.rlike(rf"^(?:{'|'.join(words)})[^\p{{L}}\p{{Nd}}_{extra}]")


def _first(text: Column, banned: Column, *rules) -> Column:
    """First rule that matches wins: rules are (guard, pattern, group, kind).

    A guard is a cheap necessary condition (a byte search) of its pattern, so
    that most lines never reach a regular expression.
    """
    out = None
    for guard, pattern, group, kind in rules:
        name = F.regexp_extract(text, pattern, group)
        value = F.struct(name.alias("name"), kind.alias("kind"))
        hit = guard & (name != "") & ~banned
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def declaration(code="code", language="language") -> Column:
    """IDX-4: struct(name, kind) of the declaration on a line, else null."""
    code, language = _c(code), _c(language)
    text = strip(code)
    # blanks are in no word that a guard looks for: guards search the line itself and trim it last
    call = code.contains("(")
    statement = _starts_with_word(text, BRACE_STATEMENT_WORDS, ".")
    a_type = code.contains("class") | code.contains("interface") | code.contains("enum") | code.contains("record")
    java = _first(
        text, statement,
        (a_type, JAVA_TYPE, 2, F.regexp_extract(text, JAVA_TYPE, 1)),
        (call & ~text.endswith(";"), JAVA_METHOD, 1, F.lit("method")),
    )
    script = _first(
        text, statement,
        (code.contains("class"), JS_CLASS, 1, F.lit("class")),
        (code.contains("interface"), JS_INTERFACE, 1, F.lit("interface")),
        (code.contains("function"), JS_FUNCTION, 1, F.lit("function")),
        (code.contains("="), JS_ARROW, 1, F.lit("function")),
        (code.contains("=>"), JS_OBJECT_ARROW, 1, F.lit("function")),
        (call & code.contains("{") & text.endswith("{"), JS_METHOD, 1, F.lit("method")),
    )
    go = _first(text, statement, (code.contains("func") & text.startswith("func"), GO_FUNC, 1, F.lit("function")))
    python = _first(
        code, _starts_with_word(text, PY_STATEMENT_WORDS, ""),
        (code.contains("class"), PY_CLASS, 2, F.lit("class")),
        (code.contains("def"), PY_DEF, 2, F.lit("function")))
    return (
        F.when(language == "java", java)
        .when(language.isin(*SCRIPT_LANGUAGES), script)
        .when(language == "go", go)
        .when(language == "python", python)
    )


def brace_delta(code="code") -> Column:
    """IDX-3: opening minus closing braces of a line."""
    code = _c(code)
    # one deletion per side keeps the count a byte operation; a line without the byte is not copied
    return F.octet_length(F.replace(code, F.lit("}"), F.lit(""))) - F.octet_length(F.replace(code, F.lit("{"), F.lit("")))


def import_targets(raw="raw", code="code", language="language") -> Column:
    """IDX-11: array of import targets on a line, in pattern order."""
    raw, code, language = _c(raw), _c(code), _c(language)

    def every(text, pattern):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    nothing = F.array().cast("array<string>")
    found = (
        F.when(~raw.contains("import") & ~raw.contains("require"), nothing)
        .when(language == "java", every(raw, JAVA_IMPORT))
        .when(language.isin(*SCRIPT_LANGUAGES),
              F.concat(every(raw, JS_IMPORT_FROM), every(raw, JS_IMPORT_BARE), every(raw, JS_REQUIRE)))
        .when(language == "go", every(raw, GO_IMPORT))
        .when(language == "python", F.concat(every(code, PY_FROM_IMPORT), every(code, PY_IMPORT)))
        .otherwise(nothing)
    )
    return F.filter(F.transform(found, strip), lambda t: t != "")


def call_targets(code="code", language="language") -> Column:
    """IDX-12: array of callee texts on a line, noise words removed."""
    code, language = _c(code), _c(language)

    def calls(pattern, noise, fold):
        # the whole match without blanks and the bracket is the callee text; most hold no blank to look for
        found = F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)), lambda m: F.when(
            m.rlike(r"\s"), F.translate(m, " \t\f\r\u000b(", "")).otherwise(F.substring_index(m, "(", 1)))

        def simple(callee):
            name = F.substring_index(callee, ".", -1)
            return F.lower(name) if fold else name

        return F.filter(found, lambda c: ~simple(c).isin(*noise))

    return F.when(~code.contains("("), F.array().cast("array<string>")).when(
        language == "python", calls(PY_CALL, PY_CALL_NOISE, fold=False)
    ).otherwise(calls(BRACE_CALL, BRACE_CALL_NOISE, fold=True))


def is_dynamic_line(code="code", language="language") -> Column:
    """IDX-13: line-level flag for calls that cannot be resolved statically."""
    code = _c(code)

    def any_of(*words):
        out = code.contains(words[0])
        for word in words[1:]:
            out = out | code.contains(word)
        return out

    # byte searches that every alternative needs, before the pattern itself
    brace = any_of("]", "?", "eval", ".apply", ".call", "Function", "forName", ".invoke", ".getMethod",
                   ".getDeclaredMethod", "newInstance", "method_missing")
    python = any_of("attr", "eval", "exec", "globals", "locals", "apply", "import_module")
    return F.when(_c(language) == "python", python & code.rlike(PY_DYNAMIC)).otherwise(
        brace & code.rlike(BRACE_DYNAMIC))


def is_import_like(raw="raw", code="code", language="language") -> Column:
    """IDX-9: blank, comment-header or import line."""
    raw, code, language = _c(raw), _c(code), _c(language)
    text = strip(raw)
    brace = (
        text.startswith("package ") | text.startswith("using ") | text.startswith("#include")
        | text.startswith("//") | text.startswith("*") | text.startswith("/*")
        | raw.rlike(JAVA_IMPORT) | raw.rlike(JS_IMPORT_FROM)
        | raw.rlike(JS_IMPORT_BARE) | raw.rlike(GO_IMPORT)
    )
    python = code.rlike(PY_FROM_IMPORT) | code.rlike(PY_IMPORT) | strip(code).startswith("#")
    return F.when(language == "python", (strip(code) == "") | python).otherwise((text == "") | brace)


def has_meaning(code="code", language="language") -> Column:
    """IDX-9: more than blanks (and, between braces, more than punctuation)."""
    code = _c(code)
    return F.when(_c(language) == "python", strip(code) != "").otherwise(code.rlike(r"[^\s{};,]"))
