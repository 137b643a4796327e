"""Symbols, blocks and references of a file in one pass over its text (IDX-1 .. IDX-15).

:mod:`symbols` and :mod:`references` state the same rules over a row a line, whose facts meet in windows and joins. Here a file is
lexed, searched for its declarations, walked and searched for its calls in one Python step, so no line becomes a row and no text is
moved or stored for it. Patterns are those of :mod:`grammar`, read as the JVM reads them; lines that cannot match are left out by the same
byte searches. The work of a file is linear in its text but for what a pattern itself takes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import grammar as G
from corpuscope.functions.languages import SCRIPT_LANGUAGES, SYMBOL_LANGUAGES
from corpuscope.functions.text import WHITESPACE
from corpuscope.operators.lines import _blank_brace, _docstring_lines, _strip_comments, dealt_by_file, task_count
from corpuscope.operators.symbols import _walk_braces, _walk_indents

#: one row per symbol, block, gap, owner step or reference; a reference has its target as ``name`` and its owner as ``parent_symbol``
SCAN_SCHEMA = (
    "project_id string, file_id string, path string, language string, item string, seq int, name string, kind string, "
    "parent_symbol string, start_line int, end_line int, signature string, is_dynamic boolean"
)
#: rows that leave in one Arrow batch, and characters of text whose files do
BATCH_ROWS, BATCH_CHARS = 1 << 16, 4 << 20

_TERMINATORS = "\n\r\u0085\u2028\u2029"
#: stand-ins of characters beyond ASCII: those that belong to a word for the JVM, and the rest
_LETTER, _SIGN, _MARK = "\u00e9", "\u00a7", "\u0300"
_WORD = f"[A-Za-z0-9_{_LETTER}]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_BLANK = r"[ \t\r\f\x0b]"


class _Kinds(dict):
    """For ``str.translate``: a character's stand-in; marks stay marks until their base is known."""

    def __missing__(self, code: int):
        char = chr(code)
        kind = unicodedata.category(char)
        if code < 128 or char in _TERMINATORS:
            out = char
        else:
            out = _LETTER if kind[0] == "L" or kind == "Nd" else _MARK if kind == "Mn" else _SIGN
        self[code] = out
        return out


_KINDS = _Kinds()


def _plain(text: str) -> str:
    """The text, character by character, with one letter for all letters and digits beyond ASCII: ``\\b`` of the JVM (17) knows them."""
    if text.isascii():
        return text
    out = text.translate(_KINDS)
    if _MARK in out:  # a mark on a letter or digit belongs to the word
        out = re.sub(f"(?<=[A-Za-z0-9{_LETTER}]){_MARK}+", lambda m: _LETTER * len(m[0]), out).replace(_MARK, _SIGN)
    return out


class _Java:
    """A pattern as the JVM reads it: ``\\w`` and ``\\s`` are ASCII, ``\\b`` is not, ``.`` and ``$`` know five line ends."""

    def __init__(self, pattern: str):
        pattern = pattern.replace(".*?", f"[^{_TERMINATORS}]*?")
        if pattern.endswith("$"):
            pattern = pattern[:-1] + rf"(?=(?:\r\n|[{_TERMINATORS}])?\Z)"
        self.ascii = re.compile(pattern, re.A)
        self.other = re.compile(pattern.replace(r"\b", _EDGE), re.A)

    def on(self, text: str) -> re.Pattern:
        return self.ascii if text.isascii() else self.other

    def first(self, text: str) -> re.Match | None:
        return self.on(text).search(_plain(text))

    def every(self, text: str) -> list[str]:
        """The first group of all matches, as the text has it."""
        return [text[m.start(1):m.end(1)] for m in self.on(text).finditer(_plain(text))]


_JAVA_TYPE, _JAVA_METHOD = _Java(G.JAVA_TYPE), _Java(G.JAVA_METHOD)
_JS_CLASS, _JS_INTERFACE, _JS_FUNCTION = _Java(G.JS_CLASS), _Java(G.JS_INTERFACE), _Java(G.JS_FUNCTION)
_JS_ARROW, _JS_OBJECT_ARROW, _JS_METHOD = _Java(G.JS_ARROW), _Java(G.JS_OBJECT_ARROW), _Java(G.JS_METHOD)
_GO_FUNC, _PY_CLASS, _PY_DEF, _PY_DECORATOR = _Java(G.GO_FUNC), _Java(G.PY_CLASS), _Java(G.PY_DEF), _Java(G.PY_DECORATOR)
_JAVA_IMPORT, _GO_IMPORT, _JS_REQUIRE = _Java(G.JAVA_IMPORT), _Java(G.GO_IMPORT), _Java(G.JS_REQUIRE)
_JS_IMPORT_FROM, _JS_IMPORT_BARE = _Java(G.JS_IMPORT_FROM), _Java(G.JS_IMPORT_BARE)
_PY_FROM_IMPORT, _PY_IMPORT = _Java(G.PY_FROM_IMPORT), _Java(G.PY_IMPORT)
_DYNAMIC = {True: _Java(G.PY_DYNAMIC), False: _Java(G.BRACE_DYNAMIC)}


def _in_lines(pattern: str) -> _Java:
    """A call pattern for a whole text: blanks stay in their line, groups are not kept, and no run is given back, since what follows one is not in it."""
    for part, new in ((r"\s*", _BLANK + "*+"), (r"[\w$]*", r"[\w$]*+"), (r"]\w*", r"]\w*+"), ("([", "(?:[")):
        pattern = pattern.replace(part, new)
    return _Java(pattern)


_CALLS = {True: _in_lines(G.PY_CALL), False: _in_lines(G.BRACE_CALL)}
_NOISE = {True: frozenset(G.PY_CALL_NOISE), False: frozenset(G.BRACE_CALL_NOISE)}
_STATEMENTS = {True: frozenset(G.PY_STATEMENT_WORDS), False: frozenset(G.BRACE_STATEMENT_WORDS)}
_HEAD_WORD = re.compile("[a-z]+")
#: what a line that matches holds, of the declarations and of the dynamic calls
_TYPE_WORDS = ("class", "interface", "enum", "record")
_DYNAMIC_WORDS = {
    True: ("attr", "eval", "exec", "globals", "locals", "apply", "import_module"),
    False: ("]", "?", "eval", ".apply", ".call", "Function", "forName", ".invoke", ".getMethod", ".getDeclaredMethod", "newInstance",
            "method_missing"),
}
_MEANING = re.compile(r"[^\s{};,]", re.A)


def _is_statement(text: str, python: bool) -> bool:
    """Whether a line begins with a statement word and something that does not go on with a name."""
    head = _HEAD_WORD.match(text)
    if head is None or head[0] not in _STATEMENTS[python] or len(text) == head.end():
        return False
    after = text[head.end()]
    if after.isascii():
        return not (after.isalnum() or after == "_" or (after == "." and not python))
    kind = unicodedata.category(after)
    return not (kind[0] == "L" or kind == "Nd")


def declaration(code: str, language: str) -> tuple[str, str] | None:
    """IDX-4: (name, kind) of the declaration on a line."""
    python = language == "python"
    text = code.strip(WHITESPACE)
    call, rules = "(" in code, []
    if python:
        rules = [("class" in code, _PY_CLASS, 2, "class"), ("def" in code, _PY_DEF, 2, "function")]
    elif language == "java":
        rules = [(any(w in code for w in _TYPE_WORDS), _JAVA_TYPE, 2, None), (call and not text.endswith(";"), _JAVA_METHOD, 1, "method")]
    elif language in SCRIPT_LANGUAGES:
        rules = [("class" in code, _JS_CLASS, 1, "class"), ("interface" in code, _JS_INTERFACE, 1, "interface"),
                 ("function" in code, _JS_FUNCTION, 1, "function"), ("=" in code, _JS_ARROW, 1, "function"),
                 ("=>" in code, _JS_OBJECT_ARROW, 1, "function"), (call and text.endswith("{"), _JS_METHOD, 1, "method")]
    elif language == "go":
        rules = [(text.startswith("func"), _GO_FUNC, 1, "function")]
    for guard, pattern, group, kind in rules:
        if guard and (found := pattern.first(code if python else text)):
            return None if _is_statement(text, python) else (found[group], kind or found[1])
    return None


def _lines_with(word: str, whole: str, ends: np.ndarray) -> set[int]:
    """Lines from 0 that hold a word."""
    at, found = whole.find(word), []
    while at >= 0:
        found.append(at)
        at = whole.find(word, at + len(word))
    return set(np.searchsorted(ends, found).tolist())


def _declarations(lines: list[str], whole: str, ends: np.ndarray, language: str) -> dict[int, tuple[str, str]]:
    """Declarations by line from 0. Only lines that hold what a rule needs are tried."""
    words, tried = {"python": ("class", "def"), "java": _TYPE_WORDS, "go": ("func",)}.get(language, ("class", "interface", "function", "=")), set()
    for word in words:
        tried |= _lines_with(word, whole, ends)
    if language == "java":
        tried.update([i for i, c in enumerate(lines) if "(" in c and c[-1] != ";" and not c.rstrip(WHITESPACE).endswith(";")])
    elif language in SCRIPT_LANGUAGES:
        tried.update([i for i in _lines_with("{", whole, ends) if i < len(lines) and "(" in lines[i]])
    found = ((i, declaration(lines[i], language)) for i in sorted(tried) if i < len(lines))
    return {i: d for i, d in found if d is not None}


def _signature(raw: str) -> str:
    return raw.strip(WHITESPACE)[:500]


class File:
    """A file's lines, raw and lexed, and what is found in them."""

    def __init__(self, content: str | None, language: str, strict: bool):
        self.language, self.python, self.strict = language, language == "python", strict
        text = (content or "").replace("\r\n", "\n")
        self.raw = text.split("\n") if text else []
        if self.raw and not self.raw[-1]:
            self.raw.pop()
        self.n = len(self.raw)
        self.whole = _strip_comments(text, strict) if self.python else _blank_brace(text)
        self.code = self.whole.split("\n")[:self.n]
        self.code += [""] * (self.n - len(self.code))
        self.text = text
        self.ends = self._ends()
        self.declared = _declarations(self.code, self.whole, self.ends, language)
        rows = self._indents() if self.python else self._braces()
        # a file without any candidate has no items
        self.found = (_walk_indents if self.python else _walk_braces)(rows, self.n) if rows else None

    def _ends(self) -> np.ndarray:
        """Places of the line feeds in the lexed text."""
        if self.whole.isascii():
            return np.flatnonzero(np.frombuffer(self.whole.encode(), np.uint8) == 10)
        return np.flatnonzero(np.frombuffer(self.whole.encode("utf-32-le"), np.uint32) == 10)

    def _braces(self) -> list[dict]:
        """IDX-4 + IDX-5: declarations with the event that ends or opens them, as :func:`symbols.brace_candidates` has them."""
        if not self.declared:
            return []
        moving = {*_lines_with("{", self.whole, self.ends), *_lines_with("}", self.whole, self.ends)}
        delta = {i: moved for i in moving if i < self.n and (moved := self.code[i].count("{") - self.code[i].count("}"))}
        open_headers = any(i not in delta and ";" not in self.code[i] for i in self.declared)
        semis = {i for i, c in enumerate(self.code) if ";" in c} if open_headers else {i for i in self.declared if ";" in self.code[i]}
        before, depth = {}, 0
        kept = sorted({*delta, *semis, *self.declared})
        for i in kept:
            before[i] = depth
            depth += delta.get(i, 0)
        rows, event, body_end = [], None, None
        nearest: dict[int, int] = {}  # of each depth the next line below that comes to it
        for i in reversed(kept):
            moved = delta.get(i, 0)
            if moved or i in semis:
                event, body_end = i, nearest.get(before[i]) if moved > 0 else None
            if moved:
                nearest[before[i] + moved] = i
                if moved > 0:
                    nearest[before[i]] = i
            if i in self.declared:
                name, kind = self.declared[i]
                rows.append({
                    "line_no": i + 1, "level": before[i], "name": name, "kind": kind, "signature": _signature(self.raw[i]),
                    "event_line": None if event is None else event + 1, "event_delta": None if event is None else delta.get(event, 0),
                    "event_semi": event in semis, "body_end": None if body_end is None else body_end + 1})
        return rows[::-1]

    def _indents(self) -> list[dict]:
        """IDX-4 + IDX-6: declarations and the lines that can end a block, as :func:`symbols.indent_candidates` has them."""
        rows, prev, last_other, run_text, decorators = [], None, 0, None, "@" in self.whole
        in_run = False
        for i, c in enumerate(self.code):
            run_line, text_before = last_other + 1, run_text
            decorator = decorators and "@" in c and _PY_DECORATOR.first(c) is not None
            if not decorator:
                last_other = i + 1
            elif not in_run:
                run_text = _signature(self.raw[i])
            in_run = decorator
            if not c.strip(WHITESPACE):
                continue
            level, decl = len(c) - len(c.lstrip(" \t")), self.declared.get(i)
            if decl or (prev and (level < prev[1] or prev[2])):
                rows.append({
                    "line_no": i + 1, "level": level, "name": decl and decl[0], "kind": decl and decl[1],
                    "signature": _signature(self.raw[i]) if decl else None, "prev_line": prev and prev[0],
                    "decorated_from": run_line, "decorated_text": text_before,
                    "one_liner": bool(decl and ":" in c and c.rpartition(":")[2].strip(WHITESPACE))})
            prev = (i + 1, level, decl)
        for row in rows:
            row["tail_line"] = prev[0]
        return rows

    def items(self) -> list[tuple]:
        return list(self.found.rows()) if self.found else []

    def imports(self) -> list[tuple[int, str]]:
        """IDX-11: (line, target)."""
        if "import" not in self.text and "require" not in self.text:
            return []
        out = []
        for i, raw in enumerate(self.raw):
            if "import" not in raw and "require" not in raw:
                continue
            if self.python:
                found = _PY_FROM_IMPORT.every(self.code[i]) + _PY_IMPORT.every(self.code[i])
            elif self.language == "java":
                found = _JAVA_IMPORT.every(raw)
            elif self.language == "go":
                found = _GO_IMPORT.every(raw)
            else:
                found = _JS_IMPORT_FROM.every(raw) + _JS_IMPORT_BARE.every(raw) + _JS_REQUIRE.every(raw)
            out += [(i + 1, target) for x in found if (target := x.strip(WHITESPACE))]
        return out

    def calls(self) -> tuple[list[str], np.ndarray]:
        """IDX-12: callee texts and their lines."""
        if "(" not in self.whole:
            return [], np.zeros(0, np.int64)
        pattern, noise, names, ends = _CALLS[self.python].on(self.whole), _NOISE[self.python], [], []
        for match in pattern.finditer(_plain(self.whole)):
            names.append(match[0])
            ends.append(match.end())

        def callee(found: str) -> str | None:
            name = "".join(found[:-1].split())
            simple = name.rpartition(".")[2]
            return None if (simple if self.python else simple.lower()) in noise else name

        callees = {found: callee(found) for found in set(names)}
        names = [callees[found] for found in names]
        lines = np.searchsorted(self.ends, np.asarray(ends, np.int64)) + 1
        keep = (lines <= self.n) & np.fromiter((name is not None for name in names), bool, len(names))
        if self.python:
            docs = np.zeros(max(self.n, int(lines.max(initial=0))) + 1, bool)
            mask = _docstring_lines(self.text)[:len(docs) - 1]
            docs[1:len(mask) + 1] = mask
            keep &= ~docs[lines]
            if self.strict:  # a Python header is not a call of its own name
                own = self.declared
                keep &= np.fromiter((own.get(line - 1, (None,))[0] != name for line, name in zip(lines.tolist(), names)), bool, len(names))
        elif self.found:  # a declaration header of a brace language is not a call site
            headers = np.zeros(max(self.n, int(lines.max(initial=0))) + 2, bool)
            headers[[s[3] for s in self.found.symbols]] = True
            keep &= ~headers[lines]
        if not keep.all():
            names = [name for name, kept in zip(names, keep.tolist()) if kept]
        return names, lines[keep]

    def dynamic(self) -> np.ndarray:
        """IDX-13: a flag a line, from 1."""
        out = np.zeros(self.n + 1, bool)
        pattern, tried = _DYNAMIC[self.python], set()
        for word in _DYNAMIC_WORDS[self.python]:
            tried |= _lines_with(word, self.whole, self.ends)
        for i in tried:
            if i < self.n:
                out[i + 1] = pattern.first(self.code[i]) is not None
        return out

    def references(self) -> tuple[list[str], list[str], list[str | None], list[int], list[bool]]:
        """(target, kind, owner, line, is_dynamic) as lists: imports first."""
        imports, (names, lines) = self.imports(), self.calls()
        at = np.concatenate([np.asarray([line for line, _ in imports], np.int64), lines])
        if self.found:
            owner, ordered = self.found.owners()
            owners = [None, *(s[0] for s in ordered)]
            by = [owners[k] for k in owner[at].tolist()]
        else:
            by = [None] * len(at)
        flags = self.dynamic()[lines].tolist() if names else []
        kinds = ["import"] * len(imports) + ["call"] * len(names)
        return [x for _, x in imports] + names, kinds, by, at.tolist(), [False] * len(imports) + flags

    def _import_like(self, i: int) -> bool:
        raw, code = self.raw[i], self.code[i]
        if self.python:
            text = code.strip(WHITESPACE)
            return not text or text[0] == "#" or bool(_PY_FROM_IMPORT.first(code) or _PY_IMPORT.first(code))
        text = raw.strip(WHITESPACE)
        return not text or text.startswith(("package ", "using ", "#include", "//", "*", "/*")) or any(
            p.first(raw) for p in (_JAVA_IMPORT, _JS_IMPORT_FROM, _JS_IMPORT_BARE, _GO_IMPORT))

    def _has_meaning(self, i: int) -> bool:
        return bool(self.code[i].strip(WHITESPACE) if self.python else _MEANING.search(self.code[i]))

    def blocks(self) -> list[dict]:
        """IDX-9: blocks and gaps by line; a gap without meaning is dropped."""
        if not self.n:
            return []
        items = sorted(((start, end, item == "gap", kind, name, parent) for item, _, name, kind, parent, start, end, _ in self.items() if item in ("block", "gap")),
                       key=lambda b: b[:3]) if self.found else [(1, self.n, True, None, None, None)]
        out = []
        for start, end, gap, kind, name, parent in items:
            if gap and not any(self._has_meaning(i) for i in range(start - 1, min(end, self.n))):
                continue
            if gap and name is None:
                kind = "imports" if all(self._import_like(i) for i in range(start - 1, min(end, self.n))) else "module"
            out.append({"start": start, "end": end, "kind": kind, "name": name, "parent": parent})
        return out


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """Identity and text of one file at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            *ids, content = (column[row].as_py() for column in batch.columns)
            yield tuple(ids), content


def _scanner(strict: bool):
    kinds = [(name, {"int": pa.int32(), "boolean": pa.bool_()}.get(kind, pa.string())) for name, kind in (c.split() for c in SCAN_SCHEMA.split(", "))]
    schema = pa.schema(kinds)

    def leave(ids: list[tuple], counts: list[int], columns: list[list]) -> Iterator[pa.RecordBatch]:
        at = pa.array(np.repeat(np.arange(len(ids)), counts))
        identity = [pa.array([x[k] for x in ids], pa.string()).take(at) for k in range(4)]
        whole = pa.RecordBatch.from_arrays(identity + [pa.array(c, t) for c, (_, t) in zip(columns, kinds[4:])], schema=schema)
        for start in range(0, whole.num_rows, BATCH_ROWS):
            yield whole.slice(start, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, columns, seen = [], [], [[] for _ in kinds[4:]], 0
        for identity, content in texts(batches):
            file = File(content, identity[3], strict)
            items = file.items()
            targets, sorts, owners, lines, flags = file.references()
            n = len(targets)
            item, seq, name, kind, parent, start, end, text, dynamic = columns
            if items:
                for column, values in zip(columns, zip(*items)):
                    column.extend(values)
                dynamic.extend([None] * len(items))
            item.extend(["reference"] * n)
            seq.extend(range(n))
            name.extend(targets)
            kind.extend(sorts)
            parent.extend(owners)
            start.extend(lines)
            end.extend([None] * n)
            text.extend([None] * n)
            dynamic.extend(flags)
            ids.append(identity)
            counts.append(n + len(items))
            seen += len(content or "")
            if seen >= BATCH_CHARS or len(item) >= BATCH_ROWS:
                yield from leave(ids, counts, columns)
                ids, counts, columns, seen = [], [], [[] for _ in kinds[4:]], 0
        if ids:
            yield from leave(ids, counts, columns)

    return run


def capable(files: DataFrame) -> DataFrame:
    """The files that a scan reads, as :func:`texts` takes them."""
    return files.filter(F.col("language").isin(*SYMBOL_LANGUAGES)).select("project_id", "file_id", "path", "language", "content")


def scan(files: DataFrame, strict: bool = False) -> DataFrame:
    """All items and references of the symbol-capable files, with their path, where their text is read; nothing is moved or stored.

    :func:`symbols.structure` and :func:`references.references_of` take these rows in place of files.
    """
    return capable(files).mapInArrow(_scanner(strict), SCAN_SCHEMA)


def scan_once(files: DataFrame, strict: bool = False) -> DataFrame:
    """:func:`scan`, written once in buckets by file: texts are dealt by file before they are read, so only they move."""
    tasks = task_count(files)
    return dealt_by_file(scan(files.repartition(tasks, "file_id"), strict), tasks, moved=True)
