"""Python source to rows: one row per function with its counts, or one row per file that does not parse.

Everything about one function is produced together, so metrics need no shuffle. A function's
body is held as parts, runs of whole statements that are counted once; a batch adds up the
counts of its functions' parts in numpy. Statements leave the parser as an array of facts only
where they are asked for.

A part of a top-level function that was parsed in one file is known in the next: a file whose
parts are all known is not parsed again. This is exact. A part begins with the indentation of
its block and holds whole statements, so its tokens do not depend on what stands around it, and
only else, elif, except and finally could go on with the statement before, with which no part
begins. What is known was read off a file that parsed.
"""

from __future__ import annotations

import ast
import gc
import keyword
import re
import warnings
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: depth: blocks around the statement, where the block of an elif is that of its if; in_star: inside an except* statement; in_star_handler: in a handler of one.
STATEMENT = {
    "node": "string", "is_top": "boolean", "is_docstring": "boolean", "is_scope": "boolean", "lineno": "int", "col": "int", "end_lineno": "int",
    "n_handlers": "int", "n_cases": "int", "depth": "int", "in_star": "boolean", "in_star_handler": "boolean",
}
FUNCTION = {
    "path": "string", "fn_ord": "int", "qualified_name": "string", "name": "string", "kind": "string", "container": "string", "is_async": "boolean", "lineno": "int", "col": "int", "end_lineno": "int",
    "n_arguments": "int", "first_param": "string",
}
#: Counted over a function's statements; the deepest statement is the first of its depth, and depth 0 is the function's own place.
COUNTS = {"max_depth": "int", "depth_line": "int", "depth_col": "int", "sloc": "int", "branches": "int", "n_statements": "int", "n_top_statements": "int"}
ERROR = {"error_lineno": "int", "error": "string"}
STATEMENTS = f"statements array<struct<{', '.join(f'{k}: {t}' for k, t in STATEMENT.items())}>>"
#: Functions and new statements that are handed on together, about.
BATCH = 1 << 15
#: Characters of parts that are kept to be known again, and numbers of statements, about.
KNOWN = 1 << 22
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
#: Statements that hold blocks of their own.
_COMPOUND = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match))


#: Numbers of a statement as collected: number of its class, flags (bits in this order), place, counts, depth.
_NUMBERS = ("node", "flags", "lineno", "col", "end_lineno", "n_handlers", "n_cases", "depth")
_FLAGS = ("is_top", "is_docstring", "is_scope", "in_star", "in_star_handler")
_KINDS = sorted(ast.stmt.__subclasses__(), key=lambda c: c.__name__)
_CODES = {kind: k for k, kind in enumerate(_KINDS)}


#: What a statement adds to the branches: one, its handlers or its cases.
_BRANCHING = frozenset(_CODES[kind] for kind in (ast.If, ast.For, ast.AsyncFor, ast.While))
_TOP, _DOCSTRING, _SCOPE, _STAR, _STAR_HANDLER = (1 << bit for bit in range(len(_FLAGS)))


def _count(numbers: list[tuple[int, ...]], start: int) -> tuple[int, ...]:
    """(statements, top statements, SLOC, branches, depth, line, column) of statements in source order; the line is told from start, as line 1.

    SLOC are distinct lines of the top-level statements; a nested scope counts its first line, the docstring none.
    Branches leave out handlers of except*, and the deepest statement is not looked for inside except* statements.
    """
    top = sloc = branches = depth = line = col = 0
    last = start - 1
    for node, flags, lineno, column, end, n_handlers, n_cases, deep in numbers:
        if flags & _TOP:
            top += 1
            if not flags & _DOCSTRING:
                until = lineno if flags & _SCOPE else end
                sloc += max(until - max(lineno - 1, last), 0)
                last = max(last, until)
        if not flags & _STAR_HANDLER:
            if node in _BRANCHING:
                branches += 1
            elif node == _CODES[ast.Try]:
                branches += n_handlers
            elif node == _CODES[ast.Match]:
                branches += n_cases
        if deep > depth and not flags & _STAR:
            depth, line, col = deep, lineno - start + 1, column
    return len(numbers), top, sloc, branches, depth, line, col


class Parts:
    """Parts by number: lines of text, last line of a statement, counts, statements with lines from 1. Part 0 is empty."""

    def __init__(self):
        self.counted = array("i", [0] * 9)
        self.statements = array("i")
        #: numbers of parts by text; and of first parts, with the number of arguments and the first of them, by the text around the function's name
        self.known: dict[str, int] = {}
        self.heads: dict[tuple[str, str], tuple[int, int, str | None]] = {}
        #: texts of pieces of a module without functions
        self.plain: set[str] = set()
        self.held = 0

    def add(self, numbers: list[tuple[int, ...]], start: int, lines: int, last: int) -> int:
        self.counted.extend((lines, last - start + 1, *_count(numbers, start)))
        for node, flags, lineno, col, end, *rest in numbers:
            self.statements.extend((node, flags, lineno - start + 1, col, end - start + 1, *rest))
        return len(self.counted) // 9 - 1


class Rows:
    """Rows to come: what is told of each function or error, and the numbers of its parts."""

    def __init__(self, parts: Parts | None = None, statements: bool = True):
        self.parts = parts or Parts()
        self.with_statements = statements
        self.before = len(self.parts.statements) // len(_NUMBERS)
        self.told: list[tuple] = []
        self.part = array("i")
        self.first = array("i")

    def __len__(self) -> int:
        new = len(self.part) if self.with_statements else 0
        return len(self.told) + new + len(self.parts.statements) // len(_NUMBERS) - self.before

    @property
    def ends(self) -> list[int]:
        """Where the statements of each row end, from 0."""
        return [0, *np.cumsum(self._sums()["n"]).tolist()]

    def add(self, told: tuple, parts: list[int]) -> None:
        """A row: the columns of _TOLD and the numbers of its parts, in order."""
        self.told.append(told)
        self.first.append(len(self.part))
        self.part.extend(parts)

    def _sums(self) -> dict[str, np.ndarray]:
        """Of each row, the sums over its parts, the deepest statement's place and the line of its end; of each part, its number and first line less one."""
        part, first = np.array(self.part, np.int64), np.array(self.first, np.int64)
        lines, last, n, top, sloc, branches, depth, line, col = np.array(self.parts.counted, np.int64).reshape(-1, 9)[part].T
        sizes = np.diff(first, append=len(part))
        lineno = np.array([x[_LINENO] or 0 for x in self.told], np.int64)
        above = np.cumsum(lines) - lines
        above += np.repeat(lineno - 1 - above[first], sizes)
        # the greatest depth, of equals the first part
        best = np.maximum.reduceat(depth * len(part) + len(part) - 1 - np.arange(len(part)), first)
        best = len(part) - 1 - best % len(part)
        flat, column = depth[best] == 0, np.array([x[_LINENO + 1] or 0 for x in self.told], np.int64)
        total = lambda x: np.add.reduceat(x, first)
        return {
            "n": total(n), "top": total(top), "sloc": total(sloc), "branches": total(branches), "depth": depth[best], "line": np.where(flat, lineno, line[best] + above[best]),
            "col": np.where(flat, column, col[best]), "end": (above + last)[first + sizes - 1], "part": part, "above": above,
        }

    def batch(self) -> pa.RecordBatch:
        sums = self._sums()
        columns = dict(zip(_TOLD, zip(*self.told))) if self.told else dict.fromkeys(_TOLD, ())
        failed = np.array([x is not None for x in columns["error"]], bool)
        arrays = {k: pa.array(columns[k], _ARROW[t]) for k, t in (FUNCTION | ERROR).items() if k in columns}
        for k, of in _SUMS.items():
            arrays[k] = pa.array(sums[of].astype(np.int32), mask=failed)
        if self.with_statements:
            arrays["statements"] = self._lists(sums)
        names = columns_of(self.with_statements)
        return pa.RecordBatch.from_arrays([arrays[k] for k in names], names=names)

    def _lists(self, sums: dict[str, np.ndarray]) -> pa.ListArray:
        sizes = np.array(self.parts.counted, np.int64).reshape(-1, 9)[:, 2]
        starts, mine = np.cumsum(sizes) - sizes, sizes[sums["part"]]
        place = np.repeat(starts[sums["part"]] - (np.cumsum(mine) - mine), mine) + np.arange(mine.sum())
        numbers = dict(zip(_NUMBERS, np.array(self.parts.statements, np.int32).reshape(-1, len(_NUMBERS))[place].T.copy()))
        above = np.repeat(sums["above"], mine).astype(np.int32)
        numbers["lineno"] += above
        numbers["end_lineno"] += above
        columns = {k: pa.array(v) for k, v in numbers.items()}
        columns["node"] = pa.DictionaryArray.from_arrays(columns["node"], [kind.__name__ for kind in _KINDS]).dictionary_decode()
        columns |= {k: pa.array(numbers["flags"] >> bit & 1 == 1) for bit, k in enumerate(_FLAGS)}
        items = pa.StructArray.from_arrays([columns[k] for k in STATEMENT], names=list(STATEMENT))
        return pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sums["n"])], pa.int32()), items)


def columns_of(statements: bool) -> list[str]:
    return [*FUNCTION, *COUNTS, *(["statements"] if statements else []), *ERROR]


def schema(statements: bool) -> str:
    types = FUNCTION | COUNTS | ERROR
    return ", ".join(STATEMENTS if k == "statements" else f"{k} {types[k]}" for k in columns_of(statements))


#: Columns that a row is told with; the others are summed up from its parts.
_TOLD = (*(k for k in FUNCTION if k != "end_lineno"), *ERROR)
_LINENO = _TOLD.index("lineno")
_SUMS = {"end_lineno": "end", "max_depth": "depth", "depth_line": "line", "depth_col": "col", "sloc": "sloc", "branches": "branches", "n_statements": "n", "n_top_statements": "top"}


def _blocks(node: ast.stmt) -> Iterator[tuple[list[ast.stmt], int, bool]]:
    """(statements, levels deeper, is a handler) of each block inside a compound statement, in source order."""
    if isinstance(node, ast.Match):
        for case in node.cases:
            yield case.body, 1, False
        return
    yield node.body, 1, False
    for handler in getattr(node, "handlers", ()):
        yield handler.body, 1, True
    rest = getattr(node, "orelse", ())
    if rest:
        yield rest, int(not (isinstance(node, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If))), False
    if last := getattr(node, "finalbody", ()):
        yield last, 1, False


def _statements(body: list[ast.stmt], begins: bool) -> list[tuple[int, ...]]:
    """_NUMBERS of the statements of a function's body, or of some in a row; begins: the first may be the docstring."""
    first, numbers = body[0], []
    documented = begins and isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    add = numbers.append
    # explicit stack of (statement, depth, flags): generated code may nest deeper than the interpreter's own recursion
    todo = [(s, 0, _TOP) for s in reversed(body)]
    if documented:
        todo[-1] = (first, 0, _TOP | _DOCSTRING)
    while todo:
        node, depth, flags = todo.pop()
        kind = type(node)
        if kind not in _COMPOUND:
            add((_CODES[kind], flags | _SCOPE if kind in _SCOPES else flags, node.lineno, node.col_offset, node.end_lineno, 0, 0, depth))
            continue
        add((_CODES[kind], flags, node.lineno, node.col_offset, node.end_lineno, len(getattr(node, "handlers", ())), len(node.cases) if kind is ast.Match else 0, depth))
        flags &= _STAR | _STAR_HANDLER
        if kind is ast.TryStar:
            flags |= _STAR
        inside = [(s, depth + deeper, flags | _STAR_HANDLER if of_handler and kind is ast.TryStar else flags) for block, deeper, of_handler in _blocks(node) for s in block]
        todo.extend(reversed(inside))
    return numbers


def _functions(tree: ast.Module) -> Iterator[tuple[str, str, str | None, ast.stmt]]:
    """(qualified name, kind, container, node), depth first in source order. Only def and class bodies are entered."""
    todo = [(s, "", "function") for s in reversed(tree.body)]
    while todo:
        node, prefix, kind = todo.pop()
        if not isinstance(node, _SCOPES):
            continue
        name = f"{prefix}.{node.name}" if prefix else node.name
        if isinstance(node, _FUNCTIONS):
            yield name, kind, prefix or None, node
        inner = "nested" if isinstance(node, _FUNCTIONS) else "method"
        todo.extend((s, name, inner) for s in reversed(node.body))


#: Where a line of a block begins a statement, of the module and of a body with so many spaces.
_NEXT = r"(?![ #\n)\]}]|el|ex|fi)"
_MODULE = re.compile(rf"\n(?={_NEXT}.)")
_BODY = [re.compile(rf"\n(?= {{{n}}}{_NEXT}.)") for n in range(33)]
_DEF = re.compile(r"def ([A-Za-z_][A-Za-z_0-9]*)(?=\()")
#: Its first line after the header.
_INSIDE = re.compile(r"\n( +)(?=[^ #\n])")
#: Texts with these are always parsed: they change what a line or its indentation is.
_UNUSUAL = re.compile(r"[\r\f\t\\]")


def _cut(text: str) -> tuple[str, tuple[str, str], list[str]] | None:
    """A piece of a module as (name of its function, text around the name up to the end of the first part, later parts), if it looks like a function."""
    named, inside = _DEF.match(text), _INSIDE.search(text)
    if named is None or inside is None or keyword.iskeyword(named[1]) or len(inside[1]) >= len(_BODY):
        return None
    header, *body = _BODY[len(inside[1])].split(text.rstrip("\n"))
    return (named[1], (header[named.end() :], body[0]), body[1:]) if body else None


def _recall(path: str | None, text: str, rows: Rows) -> bool:
    """Add the functions of a file whose every part is known, if so."""
    found, line, known = [], 1, rows.parts.known
    for piece in _MODULE.split(text.rstrip("\n")):
        if piece in rows.parts.plain:
            line += piece.count("\n") + 1
            continue
        cut = _cut(piece)
        head = cut and rows.parts.heads.get(cut[1])
        if head is None:
            return False
        parts = [head[0], *map(known.get, cut[2])]
        if None in parts:
            return False
        found.append(((path, len(found), cut[0], cut[0], "function", None, False, line, 0, head[1], head[2], None, None), parts))
        line += piece.count("\n") + 1
    for x in found:
        rows.add(*x)
    return True


def _arguments(node: ast.stmt) -> tuple[int, str | None]:
    a = node.args
    named = [x.arg for x in (*a.posonlyargs, *a.args)]
    return len(named) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None), named[0] if named else None


def _learn(node: ast.stmt, text: str, parts: Parts) -> list[int] | None:
    """The parts of a function that is all of a piece of its module, from its text; None if they are not whole statements."""
    cut = _cut(text)
    if cut is None or node.body[-1].end_lineno != node.end_lineno or any(isinstance(s, _SCOPES) for s in node.body):
        return None
    name, (header, first), later = cut
    start, runs, k = node.lineno + header.count("\n") + 1, [], 0
    if node.body[0].lineno != start:
        return None
    for part in (first, *later):
        end, begin = start + part.count("\n"), k
        while k < len(node.body) and node.body[k].lineno <= end:
            if node.body[k].lineno < start or node.body[k].end_lineno > end:
                return None
            k += 1
        if begin == k:
            return None
        runs.append((part, start, end, node.body[begin:k]))
        start = end + 1
    if k < len(node.body):
        return None
    numbers = []
    for place, (part, start, end, body) in enumerate(runs):
        told = parts.heads.get((header, first), (None,))[0] if place == 0 else parts.known.get(part)
        if told is None:
            start = start if place else node.lineno
            told = parts.add(_statements(body, place == 0), start, end - start + 1, body[-1].end_lineno)
            if place == 0:
                parts.heads[header, first] = (told, *_arguments(node))
                parts.held += len(header)
            else:
                parts.known[part] = told
            parts.held += len(part)
        numbers.append(told)
    return numbers


def _pieces(tree: ast.Module, text: str, parts: Parts) -> dict[int, str]:
    """Texts of the module's pieces by first line, of those that hold one plain function. Whole pieces without functions are known from now on."""
    if _UNUSUAL.search(text):
        return {}
    out, line, k = {}, 1, 0
    for piece in _MODULE.split(text.rstrip("\n")):
        end, begin = line + piece.count("\n"), k
        while k < len(tree.body) and tree.body[k].lineno <= end:
            k += 1
        nodes = tree.body[begin:k]
        whole = all(line <= s.lineno and s.end_lineno <= end for s in nodes) and (nodes or piece.lstrip()[:1] in ("", "#"))
        if whole and not any(isinstance(s, _SCOPES) for s in nodes):
            parts.held += 0 if piece in parts.plain else len(piece)
            parts.plain.add(piece)
        elif whole and len(nodes) == 1 and type(nodes[0]) is ast.FunctionDef and not nodes[0].decorator_list and nodes[0].lineno == line:
            out[line] = piece
        line = end + 1
    return out


def parse(path: str | None, content: bytes | str | None, rows: Rows) -> None:
    """Add the rows of one file. Null content counts as empty; what does not decode or parse gives one error row."""
    try:
        text = content.decode("utf-8") if isinstance(content, bytes) else content or ""
        if _recall(path, text, rows):
            return
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        pieces, found = _pieces(tree, text, rows.parts), []
        for k, (name, kind, container, node) in enumerate(_functions(tree)):
            piece = pieces.get(node.lineno) if kind == "function" else None
            parts = _learn(node, piece, rows.parts) if piece is not None else None
            if parts is None:
                parts = [rows.parts.add(_statements(node.body, True), node.lineno, 0, node.end_lineno)]
            found.append(((path, k, name, node.name, kind, container, isinstance(node, ast.AsyncFunctionDef), node.lineno, node.col_offset, *_arguments(node), None, None), parts))
        for x in found:
            rows.add(*x)
        return
    except UnicodeDecodeError as e:
        error = (None, f"not UTF-8: {e.reason}")
    except SyntaxError as e:
        error = (e.lineno, e.msg)
    except (ValueError, RecursionError, MemoryError) as e:
        error = (None, f"{type(e).__name__}: {e}")
    rows.add((path, *[None] * (len(_TOLD) - 3), *error), [0])


def parse_sources(sources: DataFrame, statements: bool = False) -> DataFrame:
    """Parse (path, content) rows; content is binary (strict UTF-8) or text. Filter sources first: Spark cannot push a filter through Python. statements: with an array of each function's statements."""

    def run(batches):
        rows, collecting = Rows(statements=statements), gc.isenabled()
        gc.disable()  # trees hold no cycles, and searching them for some takes longer than parsing
        try:
            for b in batches:
                for some in (b.slice(k, 64) for k in range(0, b.num_rows, 64)):
                    for path, content in zip(some.column("path").to_pylist(), some.column("content").to_pylist()):
                        parse(path, content, rows)
                        full = rows.parts.held >= KNOWN or len(rows.parts.statements) >= KNOWN
                        if full or len(rows) >= BATCH:
                            if rows.told:
                                yield rows.batch()
                            rows = Rows(None if full else rows.parts, statements)
            if rows.told:
                yield rows.batch()
        finally:
            if collecting:
                gc.enable()

    return sources.select("path", "content").mapInArrow(run, schema(statements))


def functions(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error", "error_lineno")


def top_level_functions(parsed: DataFrame) -> DataFrame:
    """Functions that stand directly in their module."""
    return functions(parsed).where("kind = 'function'")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("path", F.col("error_lineno").alias("lineno"), F.col("error").alias("msg"))


def statements(parsed: DataFrame) -> DataFrame:
    """One row per statement, keyed by (path, fn_ord, ord), of sources parsed with statements."""
    rows = functions(parsed).select("path", "fn_ord", F.posexplode("statements").alias("ord", "s"))
    return rows.select("path", "fn_ord", "ord", "s.*")
