"""Functions, calls and statements of source files.

Parsing needs a parser: Python files go through ``ast``, the others through brace matching, Arrow batch by
Arrow batch; everything after it is relational.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTIONS = "file string, language string, key string, name string, class_name string, line int, end_line int, is_constructor boolean, is_static boolean, params array<string>, calls array<struct<line:int,name:string,receiver:string,arguments:array<string>>>, statements array<struct<line:int,target:string,expr:string,call:string,returned:boolean>>"
#: Function heads by language: the first pair of groups that matched is (name, parameters).
_HEADS = {
    "go": re.compile(r"^\s*func\s*(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(([^)]*)\)"), "rust": re.compile(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
    "javascript": re.compile(r"\bfunction\s*\*?\s*(\w+)\s*\(([^)]*)\)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"),
    "php": re.compile(r"\bfunction\s+&?(\w+)\s*\(([^)]*)\)"), "kotlin": re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(([^)]*)\)"), "swift": re.compile(r"\bfunc\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
    "scala": re.compile(r"\bdef\s+(\w+)\s*(?:\[[^\]]*\]\s*)?\(([^)]*)\)"), "ruby": re.compile(r"^\s*def\s+(?:self\.)?(\w+[?!=]?)\s*(?:\(([^)]*)\))?"),
    "shell": re.compile(r"^\s*function\s+([\w-]+)()\s*(?:\(\s*\))?|^\s*(\w+)\s*\(\s*()\)"), "powershell": re.compile(r"(?i)^\s*(?:function|filter|workflow)\s+(?:\w+:)?([\w-]+)\s*(?:\(([^)]*)\))?")}
_HEADS["typescript"] = _HEADS["javascript"]
_GENERIC = re.compile(r"^[\w\s<>,*&:~\[\]@.]*?\b(\w+)\s*\(([^;{}()]*)\)\s*(?:const\s*|override\s*|noexcept\s*|throws\s+[\w, .]+|where\s+[^{;]*)*(?::[^;{}]*)?\s*(?:\{.*)?$")
_TYPES = re.compile(r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)|\bstruct\s+(\w+)\s*(?:<[^>]*>)?\s*(?:[:{]|$)|\b(?:enum\s+class|class|interface|object|trait|module|enum)\s+(\w+)")
_RECEIVER = re.compile(r"^\s*func\s*\(\s*(?:\w+\s+)?\*?(\w+)|\b(\w+)::~?\w+\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "else", "elif", "elsif", "do", "sizeof", "new", "synchronized", "using", "lock", "unless", "until", "foreach", "match"}
_CALL = re.compile(r"(?:\b(\w+)(?:\.|->|::))?\b(\w+)\s*\(")
_ANNOTATION = re.compile(r"@[\w.]+\s*\([^()]*\)")
_RETURN = re.compile(r"^\s*return\b\s*(.*?);?\s*$")
_ASSIGN = re.compile(r"^\s*(?:[\w<>\[\]*&:]+\s+)*?[*&$]?(\w+)\s*(?::=|=)(?!=)\s*(.+)$")
_DOUBLE, _SLASHES, _HASH = r"\"(?:\\.|[^\"\\\n])*\"", r"//[^\n]*|/\*.*?\*/", r"(?<![\w$\{&])#[^\n]*"
_SINGLE, _LETTER = r"'(?:\\.|[^'\\\n])*'", r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
_HIDDEN = {"rust": re.compile(f"{_DOUBLE}|{_LETTER}|{_SLASHES}", re.S)} | {x: re.compile(f"{_DOUBLE}|{_SINGLE}|{_HASH}", re.S) for x in ("ruby", "shell", "powershell")}
_HIDDEN_ELSE = re.compile(f"{_DOUBLE}|{_SINGLE}|{_SLASHES}", re.S)
#: What opens and closes a block of Ruby: a word that begins a line, or a ``do`` that ends it.
_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\s*(?:\|[^|]*\|)?\s*$")
_RUBY_CLOSE = re.compile(r"^\s*end\b")
#: Lines after which a body without a block ends.
_REACH, _REACH_SCALA = 200, 20


def split_arguments(text: str) -> list[str]:
    """Comma-separated parts outside brackets and quotes."""
    out, depth, quote, part = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()] if part.strip() else out


def parameter_names(text: str, language: str = "") -> list[str]:
    """Identifiers of a parameter list, whether the type comes first or last; in Go the name does."""
    names = []
    while "<" in text and (bare := re.sub(r"<[^<>]*>", "", text)) != text:
        text = bare
    for p in split_arguments(re.sub(r"'\w+\b(?!')", "", text)):
        p = p.split("=")[0].strip()
        word = re.findall(r"[A-Za-z_]\w*", p.split(":")[0] if ":" in p and "::" not in p else p)
        name = word and word[0 if language == "go" else -1]
        if name and name not in ("void", "self", "this"):
            names.append(name)
    return names


def python_functions(source: str) -> list[dict]:
    """Functions of a Python file; one that can't be parsed, or nests too deeply for the parser, has none."""
    try:
        return _python_functions(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


#: Fields that hold statements; only these can hold functions and classes.
_BODIES = frozenset(("body", "handlers", "orelse", "finalbody", "cases"))


def _walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk(), in its order, without contexts."""
    todo = [node]
    for n in todo:
        if type(n) in (ast.Name, ast.Constant):
            continue
        for f in n._fields:
            if f != "ctx":
                v = getattr(n, f, None)
                if isinstance(v, list):
                    todo += [x for x in v if isinstance(x, ast.AST)]
                elif isinstance(v, ast.AST):
                    todo.append(v)
    return todo


def _blocks(node: ast.AST) -> Iterator[ast.AST]:
    """The statements, handlers and cases right inside a node, in order."""
    for f in node._fields:
        if f in _BODIES and isinstance(v := getattr(node, f), list):
            yield from v


def _source(n: ast.AST) -> str:
    """ast.unparse(), with short ways for names, strings, attributes and calls of these, as most expressions are."""
    kind = type(n)
    if kind is ast.Name:
        return n.id
    if kind is ast.Constant and type(n.value) is str and n.kind is None:
        return repr(n.value)
    if kind is ast.Attribute and type(n.value) in (ast.Name, ast.Attribute, ast.Call):
        return f"{_source(n.value)}.{n.attr}"
    if kind is ast.Call and not n.keywords and type(n.func) in (ast.Name, ast.Attribute) and all(type(x) in (ast.Name, ast.Attribute, ast.Call) or (type(x) is ast.Constant and type(x.value) is str) for x in n.args):
        return f"{_source(n.func)}({', '.join(map(_source, n.args))})"
    return ast.unparse(n)


def _python_functions(tree: ast.AST) -> list[dict]:
    out = []

    def visit(node: ast.AST, owner: str) -> None:
        for child in _blocks(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
                calls, statements = [], []
                inside = _walk(child)
                for n in inside:
                    if isinstance(n, ast.Call):
                        f = n.func
                        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
                        receiver = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
                        if name:
                            calls.append({"line": n.lineno, "name": name[:100], "receiver": receiver, "arguments": [*map(_source, n.args)]})
                for n in sorted((n for n in inside if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return)) and n.__dict__.get("value") is not None), key=lambda n: n.lineno):
                    target = n.targets[0] if isinstance(n, ast.Assign) else getattr(n, "target", None)
                    inner = n.value if isinstance(n.value, ast.Call) else next((c for c in _walk(n.value) if isinstance(c, ast.Call)), None)
                    called = inner and (inner.func.attr if isinstance(inner.func, ast.Attribute) else getattr(inner.func, "id", None))
                    statements.append({"line": n.lineno, "target": target.id if isinstance(target, ast.Name) else None, "expr": _source(n.value), "call": called or None, "returned": isinstance(n, ast.Return)})
                static = any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in child.decorator_list)
                out.append({"name": child.name, "class_name": owner, "line": child.lineno, "end_line": child.end_lineno or child.lineno, "is_constructor": child.name == "__init__", "is_static": static, "params": params, "calls": calls, "statements": statements})
                visit(child, owner)
            else:
                visit(child, child.name if isinstance(child, ast.ClassDef) else owner)

    visit(tree, "")
    return out


def _hide(source: str, language: str) -> str:
    """The source with blanks in place of strings and comments; lines and columns stay."""
    return _HIDDEN.get(language, _HIDDEN_ELSE).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _block_ends(code: list[str], language: str) -> dict[int, int]:
    """The line on which the first block that a line opens is closed, in one pass over hidden lines."""
    ends, stack = {}, []
    for k, text in enumerate(code):
        if language == "ruby":
            if _RUBY_OPEN.search(text) and not re.search(r"\bend\s*$", text):
                stack.append(k)
            elif _RUBY_CLOSE.search(text) and stack:
                ends[stack.pop()] = k
            continue
        for c in re.findall(r"[{}]", text):
            if c == "{":
                stack.append(k)
            elif stack:
                ends[stack.pop()] = k  # the outermost of a line is closed last
    return ends


def _line_calls(line: str, code: str, at: int) -> list[dict]:
    """Calls of a line from a place on; arguments go to the bracket that closes them, or to the next one if the line has none."""
    closed, stack, out = {}, [], []
    for b in re.finditer(r"[()]", code):
        if b[0] == "(":
            stack.append(b.start())
        elif stack:
            closed[stack.pop()] = b.start()
    for c in _CALL.finditer(line, at):
        if c[2] not in _KEYWORDS and code[c.start(2) : c.end(2)] == c[2]:
            stop = closed.get(c.end() - 1)
            arguments = line[c.end() : stop] if stop is not None else re.match(r"[^()]*", line[c.end() : c.end() + 4096])[0]
            out.append({"name": c[2][:100], "receiver": c[1], "arguments": split_arguments(arguments)})
    return out


def brace_functions(source: str, language: str) -> list[dict]:
    """Functions by their heads and blocks, each with the innermost type that holds it.

    A block begins on one of the three lines from the end of the head. A function without one ends on its line if it has a body after
    ``=`` or an arrow or is a declaration, else 20 lines on in Scala and 200 lines on in other languages, or with the file.
    """
    lines = source.split("\n")
    code, head = _hide(source, language).split("\n"), _HEADS.get(language, _GENERIC)
    ends, out, types, last = _block_ends(code, language), [], [], len(lines) - 1

    def block(k: int) -> int | None:
        return next((ends.get(j, min(k + _REACH, last)) for j in range(k, min(k + 3, len(code))) if (_RUBY_OPEN.search(code[j]) if language == "ruby" else "{" in code[j])), None)

    for k, text in enumerate(code):
        if head is _GENERIC and "@" in text:
            text = _ANNOTATION.sub(lambda m: " " * len(m[0]), text)
        while types and types[-1][0] < k:
            types.pop()
        t = _TYPES.search(text)
        if t and (stop := block(k)) is not None:
            types.append((stop, t[1] or t[2] or t[3]))
        low = k
        if text.count("(") > text.count(")"):  # a list of parameters over several lines
            while low < min(k + 20, last) and text.count("(") > text.count(")"):
                low += 1
                text += " " + _ANNOTATION.sub("", code[low])
        m = head.search(text)
        if not m:
            continue
        name, params = next(((m[i], m[i + 1] or "") for i in range(1, (m.lastindex or 1) + 1, 2) if m[i]), (None, ""))
        rest = text[m.end(m.lastindex) :].lstrip(") ") if m.lastindex else ""
        if not name or name in _KEYWORDS or (head is _GENERIC and not any("{" in x for x in code[low : low + 2])):
            continue
        if language == "rust" and "{" not in rest and rest.rstrip().endswith(";"):
            continue  # a signature
        short = "{" not in rest and (rest.rstrip().endswith(";") or re.search(r"=>?\s*\S", rest))
        end = k if language != "ruby" and short else block(low)
        if end is None:
            end = min(k + (_REACH_SCALA if language == "scala" else _REACH), last)
        own = _RECEIVER.search(text) if language in ("go", "cpp") else None
        owner = (own[1] or own[2]) if own else types[-1][1] if types else ""
        calls, statements = [], []
        for j in range(k if low == k else low + 1, end + 1):
            at = m.end(m.lastindex or 0) if j == k else 0  # a body may begin on the head's line
            calls += [c | {"line": j + 1} for c in _line_calls(lines[j], code[j], at)]
            if j == k:
                continue
            a, called, back = _ASSIGN.match(lines[j]), _CALL.search(lines[j]), _RETURN.match(lines[j])
            if a or called or back:
                expr = back[1] if back else a[2] if a else lines[j].strip()
                statements.append({"line": j + 1, "target": a[1] if a and not back else None, "expr": expr, "call": called[2] if called and called[2] not in _KEYWORDS else None, "returned": bool(back)})
        static = bool(re.search(r"\bstatic\b", text[: m.end()])) or (language == "ruby" and "self." in text)
        built = bool(owner) and name in (owner, "constructor", "init", "initialize", "__construct")
        out.append({"name": name, "class_name": owner, "line": k + 1, "end_line": end + 1, "is_constructor": built, "is_static": static, "params": parameter_names(params, language), "calls": calls, "statements": statements})
    return out


def functions(files: DataFrame) -> DataFrame:
    """All functions of (path, language, content), keyed file::class.name@line."""
    names = [x.strip().split(" ")[0] for x in ("file", "language", "key", "name", "class_name", "line", "end_line", "is_constructor", "is_static", "params", "calls", "statements")]

    call = pa.struct([("line", pa.int32()), ("name", pa.string()), ("receiver", pa.string()), ("arguments", pa.list_(pa.string()))])
    statement = pa.struct([("line", pa.int32()), ("target", pa.string()), ("expr", pa.string()), ("call", pa.string()), ("returned", pa.bool_())])
    schema = pa.schema([("file", pa.string()), ("language", pa.string()), ("key", pa.string()), ("name", pa.string()), ("class_name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("is_constructor", pa.bool_()), ("is_static", pa.bool_()), ("params", pa.list_(pa.string())), ("calls", pa.list_(call)), ("statements", pa.list_(statement))])
    assert names == schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, content in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
                found = python_functions(content or "") if language == "python" else brace_functions(content or "", language or "")
                rows += [f | {"file": path, "language": language, "key": f"{path}::{f['class_name'] + '.' if f['class_name'] else ''}{f['name']}@{f['line']}"} for f in found]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "language", "content").mapInArrow(run, FUNCTIONS)


def call_sites(fns: DataFrame) -> DataFrame:
    """(src, file, line, name, receiver, arguments), a name once a line and function: its first call there."""
    rows = fns.select(F.col("key").alias("src"), "file", F.posexplode("calls").alias("_at", "c")).select("src", "file", "_at", "c.line", "c.name", "c.receiver", "c.arguments")
    return rows.groupBy("src", "file", "line", "name").agg(F.min_by(F.struct("receiver", "arguments"), "_at").alias("r")).select("src", "file", "line", "name", "r.receiver", "r.arguments")


def variables(fns: DataFrame) -> DataFrame:
    """(file, scope, name, line, assigned_from, is_param): parameters and assigned variables of functions, each at its first place."""
    own = fns.select("file", F.col("key").alias("scope"), F.col("line").alias("at"), F.explode("params").alias("name")).select("file", "scope", "name", F.col("at").alias("line"), F.lit(None).cast("string").alias("assigned_from"), F.lit(True).alias("is_param"))
    put = fns.select("file", F.col("key").alias("scope"), F.explode("statements").alias("s")).where("s.target IS NOT NULL").select("file", "scope", F.col("s.target").alias("name"), "s.line", F.col("s.expr").alias("assigned_from"), F.lit(False).alias("is_param"))
    return own.unionByName(put).groupBy("file", "scope", "name").agg(F.min_by(F.struct("line", "assigned_from", "is_param"), F.struct("line", F.col("is_param").cast("int"))).alias("r")).select("file", "scope", "name", "r.*")


def classes(files: DataFrame) -> DataFrame:
    """(file, line, name, parent) of class-like declarations."""
    from sentrel.sources.files import lines_of

    p = r"\b(?:class|interface|struct|trait)\s+(\w+)\s*(?:\(|extends\s+|:\s*(?:public\s+)?)?\s*(\w+)?"
    return lines_of(files).where(F.col("content").rlike(p)).select("file", "line", F.regexp_extract("content", p, 1).alias("name"), F.regexp_extract("content", p, 2).alias("parent"))
