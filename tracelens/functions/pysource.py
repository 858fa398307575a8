"""Facts of Python source and of recorded output, as plain functions that the code operators map over batches.

Source is parsed and decoded, never imported or run.
"""

from __future__ import annotations

import ast
import difflib
import io
import json
import re
import tokenize

from ..schemas import CONFIDENCE, DIAGNOSIS_ABSTENTION, OPERATIONS
from .text import GLYPHS

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Patterns of output lines and control sequences (fixed values).
_CONTROL = re.compile(r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]|\x1b[PX^_][^\x1b]*\x1b\\|\x1b[@-Z\\-_]")
_FRAME = re.compile(r'^\s*File "([^"]+)", line (\d+)(?:, in (.+))?')
_NOISE = re.compile(r"^\s*\[Previous line repeated \d+ more times\]|^\s*[\^~ ]+$")
_RAISED = re.compile(r"^([a-zA-Z_][a-zA-Z0-9_.]*)(?::\s*(.*))?$")


# --- decoding ---------------------------------------------------------------------------------------


def declared_encoding(raw: bytes) -> tuple[str | None, bool]:
    """(encoding by mark or cookie, whether there is a mark); the encoding is None if it is unknown or doesn't decode all."""
    marked = raw.startswith(b"\xef\xbb\xbf")
    try:
        name = "utf-8" if marked or not raw else tokenize.detect_encoding(io.BytesIO(raw).readline)[0].lower()
        raw.decode(name)
    except (SyntaxError, LookupError, UnicodeDecodeError):
        return None, marked
    return name, marked


def decode(raw: bytes) -> str:
    """Text by the declared encoding, without a mark; else as UTF-8 with replacement."""
    name, marked = declared_encoding(raw)
    raw = raw[3:] if marked else raw
    return raw.decode(name) if name else raw.decode("utf-8", "replace")


def fallback_glyphs(text: str, encoding: str) -> str:
    """Text that an output encoding can show: ASCII stand-ins for known glyphs, '?' for the rest, only where something doesn't fit."""
    try:
        text.encode(encoding)
        return text
    except (UnicodeEncodeError, LookupError):
        text = text.translate(str.maketrans(GLYPHS))
    try:
        return text.encode(encoding, "replace").decode(encoding)
    except LookupError:
        return text.encode("ascii", "replace").decode("ascii")


# --- diffs and JSON ---------------------------------------------------------------------------------


def unified_diff(before: str, after: str, name: str = "file.py", context: int = 3) -> str:
    if before == after:
        return ""
    path = (name or "file.py").replace("\\", "/")
    lines = list(difflib.unified_diff(before.splitlines(), after.splitlines(), f"a/{path}", f"b/{path}", n=context, lineterm=""))
    return "".join(f"{x}\n" for x in lines)


def is_edit(v: object) -> bool:
    texts, lines = ("expected_text", "replacement_text"), ("start_line", "end_line")
    return (
        isinstance(v, dict) and set(v) <= {"operation", *texts, *lines} and v.get("operation") in OPERATIONS
        and all(TYPES["integer"](v.get(k)) for k in lines) and all(isinstance(v.get(k, ""), str) for k in texts)
    )


#: Checks of the types that record schemas use.
TYPES = {
    "string": lambda v: isinstance(v, str), "string?": lambda v: v is None or isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "strings": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), "edits": lambda v: isinstance(v, list) and 1 <= len(v) <= 8 and all(map(is_edit, v)),
}
#: Fields of the closed record schemas: (type, required, allowed values).
SCHEMAS = {
    "diagnosis": {"bug_description": ("string", True, None), "root_cause": ("string", True, None), "confidence": ("string", True, CONFIDENCE), "cited_evidence_ids": ("strings", False, None), "rationale": ("string", True, None)},
    "edit_proposal": {"target_file": ("string", True, None), "edits": ("edits", True, None), "explanation": ("string", True, None)},
    "abstention": {"target": ("string", True, None), "reason": ("string", True, DIAGNOSIS_ABSTENTION), "details": ("string", True, None), "raw_payload": ("string?", False, None), "validation_errors": ("strings", False, None), "retry_attempted": ("boolean", False, None)},
}


def schema_errors(text: str, schema: str) -> list[str]:
    """What keeps a text from being one JSON object of a closed schema: syntax, missing and unknown fields, types, values."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return ["not JSON"]
    if not isinstance(value, dict):
        return ["not an object"]
    fields = SCHEMAS[schema]
    out = [f"missing {k}" for k, (_, needed, _) in fields.items() if needed and k not in value]
    out += [f"unknown {k}" for k in value if k not in fields]
    for k, (kind, _, allowed) in fields.items():
        if k in value and not TYPES[kind](value[k]):
            out.append(f"type of {k}")
        elif k in value and allowed and value[k] not in allowed:
            out.append(f"value of {k}")
    return out


# --- tracebacks -------------------------------------------------------------------------------------


def base(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


INDENT = (" ", "\t")


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines in runs: one that is not indented, and the indented ones after it. The first run may lack the former."""
    starts = [i for i, line in enumerate(lines) if i == 0 or not line.startswith(INDENT)]
    return [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)])]


def exception_of(run: list[str]) -> tuple[str, str] | None:
    """(type, message) of a run whose first line raises: all its other lines continue the message."""
    if run[0].startswith(INDENT) or _FRAME.match(run[0]) or _NOISE.match(run[0]) or not (m := _RAISED.match(run[0])):
        return None
    return m[1], " ".join(x for x in ((m[2] or ""), *map(str.strip, run[1:])) if x).strip()


def frames_of(lines: list[str], target: str) -> list[dict]:
    """Frames that lines tell of, each header with the indented lines up to the next; lines before the first header are of none."""
    heads = [(i, m) for i, line in enumerate(lines) if (m := _FRAME.match(line))]
    out = []
    for (i, m), end in zip(heads, [*(i for i, _ in heads[1:]), len(lines)]):
        ours = base(m[1]) == base(target)
        code = [x.strip() for x in lines[i + 1 : end] if x.startswith(INDENT) and not _NOISE.match(x)]
        out.append({"file": target if ours else m[1], "line": max(1, int(m[2])), "function": m[3] or "<module>", "code": "\n".join(code).strip(), "is_target": ours})
    return out


def parse_traceback(stderr: str, target: str) -> dict:
    """{frames, type, message, file, line} of captured error output; type is None without an exception.

    The output falls into stretches that end with an exception each, and a rest; each stretch has frames of its own. The last exception decides;
    without one the last line that, stripped, looks like one does. file and line are the last target frame's, else the last frame's.
    """
    lines = _CONTROL.sub("", stderr or "").splitlines()
    stretches: list[list[str]] = [[]]
    raised: list[tuple[str, str]] = []
    for run in paragraphs(lines):
        if found := exception_of(run):
            raised.append(found)
            stretches.append([])
        else:
            stretches[-1] += run
    frames = [f for s in stretches for f in frames_of(s, target)]
    if not raised:
        loose = [(m[1], (m[2] or "").strip()) for line in lines if (m := _RAISED.match(line.strip()))]
        raised = loose[-1:]
    if not raised:
        return {"frames": frames, "type": None, "message": None, "file": None, "line": None}
    top = max(enumerate(frames), key=lambda f: (f[1]["is_target"], f[0]), default=(0, {"file": target, "line": None}))[1]
    return {"frames": frames, "type": raised[-1][0], "message": raised[-1][1], "file": top["file"], "line": top["line"]}


# --- syntax trees -----------------------------------------------------------------------------------


def syntax_problem(source: str) -> dict | None:
    """{line, col, message} of the first syntax error, clamped to 1; None of source that parses."""
    try:
        ast.parse(source)
        return None
    except SyntaxError as e:
        return {"line": max(1, e.lineno or 1), "col": max(1, e.offset or 1), "message": e.msg or "invalid syntax"}
    except ValueError as e:
        return {"line": 1, "col": 1, "message": str(e)}


def first_line(node: ast.AST) -> int:
    return max(1, min([node.lineno, *(d.lineno for d in node.decorator_list)]))


def parameters(a: ast.arguments) -> list[str]:
    star = lambda prefix, arg: [prefix + arg.arg] if arg else []
    return [x.arg for x in (*a.posonlyargs, *a.args)] + star("*", a.vararg) + [x.arg for x in a.kwonlyargs] + star("**", a.kwarg)


def definitions(source: str) -> list[dict]:
    """Functions and classes, in the order of the file with a class after its members: module-level functions, methods, and nested
    classes; functions inside functions are left out. [] of source that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    total = len(source.splitlines())
    out: list[dict] = []

    def span(n: ast.AST) -> dict:
        start = first_line(n)
        return {"start": start, "end": min(total, max(start, n.end_lineno or start)) if total else start}

    def visit(body: list[ast.stmt], path: str) -> None:
        for n in body:
            if isinstance(n, FUNCTIONS):
                out.append({"kind": "function", "name": n.name, "qualified_name": path + n.name, **span(n), "parameters": parameters(n.args), "is_async": isinstance(n, ast.AsyncFunctionDef),
                            "is_method": bool(path), "docstring": ast.get_docstring(n), "methods": []})
            elif isinstance(n, ast.ClassDef):
                visit(n.body, f"{path}{n.name}.")
                out.append({"kind": "class", "name": path + n.name, "qualified_name": path + n.name, **span(n), "parameters": [], "is_async": False, "is_method": False, "docstring": None,
                            "methods": [m.name for m in n.body if isinstance(m, FUNCTIONS)]})

    visit(tree.body, "")
    return [{**d, "ordinal": i} for i, d in enumerate(out)]


LOOPS = {ast.For: "for", ast.AsyncFor: "async_for", ast.While: "while"}
BRANCHES = {ast.If: "if", ast.IfExp: "if_exp", ast.Match: "match", ast.Try: "try"}


def callee(f: ast.expr) -> str:
    match f:
        case ast.Name(id=x):
            return x
        case ast.Attribute(value=v, attr=a):
            return ".".join(filter(None, (callee(v), a)))
    return ""


def structure(source: str) -> list[dict]:
    """Rows of what stands in each function and method: (function, kind, label, start, end, depth, flag, count, pre, post).

    kind is loop, branch, call, return, comprehension or nested; flag tells a branch's else, a recursive call, a return's value; count a call's
    arguments; depth a loop's nesting; pre and post are preorder numbers, so that containment is a range.
    """
    rows: list[dict] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return rows
    functions = [(n, "") for n in tree.body if isinstance(n, FUNCTIONS)]
    functions += [(m, f"{c.name}.") for c in tree.body if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, FUNCTIONS)]
    for node, prefix in functions:
        names = {node.name, prefix + node.name, f"self.{node.name}"}
        clock = 0

        def walk(n: ast.AST, depth: int, top: ast.AST = node, own: set = names, where: str = prefix + node.name) -> None:
            nonlocal clock
            clock += 1
            row = {"function": where, "start": getattr(n, "lineno", 0), "end": getattr(n, "end_lineno", 0), "depth": 0, "flag": False, "count": 0, "pre": clock, "post": clock}
            kind = type(n)
            if kind in LOOPS:
                depth += 1
                row |= {"kind": "loop", "label": LOOPS[kind], "depth": depth}
            elif kind in BRANCHES:
                row |= {"kind": "branch", "label": BRANCHES[kind], "flag": kind is ast.IfExp or bool(getattr(n, "orelse", None))}
            elif kind is ast.Call:
                name = callee(n.func)
                row |= {"kind": "call", "label": name, "flag": name in own, "count": len(n.args) + len(n.keywords)}
            elif kind is ast.Return:
                row |= {"kind": "return", "label": "return", "flag": n.value is not None}
            elif kind in (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp):
                row |= {"kind": "comprehension", "label": kind.__name__}
            elif isinstance(n, FUNCTIONS) and n is not top:
                row |= {"kind": "nested", "label": n.name}
            if "kind" in row:
                rows.append(row)
            for child in ast.iter_child_nodes(n):
                walk(child, depth)
            row["post"] = clock

        walk(node, 0)
    return rows


def reads_input(call: ast.Call) -> bool:
    match call.func:
        case ast.Name(id="input"):
            return True
        case ast.Attribute(attr="read" | "readline" | "readlines", value=ast.Attribute(attr="stdin") | ast.Name(id="stdin")):
            return True
    return False


def input_needs(source: str) -> dict:
    """{requires, in_loop, count, prompts} of standard input."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return {"requires": False, "in_loop": False, "count": 0, "prompts": []}
    asks = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and reads_input(n)]
    looped = any(isinstance(n, ast.Call) and reads_input(n) for loop in ast.walk(tree) if type(loop) in LOOPS for n in ast.walk(loop))
    prompts = [c.args[0].value for c in asks if isinstance(c.func, ast.Name) and c.args and isinstance(c.args[0], ast.Constant) and isinstance(c.args[0].value, str)]
    return {"requires": bool(asks), "in_loop": looped, "count": len(asks), "prompts": prompts}
