"""Functions of one file's text that are procedural by nature; they run in Arrow batches."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from typing import NamedTuple

import ahocorasick

from scanframe import tables

try:
    import re._parser as _parser
except ImportError:  # Python before 3.11
    import sre_parse as _parser

SNIPPET = 120
BLOCK_COMMENT_EXTS = (set(tables.SLASH_COMMENT_EXTS) - {".lua"}) | {".php", ".css", ".scss"}


class Hit(NamedTuple):
    """A finding without its file and place."""

    line: int
    type: str
    severity: str
    snippet: str
    description: str
    category: str
    analyzer: str


# ---------------------------------------------------------------- comments and strings


@cache
def _opaque(ext: str) -> re.Pattern | None:
    """Matches one comment or string literal of the dialect, closed or not."""
    parts = []
    if ext in tables.HASH_COMMENT_EXTS:
        parts.append(r"#[^\n]*")
    if ext in tables.SLASH_COMMENT_EXTS:
        parts.append(r"//[^\n]*")
    if ext == ".sql":
        parts.append(r"--[^\n]*")
    if ext in BLOCK_COMMENT_EXTS:
        parts.append(r"/\*[\s\S]*?(?:\*/|\Z)")
    for quote in ('"', "'"):
        parts.append(rf"(?P<triple{len(parts)}>{quote * 3})(?:\\[\s\S]?|(?!{quote * 3})[^\\])*(?:{quote * 3}|\Z)")
        parts.append(rf"{quote}(?:\\[\s\S]?|[^\\{quote}])*(?:{quote}|\Z)")
    if ext in tables.BACKTICK_EXTS:
        parts.append(r"`(?:\\[\s\S]?|[^\\`])*(?:`|\Z)")
    return re.compile("|".join(parts))


_VISIBLE = re.compile(r"[^\n]")


def blank(text: str, ext: str) -> str:
    """``text`` with comments and strings turned into spaces; lines stay where they are.

    The three quotes that open a long string leave one space.
    """

    def spaces(m: re.Match) -> str:
        return _VISIBLE.sub(" ", m[0][2:] if m.lastgroup else m[0])

    return _opaque(ext).sub(spaces, text)


def code_lines(text: str, ext: str) -> list[int]:
    """Indexes (from 0) of the lines that are not comments as a whole."""
    kept, inside = [], False
    hashed, slashed, blocks = ext in tables.HASH_COMMENT_EXTS, ext in tables.SLASH_COMMENT_EXTS, ext in BLOCK_COMMENT_EXTS
    for k, line in enumerate(map(str.strip, text.split("\n"))):
        if inside:
            if blocks and "*/" in line:
                inside = False
                if line.endswith("*/") and not line.startswith("*"):
                    kept.append(k)
        elif (hashed and line.startswith("#")) or ((slashed or ext == ".groovy") and line.startswith("//")):
            continue
        elif blocks and line.startswith("/*"):
            inside = "*/" not in line[2:] or line.count("/*") > line.count("*/")
        else:
            kept.append(k)
    return kept


# ---------------------------------------------------------------- rules


def needle(pattern: str) -> str:
    """A lower-case literal that every match of ``pattern`` starts with, or ''.

    Read off the parsed pattern, so escapes, quantifiers and alternations cannot fool it; one
    of under three characters is not worth a search.
    """
    out = []
    for op, value in _parser.parse(pattern, re.IGNORECASE | re.MULTILINE):
        if op is not _parser.LITERAL:
            break
        out.append(chr(value))
    return "".join(out).lower() if len(out) >= 3 and "".join(out).isascii() else ""


def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of ``pattern`` holds at least one, or none.

    Of the parts that every match must have, the one with the longest literals is taken; an
    alternation needs a literal from each of its branches.
    """

    def required(parts) -> set[str]:
        found, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value).lower()
                continue
            if run:
                found.append({run})
                run = ""
            if op is _parser.SUBPATTERN:
                found.append(required(value[-1]))
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                found.append(required(value[2]))
            elif op is _parser.BRANCH:
                branches = [required(b) for b in value[1]]
                found.append(set().union(*branches) if all(branches) else set())
        return max(found, key=lambda f: min(map(len, f), default=0), default=set())

    out = required(_parser.parse(pattern, re.IGNORECASE | re.MULTILINE))
    return tuple(sorted(out)) if out and min(map(len, out)) >= 3 and all(map(str.isascii, out)) else ()


class Rule(NamedTuple):
    name: str
    regex: re.Pattern
    severity: str
    category: str
    description: str
    needles: tuple[str, ...]
    credible: Callable[[str], bool] | None


#: Rule names whose quoted literal must not be a placeholder.
VALIDATED = (
    "Password Assignment", "DB Password", "API Secret", "API Key", "Secret Key", "Access Token",
    "Encryption Key", "Signing Key", "Master Key", "Hardcoded Credential",
)


def compile_rule(name: str, pattern: str, severity: str, category: str, description: str) -> Rule | None:
    """None for a pattern that does not compile: such a rule is left out."""
    try:
        regex = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
    except re.error:
        return None
    return Rule(name, regex, severity, category, description, needles(pattern), is_credible if name in VALIDATED else None)


class Rules(tuple):
    """Rules in order, and one automaton of all literals that their matches require.

    The automaton reads a text once, whatever the number of rules, and names those that may
    match; rules without such a literal always may.
    """

    @cached_property
    def _automaton(self) -> tuple[ahocorasick.Automaton | None, frozenset[int]]:
        of: dict[str, set[int]] = {}
        for k, rule in enumerate(self):
            for needle_ in rule.needles:
                of.setdefault(needle_, set()).add(k)
        automaton = ahocorasick.Automaton() if of else None
        for word, own in of.items():
            automaton.add_word(word, own)
        if of:
            automaton.make_automaton()
        return automaton, frozenset(k for k, rule in enumerate(self) if not rule.needles)

    def candidates(self, low: str) -> list[Rule]:
        """The rules that may match a text, given in lower case; in their order."""
        automaton, free = self._automaton
        found = set(free)
        for _, own in automaton.iter(low) if automaton else ():
            found |= own
        return [self[k] for k in sorted(found)]


def compile_rules(rows) -> Rules:
    return Rules(r for row in rows if (r := compile_rule(*row)))


@cache
def config_rules() -> Rules:
    return compile_rules(tables.CONFIG_RULES)


@cache
def secret_rules() -> Rules:
    from scanframe.secrets_family import SECRET_RULES

    return compile_rules(SECRET_RULES)


@cache
def language_rules(ext: str) -> Rules:
    return compile_rules(r[:5] for r in tables.LANGUAGE_RULES if ext in r[5].split())


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def scan_rules(text: str, rules: tuple[Rule, ...], analyzer: str = "pattern") -> Iterator[Hit]:
    """Every non-overlapping match of every rule, rule by rule."""
    own = rules if isinstance(rules, Rules) else Rules(rules)
    if not (may := own.candidates(text.lower())):
        return
    starts, lines = line_starts(text), text.split("\n")
    for rule in may:
        for m in rule.regex.finditer(text):
            if rule.credible is None or rule.credible(m[0]):
                n = bisect_right(starts, m.start())
                yield Hit(n, rule.name, rule.severity, lines[n - 1].strip()[:SNIPPET], rule.description, rule.category, analyzer)


# ---------------------------------------------------------------- placeholders


def is_placeholder(value: str) -> bool:
    v = value.strip().strip("'\"").lower()
    return (
        v in tables.PLACEHOLDERS
        or len(v) < 6
        or v[0] in "$%<{["
        or v[-1] in "}>]"
        or not v.strip("x*.·_-")
        or "{{" in value
        or "{%" in value
        or ("%" in v and len(v.replace("%s", "").replace("%d", "")) < 3)
    )


_QUOTED = re.compile(r"'([^'\n]{2,})'|\"([^\"\n]{2,})\"|`([^`\n]{2,})`")


def first_quoted(text: str) -> str | None:
    m = _QUOTED.search(text)
    return m[m.lastindex] if m else None


def is_credible(match: str) -> bool:
    value = first_quoted(match)
    return value is None or not is_placeholder(value)


# ---------------------------------------------------------------- tokens


class Token(NamedTuple):
    pos: int
    type: str
    value: str
    line: int
    col: int


@cache
def _token_regex() -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in tables.TOKEN_CLASSES))


def tokens(text: str) -> list[Token]:
    """Code tokens; comments, strings and white space are dropped. Lines and columns are those
    of the text, whatever was dropped before."""
    starts, out = line_starts(text), []
    for m in _token_regex().finditer(text):
        if not m.lastgroup.startswith(("COMMENT", "STRING", "NEWLINE", "SKIP")):
            n = bisect_right(starts, m.start())
            out.append(Token(len(out), m.lastgroup, m[0], n, m.start() - starts[n - 1]))
    return out


def scan_tokens(text: str, ext: str) -> list[Hit]:
    """Dangerous calls, then names that write markup and are assigned or called."""
    found, lines = tokens(text), text.split("\n")
    dangerous = {f: (s, c) for e, f, s, c in tables.DANGEROUS_CALLS if e == ext}
    hits = []
    for t in found:
        if t.type == "FUNCTION_CALL" and t.value in dangerous:
            severity, category = dangerous[t.value]
            hits.append(Hit(t.line, f"Lexer: {t.value}()", severity, lines[t.line - 1].strip()[:SNIPPET], f"Lexer detected dangerous function '{t.value}()'.", category, "lexer"))
    if ext in tables.BACKTICK_EXTS:
        for t, following in zip(found, found[1:], strict=False):
            if t.type == "IDENT" and t.value in tables.XSS_NAMES and following.value in ("=", "("):
                hits.append(Hit(t.line, f"Lexer: XSS sink '{t.value}'", "HIGH", lines[t.line - 1].strip()[:SNIPPET], f"Lexer detected XSS sink '{t.value}'.", "XSS", "lexer"))
    return hits


# ---------------------------------------------------------------- taint


@cache
def _taint(ext: str):
    sinks = [(label, re.compile(p), severity) for label, p, severity in tables.TAINT_SINKS[ext]]
    return tables.TAINT_SOURCES[ext], sinks, re.compile(tables.TAINT_ASSIGNMENTS[ext])


_WORDS = re.compile(r"\w+")


def scan_taint(text: str, ext: str) -> list[Hit]:
    """An ordered fold over the lines; the state maps tainted variables to their source line.

    A line's sinks are judged before its assignment. A sink reports the variable on the line
    that was tainted first, else the first source on it. A variable tainted anew keeps its
    place among the tainted ones. An assignment passes on the taint of every variable on its
    line, in their order.
    """
    if ext not in tables.TAINT_SOURCES:
        return []
    sources, sinks, assignment = _taint(ext)
    tainted: dict[str, int] = {}
    hits: dict[tuple[int, str, str], Hit] = {}
    for n, line in enumerate(map(str.strip, text.split("\n")), 1):
        if not line:
            continue
        words = set(_WORDS.findall(line))
        direct = [s for s in sources if s in line]
        culprit = next((v for v in tainted if v in words), None) or (direct[0] if direct else None)
        if culprit:
            for label, regex, severity in sinks:
                if (n, culprit, label) not in hits and regex.search(line):
                    origin = tainted.get(culprit, n)
                    told = f"Taint flow: untrusted value '{culprit}' (line {origin}) reaches dangerous sink '{label}' (line {n})."
                    hits[n, culprit, label] = Hit(n, f"Taint: {culprit} -> {label}", severity, line[:SNIPPET], told, "INJECTION", "taint")
        m = assignment.search(line)
        if m and m[1]:
            if direct:
                tainted[m[1]] = n
            for v, origin in list(tainted.items()):
                if v in words and v != m[1]:
                    tainted[m[1]] = origin
    return list(hits.values())


# ---------------------------------------------------------------- Python syntax trees

_UNTRUSTED_OBJECTS = ("request", "req", "input", "args", "params", "data", "form", "query", "json", "body", "headers", "cookies")
_UNTRUSTED_NAMES = (*_UNTRUSTED_OBJECTS, "argv", "sys", "environ", "getenv")
_SQL_CALLS = ("execute", "executemany", "executescript", "raw", "query", "execute_query", "execute_sql")
_ANYWHERE = ("0.0.0.0", "::")


def call_name(call: ast.Call) -> str:
    """The dotted name of what is called; what stands before an attribute of an expression is
    left out. '' where there is no name."""
    parts, at = [], call.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        parts.append(at.id)
    return ".".join(reversed(parts))


def _inputs(call: ast.Call) -> list[ast.expr]:
    return [*call.args, *(k.value for k in call.keywords)]


def _untrusted(e: ast.expr) -> bool:
    match e:
        case ast.Name(id=name):
            return name in _UNTRUSTED_NAMES
        case ast.Subscript(value=ast.Name(id=name)) | ast.Attribute(value=ast.Name(id=name)):
            return name in _UNTRUSTED_OBJECTS
        case ast.BinOp(op=ast.Add()):
            return _untrusted(e.left) or _untrusted(e.right)
        case ast.Call():
            return any(map(_untrusted, _inputs(e)))
    return False


def _dynamic(e: ast.AST) -> bool:
    """Whether a string is put together anywhere in the expression."""
    match e:
        case ast.JoinedStr() | ast.BinOp(op=ast.Add() | ast.Mod()):
            return True
        case ast.Call() if call_name(e).rpartition(".")[2] == "format":
            return True
    return any(map(_dynamic, ast.iter_child_nodes(e)))


def _keyword(call: ast.Call, name: str) -> ast.expr | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _is_constant(e: ast.expr | None, *values) -> bool:
    return isinstance(e, ast.Constant) and any(e.value is v or (isinstance(v, str) and e.value == v) for v in values)


def _call_hits(call: ast.Call) -> Iterator[tuple[str, str, str, str, str]]:
    """(type, severity, snippet, description, category) of one call."""
    name = call_name(call)
    if not name:
        return
    last, shown = name.rpartition(".")[2], f"{name}()"
    fed = any(map(_untrusted, _inputs(call)))
    if name in ("eval", "exec") and fed:
        yield f"AST: {shown} with user input", "CRITICAL", shown, f"{shown} called with untrusted input - code injection.", "INJECTION"
    if name in ("__import__", "importlib.import_module") and fed:
        yield "AST: Dynamic import with user input", "CRITICAL", shown, "Dynamic module import with untrusted input.", "INJECTION"
    if name in ("pickle.load", "pickle.loads"):
        yield "AST: pickle deserialization", "CRITICAL", "pickle.load()", "Pickle deserialization allows arbitrary code execution.", "DESERIALIZATION"
    if name == "yaml.load" and _keyword(call, "Loader") is None:
        yield "AST: yaml.load without SafeLoader", "HIGH", "yaml.load()", "yaml.load() without Loader=SafeLoader.", "DESERIALIZATION"
    if name in ("os.system", "os.popen"):
        yield f"AST: {name}", "HIGH", shown, f"{name} allows command injection. Use subprocess.run().", "INJECTION"
    if name.startswith("subprocess.") and _is_constant(_keyword(call, "shell"), True):
        yield "AST: subprocess with shell=True", "HIGH", "subprocess...(shell=True)", "subprocess with shell=True allows command injection.", "INJECTION"
    if name == "open" and fed:
        yield "AST: open() with user input", "HIGH", "open(...)", "File open with untrusted input - path traversal risk.", "TRAVERSAL"
    if name == "render_template_string":
        yield "AST: render_template_string", "CRITICAL", shown, "Jinja2 SSTI vulnerability.", "INJECTION"
    if name == "getattr" and fed:
        yield "AST: getattr with user input", "HIGH", "getattr(...)", "Dynamic attribute access with untrusted input.", "INJECTION"
    if name in ("marshal.load", "marshal.loads"):
        yield "AST: marshal deserialization", "CRITICAL", "marshal.load()", "Marshal deserialization allows arbitrary code execution.", "DESERIALIZATION"
    if (last.lower() in _SQL_CALLS or name in ("text", "sqlalchemy.text")) and any(map(_dynamic, _inputs(call))):
        told = f"{shown} builds its SQL from string formatting or concatenation - SQL injection risk. Use parameterized queries."
        yield "AST: SQL query via string formatting", "CRITICAL", ast.unparse(call)[:SNIPPET], told, "INJECTION"
    if "." in name and last in ("md5", "sha1"):
        weak = "md5" if "md5" in name else "sha1"
        yield f"AST: weak hash ({weak.upper()})", {"md5": "HIGH", "sha1": "MEDIUM"}[weak], shown, f"{shown} is cryptographically broken/deprecated. Use SHA-256+.", "CRYPTO"
    elif last == "new" and call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str):
        given = call.args[0].value
        weak = given.strip().lower().replace("-", "")
        if weak in ("md5", "sha1"):
            yield f"AST: weak hash ({weak.upper()})", {"md5": "HIGH", "sha1": "MEDIUM"}[weak], f'{name}("{given}")', f'{name}("{weak}") uses a broken/deprecated digest. Use SHA-256+.', "CRYPTO"
    if last in ("run", "serve", "create_server"):
        host = _keyword(call, "host")
        everywhere = _is_constant(host, *_ANYWHERE) if isinstance(host, ast.Constant) else any(_is_constant(a, *_ANYWHERE) for a in call.args)
        if everywhere:
            yield "AST: binds 0.0.0.0", "MEDIUM", ast.unparse(call)[:SNIPPET], "Service bound to 0.0.0.0 - exposed on all network interfaces.", "NETWORK"


def _assignment_hits(node: ast.Assign) -> Iterator[tuple[str, str, str, str, str]]:
    for target in node.targets:
        if not isinstance(target, ast.Name):
            continue
        if target.id == "DEBUG" and _is_constant(node.value, True):
            yield "AST: DEBUG = True", "HIGH", "DEBUG = True", "Django DEBUG mode enabled.", "CONFIG"
        value = node.value.value if isinstance(node.value, ast.Constant) else None
        if target.id.lower() in tables.CREDENTIAL_NAMES and isinstance(value, str) and not is_placeholder(value):
            told = f"Hardcoded credential '{target.id}' embedded in source code. Load it from environment/secret manager instead."
            yield f"AST: hardcoded {target.id}", "CRITICAL", f'{target.id} = "{"*" * min(len(value), 12)}"', told, "AUTH"


_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias)


def _inner(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a tree as ``ast.walk`` orders them, but without those that hold no other."""
    queue = [tree]
    for node in queue:
        for name in node._fields:
            value = getattr(node, name, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _LEAVES):
                    queue.append(child)
        yield node


def scan_python(text: str) -> list[Hit]:
    """Findings of a Python file's syntax tree, breadth first; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    hits = []
    for node in _inner(tree):
        found = _call_hits(node) if isinstance(node, ast.Call) else _assignment_hits(node) if isinstance(node, ast.Assign) else ()
        hits += [Hit(node.lineno, *h, "ast") for h in found]
    return hits


class Call(NamedTuple):
    line: int
    name: str
    args: list[str]
    fed: bool


def python_calls(text: str) -> list[Call]:
    """Every named call of a Python file: line, dotted name, argument texts, untrusted input."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and call_name(n)]
    return [Call(c.lineno, call_name(c), [ast.unparse(a)[:SNIPPET] for a in _inputs(c)], any(map(_untrusted, _inputs(c)))) for c in calls]


class TreeNode(NamedTuple):
    node_id: int
    parent_id: int
    type: str
    line: int
    text: str


#: Names that syntax-tree searches know for the node types of Python's own parser.
_TREE_TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition",
    "Call": "call", "BinOp": "binary_operator", "JoinedStr": "f_string", "Lambda": "arrow_function",
}


def python_tree(text: str) -> list[TreeNode]:
    """The syntax tree of a Python file as rows that name their parent; the root's is -1.

    Expressions and statements have their whole text, which searches look into.
    """
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = [line.encode() for line in text.split("\n")]

    def segment(n: ast.AST) -> str:
        own = lines[n.lineno - 1 : n.end_lineno]
        own[-1] = own[-1][: n.end_col_offset]
        own[0] = own[0][n.col_offset :]
        return b"\n".join(own).decode(errors="ignore")

    rows, queue = [], [(root, -1)]
    for node, parent in queue:
        k = len(rows)
        kind = _TREE_TYPES.get(type(node).__name__, type(node).__name__)
        shown = segment(node) if isinstance(node, (ast.expr, ast.stmt)) else ""
        rows.append(TreeNode(k, parent, kind, getattr(node, "lineno", 0), shown))
        queue += [(child, k) for child in ast.iter_child_nodes(node)]
    return rows
