"""Symbols, calls and imports of one source file: a lexer that knows strings and comments, and scopes over its tokens.

Python is read by its own syntax tree.  For Rust, TypeScript, JavaScript, Go, Java and C++ the
lexer drops comments and strings and pairs the brackets; one pass over the tokens then keeps
the scope of every bracket region (class, implementation, function, ...), which gives
declarations their span and parent and tells calls from declarations.  Lines count from 1.

Call types: ``direct``, ``method`` (behind a receiver), ``qualified`` (behind a path),
``macro`` and ``constructor``.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

_WORD = r"[^\W\d]\w*"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SIGNS = r"::|->|=>|\?\.|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\||[^\w\s]"
#: Literals by language, tried before words and signs.
_LITERALS = {
    "rust": r'b?r(?P<hash>#*)".*?"(?P=hash)|b?' + _QUOTED.replace("\\n", "") + r"|b?'(?:\\[^\n]{1,8}?|[^'\\\n])'|'[^\W\d]\w*",
    "go": rf"`[^`]*`?|{_QUOTED}|'(?:\\.|[^'\\\n])*'",
    "java": rf'""".*?"""|{_QUOTED}|' + r"'(?:\\.|[^'\\\n])*'",
    "cpp": r'(?:u8|[uUL])?R"(?P<raw>[^(\s]*)\(.*?\)(?P=raw)"|(?:u8|[uUL])?' + _QUOTED + r"|'(?:\\.|[^'\\\n])*'|^[ \t]*\#(?:\\\n|[^\n])*",
    "typescript": rf"{_QUOTED}|'(?:\\.|[^'\\\n])*'?",
}
_LITERALS["javascript"] = _LITERALS["typescript"]
_LEXERS = {lang: re.compile(rf"(?P<comment>{_COMMENT})|(?P<literal>{lit})|(?P<word>[#$]?[$\w]*[$\w])|(?P<sign>{_SIGNS})", re.S | re.M) for lang, lit in _LITERALS.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")

#: Words that never name what is called, and words that may stand before a declaration.
_COMMON = "if else for while do switch case return throw new delete typeof instanceof sizeof catch try finally this super const static import class enum interface function void constructor public private protected"
_RESERVED = {
    "rust": frozenset(f"{_COMMON} loop match as in await yield async fn struct trait impl type where unsafe move let mut ref mod pub use dyn crate self Self extern".split()),
    "typescript": frozenset(f"{_COMMON} in of await yield async let var export extends implements with".split()),
    "go": frozenset(f"{_COMMON} func go defer select range map chan type struct var package fallthrough goto".split()),
    "java": frozenset(f"{_COMMON} assert synchronized throws extends implements".split()),
    "cpp": frozenset(f"{_COMMON} alignof alignas decltype noexcept static_assert operator template typename using namespace struct union not and or defined constexpr explicit catch requires".split()),
}
_RESERVED["javascript"] = _RESERVED["typescript"]
_MODIFIERS = frozenset("pub async unsafe const extern default export declare abstract public private protected static final readonly override synchronized native strictfp transient volatile sealed inline virtual explicit constexpr friend mutable get set crate".split())
_PRIMITIVE = frozenset("int char bool float double long short unsigned signed auto void wchar_t size_t".split())


@dataclass
class Token:
    text: str
    kind: str
    line: int
    col: int
    end_line: int
    end_col: int
    pair: int = -1  # the bracket that closes or opens this one
    comments: tuple[str, ...] = ()  # right before it, on lines of their own


@dataclass
class Scope:
    kind: str  # file, class, impl, trait, interface, enum, function, module, block
    name: str | None = None
    parent: str | None = None  # the nearest class, implementation or module
    access: str = "public"


def tokenize(source: str, lang: str) -> list[Token]:
    """Words, literals and signs, with brackets paired; template literals give the code inside them."""
    lexer, out, comments = _LEXERS[lang], [], []
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = at = 0
    templates: list[int] = []  # open brackets of the code inside template literals
    script = lang in ("typescript", "javascript")

    def add(kind: str, begin: int, end: int) -> None:
        nonlocal line
        while line + 1 < len(starts) and starts[line + 1] <= begin:
            line += 1
        text = source[begin:end]
        rows = text.count("\n")
        end_col = end - begin + begin - starts[line] if not rows else len(text) - text.rindex("\n") - 1
        if kind == "comment":
            if not out or out[-1].end_line < line + 1:
                comments.append(text)
            return
        out.append(Token(text, kind, line + 1, begin - starts[line], line + 1 + rows, end_col, -1, tuple(comments)))
        comments.clear()

    def template(begin: int) -> int:
        """From inside a template literal to its end, or into the code after ``${``."""
        m = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S).match(source, begin)
        if source.startswith("${", m.end()):
            add("sign", m.end(), m.end() + 2)
            templates.append(0)
            return m.end() + 2
        return m.end() + 1

    while at < len(source):
        ch = source[at]
        if ch.isspace():
            at += 1
            continue
        if script and ch == "`":
            add("literal", at, at + 1)
            at = template(at + 1)
            continue
        if script and templates and ch in "{}":
            templates[-1] += 1 if ch == "{" else -1
            if templates[-1] < 0:
                templates.pop()
                add("sign", at, at + 1)
                at = template(at + 1)
                continue
        if script and ch == "/" and (not out or out[-1].kind == "sign" and out[-1].text not in (")", "]", "}") or out[-1].text in ("return", "typeof", "case", "in", "of")) and (m := _REGEX.match(source, at)):
            add("literal", at, m.end())
            at = m.end()
            continue
        m = lexer.match(source, at)
        if not m:
            at += 1
            continue
        end = m.end()
        if m.lastgroup == "comment" and lang == "rust" and m.group().startswith("/*"):  # these nest
            depth, end = 0, at
            for x in re.compile(r"/\*|\*/").finditer(source, at):
                depth += 1 if x.group() == "/*" else -1
                end = x.end()
                if not depth:
                    break
            end = len(source) if depth else end
        kind = m.lastgroup if m.lastgroup in ("comment", "word", "sign") else "literal"
        add("directive" if kind == "literal" and lang == "cpp" and m.group().lstrip().startswith("#") else kind, at, end)
        at = max(end, at + 1)
    open_: list[int] = []
    for i, t in enumerate(out):
        if t.kind == "sign" and t.text in ("(", "[", "{", "${"):
            open_.append(i)
        elif t.kind == "sign" and t.text in (")", "]", "}"):
            while open_ and {"(": ")", "[": "]", "{": "}", "${": "}"}[out[open_[-1]].text] != t.text and t.text == "}":
                out[open_.pop()].pair = i  # a bracket left open ends with the block around it
            if open_ and {"(": ")", "[": "]", "{": "}", "${": "}"}[out[open_[-1]].text] == t.text:
                t.pair, out[open_[-1]].pair = open_[-1], i
                open_.pop()
    for i in open_:
        out[i].pair = len(out)
    return out


def clean_comment(text: str) -> str:
    """A comment without its marks."""
    if text.startswith("//"):
        return text.lstrip("/!").strip()
    body = text.removeprefix("/*").removesuffix("*/").lstrip("*!").strip()
    return "\n".join(x.strip().lstrip("*").strip() for x in body.split("\n"))


class Reader:
    """One pass over the tokens of a file."""

    def __init__(self, source: str, lang: str):
        self.lang, self.t = lang, tokenize(source, lang)
        self.n = len(self.t)
        self.t += [Token("", "literal", source.count("\n") + 1, 0, source.count("\n") + 1, 0)] * 4  # reading ahead needs no check
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        self.source_lines = source.split("\n")
        regions = [(0, self.n, Scope("file"))]
        self.more: list[tuple[int, int, Scope]] = []
        self.bodies: set[int] = set()  # of anonymous classes
        while regions:
            i, end, scope = regions.pop()
            while i < end:
                i = max(i + 1, self._step(i, end, scope))
            regions += self.more
            self.more = []
        for rows, key in ((self.symbols, ("line_start", "col_start")), (self.calls, ("call_line", "call_col"))):
            rows.sort(key=lambda r: tuple(r[k] for k in key))

    # --- tokens ---

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "literal" else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word" and not self.t[i].text[0].isdigit()

    def close(self, i: int) -> int:
        """The token that closes bracket ``i``."""
        return self.t[i].pair if i < self.n and self.t[i].pair > i else i

    def generics(self, i: int) -> int:
        """Behind the angle brackets that open at ``i``, or ``i``."""
        depth, j = 0, i
        while j < self.n and j < i + 400:
            x = self.text(j)
            if x in ("(", "[", "{"):
                j = self.close(j)
            elif x in ("<", "<="):
                depth += 1
            elif x == ">":
                depth -= 1
            elif x in (";", "}", ")", "&&", "||") or not depth:
                break
            j += 1
            if not depth:
                return j
        return i

    def between(self, a: int, b: int) -> str:
        """Source from token ``a`` to before token ``b``, on one line."""
        if a >= b or a >= self.n:
            return ""
        first, last = self.t[a], self.t[min(b, self.n) - 1]
        rows = self.source_lines[first.line - 1 : last.end_line]
        if len(rows) == 1:
            return rows[0][first.col : last.end_col]
        return " ".join(x.strip() for x in [rows[0][first.col :], *rows[1:-1], rows[-1][: last.end_col]])

    def until(self, i: int, stops: tuple[str, ...], end: int) -> int:
        """The first of ``stops`` at this depth from ``i`` on, or ``end``."""
        while i < end:
            x = self.text(i)
            if x in stops:
                return i
            i = self.close(i) + 1 if x in ("(", "[", "{", "${") else i + 1
        return end

    def begin(self, i: int) -> tuple[int, set[str]]:
        """Where the modifiers before ``i`` begin, and which they are."""
        found: set[str] = set()
        while i > 0:
            x = self.text(i - 1)
            if x in _MODIFIERS:
                found.add(x)
                i -= 1
            elif x == ")" and self.text(self.t[i - 1].pair - 1) == "pub":
                i = self.t[i - 1].pair
            elif self.t[i - 1].kind == "literal" and self.text(i - 2) == "extern":
                i -= 1
            else:
                break
        return i, found

    # --- results ---

    def declare(self, name: int, kind: str, start: int, last: int, scope: Scope, found: set[str], signature: str | None = None, parent: str | None = None) -> None:
        first, end = self.t[start], self.t[min(last, self.n - 1)]
        label = self.text(name)
        lang = self.lang
        if lang == "go":
            visible = label[:1].isupper()
        elif lang == "rust":
            visible = "pub" in found
        elif found & {"private", "protected", "public"}:
            visible = "public" in found
        else:
            visible = scope.access == "public" and not label.startswith("#")
        doc = start
        while doc > 0 and self.text(doc - 1) in ("]", ")"):  # attributes and annotations before it
            opens = self.t[doc - 1].pair
            if self.text(opens - 1) == "#":
                doc = opens - 1
            elif self.text(opens - 2) == "@":
                doc = opens - 2
            else:
                break
        while doc > 1 and self.text(doc - 2) == "@":
            doc -= 2
        comments = [clean_comment(c) for c in (self.t[doc].comments or first.comments)]
        self.symbols.append({
            "name": label.lstrip("#"), "kind": kind, "line_start": first.line, "col_start": first.col, "line_end": end.end_line, "col_end": end.end_col,
            "parent": parent or scope.parent, "signature": signature, "docstring": "\n".join(comments) or None, "visibility": "public" if visible else "private",
        })

    def enter(self, opens: int, kind: str, name: str | None, scope: Scope, access: str = "public") -> int:
        """Read the region of bracket ``opens`` in a scope of its own; the place behind it."""
        parent = name if kind in ("class", "impl", "module", "interface", "enum", "trait") and name else scope.parent
        self.more.append((opens + 1, self.close(opens), Scope(kind, name, parent, access)))
        return self.close(opens) + 1

    def function(self, name: int, kind: str, start: int, params: int, end: int, scope: Scope, found: set[str], parent: str | None = None, needs_body: bool = True) -> int:
        """A function whose parameters open at ``params``: declared if it has a body, which is read next."""
        after = self.close(params) + 1
        body = self.until(after, ("{", ";", "}"), end)
        if self.lang == "go" and self.text(body) == "{" and self.text(body - 1) in ("interface", "struct"):
            body = self.until(self.close(body) + 1, ("{", ";", "}"), end)
        has = self.text(body) == "{"
        if not has and needs_body:
            return after
        arrow = self.until(after, ("where", "{", ";", "throws"), body)
        result = self.between(after, min(arrow, body)).strip()
        signature = {"java": self.between(params, after), "cpp": None}.get(self.lang, self.between(params, after) + {"rust": f" {result}", "go": f" {result}"}.get(self.lang, result) if result else self.between(params, after))
        self.declare(name, kind, start, self.close(body) if has else body, scope, found, signature, parent)
        self.more.append((params + 1, after - 1, Scope("parameters", None, scope.parent)))
        return self.enter(body, "function", None, scope) if has else body + 1

    def call(self, i: int, kind: str) -> None:
        t = self.t[i]
        self.calls.append({"callee_name": t.text, "call_line": t.line, "call_col": t.col + 1, "call_type": kind})

    def imported(self, module: str, line: int) -> None:
        relative = module.startswith((".", "self::", "super::", "crate::")) or module in ("self", "super", "crate")
        self.imports.append({"imported_module": module, "import_line": line, "is_relative": relative})

    # --- the pass ---

    def _step(self, i: int, end: int, scope: Scope) -> int:
        x = self.text(i)
        if not x:
            return i + 1
        own = {"rust": self._rust, "go": self._go, "java": self._java, "cpp": self._cpp}.get(self.lang, self._script)(i, x, end, scope)
        if own is not None:
            return own
        if x == "{" and (i in self.bodies or scope.kind == "constants"):
            return self.enter(i, "class", None, scope)
        if x == "{" and scope.kind in ("class", "interface", "enum"):
            return self.enter(i, "block", None, scope)  # initializers and bodies of constants
        if self.word(i) and (scope.kind != "parameters" or self.lang in ("typescript", "javascript")) and not (scope.kind == "interface" and self.lang == "go"):
            if scope.kind == "constants" and self.text(i + 1) == "(" and self.text(i - 1) in ("{", ",", ")"):
                return i + 1  # arguments of an enum constant
            self._call(i, x)
        return i + 1

    def _declared(self, i: int) -> bool:
        """Whether the C++ or Java name at ``i`` follows a type, and so is no call."""
        before = self.t[i - 1]
        if not i or before.kind == "word":
            return bool(i) and before.text not in ("return", "else", "throw", "case", "co_return", "co_await", "co_yield", "and", "or", "not", "do", "new", "yield", "assert")
        if before.text != ">":
            return False
        depth, j = 0, i - 1
        while j > max(0, i - 60) and self.text(j) not in (";", "{", "}", "&&", "||"):
            depth += {">": 1, "<": -1}.get(self.text(j), 0)
            if not depth:
                j -= 1
                while self.text(j - 1) in ("::", ".") and self.word(j - 2):
                    j -= 2
                return self.word(j) and self.text(j - 1) in (";", "{", "}", "", "const", "static", "(", "final")
            j -= 1
        return False

    def _call(self, i: int, x: str) -> None:
        before, after = self.text(i - 1), self.text(i + 1)
        if self.lang == "rust" and after == "!" and self.text(i + 2) in ("(", "[", "{") and before != ".":
            return self.call(i, "macro")
        opens = i + 1
        if self.lang == "rust" and after == "::" and self.text(i + 2) == "<":
            opens = self.generics(i + 2)
        elif after == "<" and self.lang != "rust" and (self.lang != "go"):
            opens = self.generics(i + 1)
        elif after == "?." and self.text(i + 2) == "(":
            opens = i + 2
        path = i  # a.b.C of new a.b.C(...)
        while self.text(path - 1) in (".", "::") and self.word(path - 2):
            path -= 2
        made = self.text(path - 1) == "new" and self.lang != "rust" and self.lang != "go"
        if self.text(opens) != "(" and not (made and self.lang in ("typescript", "javascript") and after not in (".", "::")) or x in _RESERVED[self.lang] and before not in (".", "?.", "->"):
            return None
        if made:
            if self.lang == "java" and self.text(opens) == "(" and self.text(self.close(opens) + 1) == "{":
                self.bodies.add(self.close(opens) + 1)
            return self.call(i, "constructor") if self.text(opens) not in (".", "::") else None
        if self.lang in ("cpp", "java") and (x in _PRIMITIVE or self._declared(i)):
            return None
        if before == "function" or before == "*" and self.text(i - 2) == "function" or self.lang in ("typescript", "javascript") and before in ("{", ",") and self.text(self.close(opens) + 1) == "{":
            return None  # named function expressions and methods of object literals
        if self.lang == "rust" and x[:1].isupper() and before not in (".",):
            follows = self.text(self.close(opens) + 1)
            if follows in ("=>", "|") or follows == "if" and self.t[self.close(opens)].line == self.t[self.close(opens) + 1].line or self._pattern(path):
                return None
        if before in (".", "?.") or self.lang == "cpp" and before == "->":
            return self.call(i, "method")
        return self.call(i, "qualified" if before == "::" else "direct")

    def _pattern(self, i: int) -> bool:
        """Whether a Rust path at ``i`` stands in a pattern, after ``let``."""
        while i > 0 and self.text(i - 1) in ("(", ",", "&", "ref", "mut", "|"):
            i -= 1
        return self.text(i - 1) == "let"

    def _rust(self, i: int, x: str, end: int, scope: Scope) -> int | None:
        after = i + 1
        if x == "#" and (self.text(after) == "[" or self.text(after) == "!" and self.text(i + 2) == "["):
            return self.close(after if self.text(after) == "[" else i + 2) + 1
        if x == "macro_rules" and self.text(after) == "!":
            return self.close(self.until(i + 2, ("{", "(", "["), end)) + 1
        if x == "use":
            stop = self.until(after, (";",), end)
            path = self.until(after, ("{", "as"), stop)
            parts = self.between(after, path).replace(" ", "").removesuffix("::*").removesuffix("::")
            if parts:
                self.imported(parts, self.t[after].line)
            return stop + 1
        start, found = self.begin(i)
        if x == "impl" and self.text(i - 1) not in (":", "->", "(", ",", "<", "&", "=", "dyn", "+"):
            body = self.until(after, ("{", ";"), end)
            j = self.generics(after) if self.text(after) == "<" else after
            name = None
            while j < body and self.text(j) != "where":
                if self.text(j) == "for":
                    name = None
                elif self.text(j) == "<":
                    j = max(self.generics(j) - 1, j)
                elif self.word(j) and self.text(j) not in ("dyn", "mut", "const", "unsafe"):
                    name = self.text(j)
                j += 1
            return self.enter(body, "impl", name, scope) if self.text(body) == "{" else body
        if not self.word(after) or self.text(i - 1) in (".", "*", "'"):
            return None
        if x == "fn":
            params = self.generics(after + 1) if self.text(after + 1) == "<" else after + 1
            return self.function(after, "method" if scope.kind == "impl" else "function", start, params, end, scope, found) if self.text(params) == "(" else None
        kind = {"struct": "class", "union": "class", "enum": "enum", "trait": "interface", "mod": "module", "type": "type", "const": "constant", "static": "constant"}.get(x)
        if not kind or x == "type" and scope.kind == "trait" or x == "union" and self.text(i + 2) not in ("{", "<"):
            return None
        name = i + 2 if self.text(after) == "mut" else after
        if kind == "constant" and (self.text(name) in _RESERVED["rust"] or self.text(name + 1) != ":"):
            return None
        stops = (";",) if kind in ("type", "constant") else ("{", ";")
        last = self.until(name + 1, stops, end)
        body = self.text(last) == "{"
        self.declare(name, kind, start, self.close(last) if body else last, scope, found)
        if body and x in ("mod", "trait"):
            return self.enter(last, "module" if x == "mod" else "block", self.text(name) if x == "mod" else None, scope)
        return self.close(last) + 1 if body else name + 1

    def _go(self, i: int, x: str, end: int, scope: Scope) -> int | None:
        if x == "import":
            many = self.text(i + 1) == "("
            for j in range(i + 1, self.close(i + 1) if many else self.until(i + 1, (";",), min(end, i + 3))):
                if self.t[j].kind == "literal":
                    self.imported(self.t[j].text.strip('"`'), self.t[j].line)
            return self.close(i + 1) + 1 if many else i + 1
        if x == "func":
            name, owner = i + 1, None
            if self.text(name) == "(" and self.word(self.close(name) + 1) and scope.kind == "file":
                of = [self.text(j) for j in range(name + 1, self.until(name + 1, ("[",), self.close(name))) if self.word(j)]
                owner, name = (of or [None])[-1], self.close(name) + 1
            if self.word(name):
                params = self.close(name + 1) + 1 if self.text(name + 1) == "[" else name + 1
                if self.text(params) == "(":
                    return self.function(name, "method" if owner else "function", i, params, end, scope, set(), owner)
            return None
        kind = {"type": "type", "const": "constant", "var": "variable"}.get(x)
        if kind and (self.text(i + 1) == "(" or self.word(i + 1)) and self.text(i - 1) not in (".", "("):
            many = self.text(i + 1) == "("
            j, stop = (i + 2, self.close(i + 1)) if many else (i + 1, end)
            last_line = -1
            while j < stop:
                if self.word(j) and self.t[j].line > last_line:
                    names = [j]
                    while self.text(names[-1] + 1) == "," and self.word(names[-1] + 2):
                        names.append(names[-1] + 2)
                    last = names[-1]
                    while last + 1 < stop and (self.t[last + 1].line == self.t[last].end_line and self.text(last + 1) != ";"):
                        last = self.close(last + 1)
                    shape = {"struct": "class", "interface": "interface"}.get(self.text(self.close(j + 1) + 1 if self.text(j + 1) == "[" else j + 1), kind)
                    for n in names if kind != "type" else names[:1]:
                        self.declare(n, shape if kind == "type" else kind, n if many else i, last, scope, set())
                    for k in range(names[-1] + 1, last + 1):
                        if self.text(k) == "interface" and self.text(k + 1) == "{":
                            self.enter(k + 1, "interface", None, scope)
                        elif self.text(k) == "{" and self.text(k - 1) not in ("interface", "struct") and kind != "type":
                            self.enter(k, "block", None, scope)
                            break
                        elif self.word(k) and kind != "type":
                            self._call(k, self.text(k))
                    last_line, j = self.t[last].end_line, last + 1
                    if not many:
                        return j
                else:
                    j += 1
            return self.close(i + 1) + 1
        return None

    def _annotation(self, i: int) -> int:
        """Behind the annotation at ``i``."""
        j = i + 2
        while self.text(j) == ".":
            j += 2
        return self.close(j) + 1 if self.text(j) == "(" else j

    def _member(self, i: int, end: int, scope: Scope) -> int | None:
        """A method, constructor or field of a Java class at the first token of a member."""
        j = i
        while j < end and (self.text(j) in _MODIFIERS or self.text(j) == "@" and self.text(j + 1) != "interface"):
            j = self._annotation(j) if self.text(j) == "@" else j + 1
        if self.text(j) in ("class", "interface", "enum", "record", "@", "{", "}", ";", ""):
            return None
        start = i
        while self.text(start) == "@":
            start = self._annotation(start)
        found = {self.text(k) for k in range(i, j)}
        if self.text(j) == "<":
            j = self.generics(j)
        while j < end and (self.word(j) or self.text(j) in (".", "[", "<", "?", "...", "@")):
            if self.text(j) == "<":
                j = max(self.generics(j), j + 1)
            elif self.text(j) == "[":
                j = self.close(j) + 1
            elif self.text(j + 1) in ("(", "=", ";", ",") and self.word(j):
                break
            else:
                j += 1
        if self.text(j + 1) == "(":
            return self.function(j, "method", start, j + 1, end, scope, found, needs_body=False)
        if self.text(j + 1) in ("=", ";", ","):
            last = self.until(j, (";",), end)
            k = j
            while k < last:
                if self.word(k) and self.text(k + 1) in ("=", ";", ","):
                    self.declare(k, "variable", start, last, scope, found)
                k = self.until(k, (",",), last) + 1
            self.more.append((j + 1, last, Scope("block", None, scope.parent)))
            return last + 1
        return None

    def _java(self, i: int, x: str, end: int, scope: Scope) -> int | None:
        if x == "import" and scope.kind == "file":
            stop = self.until(i, (";",), end)
            self.imported(self.between(i + 2 if self.text(i + 1) == "static" else i + 1, stop).replace(" ", "").removesuffix(".*"), self.t[i].line)
            return stop + 1
        if x == "package" and scope.kind == "file":
            return self.until(i, (";",), end) + 1
        if x == "@" and self.text(i + 1) != "interface":
            return self._member(i, end, scope) or self._annotation(i) if scope.kind in ("class", "interface") else self._annotation(i)
        kind = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}.get(x)
        if kind and self.word(i + 1) and self.text(i - 1) != "." and (x != "record" or self.text(i + 2) in ("(", "<")):
            start, found = self.begin(i)
            body = self.until(i + 2, ("{", ";"), end)
            self.declare(i + 1, kind, start, self.close(body), scope, found)
            if self.text(body) != "{":
                return body
            if x == "enum":  # constants, then members
                stop = self.until(body + 1, (";",), self.close(body))
                self.more.append((body + 1, stop, Scope("constants", None, self.text(i + 1))))
                self.more.append((stop + 1, self.close(body), Scope("class", self.text(i + 1), self.text(i + 1))))
                return self.close(body) + 1
            return self.enter(body, "interface" if kind == "interface" else "class", self.text(i + 1), scope)
        if scope.kind in ("class", "interface") and (self.word(i) or x == "<"):
            return self._member(i, end, scope)
        return None

    def _cpp(self, i: int, x: str, end: int, scope: Scope) -> int | None:
        if self.t[i].kind == "directive":
            if m := re.match(r'\s*#\s*include\s*[<"]([^>"]+)', x):
                self.imported(m.group(1), self.t[i].line)
            return i + 1
        if scope.kind in ("class", "struct") and x in ("public", "private", "protected") and self.text(i + 1) == ":":
            scope.access = x
            return i + 2
        if x in ("template",) and self.text(i + 1) == "<":
            return self.generics(i + 1)
        if x == "[" and self.text(i + 1) == "[":
            return self.close(i) + 1
        if x == "namespace":
            body = self.until(i + 1, ("{", ";", "="), end)
            if self.text(body) != "{":
                return self.until(i, (";",), end) + 1
            if self.word(i + 1):
                self.declare(body - 1, "module", i, self.close(body), scope, set())
            return self.enter(body, "module", self.text(body - 1) if self.word(i + 1) else None, scope)
        if x in ("class", "struct", "union", "enum") and self.text(i - 1) not in ("<", ",", "enum"):
            name = i + 2 if x == "enum" and self.text(i + 1) in ("class", "struct") else i + 1
            while self.text(name) == "[" or self.word(name) and self.word(name + 1) and self.text(name + 1) != "final":
                name = self.close(name) + 1 if self.text(name) == "[" else name + 1
            body = self.until(name + 1, ("{", ";", "(", "=", ","), end)
            if self.word(name) and self.text(body) == "{" and self.text(name + 1) in ("{", ":", "final", "<"):
                self.declare(name, "enum" if x == "enum" else "class", i, self.close(body), scope, set())
                if x == "enum":
                    return self.close(body) + 1
                return self.enter(body, "class", self.text(name), scope, "private" if x == "class" else "public")
            return None
        if x in ("typedef", "using"):
            stop = self.until(i, (";",), end)
            if x == "typedef" and self.word(stop - 1):
                self.declare(stop - 1, "type", i, stop, scope, set())
            elif x == "using" and self.text(i + 2) == "=":
                self.declare(i + 1, "type", i, stop, scope, set())
            return stop + 1
        if scope.kind in ("function", "block", "parameters"):
            return None
        if self.word(i) and x not in _RESERVED["cpp"] and self.text(i - 1) not in (".", "->"):
            if self.text(i + 1) == "(" and self.text(i - 1) != "=":
                name, owner = i, self.text(i - 2) if self.text(i - 1) == "::" else None
                after = self.close(i + 1) + 1
                j = after
                while j < end and self.text(j) not in ("{", ";", "=", ","):
                    if self.text(j) == ":":  # initializers of members
                        j += 1
                        while j < end:
                            while j < end and self.text(j) not in ("(", "{"):
                                j += 1
                            self.more.append((j + 1, self.close(j), Scope("block", None, scope.parent)))
                            j = self.close(j) + 1
                            if self.text(j) != ",":
                                break
                    else:
                        j = self.close(j) + 1
                if self.text(j) == "{":
                    inside = scope.kind == "class" or owner
                    self.declare(name, "method" if inside else "function", self._line_begin(i), self.close(j), scope, set(), None, owner)
                    return self.enter(j, "function", None, scope)
                return self.until(j, (";",), end) + 1
            if self.text(i + 1) == "=" and self.t[i - 1].kind == "word" or self.text(i + 1) == "=" and self.text(i - 1) in ("*", "&", ">"):
                stop = self.until(i, (";",), end)
                self.declare(i, "variable", self._line_begin(i), stop, scope, set())
                self.more.append((i + 2, stop, Scope("block", None, scope.parent)))
                return stop + 1
            return i + 1
        return None

    def _line_begin(self, i: int) -> int:
        """First token of the C++ declaration that names token ``i``."""
        while i > 0 and self.text(i - 1) not in (";", "}", "{", ":", ">", "") and self.t[i - 1].kind != "directive":
            i -= 1
        return i

    def _statement_end(self, i: int, end: int) -> int:
        """Last token of the script statement that holds ``i``, at a semicolon or where a line ends it."""
        while i < end:
            x = self.text(i)
            if x == ";":
                return i
            i = self.close(i) if x in ("(", "[", "{", "${") else i
            if i + 1 >= end:
                return end - 1
            a, b = self.t[i], self.t[i + 1]
            goes_on = a.kind == "sign" and a.text not in (")", "]", "}") or b.kind == "sign" and b.text not in ("{", "[", "(", "@", "}", "++", "--", "!") or b.text in ("instanceof", "in", "of", "as")
            if b.line > a.end_line and not goes_on or a.kind != "sign" and b.text in ("const", "let", "var", "class", "function"):
                return i
            i += 1
        return end - 1

    def _arrow(self, name: int, last: int) -> bool:
        """Whether the declared name is an arrow function."""
        j = self.until(name + 1, ("=", ",", ";"), last + 1)
        if self.text(j) != "=":
            return False
        j = j + 2 if self.text(j + 1) == "async" and self.text(j + 2) != "=>" else j + 1
        j = self.generics(j) if self.text(j) == "<" else j
        return self.text(j + 1) == "=>" if self.word(j) else self.text(j) == "(" and self.text(self.until(self.close(j) + 1, ("=>", ",", ";", "{"), last + 1)) == "=>"

    def _script(self, i: int, x: str, end: int, scope: Scope) -> int | None:
        before = self.text(i - 1)
        start, found = self.begin(i)
        lead = self.text(start - 1)
        statement = i == 0 or start == 0 or lead in (";", "{", "}", ")", ":", "") or self.t[start].line > self.t[start - 1].end_line and not (self.t[start - 1].kind == "sign" and lead not in ("]", ")", "}"))
        if x == "import" and self.text(i + 1) not in ("(", "."):
            j = i + 1
            while j < min(end, i + 400) and self.t[j].kind != "literal" and self.text(j) != ";":
                j += 1
            if j < end and self.t[j].kind == "literal":
                self.imported(self.t[j].text.strip("\"'"), self.t[j].line)
            return j + 1
        if x == "require" and self.text(i + 1) == "(" and i + 2 < end and self.t[i + 2].kind == "literal" and self.text(i + 3) == ")":
            self.imported(self.t[i + 2].text.strip("\"'"), self.t[i].line)
        if x == "@" and scope.kind == "class":
            return self._annotation(i)
        if x == "function" and statement:
            name = i + 2 if self.text(i + 1) == "*" else i + 1
            params = self.generics(name + 1) if self.text(name + 1) == "<" else name + 1
            if self.word(name) and self.text(params) == "(":
                return self.function(name, "function", start, params, end, scope, found)
        if x == "class":
            body = self.until(i + 1, ("{",), end)
            named = self.word(i + 1) and self.text(i + 1) not in ("extends", "implements")
            if named and statement:
                self.declare(i + 1, "class", start, self.close(body), scope, found)
            return self.enter(body, "class", self.text(i + 1) if named else None, scope) if before not in (".", "?.") and self.text(body) == "{" else None
        if self.lang == "typescript" and statement and self.word(i + 1):
            kind = {"interface": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module"}.get(x)
            if kind in ("interface", "enum", "module"):
                body = self.until(i + 2, ("{", ";"), end)
                if self.text(body) == "{":
                    self.declare(i + 1, kind, start, self.close(body), scope, found)
                    return self.enter(body, "module", self.text(i + 1), scope) if kind == "module" else self.close(body) + 1
            elif kind == "type" and self.text(self.generics(i + 2) if self.text(i + 2) == "<" else i + 2) == "=":
                last = self._statement_end(i, end)
                self.declare(i + 1, "type", start, last, scope, found)
                return last + 1
        if x in ("const", "let", "var") and self.word(i + 1) and before not in (".", "?.") and not (x == "const" and self.text(i + 1) == "enum"):
            last = self._statement_end(i, end)
            j = i + 1
            while self.word(j) and self.text(j + 1) not in ("of", "in") and j <= last:
                self.declare(j, "function" if self._arrow(j, last) else "variable", start, last, scope, found)
                j = self.until(j, (",", ";"), last + 1) + 1
            return i + 2
        if scope.kind == "class" and (self.word(i) or self.t[i].text == "[") and x not in _MODIFIERS - {"get", "set", "static"} and before not in (".", "?.", "="):
            name = i
            if x in ("get", "set", "static", "async") and self.word(i + 1):
                return None
            params = self.generics(i + 1) if self.text(i + 1) == "<" else i + 1
            if self.text(params) == "(" and self.word(i):
                body = self.until(self.close(params) + 1, ("{", ";", "}"), end)
                if self.text(body) == "{":
                    return self.function(name, "method", start, params, end, scope, found)
                return self.close(params) + 1
            last = self._statement_end(i, end)  # a field: its value is code
            equals = self.until(i, ("=",), last + 1)
            if equals <= last:
                self.more.append((equals + 1, last + 1, Scope("block", None, scope.parent)))
            return last + 1
        return None


def _python(content: str) -> tuple[list[dict], list[dict], list[dict]]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], [], []
    symbols, calls, imports = [], [], []

    def symbol(node: ast.AST, name: str, kind: str, parent: str | None, signature: str | None = None, doc: str | None = None) -> None:
        symbols.append({"name": name, "kind": kind, "line_start": node.lineno, "col_start": node.col_offset, "line_end": node.end_lineno, "col_end": node.end_col_offset, "parent": parent, "signature": signature, "docstring": doc, "visibility": "private" if name.startswith("_") else "public"})

    todo: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while todo:
        node, parent, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                symbol(child, child.name, "class" if is_class else "method" if in_class else "function", parent, None if is_class else f"({ast.unparse(child.args)})", ast.get_docstring(child))
                todo.append((child, child.name, is_class))
            else:
                todo.append((child, parent, in_class))
            if isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    calls.append({"callee_name": name, "call_line": child.lineno, "call_col": child.col_offset + 1, "call_type": "method" if isinstance(f, ast.Attribute) else "direct"})
            elif isinstance(child, ast.Import):
                imports.extend({"imported_module": a.name, "import_line": child.lineno, "is_relative": False} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append({"imported_module": "." * child.level + (child.module or ""), "import_line": child.lineno, "is_relative": child.level > 0})
    for child in tree.body:
        for target in child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []:
            if isinstance(target, ast.Name):
                symbol(child, target.id, "constant" if target.id.isupper() else "variable", None)
    symbols.sort(key=lambda r: (r["line_start"], r["col_start"]))
    calls.sort(key=lambda r: (r["call_line"], r["call_col"]))
    return symbols, calls, imports


def parse(content: str | None, lang: str | None) -> tuple[list[dict], list[dict], list[dict]]:
    """(symbols, calls, imports) of one file; nothing for unknown languages and for Python that does not parse."""
    if not content or not lang:
        return [], [], []
    if lang == "python":
        return _python(content)
    r = Reader(content, lang)
    return r.symbols, r.calls, r.imports
