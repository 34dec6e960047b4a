"""Outermost syntax units of source texts: one pass over the characters with a stack.

Strings (of several lines too), comments, brackets and, for Python, indentation are followed, so what stands at the
beginning of a line within them begins no unit. A unit is (kind, name, start, end): places of characters. Units
within units aren't told, units within other statements are (a function in an ``if``, a method in an object literal).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Unit = tuple[str, str | None, int, int]

_PYTHON = re.compile(r"""(?P<string>(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"{3}|'{3}|"|'))|(?P<comment>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\r?\n)|(?P<end>\n|;)|(?P<text>[^\s#"'(\[{)\]};\\]+)|(?P<other>\\)""")
_PYTHON_STRING_END = {q: re.compile(rf"(?:\\.|(?!{q}).)*?(?:{q}|\Z)", re.S) for q in ('"""', "'''")} | {q: re.compile(rf"(?:\\.|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)", re.S) for q in ('"', "'")}
_PYTHON_KINDS = (
    ("decorated_definition", re.compile(r"@")),
    ("function_definition", re.compile(r"(?:async\s+)?def\s+(\w+)")),
    ("class_definition", re.compile(r"class\s+(\w+)")),
    ("import_statement", re.compile(r"import\b")),
    ("import_from_statement", re.compile(r"from\b(?!\s+__future__\b)[^\n]*?\bimport\b")),
)
_BLOCKS = ("function_definition", "class_definition")


def _python_statements(text: str) -> Iterator[tuple[int, int, int]]:
    """(indentation, start, end) of each simple statement or header line, joined lines and brackets included."""
    depth, start, end, column, at, n = 0, None, 0, 0, 0, len(text)
    line_start = 0  # of the physical line on which a statement begins
    while at < n:
        m = _PYTHON.match(text, at)
        if m is None:  # white space
            at += 1
            continue
        kind, at = m.lastgroup, m.end()
        if kind == "end":
            if start is not None and depth <= 0:
                yield column, start, end
                start = None
                if m[0] == ";":
                    continue  # what follows has the same indentation
            if m[0] == "\n":
                line_start = at
            continue
        if kind in ("comment", "joined"):
            continue
        if start is None:
            start, depth = m.start(), 0
            if text[line_start:start].isspace() or line_start == start:
                column = len(text[line_start:start].expandtabs())
        if kind == "string":
            quote = m[0].lstrip("rRbBfFuU")
            at = _PYTHON_STRING_END[quote].match(text, at).end()
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        end = at
    if start is not None:
        yield column, start, end


def python_units(text: str) -> Iterator[Unit]:
    """Functions, classes, decorated definitions and imports."""
    held: list | None = None  # kind, name, start, end, indentation, still to be defined
    for indent, start, end in _python_statements(text):
        if held is not None:
            if held[5] and indent == held[4]:  # after a decorator: the next one, or what it decorates
                held[3], held[5] = end, text.startswith("@", start)
                continue
            if indent > held[4]:
                held[3] = end
                continue
            yield held[0], held[1], held[2], held[3]
            held = None
        for kind, pattern in _PYTHON_KINDS:
            if m := pattern.match(text, start, end):
                name = m[1] if kind in _BLOCKS else None
                if kind in _BLOCKS or kind == "decorated_definition":
                    held = [kind, name, start, end, indent, kind == "decorated_definition"]
                else:
                    yield kind, None, start, end
                break
    if held is not None:
        yield held[0], held[1], held[2], held[3]


_SCRIPT = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[-+*/%&|^<>=!?]+|[()\[\]{}`;,.:@#~\\])""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_AFTER = frozenset("return typeof new await yield delete void in of instanceof case default extends".split())  # words that an expression follows
Token = tuple[str, int, int]  # text (strings and the like as their first character), start, end


def _script_tokens(text: str) -> tuple[list[Token], dict[int, int]]:
    """Tokens without white space and comments, and for each opening bracket the token that closes it. Templates are one token each."""
    tokens: list[Token] = []
    open_at: list[int] = []  # places of open brackets; a template's ``${`` is a -1
    match: dict[int, int] = {}
    templates: list[int] = []  # where the open templates begin

    def template(at: int) -> int:
        m = _TEMPLATE.match(text, at)
        if m[1] == "${":
            open_at.append(-1)
        else:
            start = templates.pop()
            if not templates:
                tokens.append(("`", start, m.end()))
        return m.end()

    at, n = 0, len(text)
    while at < n:
        m = _SCRIPT.match(text, at)
        if m is None:
            at += 1
            continue
        kind, word, start = m.lastgroup, m[0], at
        at = m.end()
        if kind == "comment":
            continue
        if kind == "op" and word.startswith("/") and not templates and _expression_follows(tokens) and (r := _REGEX.match(text, start)):
            tokens.append(("/", start, r.end()))
            at = r.end()
            continue
        if word == "`":
            templates.append(start)
            at = template(at)
            continue
        if word == "}" and open_at and open_at[-1] == -1:
            open_at.pop()
            at = template(at)
            continue
        if templates:  # code within a template: only its brackets count
            if word == "{":
                open_at.append(-2)
            elif word == "}" and open_at and open_at[-1] == -2:
                open_at.pop()
            continue
        if word in "([{":
            open_at.append(len(tokens))
        elif word in _PAIRS and open_at and open_at[-1] >= 0 and tokens[open_at[-1]][0] == _PAIRS[word]:
            match[open_at.pop()] = len(tokens)
        tokens.append((word[0] if kind == "string" else word, start, at))
    for i in open_at:  # what is never closed ends with the text
        if i >= 0:
            match[i] = len(tokens) - 1
    return tokens, match


def _expression_follows(tokens: list[Token]) -> bool:
    if not tokens:
        return False
    last = tokens[-1][0]
    return last in _AFTER or last[0] in "=(,:[?!&|+-*%^<>~{;}" and last not in ("++", "--")


class _Script:
    def __init__(self, text: str, types: bool):
        self.text, self.types = text, types
        self.tokens, self.match = _script_tokens(text)

    def word(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def new_line(self, i: int) -> bool:
        """Whether a line ends between a token and the one before it."""
        return 0 < i < len(self.tokens) and "\n" in self.text[self.tokens[i - 1][2] : self.tokens[i][1]]

    def begins(self, i: int) -> bool:
        """Whether a statement can begin at a token."""
        if i == 0:
            return True
        last = self.word(i - 1)
        return last in (";", "}", "{") or (self.new_line(i) and last not in _AFTER and last[0] not in "=(,:[?!&|+-*/%^<>~.")

    def ends(self, i: int) -> int:
        """The last token of a statement or expression that goes on at ``i``: up to a semicolon, comma, closing bracket or a line's end that ends it."""
        j = i
        while j < len(self.tokens):
            if self.word(j) in (";", ",", ")", "]", "}"):
                return j - 1
            j = self.match.get(j, j)
            if j + 1 < len(self.tokens) and self.new_line(j + 1):
                last, following = self.word(j), self.word(j + 1)
                if not (last[0] in "=(,:[?&|+-*%^<>~." and last not in ("++", "--")) and not (following[0] in ".?:&|+-*%^<>=," or following in ("in", "instanceof")):
                    return j
            j += 1
        return len(self.tokens) - 1

    def body(self, i: int) -> int | None:
        """The closing bracket of the first body in braces at ``i`` or after it; None if the statement ends first."""
        while i < len(self.tokens) and self.word(i) != ";":
            if self.word(i) == "{" and self.word(i - 1) not in (":", "|", "&", "<", ",", "extends"):
                return self.match[i]
            i = self.match.get(i, i) + 1
        return None

    def function(self, i: int) -> tuple[str | None, int] | None:
        """Name and last token of a function whose word ``function`` is at ``i``."""
        j = i + 1 + (self.word(i + 1) == "*")
        name = self.word(j) if self.word(j) != "(" else None
        end = self.body(j)
        return None if end is None else (name, end)

    def arrow(self, i: int) -> int | None:
        """The last token of an arrow function that begins at ``i`` (parameters, or a word before them)."""
        j = i + 1 if self.word(i) == "async" and not self.new_line(i + 1) and self.word(i + 1) not in ("=>", "function") else i
        if self.word(j) == "(":
            j = self.match[j] + 1
            if self.types and self.word(j) == ":":  # a type of what is returned
                k = j + 1
                while k < len(self.tokens) and self.word(k) not in ("=>", ";", ",", ")", "}", "=") and not self.new_line(k):
                    k = self.match.get(k, k) + 1
                j = k
        elif re.match(r"[\w$]", self.word(j)) and self.word(j) not in _AFTER:
            j += 1
        if self.word(j) != "=>" or j + 1 >= len(self.tokens):
            return None
        return self.match[j + 1] if self.word(j + 1) == "{" else self.ends(j + 1)

    def method(self, i: int) -> tuple[str, int] | None:
        """Name and last token of a method that begins at ``i``, at a member's place."""
        while self.word(i) in ("static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override") and self.word(i + 1) not in ("(", "=", ":", ","):
            i += 1
        i += self.word(i) == "#"
        last = self.match.get(i, i)  # a name, or one in square brackets
        j = last + 1
        if self.word(j) != "(" or not re.match(r"[\w$\"'\[]", self.word(i)):
            return None
        j = self.match[j] + 1
        if self.types and self.word(j) == ":":
            j += 1
            while j < len(self.tokens) and self.word(j) not in ("{", ";", "}"):
                j += 1
        return (self.text[self.tokens[i][1] : self.tokens[last][2]], self.match[j]) if self.word(j) == "{" else None

    def literal(self, i: int) -> bool:
        """Whether the brace at ``i`` holds members: an object, or the body of a class that isn't a unit."""
        last = self.word(i - 1)
        if i and (last in ("return", "default", "await", "yield") or last[0] in "=(,:[?&|" and last != "=>"):
            return True
        k = i - 1
        while k >= 0 and self.word(k) not in (";", "{", "}", "(", ",", "="):
            if self.word(k) == "class":
                return True
            k -= 1
        return False

    def units(self) -> Iterator[Unit]:
        i, members = 0, [False]  # of each open bracket whether its braces hold members
        closing: list[int] = []
        while i < len(self.tokens):
            if closing and i == closing[-1]:
                closing.pop()
                members.pop()
                i += 1
                continue
            found = self.unit(i, members[-1] and self.word(i - 1) in ("{", ",", ";", "}"))
            if found:
                kind, name, last = found
                yield kind, name, self.tokens[i][1], self.tokens[last][2]
                i = last + 1
                continue
            if i in self.match and self.match[i] > i:
                closing.append(self.match[i])
                members.append(self.word(i) == "{" and self.literal(i))
            i += 1

    def unit(self, i: int, member: bool) -> tuple[str, str | None, int] | None:
        word, following = self.word(i), self.word(i + 1)
        if self.word(i - 1) in (".", "?."):
            return None
        if member and (m := self.method(i)):
            return "method_definition", m[0], m[1]
        begins = not member and self.begins(i)
        if begins and word == "import" and following not in ("(", "."):
            return "import_statement", None, self.closed(self.ends_list(i))
        if begins and word == "export":
            return "export_statement", None, self.exported(i)
        if word == "function" or (word == "async" and following == "function" and not self.new_line(i + 1)):
            if f := self.function(i + (word == "async")):
                return ("function_declaration", f[0], f[1]) if begins else ("function_expression", f[0], f[1])
        if begins and (word == "class" or (word == "abstract" and following == "class")) and (end := self.body(i + 1)) is not None:
            return "class_declaration", self.word(i + 1 + (word == "abstract")), end
        if self.types and begins and word == "interface" and (end := self.body(i + 1)) is not None:
            return "interface_declaration", following, end
        if self.types and begins and word == "type" and re.match(r"[A-Za-z_$]", following) and self.word(i + 2) in ("=", "<"):
            return "type_alias_declaration", following, self.closed(self.ends_list(i))
        if (word == "(" or re.match(r"[A-Za-z_$]", word)) and (end := self.arrow(i)) is not None:
            return "arrow_function", None, end
        return None

    def ends_list(self, i: int) -> int:
        """``ends``, but commas don't end it."""
        j = self.ends(i)
        while self.word(j + 1) == ",":
            j = self.ends(j + 2)
        return j

    def closed(self, j: int) -> int:
        return j + 1 if self.word(j + 1) == ";" else j

    def exported(self, i: int) -> int:
        j = i + 1
        while self.word(j) in ("default", "async", "abstract", "declare"):
            j += 1
        if self.word(j) in ("function", "class", "interface", "enum", "namespace") and (end := self.body(j + 1)) is not None:
            return end
        if self.word(j) in ("{", "*"):
            return self.closed(self.ends_list(j))
        return self.closed(self.ends_list(i + 1))


def javascript_units(text: str) -> Iterator[Unit]:
    """Functions and classes (declared, or as expressions), methods, arrow functions, imports and exports."""
    yield from _Script(text, False).units()


def typescript_units(text: str) -> Iterator[Unit]:
    """As ``javascript_units``, with interfaces and type aliases."""
    yield from _Script(text, True).units()


def line_numbers(text: str, units: Iterator[Unit]) -> Iterator[tuple[str, str | None, int, int, str]]:
    """(kind, name, first line, last line, content) of units in order."""
    line, at = 1, 0
    for kind, name, start, end in units:
        line += text.count("\n", at, start)
        content = text[start:end]
        yield kind, name, line, line + content.count("\n"), content
        at = start


SCANNERS = {"python": python_units, "javascript": javascript_units, "typescript": typescript_units}
