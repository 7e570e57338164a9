"""Constructs of files in languages with statements: the class of each line, the names it binds, its statement.

Brace languages are read by a tolerant parser of statements over tokens, Python by its own syntax tree.
A line has the class of the innermost construct around its first token.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from . import embedded

# --- fixed values: categories
COMPARE, BRANCH, DECLARE, ASSIGN, RETURN, COMMENT, OTHER = "比較", "分岐", "宣言", "代入", "return", "コメント", "その他"

BRACES = ("java", "c", "javascript", "typescript", "tsx")
TREES = (*BRACES, "python", *embedded.HOSTS)
#: Larger texts have no constructs.
MOST_BYTES = 12 << 20

_TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$#@][\w$]*|[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>>>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|\.\.\.|===|!==|==|!=|<=|>=|=>|->|::|\+\+|--|&&|\|\||\?\?|\?\.|[-+*/%&|^]=|\S)""", re.DOTALL)
_DIRECTIVE = re.compile(r"#(?:\\\r?\n|/\*.*?\*/|[^\n])*", re.DOTALL)
_ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_C_WORDS = set("const volatile static extern register inline unsigned signed long short restrict struct union enum".split())
_NOT_TYPES = set("return if else while for do switch case break continue goto sizeof throw new delete typeof instanceof in of await yield this super package import typedef class interface void".split()) - {"void"}
_GET_SET = re.compile(r"^(get|set)[A-Z]\w*$")
_JS = ("javascript", "typescript", "tsx")


@dataclass
class Node:
    kind: str
    first: int  # tokens, both ends included
    last: int
    constants: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    getters: list[str] = field(default_factory=list)
    setters: list[str] = field(default_factory=list)
    head: tuple[int, int] | None = None  # tokens of its condition


class Braces:
    """Statements of a text; ``nodes`` are what it found, outer ones after inner ones."""

    def __init__(self, language: str, text: str):
        self.language, self.nodes = language, []
        self.kind, self.word, self.line, self.end = [], [], [], []
        self.comments: list[tuple[int, int, int]] = []  # first and last line, offset
        self.offset: list[int] = []
        at, line, fresh = 0, 0, True
        while at < len(text):
            if text[at].isspace():
                if text[at] == "\n":
                    line, fresh = line + 1, True
                at += 1
                continue
            found = _DIRECTIVE.match(text, at) if language == "c" and fresh and text[at] == "#" else None
            kind = "directive" if found else ""
            if not found:
                found = _TOKEN.match(text, at)
                kind = found.lastgroup
            last = line + found[0].count("\n")
            if kind == "comment":
                self.comments.append((line, last, at))
            else:
                for column, value in ((self.kind, kind), (self.word, found[0]), (self.line, line), (self.end, last), (self.offset, at)):
                    column.append(value)
                fresh = False
            at, line = found.end(), last
        self.close = self._pairs()
        i = 0
        while i < len(self.word):
            i = max(i + 1, self.statement(i, "file"))

    def _pairs(self) -> dict[int, int]:
        """Closing bracket of each opening one; the end of the text where there is none."""
        open_, out = [], {}
        for i, (kind, word) in enumerate(zip(self.kind, self.word)):
            if kind == "op" and word in _CLOSES:
                open_.append(i)
            elif kind == "op" and word in ")]}":
                while open_ and _CLOSES[self.word[open_[-1]]] != word:
                    out[open_.pop()] = i - 1
                if open_:
                    out[open_.pop()] = i
        return out | {i: len(self.word) - 1 for i in open_}

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) and self.kind[i] != "text" else ""

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "name"

    def body(self, i: int, ctx: str) -> int:
        """Statements of the block that opens at i; the index after it."""
        last = self.close[i]
        j = i + 1
        while j < last:
            j = max(j + 1, self.statement(j, ctx, last))
        return last + 1

    def parens(self, i: int) -> int:
        """The index after the brackets that open at i, with what is in them."""
        if self.at(i) != "(":
            return i
        self.expression(i + 1, self.close[i])
        return self.close[i] + 1

    def statement(self, i: int, ctx: str, stop: int | None = None) -> int:
        stop = len(self.word) if stop is None else stop
        word = self.at(i)
        if i >= stop or word in (";", "}", ")", "]"):
            return i + 1
        if self.kind[i] == "directive":
            found = re.match(r"#\s*define\s+(\w+)(\(?)", self.word[i])
            if found:
                self.nodes.append(Node("macro" if found[2] else "define", i, i, constants=[found[1]]))
            return i + 1
        if word == "{":
            return self.body(i, "block")
        if self.language in _JS and ctx == "class":
            return self.member(i, stop)
        if word in ("if", "switch", "while", "for", "with", "catch", "synchronized") and (self.at(i + 1) == "(" or self.at(i + 2) == "("):
            opened = i + 1 if self.at(i + 1) == "(" else i + 2
            head = (opened, self.close[opened])
            if word == "for":
                self.loop_head(opened)
            after = self.parens(opened)
            after = self.statement(after, "block", stop)
            if word == "if" and self.at(after) == "else" and after < stop:
                after = self.statement(after + 1, "block", stop)
            self.nodes.append(Node(word, i, min(after, stop) - 1, head=head))
            return after
        if word in ("else", "finally", "try", "do"):
            after = i + 1
            if word == "try" and self.at(after) == "(":
                self.resources(after)
                after = self.parens(after)
            after = self.statement(after, "block", stop)
            if word == "do" and self.at(after) == "while":
                after = self.parens(after + 1)
            self.nodes.append(Node(word, i, min(after, stop) - 1))
            return after
        if word in ("case", "default") and ctx != "class" and self.at(i + 1) not in ("=", "("):
            while i < stop and self.at(i) not in (":", "->", "{", "}"):
                i += 1
            return i + 1
        return self.simple(i, ctx, stop)

    def ends_line(self, j: int) -> bool:
        """Whether a statement without a semicolon ends before token j."""
        if self.language not in _JS or self.line[j] == self.end[j - 1]:
            return False
        before, here = self.at(j - 1), self.at(j)
        goes_on = self.kind[j - 1] == "op" and before not in (")", "]", "}", "++", "--", ";") or before in ("extends", "new", "typeof", "return", "in", "of", "=>", "instanceof", "const", "let", "var")
        return not goes_on and not (self.kind[j] == "op" and here not in ("{", "++", "--", "@") and here != "!")

    def simple(self, i: int, ctx: str, stop: int) -> int:
        """A declaration, an expression, or a head with a body; the index after it."""
        j, flat, assigned, body, header = i, [], False, None, self.at(i)
        while j < stop:
            word = self.at(j)
            if word == ";" or (j > i and self.ends_line(j)):
                break
            if word in ("(", "["):
                flat.append(j)
                self.expression(j + 1, self.close[j])
                j = self.close[j] + 1
                continue
            if word == "{":
                plain = not assigned and not (self.language in _JS and (header in ("return", "throw", "export") and self.at(j - 1) in ("return", "throw") or header in ("const", "let", "var", "import") or self.at(j - 1) in ("(", ",", "=>", ":")))
                if self.language in _JS and self.at(j - 1) == "=>":
                    plain = False
                    self.body(j, "block")
                elif plain:
                    words = {self.at(k) for k in flat}
                    kind = "class" if words & ({"class"} if self.language in _JS else {"class", "interface", "enum", "record"}) else "struct" if words & {"struct", "union"} and self.language == "c" else "block"
                    if "enum" not in words or self.language == "java":
                        self.body(j, kind)
                    body = j
                else:
                    self.body(j, "class" if self.at(j - 1) == ")" and self.language == "java" else "block")
                flat.append(j)
                j = self.close[j] + 1
                if plain and not (self.language == "c" and (header in ("struct", "union", "enum", "typedef", "static", "const") and self.at(flat[-2] if len(flat) > 1 else i) != "(")):
                    break
                continue
            if word in ("}", ")", "]"):
                break
            assigned |= word in _ASSIGNS
            flat.append(j)
            j += 1
        last = max(i, j - 1)
        after = j + 1 if self.at(j) == ";" and j < stop else max(j, i + 1)
        end = after - 1 if self.at(after - 1) == ";" else last
        self.describe(i, last, end, flat, ctx, body)
        return after

    def describe(self, i: int, last: int, end: int, flat: list[int], ctx: str, body: int | None) -> None:
        head = self.at(i)
        start = i
        while head in ("export", "declare", "async") and self.language in _JS:
            start += 1
            head = self.at(start)
            if head == "default":
                start += 1
                head = self.at(start)
        if head == "return":
            self.assignments(flat)
            self.nodes.append(Node("return", i, end))
        elif self.language in _JS and head in ("const", "let", "var") and not (head == "const" and self.at(start + 1) == "enum"):
            names: list[str] = []
            for k in self.declarators(start + 1, last):
                self.pattern(k, names)
            self.nodes.append(Node("declare", start, end, constants=names if head == "const" else [], names=[] if head == "const" else names))
        elif self.language in _JS and head == "import":
            self.nodes.append(Node("declare", i, end))
        elif self.language in ("typescript", "tsx") and (head in ("enum", "interface") or head == "const" or head == "type" and self.name(start + 1)):
            members = []
            if body is not None and head in ("enum", "const"):
                members = [self.word[k] for k in self.declarators(body + 1, self.close[body] - 1) if self.name(k)]
            self.nodes.append(Node("declare", start, end, constants=members))
        elif self.language in ("java", "c") and head not in ("package", "import", "typedef", "throw", "break", "continue", "goto", "using") and (found := self.declared(i, flat, body)) is not None:
            names, fixed = found
            self.nodes.append(Node("declare", i, end, constants=names if fixed else [], names=[] if fixed else names))
        else:
            self.assignments(flat)
            if body is None:
                self.nodes.append(Node("expression", i, end))

    def declarators(self, i: int, last: int) -> list[int]:
        """Where each of the parts between commas begins."""
        out, j, fresh = [], i, True
        while j <= last:
            if fresh:
                out.append(j)
                fresh = False
            if self.at(j) in _CLOSES:
                j = self.close[j]
            elif self.at(j) == ",":
                fresh = True
            j += 1
        return out

    def pattern(self, i: int, names: list[str]) -> None:
        """Names that a target binds."""
        if self.at(i) in ("{", "["):
            for k in self.declarators(i + 1, self.close[i] - 1):
                if self.at(k) == "...":
                    k += 1
                elif self.at(i) == "{" and self.at(k + 1) == ":":
                    k += 2
                if k < self.close[i]:
                    self.pattern(k, names)
        elif self.name(i):
            names.append(self.word[i])

    def declared(self, i: int, flat: list[int], body: int | None) -> tuple[list[str], bool] | None:
        """(names, whether constant) if the tokens are a declaration of variables."""
        at, words = 0, []
        java = self.language == "java"
        while at < len(flat) and (self.at(flat[at]) in (_MODIFIERS if java else _C_WORDS) or self.at(flat[at]).startswith("@")):
            words.append(self.at(flat[at]))
            at += 2 if self.at(flat[at]) in ("struct", "union", "enum") and at + 1 < len(flat) and self.name(flat[at + 1]) else 1
            if at < len(flat) and self.at(flat[at]) == "(" and words[-1].startswith("@"):
                at += 1
            if at < len(flat) and flat[at] == body:
                at += 1
        typed = bool({"struct", "union", "enum", "unsigned", "signed", "long", "short"} & set(words)) and not java
        if at < len(flat) and self.name(flat[at]) and self.at(flat[at]) not in _NOT_TYPES and not (typed and (at + 1 >= len(flat) or self.at(flat[at + 1]) in ("=", ",", "[", ";"))):
            at += 1
            typed = True
            while at + 1 < len(flat) and self.at(flat[at]) == "." and self.name(flat[at + 1]):
                at += 2
            if java and at < len(flat) and self.at(flat[at]) == "<":
                depth = 0
                while at < len(flat):
                    depth += {"<": 1, ">": -1}.get(self.at(flat[at]), 0)
                    at += 1
                    if depth == 0:
                        break
            while at < len(flat) and (self.at(flat[at]) in ("*", "const", "volatile") if not java else self.at(flat[at]) == "[" and self.close[flat[at]] == flat[at] + 1):
                words.append(self.at(flat[at]))
                at += 1
        if not typed or body is not None and (at >= len(flat) or body >= flat[at] and "=" not in [self.at(k) for k in flat]):
            return None
        names, fresh, depth, prototype = [], True, 0, False
        for place in range(at, len(flat)):
            k, word = flat[place], self.at(flat[place])
            following = self.at(flat[place + 1]) if place + 1 < len(flat) else ";"
            if fresh and word == "*":
                continue
            if fresh and self.name(k):
                if following in ("=", ",", ";", "[", ":"):
                    names.append(word)
                elif following == "(" and not java:
                    prototype = True
                elif not names:
                    return None
                fresh = False
            elif fresh and word == "(" and not java and self.at(k + 1) == "*":
                prototype, fresh = True, False
            elif word == ",":
                fresh = True
            elif fresh:
                return None
        if not names and not prototype:
            return None
        return names, ({"static", "final"} <= set(words) if java else "const" in words)

    def assignments(self, flat: list[int]) -> None:
        """An assignment, and those on its right side, among tokens on one level."""
        start = 0
        for place, k in enumerate(flat):
            word = self.at(k)
            if word in (",", "?", ":", "=>", "&&", "||", ";"):
                start = place + 1
            elif word in _ASSIGNS and place > start:
                end = next((p for p in range(place + 1, len(flat)) if self.at(flat[p]) in (",", ";")), len(flat)) - 1
                last = flat[end]
                left = flat[start:place]
                if self.at(left[0]) == "return":
                    left = left[1:]
                names = [self.word[left[0]]] if len(left) == 1 and self.name(left[0]) else []
                if left:
                    self.nodes.append(Node("assign", left[0], self.close.get(last, last), names=names))
                start = place + 1

    def expression(self, i: int, stop: int) -> None:
        """Assignments and bodies within brackets."""
        flat, j = [], i
        while j < stop:
            word = self.at(j)
            flat.append(j)
            if word in ("(", "["):
                self.expression(j + 1, self.close[j])
                j = self.close[j]
            elif word == "{":
                self.body(j, "class" if self.at(j - 1) == ")" and self.language == "java" else "block")
                j = self.close[j]
            j += 1
        self.assignments(flat)

    def loop_head(self, opened: int) -> None:
        flat, j = [], opened + 1
        while j < self.close[opened] and self.at(j) != ";":
            flat.append(j)
            j = self.close[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
        if self.language in _JS and flat and self.at(flat[0]) in ("const", "let", "var") and {"of", "in"}.isdisjoint(map(self.at, flat)):
            self.describe(flat[0], flat[-1], flat[-1], flat, "block", None)
        elif self.language not in _JS and ":" not in map(self.at, flat) and flat:
            found = self.declared(flat[0], flat, None)
            if found:
                self.nodes.append(Node("declare", flat[0], flat[-1], constants=found[0] if found[1] else [], names=[] if found[1] else found[0]))

    def resources(self, opened: int) -> None:
        begin = opened + 1
        for j in range(opened + 1, self.close[opened] + 1):
            if self.at(j) in (";", ")") and j > begin:
                flat = [k for k in range(begin, j)]
                cut = next((n for n, k in enumerate(flat) if self.at(k) == "="), None)
                if cut and self.name(flat[cut - 1]) and cut > 1:
                    self.nodes.append(Node("resource", begin, j - 1, names=[self.word[flat[cut - 1]]]))
                begin = j + 1

    def member(self, i: int, stop: int) -> int:
        """A field or method of a class body."""
        j, words = i, []
        while j < stop and (self.name(j) or self.at(j) in ("*", "[", "(", "!", "?", ":")) and self.at(j) not in (";", "="):
            if self.at(j) in ("(", "[", ":"):
                break
            words.append(j)
            j += 1
            if j < stop and self.ends_line(j) and self.at(j) not in ("(", "{", "=", ":", "?"):
                break
        names = [k for k in words if self.name(k) and not self.at(k).startswith("@")]
        if not names:
            return self.simple(i, "block", stop)
        own, before = names[-1], {self.at(k) for k in names[:-1]}
        if self.at(j) == "(" or self.at(j) == "<":
            after = self.parens(j) if self.at(j) == "(" else j
            while after < stop and self.at(after) not in ("{", ";", "}"):
                after = self.close[after] + 1 if self.at(after) in ("(", "[") else after + 1
            if self.at(after) == "{":
                after = self.body(after, "block")
            get_set = {"getters": [self.word[own]]} if "get" in before else {"setters": [self.word[own]]} if "set" in before else {}
            self.nodes.append(Node("method", i, after - 1, **get_set))
            return after
        after = j
        while after < stop and self.at(after) != ";" and not (after > j and self.ends_line(after)):
            if self.at(after) == "(" or self.at(after) == "[":
                self.expression(after + 1, self.close[after])
            elif self.at(after) == "{":
                self.body(after, "block")
            after = self.close[after] + 1 if self.at(after) in _CLOSES else after + 1
        end = after if self.at(after) == ";" and after < stop else after - 1
        fixed = "readonly" in before and self.language != "javascript"
        self.nodes.append(Node("field", i, max(i, end), constants=[self.word[own]] if fixed else [], names=[] if fixed else [self.word[own]]))
        return end + 1


#: Classes of constructs; the others have none of their own.
_CLASSES = {"if": COMPARE, "switch": BRANCH, "declare": DECLARE, "field": DECLARE, "define": DECLARE, "assign": ASSIGN, "return": RETURN}
_SPANS = {"if", "switch", "while", "for", "do", "try", "declare", "field", "return", "expression", "method"}


def _lists(size: int) -> list[tuple[list, list, list, list]]:
    return [([], [], [], []) for _ in range(size)]


def _settled(found: list[tuple[list, list, list, list]]) -> list[list[tuple[str, str]]]:
    """(name, kind) of each line, each once; a constant is no variable beside."""
    out = []
    for constants, names, getters, setters in found:
        names = [n for n in names if n not in constants]
        out.append([(x, kind) for group, kind in ((constants, "constant"), (names, "var"), (getters, "getter"), (setters, "setter")) for x in dict.fromkeys(group)])
    return out


def _braces(language: str, text: str) -> list[tuple]:
    p, size = Braces(language, text), text.count("\n") + 1
    lines = [[OTHER, "high", None, None] for _ in range(size)]
    bound = _lists(size)
    # innermost construct of each token: longer ones first, so that shorter ones come on top
    order = sorted(p.nodes, key=lambda n: n.first - n.last)
    of_class: list[Node | None] = [None] * len(p.word)
    around: dict[int, Node | None] = {}
    of_span: list[Node | None] = [None] * len(p.word)
    for node in order:
        if node.kind in _CLASSES:
            around[id(node)] = of_class[node.first]
            of_class[node.first : node.last + 1] = [node] * (node.last + 1 - node.first)
        if node.kind in _SPANS:
            of_span[node.first : node.last + 1] = [node] * (node.last + 1 - node.first)
    for node in sorted(p.nodes, key=lambda n: (n.first, n.last)):
        for line in range(p.line[node.first], p.end[node.last] + 1):
            for group, values in zip(bound[line], (node.constants, node.names, node.getters, node.setters)):
                group += values
    if language == "java":
        for i, word in enumerate(p.word):
            if p.kind[i] == "name" and _GET_SET.match(word) and p.at(i + 1) == "(" and p.at(i - 1) != "new":
                bound[p.line[i]][2 if word[0] == "g" else 3].append(word)
    first: dict[int, tuple[int, int]] = {}
    for i, line in enumerate(p.line):
        first.setdefault(line, (p.offset[i], i))
    for a, b, offset in p.comments:
        if a not in first or offset < first[a][0]:
            first[a] = (offset, -1)
        for line in range(a + 1, b + 1):
            first.setdefault(line, (-1, -1)) if line < b else first.update({line: (-1, -1)})
    before = -1
    for line in range(size):
        i = first.get(line, (0, None))[1]
        if i == -1:
            lines[line][:2] = [COMMENT, "low"]
            continue
        if i is None:  # an empty line, or one within a token: what is around it
            node = of_class[before] if before >= 0 else None
            while node and p.end[before] < line and node.last <= before:
                node = around[id(node)]
            if node:
                lines[line][0] = _CLASSES[node.kind]
            continue
        before = max(before, i)
        lines[line][0] = _CLASSES[of_class[i].kind] if of_class[i] else OTHER
        node = of_span[i]
        if node:
            a, b = node.head if node.head and node.kind in ("if", "switch", "while", "for") else (node.first, node.last)
            lines[line][2:] = [p.line[a], p.end[b]]
        while before + 1 < len(p.word) and p.line[before + 1] == line:
            before += 1
    return [(k + 1, *values, names) for k, (values, names) in enumerate(zip(lines, _settled(bound)))]


def _python(text: str) -> list[tuple]:
    size = text.count("\n") + 1
    lines: list[list] = [[OTHER, "high", None, None] for _ in range(size)]
    bound = _lists(size)
    tree = ast.parse(text)
    classes = {ast.If: COMPARE, ast.Match: BRANCH, ast.Assign: ASSIGN, ast.AugAssign: ASSIGN, ast.AnnAssign: ASSIGN, ast.Return: RETURN, ast.Import: DECLARE, ast.ImportFrom: DECLARE}

    def target(node, constants: list, names: list) -> None:
        if isinstance(node, ast.Name):
            (constants if re.match(r"^[A-Z_][A-Z0-9_]+$", node.id) else names).append(node.id)
        elif isinstance(node, (ast.Tuple, ast.List)):
            for x in node.elts:
                target(x, constants, names)
        elif isinstance(node, ast.Starred) and isinstance(node.value, ast.Name):
            names.append(node.value.id)

    def visit(node, category: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            mine = category
            if isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)) and hasattr(child, "lineno"):
                mine = classes.get(type(child), category)
                begin = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
                for k in range(begin - 1, child.end_lineno):
                    lines[k][0] = mine or OTHER
                if isinstance(child, (ast.Return, ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Import, ast.ImportFrom)):
                    for k in range(child.lineno - 1, child.end_lineno):
                        lines[k][2:] = [child.lineno - 1, child.end_lineno - 1]
                targets = child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []
                for k in range(child.lineno - 1, child.end_lineno):
                    for t in targets:
                        target(t, bound[k][0], bound[k][1])
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    for d in child.decorator_list:
                        group = 2 if isinstance(d, ast.Name) and d.id == "property" else 3 if isinstance(d, ast.Attribute) and d.attr == "setter" else None
                        if group is not None:
                            for k in range(begin - 1, child.end_lineno):
                                bound[k][group].append(child.name)
                            break
            visit(child, mine)

    visit(tree, None)
    for k, line in enumerate(text.split("\n")):
        if line.lstrip().startswith("#") and not (k < size and lines[k][2] is not None and lines[k][2] < k):
            lines[k][:2] = [COMMENT, "low"]
    return [(k + 1, *values, names) for k, (values, names) in enumerate(zip(lines, _settled(bound)))]


def describe(language: str, text: str) -> list[tuple]:
    """(lineno, category, confidence, first, last, [(name, kind)]) of each line; line numbers of a span from 0, null without one.

    Nothing is known of a text that is too large or can't be read: other, with low confidence.
    """
    try:
        if len(text.encode("utf-8", "replace")) > MOST_BYTES:
            raise ValueError("too large")
        if language == "python":
            return _python(text)
        rows = _braces(embedded.HOSTS.get(language, language), embedded.host_source(language, text))
    except (SyntaxError, ValueError, RecursionError):
        return [(k + 1, OTHER, "low", None, None, []) for k in range(text.count("\n") + 1)]
    # what a statement is in the files that hold another language
    if language in ("jsp", "angular", "angular_inline"):
        rows = [(*r[:3], None, None, r[5]) for r in rows]
    spans = embedded.exec_lines(text) if language == "proc" else embedded.jsp_lines(text) if language == "jsp" else []
    for first, last in reversed(spans):
        for k in range(first, last + 1):
            rows[k] = (*rows[k][:3], first, last, rows[k][5])
    if language == "typescript" and (inner := embedded.inline_lines(text)):
        within = describe("angular_inline", text)
        for first, last in inner:
            rows[first : last + 1] = within[first : last + 1]
    return rows
