"""Code within other text: what is no code of the host language is blanked, and every line stays where it is."""

from __future__ import annotations

import re

from . import patterns as P

# --- fixed values: what marks code and what doesn't, by kind of file
JSP_OUT = (r"<%--.*?--%>", r"<!--.*?-->", r"<%@.*?%>", r"</?jsp:[^>]*?/?>")
JSP_CODE, JSP_EXPRESSION, JSP_PREFIX = r"<%[=!]?(.*?)%>", r"[$#]\{(.*?)\}", r"\b[A-Za-z_]\w*:"
TEMPLATE_OUT, TEMPLATE_VALUE = r"<!--.*?-->", r"\{\{(.*?)\}\}"
TEMPLATE_BINDING = r"""(?:\[\(?[\w.$-]+\)?\]|\([\w.$-]+\)|\*[\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
TEMPLATE_INLINE, TEMPLATE_PIPE = r"\btemplate\s*:\s*`(.*?)`", r"(?<!\|)\|(?!\|)"
EXEC_BLOCK = r"(?i)\bEXEC\s+(?:SQL|ORACLE)\b.*?(?:;|END-EXEC\b)"
#: The language that what is left is read as.
HOSTS = {"proc": "c", "jsp": "java", "angular": "typescript", "angular_inline": "typescript"}

Span = tuple[int, int]


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _without(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = re.sub(pattern, lambda m: blank(m[0]), text, flags=re.DOTALL)
    return text


def _only(text: str, parts: list[tuple[int, str]]) -> str:
    """A blank text with each of the parts at its place."""
    out, chars = blank(text), []
    at = 0
    for start, part in sorted(parts):
        part = part[max(0, at - start) :]
        start = max(at, start)
        chars += [out[at:start], part]
        at = start + len(part)
    return "".join([*chars, out[at:]])


def _lines(text: str, spans: list[Span]) -> list[Span]:
    """First and last line of spans of characters, from 0."""
    return [(text.count("\n", 0, a), text.count("\n", 0, b)) for a, b in spans]


def _exec(text: str) -> list[Span]:
    # a semicolon in a literal ends nothing
    return [m.span() for m in re.finditer(EXEC_BLOCK, _without(text, P.LITERALS["proc"]), re.DOTALL)]


def without_exec(text: str) -> str:
    """Pro*C as C: embedded statements leave their line ends only."""
    out, at = [], 0
    for a, b in _exec(text):
        out += [text[at:a], "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


def exec_lines(text: str) -> list[Span]:
    return _lines(text, _exec(text))


def jsp_java(text: str) -> str:
    """The Java of a JSP: scriptlets, expressions, and expression language without its prefixes."""
    code = _without(text, *JSP_OUT)
    parts = [(m.start(1), text[m.start(1) : m.end(1)]) for m in re.finditer(JSP_CODE, code, re.DOTALL)]
    for m in re.finditer(JSP_EXPRESSION, code, re.DOTALL):
        parts.append((m.start(1), _without(text[m.start(1) : m.end(1)], JSP_PREFIX)))
    return _only(text, parts)


def jsp_lines(text: str) -> list[Span]:
    return _lines(text, [m.span() for m in re.finditer(JSP_CODE, text, re.DOTALL)])


def _plain(expression: str) -> str:
    """A template's expression as one of the host: the first of several, a loop as an assignment, without pipes."""
    head = re.sub(r"\bof\b", "=", expression.split(";", 1)[0])
    return re.split(TEMPLATE_PIPE, head, maxsplit=1)[0]


def template_expressions(text: str) -> str:
    """The expressions of a template's values and bindings."""
    seen = _without(text, TEMPLATE_OUT)
    parts = [(m.start(1), _plain(text[m.start(1) : m.end(1)])) for m in re.finditer(TEMPLATE_VALUE, seen, re.DOTALL)]
    for m in re.finditer(TEMPLATE_BINDING, seen, re.DOTALL):
        k = 1 if m[1] is not None else 2
        parts.append((m.start(k), _plain(text[m.start(k) : m.end(k)])))
    return _only(text, parts)


def inline_expressions(text: str) -> str:
    """The same for the templates within a source of TypeScript."""
    return template_expressions(_only(text, [(m.start(1), m[1]) for m in re.finditer(TEMPLATE_INLINE, text, re.DOTALL)]))


def inline_lines(text: str) -> list[Span]:
    """Lines of the templates within a source of TypeScript; those are of the language angular_inline."""
    return _lines(text, [m.span(1) for m in re.finditer(TEMPLATE_INLINE, text, re.DOTALL)])


_READ = {"proc": without_exec, "jsp": jsp_java, "angular": template_expressions, "angular_inline": inline_expressions}


def host_source(language: str, text: str) -> str:
    return _READ[language](text) if language in _READ else text
