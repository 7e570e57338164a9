"""Statements of texts that the queries' files don't have: broken, empty, nested and embedded ones."""

import pytest

from tracewell.functions import embedded, trees


def lines(language, text):
    return {r[0]: r[1:] for r in trees.describe(language, text)}


@pytest.mark.parametrize("language", trees.TREES)
@pytest.mark.parametrize("text", ["", "\n", "{{{", ")))", "if (", "x = ", '"open', "/* open", "class", "a\n\n\nb", "é = 日本;", "#define", "${", "<%", "{{", "EXEC SQL"])
def test_any_text_gives_a_row_a_line(language, text):
    found = trees.describe(language, text)
    assert [r[0] for r in found] == list(range(1, text.count("\n") + 2))


def test_deep_nesting_is_given_up():
    text = "{" * 50_000
    assert lines("java", text)[1][:2] in ((trees.OTHER, "low"), (trees.OTHER, "high"))


def test_empty_lines_belong_to_what_is_around_them():
    found = lines("java", "class A {\n  int a =\n\n    f();\n\n  int b;\n  void g() {\n    if (a) {\n\n      h();\n    }\n  }\n}")
    assert [found[k][0] for k in (3, 5, 9, 10)] == [trees.DECLARE, trees.OTHER, trees.COMPARE, trees.COMPARE]


def test_names_of_all_lines_of_a_statement():
    found = lines("java", "class A {\n  static final\n    int TOP = 1;\n  void g() { try (Reader r = open()) { x = y = 2; } }\n}")
    assert found[2][4] == found[3][4] == [("TOP", "constant")]
    assert found[4][4] == [("r", "var"), ("x", "var"), ("y", "var")]


def test_lambda_bodies_have_statements_of_their_own():
    found = lines("java", "class A { void g() {\n  Runnable q = () -> {\n    z = 3;\n  };\n} }")
    assert found[3][0] == trees.ASSIGN and found[3][4] == [("q", "var"), ("z", "var")] and found[4][0] == trees.DECLARE


def test_javascript_without_semicolons():
    found = lines("javascript", "const a = 1\nlet b = a\n  + 2\nb = 3\nconst { c, d: [e] } = f\n")
    assert [found[k][0] for k in range(1, 6)] == [trees.DECLARE, trees.DECLARE, trees.DECLARE, trees.ASSIGN, trees.DECLARE]
    assert found[3][4] == [("b", "var")] and found[5][4] == [("c", "constant"), ("e", "constant")]


def test_templates_within_typescript():
    text = "@Component({\n  template: `<b>\n    {{ a = b }}\n  </b>`\n})\nclass C { n = 1 }"
    assert embedded.inline_lines(text) == [(1, 3)]
    found = lines("typescript", text)
    assert found[3][0] == trees.ASSIGN and found[3][4] == [("a", "var")] and ("n", "var") in found[6][4]


def test_embedded_sql_ends_outside_of_literals():
    text = "int a;\nEXEC SQL INSERT INTO t\n  VALUES (';', :b) ;\n\nint c;"
    assert embedded.exec_lines(text) == [(1, 2)] and embedded.without_exec(text) == "int a;\n\n\n\nint c;"
    assert embedded.without_exec(text).count("\n") == text.count("\n")


def test_jsp_keeps_its_places():
    text = "<%@ page x %><%-- <% no(); %> --%>\n<% int a = 1; %>${fn:size(b)}"
    out = embedded.jsp_java(text)
    assert len(out) == len(text) and "int a = 1;" in out and "no()" not in out and "fn:" not in out and "size(b)" in out
