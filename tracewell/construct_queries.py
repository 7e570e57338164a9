"""Queries over files made for each part, in languages that are read as a whole, and what each line must give.

A file's lines are those of its language below, with the part's key for ``K``. Beside each line stands
what a reader of the language finds there: class, confidence, the names bound, and the lines that a
snippet takes (from 0, none where there is no statement). The SQL states these, without any parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import constructs
from .queries import query, table

C, B, D, A, R, N, O = "比較", "分岐", "宣言", "代入", "return", "コメント", "その他"

#: Line, class, confidence, names, first and last line of its statement.
LINES: dict[str, list[tuple[str, str, str, str, int | None, int | None]]] = {
    "java": [
        ("public class TK extends Base {", O, "high", "", None, None),
        ("    private static final String CODE_K = \"X; = {\";", D, "high", "constant:CODE_K", 1, 1),
        ("    /* vK = 1;", N, "low", "", None, None),
        ("       end */", N, "low", "", None, None),
        ("    int aK, bK = f(1), cK[] = {1};", D, "high", "var:aK,var:bK,var:cK", 4, 4),
        ("    Map<String, List<Integer>> mK = new TreeMap<>();", D, "high", "var:mK", 5, 5),
        ("    void run(int p) {", O, "high", "", None, None),
        ("        xK = CODE_K;", A, "high", "var:xK", 7, 7),
        ("        if (aK == bK", C, "high", "", 8, 9),
        ("            && cK) {", C, "high", "", 8, 9),
        ("            foo(xK);", C, "high", "", 10, 10),
        ("        }", C, "high", "", 8, 9),
        ("        svc.setValue(svc.getName());", O, "high", "getter:getName,setter:setValue", 12, 12),
        ("        switch (xK) { case 1: yK += 2; break; }", B, "high", "var:yK", 13, 13),
        ("        // note", N, "low", "", None, None),
        ("        return aK;", R, "high", "", 15, 15),
        ("    }", O, "high", "", None, None),
        ("}", O, "high", "", None, None),
    ],
    "c": [
        ("#define MAX_K 10", D, "high", "constant:MAX_K", None, None),
        ("#define F_K(x) (x)", O, "high", "constant:F_K", None, None),
        ("int main(void) {", O, "high", "", None, None),
        ("  const char *pK = \"a;\", qK[3];", D, "high", "constant:pK,constant:qK", 3, 3),
        ("  static unsigned long nK;", D, "high", "var:nK", 4, 4),
        ("  struct S sK = {1};", D, "high", "var:sK", 5, 5),
        ("  int protoK(int);", D, "high", "", 6, 6),
        ("  xK = yK = 3;", A, "high", "var:xK,var:yK", 7, 7),
        ("  *rK = 4;", A, "high", "", 8, 8),
        ("  call(", O, "high", "", 9, 10),
        ("    nK);", O, "high", "", 9, 10),
        ("  if (xK == 7) return 1;", C, "high", "", 11, 11),
        ("  while (nK) { call(nK); }", O, "high", "", 12, 12),
        ("}", O, "high", "", None, None),
    ],
    "proc": [
        ("int fK(void) {", O, "high", "", None, None),
        ("  int aK = 1;", D, "high", "var:aK", 1, 1),
        ("  EXEC SQL UPDATE t SET v = 'a;b'", O, "high", "", 2, 3),
        ("    WHERE k = :aK;", O, "high", "", 2, 3),
        ("  bK = aK;", A, "high", "var:bK", 4, 4),
        ("}", O, "high", "", None, None),
    ],
    "python": [
        ("import os", D, "high", "", 0, 0),
        ("# note", N, "low", "", None, None),
        ("LIMIT_K = lowK = 1", A, "high", "constant:LIMIT_K,var:lowK", 2, 2),
        ("def runK(x):", O, "high", "", None, None),
        ("    if x == LIMIT_K:", C, "high", "", None, None),
        ("        return g(", R, "high", "", 5, 6),
        ("            x)", R, "high", "", 5, 6),
        ("    hK, *tK = 1, 2", A, "high", "var:hK,var:tK", 7, 7),
        ("    d[x] = 3", A, "high", "", 8, 8),
        ("    lowK += 1", A, "high", "", 9, 9),
        ("class CK:", O, "high", "", None, None),
        ("    @property", O, "high", "getter:vK", None, None),
        ("    def vK(self):", O, "high", "getter:vK", None, None),
        ("        return 1", R, "high", "getter:vK", 13, 13),
    ],
    "javascript": [
        ("import { a } from 'b';", D, "high", "", 0, 0),
        ("const XK = 1, { y, z: wK, ...rK } = f();", D, "high", "constant:XK,constant:y,constant:wK,constant:rK", 1, 1),
        ("let qK = 2", D, "high", "var:qK", 2, 2),
        ("qK += 1", A, "high", "var:qK", 3, 3),
        ("function gK(a) {", O, "high", "", None, None),
        ("  if (a === XK) { hK = 2; }", C, "high", "var:hK", 5, 5),
        ("  switch (a) { case 1: return 2 }", B, "high", "", 6, 6),
        ("}", O, "high", "", None, None),
    ],
    "typescript": [
        ("enum EK { A, B = 2 }", D, "high", "constant:A,constant:B", 0, 0),
        ("interface IK { a: string }", D, "high", "", 1, 1),
        ("type TK = string;", D, "high", "", 2, 2),
        ("class CK {", O, "high", "", None, None),
        ("  private readonly kK = 3;", D, "high", "constant:kK", 4, 4),
        ("  nK: number = 4;", D, "high", "var:nK", 5, 5),
        ("  get vK() { return this.nK; }", O, "high", "getter:vK", 6, 6),
        ("  set vK(x) { this.nK = x; }", O, "high", "setter:vK", 7, 7),
        ("}", O, "high", "", None, None),
    ],
    "jsp": [
        ("<%@ page import=\"x\" %>", O, "high", "", 0, 0),
        ("<%-- int no = 1; --%>", O, "high", "", 1, 1),
        ("<b><% int aK = 1; %></b>", D, "high", "var:aK", 2, 2),
        ("<% bK = 2;", A, "high", "var:bK", 3, 4),
        ("   cK = 3; %>", A, "high", "var:cK", 3, 4),
        ("<p>dK = 4</p>", O, "high", "", None, None),
    ],
    "angular": [
        ("<p>{{ aK = bK | pipe }}</p>", A, "high", "var:aK", None, None),
        ("<!-- {{ no = 1 }} -->", O, "high", "", None, None),
        ("<b (click)=\"cK = 2; d()\">x</b>", A, "high", "var:cK", None, None),
    ],
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(language: str) -> str:
    rows = (f"({k + 1}, {_quoted(c)}, {_quoted(f)}, {_quoted(n)}, {'NULL' if a is None else a}, {'NULL' if b is None else b})" for k, (_, c, f, n, a, b) in enumerate(LINES[language]))
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(lineno, category, confidence, names, a, b)"


def _files(spark, sf_dir, language: str):
    text = "\n".join(line for line, *_ in LINES[language])
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit(f"{language}/"), key).alias("relpath"), F.lit(language).alias("language"), F.replace(F.lit(text), F.lit("K"), key).alias("text"))


def _register(language: str) -> None:
    def run(spark, sf_dir):
        found = constructs(_files(spark, sf_dir, language))
        return found.select("relpath", "lineno", "category", "confidence", F.array_join(F.transform("names", lambda x: F.concat_ws(":", x["kind"], x["symbol"])), ",").alias("names"), "first", "last")

    run.__name__ = f"constructs_{language}"
    query(f"SELECT '{language}/' || p_partkey AS relpath, lineno::INT AS lineno, category, confidence, replace(names, 'K', p_partkey::VARCHAR) AS names, a::INT AS first, b::INT AS last FROM part, ({_values(language)})")(run)


for _language in LINES:
    _register(_language)
