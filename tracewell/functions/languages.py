"""Language of a file, class of a line and names that it binds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Languages that are analysed line by line.
LINE_LANGUAGES = ("sql", "shell", "perl", "groovy")

#: Languages whose lines can't be judged for themselves.
TREE_LANGUAGES = ("java", "jsp", "c", "proc", "python", "javascript", "typescript", "tsx", "angular", "angular_inline")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def extension(path: Column) -> Column:
    """The last dot of a file's name and what follows, in lower case; none for leading dots only."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def interpreter(text: Column) -> Column:
    """Name of the interpreter in the first line, without version; null without a shebang."""
    line = F.substring_index(text, "\n", 1)
    first, second = (F.regexp_extract(line, P.java(P.SHEBANG), k) for k in (1, 2))
    base = lambda c: F.substring_index(c, "/", -1)
    name = F.when((base(first) == "env") & (second != ""), base(second)).otherwise(base(first))
    bare = F.regexp_replace(name, r"\d[\d.]*$", "")
    return F.when(line.rlike(P.java(P.SHEBANG)), F.when(bare == "", name).otherwise(bare))


def shebang_language(text: Column) -> Column:
    return F.try_element_at(_lookup(P.INTERPRETERS), interpreter(text))


def resolved_by_name(path: Column, lang_map: dict[str, str] | None = None) -> Column:
    return extension(path).isin([*P.EXTENSIONS, ".html", ".htm", *(lang_map or {})])


def detect_language(path: Column, text: Column, lang_map: dict[str, str] | None = None) -> Column:
    """By the map given, the file's name, its first line, then by embedded SQL, else C."""
    sample, ext = F.substring(text, 1, P.SAMPLE_CHARS), extension(path)
    outside = F.regexp_replace(sample, P.java(P.LITERALS["proc"], "s"), "  ")
    embedded, known = outside.rlike(P.java(P.EXEC_SQL)), F.try_element_at(_lookup(P.EXTENSIONS), ext)
    found = F.when(known.isin("c", "proc"), F.when(embedded, "proc").otherwise(known))
    found = found.when(ext.isin(".html", ".htm"), F.when(sample.rlike(P.java(P.ANGULAR)), "angular").otherwise("html"))
    found = found.when(known.isNotNull(), known).when(shebang_language(sample).isNotNull(), shebang_language(sample))
    found = found.when(embedded, "proc").otherwise("c")
    return F.coalesce(F.try_element_at(_lookup(lang_map), ext), found) if lang_map else found


def detect_dialect(path: Column, text: Column) -> Column:
    shell = interpreter(F.substring(text, 1, P.SAMPLE_CHARS))
    by_name = F.when(extension(path).isin(".csh", ".tcsh"), "cshell").otherwise("bourne")
    return F.when(shell.isin(*P.BOURNE_SHELLS), "bourne").when(shell.isin(*P.C_SHELLS), "cshell").otherwise(by_name)


def mask(language: str, line: Column) -> Column:
    """Literals and comments blanked; their length does not matter to what reads a masked line."""
    return F.regexp_replace(line, P.java(P.LITERALS[language], "s"), "  ")


def _classify(language: str, rules: str, line: Column, comment: Column) -> Column:
    masked, category = mask(language, line), None
    for pattern, name in P.RULES[rules]:
        category = (F.when if category is None else category.when)(masked.rlike(P.java(pattern)), name)
    return F.struct(F.when(comment, P.COMMENTS).otherwise(category.otherwise(P.OTHER)).alias("category"), F.when(comment, "low").otherwise("medium").alias("confidence"))


def classify(language: str, line: Column, dialect: str = "bourne") -> Column:
    """(category, confidence) of a line of sql, shell, perl or groovy."""
    line = F.substring(line, 1, P.GROOVY_CHARS if language == "groovy" else P.CLASSIFIED_CHARS)
    return _classify(language, dialect if language == "shell" else language, line, line.rlike(P.java(P.COMMENT[language])))


def classify_line(language: Column, dialect: Column, line: Column) -> Column:
    """The same for a column of languages; one that isn't known is taken for a Bourne shell.

    Languages that need a syntax tree have no class here: other, with low confidence.
    """
    fixed = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    out = F.when(language == "html", fixed(P.OTHER, "high")).when(language.isin(*TREE_LANGUAGES), fixed(P.OTHER, "low"))
    for name in ("sql", "perl", "groovy"):
        out = out.when(language == name, classify(name, line))
    return out.when((language == "shell") & (dialect == "cshell"), classify("shell", line, "cshell")).otherwise(classify("shell", line))


def _none() -> Column:
    return F.array().cast("array<string>")


def _symbols(constants: Column | None, variables: Column) -> Column:
    constants = _none() if constants is None else F.array_distinct(constants)
    return F.struct(constants.alias("constants"), F.array_except(variables, constants).alias("vars"))


def _all(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(line, F.lit(P.java(pattern)), F.lit(group))


def bound_names(language: str, line: Column, dialect: str = "bourne") -> Column:
    """(constants, vars) that a line of sql, shell, perl or groovy binds, each once, in order."""
    line = mask(language, F.substring(line, 1, P.GROOVY_CHARS if language == "groovy" else P.BOUND_CHARS))
    if language == "sql":
        return _symbols(_all(line, P.SQL_CONSTANT), _all(line, P.SQL_BINDS))
    if language == "perl":
        return _symbols(_all(line, P.PERL_CONSTANT), _all(line, P.PERL_BINDS))
    if language == "groovy":
        pairs = F.arrays_zip(_all(line, P.GROOVY_MODIFIED).alias("m"), _all(line, P.GROOVY_MODIFIED, 2).alias("n"))
        final = F.filter(pairs, lambda p: F.array_contains(F.split(p["m"], r"\s+"), "final"))
        return _symbols(F.transform(final, lambda p: p["n"]), _all(line, P.GROOVY_BINDS))
    one = lambda pattern, *groups: F.filter(F.array(F.coalesce(*[F.nullif(F.regexp_extract(line, P.java(pattern), g), F.lit("")) for g in groups])), lambda x: x.isNotNull())
    if dialect == "cshell":
        return _symbols(None, one(P.CSHELL_BINDS, 1, 2, 3))
    readonly = one(P.BOURNE_READONLY, 1)
    return F.when(F.size(readonly) > 0, _symbols(readonly, _none())).otherwise(_symbols(None, one(P.BOURNE_BINDS, 1)))


def bound_names_of(language: Column, dialect: Column, line: Column) -> Column:
    out = F.when(language == "sql", bound_names("sql", line))
    for name in ("perl", "groovy"):
        out = out.when(language == name, bound_names(name, line))
    out = out.when((language == "shell") & (dialect == "cshell"), bound_names("shell", line, "cshell")).when(language == "shell", bound_names("shell", line))
    return out.otherwise(_symbols(None, _none()))


def rejection(symbol: Column, language: Column, min_length: int = 2, stoplist: list[str] | None = None) -> Column:
    """Why a name isn't followed: keyword, too_short or user_stoplist; null if it is."""
    reserved = _lookup_arrays({k: v.split() for k, v in P.RESERVED.items()})
    out = F.when(F.coalesce(F.array_contains(F.try_element_at(reserved, language), symbol), F.lit(False)), "keyword").when(F.length(symbol) < min_length, "too_short")
    return out.when(symbol.isin(stoplist), "user_stoplist") if stoplist else out


def _lookup_arrays(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]).cast("array<string>"))])


def is_stop(language: Column, line: Column) -> Column:
    """Whether a snippet ends at a line: it is complete and has an end of its language."""

    def one(name: str) -> Column:
        masked = mask(name, line)
        count = lambda chars: F.length(masked) - F.length(F.translate(masked, chars, ""))
        balanced = (count("([{") == count(")]}")) & (count("'") % 2 == 0) & (count('"') % 2 == 0)
        return ~F.regexp_replace(masked, P.java(r"\s+$"), "").endswith("\\") & balanced & masked.rlike(P.java(P.STOPS[name]))

    out = F.when(language == "sql", one("sql"))
    for name in ("perl", "groovy"):
        out = out.when(language == name, one(name))
    return out.when(language.isin(*TREE_LANGUAGES, "html", "angular"), F.lit(None).cast("boolean")).otherwise(one("shell"))
