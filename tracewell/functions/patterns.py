"""Patterns and word lists of the analysed languages.

All of these are fixed values. They are written for Java's regex engine, with the flags ``U`` (classes
and word bounds by Unicode) and ``d`` (only \\n ends a line); ``s`` lets the dot match line ends.
"""

# --- fixed values: string literals and comments, by language
LITERALS = {
    "proc": r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|//[^\n]*|/\*.*?\*/""",
    "sql": r"""'(?:''|[^'])*'|--[^\n]*|/\*.*?\*/""",
    "shell": r""""(?:\\.|[^"\\])*"|'[^']*'|#[^\n]*""",
    "perl": r"""'[^']*'|"(?:\\.|[^"\\])*"|(?<![$@%])\bqq?\([^)]*\)|(?<![$@%])\bqq?\{[^}]*\}|(?<![$@%])\bqq?\[[^\]]*\]|(?<![$@%])\bqq?<[^>]*>|(?<![$@%])\bqq?![^!]*!|(?<![$@%])#[^\n]*""",
    "groovy": r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/""",
}

# --- fixed values: categories
DECLARES, ASSIGNS, COMPARES, BRANCHES, RETURNS, PRINTS, COMMENTS, OTHER = "宣言", "代入", "比較", "分岐", "return", "出力", "コメント", "その他"

# --- fixed values: a line that is a comment only, and the rules of a language, the first that matches counts
COMMENT = {
    "sql": r"^\s*--(?!\+)|^\s*/\*(?!\+).*\*/\s*$",
    "shell": r"^\s*#",
    "perl": r"^\s*#",
    "groovy": r"^\s*//|^\s*/\*.*\*/\s*$",
}
RULES = {
    "sql": [
        (r":=", ASSIGNS),
        (r"(?i)\bWHERE\b.*?[=<>]", COMPARES),
        (r"(?i)\bCASE\s+WHEN\b|\bDECODE\s*\(|\|\|", BRANCHES),
        (r"(?i)\b(?:INSERT|UPDATE)\b", ASSIGNS),
        (r"(?i)^\s*(?:DBMS_OUTPUT\.PUT_LINE|RAISE_APPLICATION_ERROR)\b", PRINTS),
        (r"(?i)^\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?)?(?:PROCEDURE|FUNCTION|PACKAGE(?:\s+BODY)?|TRIGGER|TYPE)\b", DECLARES),
        (r"(?i)^\s*CURSOR\b", DECLARES),
        (r"(?i)\bIF\b.*\bTHEN\b|^\s*ELSIF\b", COMPARES),
        (r"(?i)^\s*(?:WHILE|FOR)\b|\bLOOP\s*$", BRANCHES),
    ],
    "bourne": [
        (r"^\s*\w+=(?!=)", ASSIGNS),
        (r"\[\s+.+?(?:=|==|-eq)\s+.+?\]", COMPARES),
        (r"^\s*case\s+", BRANCHES),
    ],
    "cshell": [
        (r"^\s*(?:set\s+\w+\s*=|setenv\s+\w+|@\s+\w+\s*=)", ASSIGNS),
        (r"^\s*(?:if|while)\s*\(", COMPARES),
        (r"^\s*switch\s*\(|^\s*case\s+.+:|^\s*breaksw\b", BRANCHES),
    ],
    "perl": [
        (r"^\s*sub\s+\w+|\bpackage\s+\w+|\buse\s+constant\b", DECLARES),
        (r"^\s*(?:my|our|local|state)\s+[$@%]|[$@%]\w+\s*=(?![=~>])", ASSIGNS),
        (r"\b(?:if|unless|elsif)\b|==|!=|<=|>=|\beq\b|\bne\b|\blt\b|\bgt\b|\ble\b|\bge\b|=~|!~|(?<![-=])<(?!=)|(?<![-=])>(?!=)", COMPARES),
        (r"\b(?:for|foreach|while|until)\b", BRANCHES),
        (r"\b(?:print|printf|say|warn|die)\b", PRINTS),
    ],
    "groovy": [
        (r"^\s*(?:class|interface|enum|trait)\s+|^\s*(?:[\w.<>,\s]+\s+)?def\s+\w+\s*\(", DECLARES),
        (r"^\s*(?:def|final|[A-Za-z_]\w*(?:<[^>]*>)?)\s+\w+\s*=(?!=)|\b\w+\s*=(?!=)", ASSIGNS),
        (r"\b(?:if|while)\b|==~|<=>|==|!=|<=|>=|=~|(?<![-=])<(?!=)|(?<![-=])>(?!=)", COMPARES),
        (r"\b(?:switch|for|case)\b", BRANCHES),
        (r"\breturn\b", RETURNS),
        (r"\b(?:println|print|printf)\b|\blog\.\w+", PRINTS),
    ],
}

# --- fixed values: what binds a name
SQL_BINDS = r"(?i)(?<![:&])\b([A-Za-z_]\w*)(?:\s+(?:CONSTANT\s+)?[A-Za-z_][\w%.]*(?:\([^)]*\))?)?\s*:="
SQL_CONSTANT = r"(?i)(?<![:&])\b([A-Za-z_]\w*)\s+CONSTANT\b"
BOURNE_BINDS = r"^\s*(?:(?:export|local|declare|typeset)\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)=(?!=)"
BOURNE_READONLY = r"^\s*readonly\s+([A-Za-z_]\w*)="
CSHELL_BINDS = r"^\s*(?:set\s+([A-Za-z_]\w*)\s*=|setenv\s+([A-Za-z_]\w*)\b|@\s+([A-Za-z_]\w*)\s*=)"
PERL_BINDS = r"[$@%](\w+)\s*=(?![=~>])"
PERL_CONSTANT = r"\buse\s+constant\s+(\w+)"
GROOVY_MODIFIED = r"\b((?:public|protected|private|static|final)(?:\s+(?:public|protected|private|static|final))*)\s+(?:[\w.$<>,\[\]\s]+?\s+)?([A-Za-z_]\w*)\s*="
GROOVY_BINDS = r"(?<![=!<>+\-*/%&|^])\b([A-Za-z_]\w*)\s*=(?!=)"

# --- fixed values: what ends the lines of a snippet
STOPS = {
    "sql": r"(?i)\b(WHERE|SET|VALUES|SELECT|FROM|GROUP\s+BY|ORDER\s+BY|HAVING)\b|;\s*$",
    "shell": r"(?:^|\s)(fi|done|esac|breaksw)\b|;",
    "perl": r";|\}|^\s*sub\b",
    "groovy": r";|\}|^\s*(?:class|def)\b",
}

# --- fixed values: how many characters of a line are looked at
CLASSIFIED_CHARS, BOUND_CHARS, GROOVY_CHARS, SAMPLE_CHARS = 4000, 800, 200, 65536

# --- fixed values: languages by file name and by first line
EXTENSIONS = {
    ".java": "java", ".sql": "sql", ".sh": "shell", ".ksh": "shell", ".bash": "shell", ".csh": "shell", ".tcsh": "shell",
    ".pc": "proc", ".c": "c", ".h": "c", ".pkb": "sql", ".pks": "sql", ".prc": "sql", ".fnc": "sql", ".trg": "sql", ".pls": "sql", ".plb": "sql",
    ".pl": "perl", ".pm": "perl", ".t": "perl", ".groovy": "groovy", ".gvy": "groovy", ".gradle": "groovy", ".ts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".py": "python",
    ".jsp": "jsp", ".jspf": "jsp", ".jspx": "jsp", ".tag": "jsp", ".tagx": "jsp",
}
INTERPRETERS = {
    "sh": "shell", "bash": "shell", "ksh": "shell", "dash": "shell", "csh": "shell", "tcsh": "shell",
    "perl": "perl", "groovy": "groovy", "node": "javascript", "python": "python",
}
BOURNE_SHELLS, C_SHELLS = ("sh", "bash", "ksh", "dash"), ("csh", "tcsh")
SHEBANG = r"^\uFEFF?#!\s*(\S+)(?:\s+(\S+))?"
EXEC_SQL = r"(?i)\bEXEC\s+SQL\b"
ANGULAR = r"\*ng[\w-]+|\[\(?[\w.$-]+\)?\]\s*=|\([\w.$-]+\)\s*=|routerLink|formControl|ngModel"

# --- fixed values: words that are never followed, by language
_JAVA = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var"
_C = "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct switch typedef union unsigned void volatile while inline restrict _Bool"
_JS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static get set of async await null true false undefined console"
_TS = _JS + " interface type enum namespace declare abstract implements readonly public private protected as is keyof infer any unknown never number string boolean object"
_ANGULAR = _TS + " ngIf ngFor ngSwitch ngClass ngStyle ngModel trackBy $event"
RESERVED = {
    "java": _JAVA,
    "jsp": _JAVA + " page include taglib c fn empty",
    "c": _C,
    "proc": _C,
    "sql": "select insert update delete from where and or not null is in like between exists into values set begin end declare if then else elsif loop for while case when decode dual table view procedure function trigger as order by group having distinct union all NUMBER VARCHAR2 VARCHAR CHAR NCHAR CLOB BLOB DATE TIMESTAMP BOOLEAN PLS_INTEGER BINARY_INTEGER INTEGER FLOAT DECIMAL LONG RAW ROWID",
    "shell": "if then else elif fi for while until do done case esac in function select time set setenv unset export readonly local return break continue switch breaksw end foreach endif endsw echo test true false",
    "perl": "my our local state sub package use require if unless elsif else while until for foreach do return last next redo eq ne lt gt le ge cmp and or not xor print printf say warn die qw q qq tr defined undef ref scalar wantarray bless",
    "groovy": "def class interface enum trait if else while switch case for return break continue println print final static import package new this super true false null void in as instanceof try catch finally throw throws assert abstract extends implements",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case self print",
    "javascript": _JS,
    "typescript": _TS,
    "tsx": _TS,
    "angular": _ANGULAR,
    "angular_inline": _ANGULAR,
    "html": "",
}


def java(pattern: str, flags: str = "") -> str:
    """The pattern with the flags that all patterns here need."""
    return f"(?Ud{flags}){pattern}"
