"""Expressions of the checking SQL, written out by hand for the texts of ``corpora``; the library has its own."""

SPACE = r"\s"
LINE_END = r"\n"
EXPANDED = r"^\s*MPRINT(?:\([A-Za-z_0-9]*\))?:\s?(.*)$"
EXPANDED_NAMED = r"^\s*MPRINT\(([A-Za-z_0-9]*)\):\s?(.*)$"
LOG_NOISE = r"^\s*(?:MLOGIC\(|SYMBOLGEN:|NOTE:|WARNING:|ERROR:|INFO:)"
SYMBOL = r"^SYMBOLGEN: +Macro variable ([A-Z_0-9]+) resolves to (.*)$"
LOOP_INDEX = r"; index variable ([A-Z]+);"
PARAMETER = r"Parameter ([A-Z_]+) has value"
LET = r"%(?:let|LET) +([A-Za-z0-9]+) *="
DEFINITION = r"(?s)%macro .*?%mend[ a-z_]*;"
DEFINITION_NAME = r"^%macro ([a-z_]+)"
NUMBER = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"
OPTION_PAIR = r"[A-Za-z]+ *= *(?:\([^)]*\)|[a-z0-9_.'\"]+)"
DATASET_TOKEN = r"[A-Za-z_][A-Za-z0-9_.]*(?:\s*\([^)]*\))?"
PROC_OPTION = r"(?:^|\W)(data|out|outest|base|inest) *= *([a-z_][a-z0-9_.]*)"
SQL_CREATE = r"\bcreate (?:table|view) ([a-z_][a-z0-9_.]*)"
SQL_INSERT = r"\binsert into ([a-z_][a-z0-9_.]*)"
SQL_FROM = r"\bfrom ([a-z_][a-z0-9_.]*)"
SQL_JOIN = r"\bjoin ([a-z_][a-z0-9_.]*)"
COMMENT_TOKEN = r"""(?s)'[^']*'?|"[^"]*"?|/\*.*?(?:\*/|\z)|[^'"/]+|/"""
STATEMENT = r"""(?:'[^']*'?|"[^"]*"?|[^;'"])+"""
