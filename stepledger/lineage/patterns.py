"""The patterns of program text and run logs, and the words they name."""

# A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
SPACE = r"[\s\x0B\x1C-\x1F\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
# The same for Spark alone, as the checking engine has no intersections: the plain characters are ruled out first, by one
# comparison, as nearly all are.
BLANK = rf"[[^!-~]&&{SPACE}]"
LINE_BREAK = r"\r\n|[[^ -~]&&[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]]"

# Lexing. Possessive, so that long texts do not exhaust the regex stack.
COMMENT_TOKEN = r"""'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|/\*[\s\S]*?(?:\*/|\z)|[^'"/]++|/"""
STATEMENT = r"""(?:'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|[^;'"]++)++"""
FIRST_WORD = r"^([A-Za-z_][A-Za-z0-9_]*)"

# Lexing a text in pieces. A token that ends in its piece, what a piece leaves open, and the blanks before a statement.
TOKEN = r"""'[^']*+'|"[^"]*+"|/\*[\s\S]*?\*/|[^;'"/]++|/(?!\*)"""
LEFT_OPEN = rf"""^(?:{TOKEN}|;++)*+('|"|/\*)?"""
BLANKS = rf"(?:{BLANK}++|/\*[\s\S]*?\*/)*+"

# Run-log lines.
EXPANDED_NAMED = rf"^{BLANK}*MPRINT\(([^)]*)\):{BLANK}?(.*)$"
EXPANDED_BARE = rf"^{BLANK}*MPRINT:{BLANK}?(.*)$"
EXPANDED = rf"^{BLANK}*MPRINT(?:\([^)]*\))?:{BLANK}?(.*)$"
LOG_NOISE = rf"(?i)^{BLANK}*(MLOGIC|SYMBOLGEN|NOTE|WARNING|ERROR|INFO)(?:{BLANK}|[(:])"
SYMBOL = rf"(?i)^{BLANK}*SYMBOLGEN:{BLANK}*Macro variable{BLANK}+({WORD}+){BLANK}+resolves to{BLANK}+(.*)$"
LOOP_INDEX = rf"(?i)index variable{BLANK}+({WORD}+)"
PARAMETER = rf"(?i)Parameter{BLANK}+({WORD}+){BLANK}+has value"
LOGIC = "MLOGIC"

# Parametric source.
LET = rf"(?i)%let{BLANK}+({WORD}+){BLANK}*="
DEFINITION = rf"(?is)%macro{BLANK}+({WORD}+)(?!{WORD}).*?%mend(?!{WORD})[^;]*;"
DEFINITION_NAME = rf"(?i)^%macro{BLANK}+({WORD}+)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Dataset references. A name is looked for only where its first letter stands.
OPTION_PAIR = rf"""[A-Za-z_]{WORD}*+{BLANK}*+={BLANK}*+(?:\([^)]*\)|[\p{{L}}\p{{N}}_."']+)"""
DATASET_NAME = r"[A-Za-z_][\p{L}\p{N}_.]*"
DATASET_TOKEN = rf"{DATASET_NAME}(?:{BLANK}*\([^)]*\))?"
PROC_OPTION = (
    rf"(?i)(?=[dobi]){NOT_WORD_BEFORE}(data|out|outest|base|inest){BLANK}*={BLANK}*({DATASET_NAME}(?:{BLANK}*\([^)]*\))?)"
)
SQL_CREATE = rf"(?i)(?=c){NOT_WORD_BEFORE}create{BLANK}+(?:table|view){BLANK}+({DATASET_NAME})"
SQL_INSERT = rf"(?i)(?=i){NOT_WORD_BEFORE}insert{BLANK}+into{BLANK}+({DATASET_NAME})"
SQL_FROM = rf"(?i)(?=f){NOT_WORD_BEFORE}from{BLANK}+({DATASET_NAME})"
SQL_JOIN = rf"(?i)(?=j){NOT_WORD_BEFORE}join{BLANK}+({DATASET_NAME})"

# Words.
TERMINATORS = ["run", "quit", "endsas"]
READERS = ["set", "merge", "update", "modify"]
OPTION_WORDS = ["end", "nobs", "point", "key", "in", "by"]
UNNAMED = ["_null_", "_data_", "_last_"]
WRITING_OPTIONS = ["out", "outest", "base"]

# The text up to where the first step starts behind a semicolon: before such a word, or after such a statement.
STARTS = r"(?i:data|proc)(?![A-Za-z0-9_])"
ENDS = rf"(?i:{'|'.join(TERMINATORS)})(?![A-Za-z0-9_])(?:{TOKEN})*+;"
BEFORE_STEP = rf"^(?:{TOKEN}|;(?!{BLANKS}(?:{STARTS}|{ENDS})))*+(?:;(?={BLANKS}{STARTS})|;{BLANKS}{ENDS})"
