r"""Patterns and word lists.

The values below are fixed: results depend on them being exactly these. They are written for Java's regex
engine, with three rules that keep them equal to their Unicode-aware, line-feed-only originals:

* ``(?U)`` makes ``\w \d \s \b`` Unicode; ``SPACE`` adds the four separators U+001C-1F that Java leaves out.
* ``[^\n]`` stands for a dot, since Java's dot also stops at CR, U+0085, U+2028 and U+2029.
* Repeated groups are possessive where nothing after them can need a shorter match, so that very long inputs
  neither backtrack nor recurse deeply.
"""

SPACE = r"[\s\x1C-\x1F]"

# What ends a line when a whole text is split (LF, CR, CRLF and the Unicode separators).
LINE_END = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
LINE = rf"[^{LINE_END}]*(?:\r\n|[{LINE_END}])|[^{LINE_END}]+"
INLINE_SPACE = rf"[\s\x1F&&[^{LINE_END}]]"

# Hidden content.
COMMENT = r"(?s)<!--.*?-->"
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{2061}\x{2062}\x{2063}\x{2064}\x{180E}\x{AD}]+"

# Openings of a line that make it an injected instruction.
INJECTION_OPENINGS = [
    r"IGNORE\s+ALL\s+PREVIOUS\s+INSTRUCTIONS\b",
    r"DISREGARD\s+(ALL\s+)?PREVIOUS\b",
    r"FORGET\s+(ALL\s+)?(PREVIOUS|PRIOR|ABOVE)\b",
    r"You\s+are\s+now\b",
    r"SYSTEM\s*:",
    r"ASSISTANT\s*:",
    r"NEW\s+INSTRUCTIONS?\s*:",
    r"BEGIN\s+NEW\s+PROMPT\b",
    r"<\|im_start\|>",
    r"<\|system\|>",
]

# One pattern for a whole injected line with its end; its spaces stay inside the line.
_OPENING = "|".join(INJECTION_OPENINGS).replace(r"\s", INLINE_SPACE)
_LINE_START = rf"(?:\A|(?<=[{LINE_END}])(?<!\r(?=\n)))"
INJECTION_LINE = (
    rf"(?iU){_LINE_START}{INLINE_SPACE}*+(?:{_OPENING})"
    rf"[^{LINE_END}]*+(?:\r\n|[{LINE_END}])?"
)

# Keys of configuration lines that are withheld.
SECRET_KEYS = ["GH_TOKEN", "GITHUB_TOKEN", "GITHUB_PERSONAL_ACCESS_TOKEN"]

# Logs of test runs that ran nothing.
VACUOUS_LOG = (
    rf"(?iU)no{SPACE}+tests?{SPACE}+specified|no{SPACE}+tests?{SPACE}+found"
    rf"|\b0{SPACE}+tests?\b|error:{SPACE}*no{SPACE}+test{SPACE}+specified"
)

# Month names, in calendar order.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
_MONTH = "|".join(MONTHS)

# Mentions of dates, URLs and numbers in prose.
CLAIM_DATES = [
    r"(?U)\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    rf"(?iU)\b((?:{_MONTH}){SPACE}+\d{{1,2}}(?:,?{SPACE}+\d{{4}})?)\b",
]
CLAIM_URL = r"""(?iU)(https?://[^\s\x1C-\x1F)\]>"']+)"""
CLAIM_URL_TAIL = ".,;:!?)>"
CLAIM_NUMBER = (
    rf"(?U)(?<!\w)([$€£¥]?{SPACE}*\d[\d,]*(?:\.\d+)?(?:{SPACE}*%|{SPACE}*[A-Za-z]{{1,5}})?)(?!\w)"
)
NUMBER_DECORATION = r"(?U)[,$€£¥%\s\x1C-\x1F]"

# The entity a line is about, and capitalised words that are never one.
ENTITY = rf"(?U)\b([A-Z][a-z]{{2,}}+\b(?:{SPACE}+[A-Z][a-z]{{2,}}+\b)*+)"
NOT_ENTITIES = [
    "The", "This", "That", "These", "Those", "There", "Here",
    "When", "Where", "What", "Which", "Who", "How", "Why",
    "Each", "Every", "All", "Some", "Any", "Most", "Many",
    "Before", "After", "During", "Between", "About", "Into",
    "Through", "With", "From", "Over", "Under", "Above", "Below",
    "Not", "Also", "However", "Therefore", "Moreover", "Furthermore",
    "Additionally", "Similarly", "Meanwhile", "Nevertheless",
]

# Text accepted as a floating point number.
_DIGITS = r"\d+(?:_\d+)*+"
FLOAT_TEXT = rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"

# Citations, and the same inside source documents (no word boundary before them).
CITATION_ARTICLE = rf"(?iU)\bArticle{SPACE}+\d+{SPACE}*\(\d+\)"
CITATION_SECTION = rf"(?iU)\bSection{SPACE}+\d++(?:\.\d++)++"
SOURCE_CITATION = rf"(?U)article{SPACE}+\d+{SPACE}*\(\d+\)|section{SPACE}+\d++(?:\.\d++)++"

# URLs in audited texts and the form their host must have.
AUDIT_URL = r"""(?i)https?://[A-Za-z0-9][A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*"""
AUDIT_URL_TAIL = ".,;:!?)>\"'"
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
# A top-level label starts with two letters; labels before it are consumed without backtracking.
HOST_FORM = rf"(?i)^https?://(?:localhost|{_LABEL}(?:\.(?![A-Za-z]{{2}}){_LABEL})*+\.[A-Za-z]{{2}})"

# Dates in audited texts.
AUDIT_DATE_ISO = r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b"
AUDIT_DATE_WRITTEN = rf"(?iU)\b(?:{_MONTH}){SPACE}+\d{{1,2}},?{SPACE}+\d{{4}}\b"
STALE_AFTER_DAYS = 183

# Plan checkboxes, worktree directories, dated track names.
_GAP = rf"[\s\x1C-\x1F&&[^\n\r]]"
CHECKBOX = {
    mark: rf"(?U)(?:\A|(?<=[\n\r])){_GAP}*+-{_GAP}++\[[{chars}]\]"
    for mark, chars in {"total": " x~", "completed": "x", "in_progress": "~", "pending": " "}.items()
}
WORKTREE_DIRECTORY = r"^issue-([^\n]+)-([^-]+)\z"
DATED_SUFFIX = r"(?U)-\d{8}\z"
LOOSE_TIMESTAMP = (
    rf"(?U)^(\d{{4}})[^\d]?(\d{{2}})[^\d]?(\d{{2}})(?:T|{SPACE})?(\d{{2}})?[^\d]?(\d{{2}})?[^\d]?(\d{{2}})?"
)

# Question and answer tags in comments.
QUESTION_TAG = rf"(?iU)\[QUESTION\](?:\[([^\]]+)\])?{SPACE}*([^\n]*)"
ANSWER_TAG = rf"(?iU)\[ANSWER\](?:\[([^\]]+)\])?{SPACE}*([^\n]*)"

# File classes.
PROSE_SUFFIXES = ["md", "txt", "markdown"]
TEXT_SUFFIXES = ["md", "txt", "json", "csv", "yaml", "yml"]
BINARY_SUFFIXES = ["pdf", "docx", "xlsx"]
LOCALE_DIRECTORIES = ["locales", "i18n", "translations", "strings"]
BASE_LOCALES = ["en", "en-us", "en_us"]

# Statuses.
AGENT_STATUSES = ["pending", "running", "completed", "failed", "interrupted"]
ENDED_STATUSES = ["completed", "failed", "interrupted"]
CLOSED_TRACKS = ["COMPLETED", "RESOLVED", "CLOSED"]
DONE_TASKS = ["completed", "resolved"]
ACTIVE_TASKS = ["in_progress", "active"]
AGENT_KEYS = ["agent", "agent_name", "assigned_agent", "assignee"]
QUOTA = "quota_exhausted"
