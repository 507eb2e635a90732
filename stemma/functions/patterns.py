r"""Patterns and word lists that results depend on. They hold in Java's and RE2's dialects alike."""

HEADING_PREFIX = r"^\s*#{1,6}\s+"
QUOTE_PREFIX = r"^\s*>\s?"
EMPHASIS = r"\*\*|__|~~|`"
ESCAPED_SIGN = r"\\([\\`*_{}\[\]#+.!|$])"
ESCAPED_PUNCTUATION = r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~])"

LEADING_PAGE = r"(?i)^\s*(?:page\s*)?(?:[ivxlcdm]{1,10}|\d{1,5})(?:\s*[·|:—–-]\s*|\s+)"
TRAILING_FRACTION = r"\d{1,5}\s*/\s*\d{1,5}\s*$"
TRAILING_PAGE = r"(?i)^(.*?)\s+(?:page\s*)?(?:\d{1,5}|[ivxlcdm]{1,10})$"
PAGE_LABEL = r"(?i)^\s*(?:page\s*)?(?:\d{1,5}\s*/\s*\d{1,5}|\d{1,5}|[ivxlcdm]{1,10})\s*$"
EDGE_NUMBER = r"(?i)^(?:(?:page)?\d{1,5}|\d{1,5}\s*/\s*\d{1,5}|[ivxlcdm]{1,10})$"
STRUCTURAL_EDGE = (
    r"(?i)^(?:chapter|part|appendix|section|contents|table of contents|list of (?:figures|tables)|preface|acknowledg(?:e)?ments|references|bibliography|index)\b"
)
NUMBERED_EDGE = r"^\d+(?:\.\d+){0,5}\.?\s+[A-Z]"
TITLE_WORD = r"^(?:[A-Z][\p{L}'’&.-]*|[A-Z0-9]{2,})$"

STRUCTURAL_LINE = r"^(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||```|~~~|\$\$|\[(?:VISUAL_|SOURCE_))"
FENCE_LINE = r"^\s*(?:```|~~~)[A-Za-z0-9_-]*\s*$"
PAGE_MARKER = r"^\s*<!--\s*page:\s*(\d+)\s*-->\s*$"
WRAP_END = r"\p{L}{2,}-\s*$"
WRAP_START = r"^\s*\p{Ll}{2,}"

NUMBERED_TITLE = r"^(\d+(?:\.\d+){0,5})\.?\s+\S"
CHAPTER = r"(?i)^chapter\s+(?:\d+|[ivxlcdm]+)\b"
FRONT_MATTER = r"(?i)^(?:contents|table of contents|list of (?:figures|tables)|preface|acknowledg(?:e)?ments|references|bibliography|index)$"
APPENDIX = r"(?i)^appendix(?:\s+[A-Z0-9]+)?(?:\s+.+)?$"
TITLE_VERB = r"(?i)\b(?:is|are|was|were|has|have|will|should|must|include)\b"
HEADING_WORD = r"^(?:[A-Z][\p{L}'’&-]*|(?:and|of|the|to|in|for|a|an))$"

CAPTION = r"(?i)^(?:figure|fig\.|table)\s+\d+"
FOOTNOTE = r"^\[\^[^\]]+\]:\s+"
LIST_ITEM = r"^(?:[-*+]\s+|\d+[.)]\s+)"

NUMBERING = r"(?i)^(?:\(?((?:\d+\.)*\d+|[A-Z]\.|[IVXLCDM]+\.)\)?)[.)]?\s+"
LIST_MARKER = r"(?i)^(?:[-*+•◦▪]|\(?\d+[.)]|\(?[a-z][.)]|\(?[ivxlcdm]+[.)])\s+"
CAPTION_MARKER = r"(?i)^(?:figure|fig\.?|table|chart|illustration)\s+\d+"
FOOTNOTE_MARKER = r"^(?:\[?\d{1,3}\]?\s+|[*†‡]\s+)"
MATH_SIGN = r"[=<>≤≥≠≈+−×÷∑∏∫√]"

TOC_END = r"(?i)(?:^|\s)(?:\d{1,4}|[ivxlcdm]{1,10})$"
TOC_LEADER = r"(?:\.{2,}|\s{2,})"
TOC_NUMBERED = r"^\d+(?:\.\d+)*\.?\s+\S"
TOC_TITLE = r"(?i)^(?:contents|list of (?:figures|tables))(?:\s+[ivxlcdm\d]+)?$"

CODE_BRACKETS = r"^[{}\[\],]+$"
CODE_REQUEST = r"(?i)^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\S+"
CODE_PAIR = r"^[A-Za-z][\w.-]*\s*(?:=|:)\s*.+$"
CODE_CONSTANT = r"^[A-Z][A-Z0-9_]{2,}$"
CODE_CAMEL = r"^[A-Za-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+$"
CODE_NAME = r"^[A-Za-z][\w.-]*,?$"

TECHNICAL_CUE = r"(?i)\b(?:equation|theorem|proof|function|probability|optimization|constraint|formula|figure|table)\b"
MATH_SYMBOL = r"[=<>≤≥≠≈+−×÷√∑∏∫∞∈∪∩^_]"
MATH_SCRIPT = r"[A-Za-z]\s*[_^]\s*[A-Za-z0-9({\[]"
MATH_FUNCTION = r"(?i)\b(?:sin|cos|tan|log|ln|exp|max|min|arg|maximize|minimize)\b"
