"""Regular expressions (Java dialect) shared by the column functions.

Inner quantifiers are possessive wherever nothing has to be given back, so that a
long literal or comment costs neither stack nor backtracking. Anchored patterns use
``\\A``: a failed search then stops at once instead of retrying at each position.
"""

from __future__ import annotations

# Unicode white space, since Java's \s knows ASCII only.
WS = r"\p{IsWhite_Space}"
NON_WS = r"\P{IsWhite_Space}"
LINE_WS = f"[{WS}&&[^\\n]]"
WS_CHARS = " \t\n\x0b\f\r" + "".join(
    chr(c)
    for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
# A word starts, ends here. The class of an ASCII neighbour is one table look-up; the
# properties are asked about others only.
B0 = rf"(?<![A-Za-z0-9_])(?:(?<=[\x00-\x7F])|(?<!{_WORD}))"
B1 = rf"(?![A-Za-z0-9_])(?:(?=[\x00-\x7F])|(?!{_WORD}))"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# A doubled quote closes and reopens a literal, which comes to the same.
LITERAL = r"'[^']*+(?:'|\z)"
_QUOTED = r'"[^"]*+(?:"|\z)'
_BRACKETED = r"\[(?:[^\]]++|\]\])*+(?:\]|\z)"

# One token of code, or one comment. An unterminated block comment leaves its last character.
CODE_OR_COMMENT = (
    rf"(?:[^'\"\[\-/]++|-(?!-)|/(?!\*)|{LITERAL}|{_QUOTED}|{_BRACKETED})++"
    r"|--[^\n]*+"
    r"|/\*(?:[^*]++|\*(?!/))*+\*/|/\*[\s\S]*(?=[\s\S]\z)|/\*"
)

# Group 1: one statement. Works on text with one newline put in front, so that the
# first line starts like any other; a GO line is consumed by the second branch.
_GO = rf"{LINE_WS}*+[Gg][Oo]{LINE_WS}*+"
STATEMENT = rf"((?:[^';\n]++|{LITERAL}|\n(?!{_GO}(?:\n|\z)))++)|\n{_GO}(?=\n|\z)"

# Procedure header.
_NAME = r"[A-Za-z0-9_\[\].]"
_DECLARE = (
    rf"(?=[CA]){B0}(?:CREATE|ALTER){WS}+(?:OR{WS}+ALTER{WS}+)?(?:PROCEDURE|PROC){WS}+{_NAME}++"
)
DECLARATION = f"(?i){_DECLARE}"
UP_TO_NAME = rf"(?i)\A[\s\S]*?{_DECLARE}"
NAME_AT_END = rf"{_NAME}++\z"
UP_TO_AS = (
    rf"(?i)\A(?:[^AE]++|(?<!{NON_WS})EXECUTE{WS}++AS{B1}|(?!{B0}AS{B1})[\s\S])*+"
    rf"{B0}AS{B1}{WS}*+"
)


# A parameter block as literals and what is between them, and as runs: brackets of one kind with the words in front
# of each, or text up to the next bracket. Runs of brackets hold no comma, equals sign or literal.
LITERAL_OR_TEXT = rf"{LITERAL}|[^']++"
BRACKET_RUNS = rf"(?:[^'(),=]*+\()++|(?:[^'(),=]*+\))++|(?:[^'()]++|{LITERAL})++"

# Statement clean-up, on text whose white space is collapsed.
BLOCK_WORDS = (
    r"(?i)\A(?:(?:BEGIN(?: (?:TRY|CATCH|TRAN|TRANSACTION)(?= |\z))?"
    r"|END(?: (?:TRY|CATCH)(?= |\z))?)(?: |\z))++"
)
OPENING_BEGIN = rf"(?i)\ABEGIN{WS}++(?!(?:TRY|CATCH|TRAN|TRANSACTION)(?!{NON_WS}))"
WHITESPACE_TO_COLLAPSE = rf"{WS}(?:(?<! ){WS}*+|{WS}++)"  # all but a single blank

TEMP_TABLE = r"#{1,2}[A-Za-z0-9_]++"

# ---------------------------------------------------------------------------
# Object references. Every keyword class searches on its own in the intended
# semantics: "FROM UPDATE x" is a read of UPDATE and a write to x, while
# "FROM FROM x" is one read. One pass gives both if an object is stepped over
# unless it ends in the keyword of ANOTHER class.
OBJECT = r"[A-Za-z0-9_#@\[\].]"
_WORDS = "SELECT|INSERT|UPDATE|DELETE|MERGE|FROM|JOIN|USING|EXEC"  # one per class
_KEYWORD = (
    rf"(?:(?:SELECT|INSERT|MERGE){WS}+INTO|DELETE(?:{WS}+{OBJECT}+)?{WS}+FROM"
    r"|UPDATE|FROM|JOIN|USING|EXEC(?:UTE)?)"
)
_ENDS_IN_OTHER = (
    rf"(?:{OBJECT}*[#@\[\].])?(?!\1(?:UTE)?(?!{OBJECT}))(?:{_WORDS}|EXECUTE)(?!{OBJECT})"
)

# Unicode noncharacters: never part of interchanged text.
MARK = chr(0xFDD0)
FIELD = chr(0xFDD1)

# groups: class, keyword with its white space, object, what is stepped over
REFERENCE = (
    rf"(?i)(?=[SIUDMFJE]){B0}(?=({_WORDS}))({_KEYWORD}{WS}++)"
    rf"(?=({OBJECT}++))((?!{_ENDS_IN_OTHER}){OBJECT}++)?"
)
REFERENCE_MARKED = f"{MARK}$3{FIELD}$2{FIELD}$4"

# Object words after EXEC that name no procedure.
NOT_PROCEDURES = ["as", "caller", "owner", "self", "sp_executesql", "sp_prepare", "sp_execute"]

# ---------------------------------------------------------------------------
# Risk rules on text whose literals are blanked.
_PART = r"[A-Za-z0-9_\[\]]"
SELECT_STAR = rf"(?i)(?=S){B0}SELECT{WS}++\*"
NOLOCK = rf"(?i)WITH{WS}*+\({WS}*+NOLOCK{WS}*+\)"
DYNAMIC_EXEC = rf"(?i)(?=E){B0}EXEC(?:UTE)?{WS}*+\({WS}*+@"
EXECUTESQL = rf"(?i)(?=S){B0}sp_executesql{B1}"
THREE_DOTS = rf"\.{_PART}++\.{_PART}++\."
FOUR_PARTS = (
    rf"(?<!{_PART})(?>{_PART}*?{_EDGE}){_PART}++\.{_PART}++\.{_PART}++\.{_PART}+{_EDGE}"
)
SUM_OR_COUNT = r"(?i)(?:SUM|COUNT)\("
JOIN = rf"(?i)(?=J){B0}JOIN{B1}"
GROUP_BY = rf"(?i)(?=G){B0}GROUP{WS}++BY{B1}"
CURSOR = rf"(?i)(?=C){B0}CURSOR{B1}"
BEGIN_TRAN = "(?i)BEGIN TRAN"
BEGIN_TRY = "(?i)BEGIN TRY"
BEGIN_CATCH = "(?i)BEGIN CATCH"
ROLLBACK = "(?i)ROLLBACK"
DATE_LITERAL = r"'\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}'"
STATUS_NUMBER = rf"(?i)(?=S){B0}STATUS{WS}*+={WS}*+\p{{Nd}}"
# on one cleaned statement
UPDATE_ALL = r"(?i)\AUPDATE(?=[\s\S]*? SET )(?![\s\S]*? WHERE )"
DELETE_ALL = r"(?i)\ADELETE(?![\s\S]*? WHERE )"
INSERT_SELECT_RAW = (
    r"(?i)\AINSERT INTO(?=[\s\S]*? SELECT )(?![\s\S]*? DISTINCT )(?![\s\S]*? GROUP BY )"
)
