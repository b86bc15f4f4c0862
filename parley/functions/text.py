"""Column expressions for text: whitespace, words, cleanup rules, escapes.

All functions return ``Column`` objects built from Spark built-ins, so they
stay inside whole-stage code generation.  Patterns are written so that the
same regular expression has the same meaning in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.fixed import PY_WHITESPACE

# One character of Python whitespace (``str.split()`` semantics).  ``\s`` alone
# is ASCII-only in Java and lacks \x0b in RE2, hence the explicit members.
WS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_RUN = WS + "+"

# Cleanup rules (our definitions of the cleaning instructions).
LATEX_INLINE = r"\$[^$\n]+\$"
LATEX_COMMAND = r"\\[a-zA-Z]+(\{[^}]*\})?"
NUMERIC_CITATION = r"\[\d+(,[ \t]*\d+)*\]"
AUTHOR_YEAR_CITATION = r"\([A-Z][a-z]+( et al\.)?,? \d{4}\)"
REFERENCES_TAIL = r"(?s)\n(References|REFERENCES)\n.*"
SPACE_RUN = r"[ \t]+"
BLANK_LINES = r"\n{3,}"
# Short lines that announce the text and end in a colon, and a bare "Sure!";
# a sentence that begins with "Sure" is content.
COMMENTARY_LINE = r"(?is)^[ \t]*((here('s| is) (the )?cleaned text[^:]{0,60}|sure[^a-z0-9:][^:]{0,60}):|sure[!.,]?)[ \t]*$"
# Fillers and stage reactions (checked per token / by literal).
FILLER_TOKEN = r"(?i)^(u+m+|h+m+)$"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove Python whitespace at both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


# Whitespace outside Java's ASCII ``\s`` class.
_RARE_WS = "".join(ch for ch in PY_WHITESPACE if ch not in " \t\n\x0b\x0c\r")


def words(c) -> Column:
    r"""``str.split()``: array of words split on runs of Python whitespace.

    The rare whitespace characters are first mapped to a space with
    ``translate`` and the text is split on ASCII ``\s+``: same result as
    splitting on the full class ``WS_RUN``, about twice as fast.
    ``array_remove`` (code-generated) drops the empty edge strings."""
    t = F.translate(col_(c), _RARE_WS, " " * len(_RARE_WS))
    return F.array_remove(F.split(t, r"\s+"), "")


def word_count(c) -> Column:
    return F.size(words(c))


def chunk_slices(word_array: Column, n: int) -> Column:
    """Array of consecutive word slices of ``n`` words; the last may be short.

    An empty word array gives an empty result (``sequence`` is guarded
    because ``sequence(0, -1)`` counts down).
    """
    size = F.size(word_array)
    idx = F.sequence(F.lit(0), F.floor((size - 1) / F.lit(n)).cast("int"))
    return F.when(size > 0, F.transform(
        idx, lambda i: F.slice(word_array, i * F.lit(n) + 1, F.lit(n)))
    ).otherwise(F.array().cast("array<array<string>>"))


def strip_latex(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col_(c), LATEX_INLINE, ""), LATEX_COMMAND, "")


def fix_whitespace(c) -> Column:
    t = F.regexp_replace(col_(c), SPACE_RUN, " ")
    t = F.regexp_replace(t, BLANK_LINES, "\n\n")
    return py_strip(t)


def strip_citations(c) -> Column:
    t = F.regexp_replace(col_(c), REFERENCES_TAIL, "")
    t = F.regexp_replace(t, NUMERIC_CITATION, "")
    return F.regexp_replace(t, AUTHOR_YEAR_CITATION, "")


def speech_text(c) -> Column:
    """Drop bullets and list numbers at line starts, keep the newline."""
    # Java and RE2 write group references differently, so the newline is
    # restored by a second pass instead of a back-reference.
    t = F.regexp_replace(col_(c), r"\n[ \t]*(•|\d+\.)[ \t]+", "\n")
    return F.regexp_replace(t, r"^[ \t]*(•|\d+\.)[ \t]+", "")


# Line joins: how a line ends and begins.
INK = r"[^ \t\r]"
LINE_TAIL = r"[ \t\r]+$"
LIST_ITEM = r"^[ \t]*([•‣*–-]|\d{1,3}[.)]|[a-z][)])[ \t]+"
LABEL_START = r"^[ \t]*[\p{L}\p{N} /&-]{1,30}:([ \t]|$)"
SENTENCE_END = r"""[.!?:;…]["'”’»)\]]*$"""
LOWER_START = r"^[ \t]*\p{Ll}"
TITLE_START = r"^[ \t]*(\p{Lu}|\d+(\.\d+)*[ \t])"
TITLE_STOP = r"[,-]$"
HEADING_WORDS = 8
LONG_LINE = 40                 # a line as long as this was broken by the page, not by its writer
HYPHEN = r"[-\x{2010}\x{ad}]$"
CUT_HEAD = r"(\p{L}+)[-\x{2010}\x{ad}]$"
CUT_TAIL = r"^[ \t]*(\p{Ll}\p{L}*)"
HYPHENATED = r"\p{L}+-\p{L}+"


def line_kinds(lines: Column) -> Column:
    """For each line a struct: the line without white space at its end, whether it
    is blank, a list item, a label (``Key: value``), and a heading (a short line
    behind a blank one or at the start, which begins like a title, ends no
    sentence and does not go on in lower case)."""
    def kind(line: Column, i: Column) -> Column:
        text = F.regexp_replace(line, LINE_TAIL, "")
        first = F.coalesce(~F.get(lines, i - 1).rlike(INK), F.lit(True))
        short = F.size(F.split(F.trim(text), r"[ \t]+")) <= HEADING_WORDS
        item = text.rlike(LIST_ITEM)
        goes_on = F.coalesce(F.get(lines, i + 1).rlike(LOWER_START), F.lit(False))
        heading = first & short & ~goes_on & text.rlike(TITLE_START) & ~text.rlike(SENTENCE_END) & ~text.rlike(TITLE_STOP) & ~item
        return F.struct(text.alias("text"), (~line.rlike(INK)).alias("blank"), item.alias("item"), text.rlike(LABEL_START).alias("label"),
                        heading.alias("heading"))
    return F.transform(lines, kind)


def cut_words(kinds: Column) -> Column:
    """For each line the word that its end cuts, with a hyphen (``exam-ple``),
    else an empty text."""
    def word(a: Column, b: Column) -> Column:
        head, tail = F.regexp_extract(a["text"], CUT_HEAD, 1), F.regexp_extract(F.coalesce(b["text"], F.lit("")), CUT_TAIL, 1)
        return F.when((head != "") & (tail != ""), F.concat(head, F.lit("-"), tail)).otherwise(F.lit(""))
    return F.zip_with(kinds, F.slice(kinds, 2, F.size(kinds)), word)


def line_joints(kinds: Column, cut: Column, hyphenated: Column) -> Column:
    """What stands between each line and the next: ``line``, ``space`` (a
    sentence goes on), ``word`` (a word goes on), ``hyphen`` (a word that the
    document, in ``hyphenated``, writes with its hyphen) or ``end``."""
    def joint(a: Column, i: Column) -> Column:
        b, text, word = F.get(kinds, i + 1), a["text"], F.get(cut, i)
        apart = a["blank"] | a["heading"] | b["blank"] | b["item"] | b["heading"]
        goes_on = b["text"].rlike(LOWER_START) | text.rlike(",$") | ((F.length(text) >= LONG_LINE) & ~b["label"])
        return (F.when(b.isNull(), F.lit("end")).when(apart, F.lit("line"))
                .when(word != "", F.when(F.array_contains(hyphenated, word), F.lit("hyphen")).otherwise(F.lit("word")))
                .when(goes_on & ~text.rlike(SENTENCE_END), F.lit("space")).otherwise(F.lit("line")))
    return F.transform(kinds, joint)


def lines_joined(kinds: Column, joints: Column) -> Column:
    def piece(a: Column, i: Column) -> Column:
        before, behind = F.coalesce(F.get(joints, i - 1), F.lit("line")), F.get(joints, i)
        text = F.when(before == "line", a["text"]).otherwise(F.regexp_replace(a["text"], r"^[ \t]+", ""))
        bare = F.regexp_replace(text, HYPHEN, "")
        return (F.when(behind == "line", F.concat(text, F.lit("\n"))).when(behind == "space", F.concat(text, F.lit(" ")))
                .when(behind == "word", bare).when(behind == "hyphen", F.concat(bare, F.lit("-"))).otherwise(text))
    return F.array_join(F.transform(kinds, piece), "")


def drop_commentary(c) -> Column:
    """Remove whole lines that are model commentary (``Here's the cleaned text:``)."""
    return F.array_join(
        F.filter(F.split(col_(c), "\n"), lambda ln: ~ln.rlike(COMMENTARY_LINE)), "\n")


def commentary_lines(c) -> Column:
    return F.size(F.filter(F.split(col_(c), "\n"), lambda ln: ln.rlike(COMMENTARY_LINE)))


def clean_text(c) -> Column:
    """Full rule-based cleanup: LaTeX, citations, list markers, commentary,
    whitespace, in that order."""
    t = strip_latex(c)
    t = strip_citations(t)
    t = speech_text(t)
    t = drop_commentary(t)
    return fix_whitespace(t)


def filler_count(c) -> Column:
    """Number of tokens such as ``umm`` or ``hmm`` (any case)."""
    toks = F.split(col_(c), NON_WORD_RUN)
    return F.size(F.filter(toks, lambda t: t.rlike(FILLER_TOKEN)))


def literal_count(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    c = col_(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("long")


def unescape(c) -> Column:
    """Undo string-literal escapes: ``\\\\``, ``\\"``, ``\\'``, ``\\n``, ``\\t``, ``\\r``.

    The text is split at escaped backslashes first, so that ``\\\\n`` stays a
    backslash followed by ``n``.
    """
    def plain(part: Column) -> Column:
        for esc, val in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
            part = F.replace(part, F.lit(esc), F.lit(val))
        return part

    return F.array_join(F.transform(F.split(col_(c), r"\\\\"), plain), "\\")


def escape(c) -> Column:
    """Inverse of :func:`unescape` for rendering: ``\\``, ``"``, newline."""
    t = F.replace(col_(c), F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit('"'), F.lit('\\"'))
    return F.replace(t, F.lit("\n"), F.lit("\\n"))


def preview(c, n: int, ellipsis: str = "...") -> Column:
    """First ``n`` characters plus an ellipsis (always appended)."""
    return F.concat(F.substring(col_(c), 1, n), F.lit(ellipsis))
