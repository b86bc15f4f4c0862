"""String literals and tuples of them, read by a state machine.

The reply format is a list of Python tuples, ``("Speaker 1", "…")``.  Both
quotes, all escapes but named characters (``\\N{…}``), neighbouring literals
that form one string, and several tuples on a line are read; nothing is
evaluated.  Everything else (prefixes, triple quotes, names, numbers, a broken
escape) is no literal, and the line is refused.
"""

from __future__ import annotations

import re

SPACE = " \t\f"
PLAIN = {'"': re.compile(r'[^"\\\r\n]*'), "'": re.compile(r"[^'\\\r\n]*")}
ONE = {"\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
HEX = {"x": 2, "u": 4, "U": 8}
OCTAL = re.compile("[0-7]{1,3}")
HEXADECIMAL = re.compile("[0-9a-fA-F]+")
PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")
LONE = re.compile("[\ud800-\udfff]")


def whole_characters(text: str) -> str:
    """Surrogate pairs as one character; a lone half becomes U+FFFD."""
    if LONE.search(text):
        text = PAIR.sub(lambda m: m.group().encode("utf-16", "surrogatepass").decode("utf-16"), text)
        text = LONE.sub("�", text)
    return text


def escape_at(s: str, at: int) -> tuple[str, int] | None:
    """The character that the escape behind the backslash at ``at - 1`` stands
    for and the place behind it; None if it is broken.  An unknown escape
    stands for itself."""
    kind = s[at:at + 1]
    if kind in ONE:
        return ONE[kind], at + 1
    if kind in HEX:
        digits = s[at + 1:at + 1 + HEX[kind]]
        if len(digits) < HEX[kind] or not HEXADECIMAL.fullmatch(digits) or int(digits, 16) > 0x10FFFF:
            return None
        return chr(int(digits, 16)), at + 1 + len(digits)
    octal = OCTAL.match(s, at)
    if octal:
        return chr(int(octal.group(), 8)), octal.end()
    return None if kind in ("", "N") else ("\\" + kind, at + 1)


def string_at(s: str, at: int) -> tuple[str, int] | None:
    """The string of the literals that begin at ``at`` and the place behind."""
    parts, found = [], False
    while s[at:at + 1] in PLAIN:
        quote, found = s[at], True
        if s.startswith(quote * 3, at):
            return None
        at += 1
        while True:
            run = PLAIN[quote].match(s, at)
            parts.append(run.group())
            at = run.end()
            if s[at:at + 1] == quote:
                at = skip(s, at + 1)
                break
            if s[at:at + 1] != "\\":
                return None  # the literal does not end
            got = escape_at(s, at + 1)
            if got is None:
                return None
            parts.append(got[0])
            at = got[1]
    return (whole_characters("".join(parts)), at) if found else None


def skip(s: str, at: int) -> int:
    while s[at:at + 1] and s[at] in SPACE:
        at += 1
    return at


def tuples(line: str) -> list[tuple[str, str]] | None:
    """The tuples of two strings on a line, separated by commas; None if the
    line holds anything else."""
    out, at = [], skip(line, 0)
    while True:
        if line[at:at + 1] != "(":
            return None
        first = string_at(line, skip(line, at + 1))
        if first is None or line[first[1]:first[1] + 1] != ",":
            return None
        second = string_at(line, skip(line, first[1] + 1))
        if second is None:
            return None
        at = second[1]
        if line[at:at + 1] == ",":  # allowed behind the last element
            at = skip(line, at + 1)
        if line[at:at + 1] != ")":
            return None
        out.append((first[0], second[0]))
        at = skip(line, at + 1)
        if at == len(line):
            return out
        if line[at] != ",":
            return None
        at = skip(line, at + 1)


def unescaped(body: str) -> str | None:
    """The text of the inside of a literal; None if an escape is broken."""
    parts, at = [], 0
    while True:
        slash = body.find("\\", at)
        if slash < 0:
            return whole_characters("".join([*parts, body[at:]]))
        got = escape_at(body, slash + 1)
        if got is None:
            return None
        parts += [body[at:slash], got[0]]
        at = got[1]
