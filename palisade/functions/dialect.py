r"""One pattern, two engines.

Rules are written with ASCII ``\b \w \d`` and with ``\s`` for Unicode white space. Java
gives ``\b`` Unicode word characters, RE2 gives ``\s`` ASCII white space; both are spelled
out here. Offsets count code points in either engine.
"""

from __future__ import annotations

import re

#: Unicode white space, inside a class, for Java and for RE2.
JAVA_SPACE = r"\t\n\x0B\f\r    -     　﻿"
RE2_SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD_BEFORE = r"(?<![A-Za-z0-9_])"
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _spaces(pattern: str, space: str, boundary: str) -> str:
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif two == r"\S":
            # a class with both is any character
            out.append(r"\S" if in_class else f"[^{space}]")
        elif two == r"\b" and not in_class:
            out.append(boundary)
        elif two[0] == "\\":
            out.append(two)
        else:
            if two[0] == "[" and not in_class:
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            k += 1
            continue
        k += 2
    return "".join(out)


#: What surely takes an ASCII word character: a character, a digit, a class of such alone; never with a quantifier that may take none.
_WORD_ITEM = re.compile(r"(?:[A-Za-z0-9_]|\\d|\\w|\[(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\d|\\w)+\])(?!\?|\*|\{0)")


def _choices(pattern: str, at: int) -> tuple[list[int], int]:
    """Where the choices of the group (or pattern) that begins at ``at`` begin, and where it ends."""
    starts, depth, in_class, k = [at], 0, False, at
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                break
        elif c == "|" and depth == 0:
            starts.append(k + 1)
        k += 1
    return starts, k


def _begins_with_word(pattern: str, at: int) -> bool:
    """Whether what stands at ``at`` takes an ASCII word character first, whichever choice it takes."""
    if not pattern.startswith("(?:", at):
        return bool(_WORD_ITEM.match(pattern, at))
    starts, end = _choices(pattern, at + 3)
    return pattern[end + 1 : end + 2] not in ("?", "*") and pattern[end + 1 : end + 3] != "{0" and all(_begins_with_word(pattern, k) for k in starts)


def _plain_start(pattern: str) -> bool:
    """Whether the pattern begins with a boundary and then a word character, and has no choice outside of groups."""
    return pattern.startswith(r"\b") and len(_choices(pattern, 0)[0]) == 1 and _begins_with_word(pattern, 2)


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's functions. A boundary before a word character, with which a pattern begins, is tested
    at every place of a text, and so as what it is there: no word character before it."""
    flag = "(?i)" if ignore_case else ""
    if _plain_start(pattern):
        return flag + _WORD_BEFORE + _spaces(pattern[2:], JAVA_SPACE, _BOUNDARY)
    return flag + _spaces(pattern, JAVA_SPACE, _BOUNDARY)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for DuckDB's functions (no lookarounds)."""
    return ("(?i)" if ignore_case else "") + _spaces(pattern, RE2_SPACE, r"\b").replace(r"\/", "/")


def python(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """The pattern compiled for Python, whose ASCII flag gives what Java has unasked: letters without case, words and digits of ASCII alone."""
    return re.compile(_spaces(pattern, JAVA_SPACE, r"\b").replace(r"\z", r"\Z"), re.ASCII | (re.IGNORECASE if ignore_case else 0))


def sql(pattern: str) -> str:
    """The pattern as a SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"
