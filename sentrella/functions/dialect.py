"""Patterns written for Python's ``re`` as Java patterns of the same meaning.

``.`` and ``$`` know line feeds only ((?d)); case folding covers Unicode ((?iu)); ``\\w``,
``\\d``, ``\\s`` and ``\\b`` use Unicode's letters, numbers and white space.
"""

from __future__ import annotations

import re
from re import PatternError
from re import _constants as _ops
from re import _parser

WORD, DIGIT, SPACE = r"\p{L}\p{N}_", r"\p{Nd}", r"\s\x1c-\x1f\x85\p{Z}"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _edge(pattern: str, i: int) -> str:
    """A word edge; where a plain letter must stand on one side, only the other is looked at."""
    after, quantifier = pattern[i + 2 : i + 3], pattern[i + 3 : i + 4]
    if after.isalnum() and quantifier not in ("?", "*", "{"):
        return rf"(?<![{WORD}])"
    if pattern[i - 1 : i].isalnum() and pattern[i - 2 : i - 1] != "\\":
        return rf"(?![{WORD}])"
    return EDGE


def java(pattern: str, ignore_case: bool = False) -> str:
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            sets = {r"\w": WORD, r"\d": DIGIT, r"\s": SPACE}
            if two in sets:
                out.append(sets[two] if inside else f"[{sets[two]}]")
            elif two == r"\b" and not inside:
                out.append(_edge(pattern, i))
            else:
                out.append(two)
            i += 2
            continue
        if inside and c in "[&":  # literal in Python, an operator in Java
            out.append("\\" + c)
        else:
            out.append(c)
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "]" and inside:
            inside = False
        i += 1
    return ("(?diu)" if ignore_case else "(?d)") + "".join(out)


def literal(text: str) -> str:
    """The text as a pattern, for Python, Java and RE2 alike."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def whole(text: str) -> str:
    """The text between non-word characters, as a Java pattern."""
    return rf"(?d)(?<![{WORD}]){literal(text)}(?![{WORD}])"


#: So many beginnings are tried one by one.
AT_ONCE = 5


def any_of(texts) -> str:
    """Any of the texts, as a pattern that tries a common beginning once, and of many beginnings
    only the few of a class; it tells whether one occurs, not which."""
    tree: dict = {}
    for t in texts:
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        after = sorted((c, literal(c) + written(then)) for c, then in node.items() if c)
        if not after:
            return ""
        ways = [w for _, w in after]
        if len(ways) > 2 * AT_ONCE:
            few = [after[i : i + AT_ONCE] for i in range(0, len(after), AT_ONCE)]
            ways = [f"(?=[{''.join(literal(c) for c, _ in some)}])(?:{'|'.join(w for _, w in some)})" for some in few]
        return (ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})") + ("?" if "" in node else "")

    return written(tree)


def any_whole(texts: list[str]) -> str:
    return rf"(?d)(?<![{WORD}])(?:{any_of(texts)})(?![{WORD}])"


#: Characters that fold to ASCII letters in case-blind matching, but not by lower-casing.
FOLDED = "\u0130\u0131\u017f\u212a", "iisk"


def _sets(parts) -> list[list[str]]:
    """Sets of texts; a match holds at least one of each."""
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        if op is _ops.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append([run])
            run = ""
        if op is _ops.SUBPATTERN:
            found += _sets(arg[-1])
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and arg[0] >= 1:
            found += _sets(arg[2])
        elif op is _ops.BRANCH:
            each = [_needed(a) for a in arg[1]]
            found.append(sum(each, []) if all(each) else None)
    return [f for f in found if f and min(map(len, f)) >= 3 and len(f) <= 24]


def _needed(parts) -> list[str] | None:
    """Texts of which a match holds at least one: the longest there are."""
    return max(_sets(parts), key=lambda f: (min(map(len, f)), -len(f)), default=None)


def needed_all(pattern: str) -> list[list[str]]:
    """As ``needed``, with every set there is, the choosiest first: a text that the pattern
    matches holds a text of each."""
    try:
        found = _sets(_parser.parse(pattern))
    except PatternError:  # a pattern of Java's dialect alone
        return []
    found = [f for f in found if all(w.isascii() for w in f)]
    return [sorted({w.lower() for w in f}) for f in sorted(found, key=lambda f: (-min(map(len, f)), len(f)))]


def foreign(pattern: str) -> list[str] | None:
    """As ``needed``, for patterns whose texts are of other scripts than Latin or of signs without
    letters, where every character has one lower-case form; None for others."""
    plain = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)
    try:
        parsed = _parser.parse(plain)
    except PatternError:
        return None
    found = _needed(parsed)
    op, arg = parsed[0] if len(parsed) == 1 else (None, None)
    if not found and op is _ops.MAX_REPEAT and arg[0] >= 1 and arg[2][0][0] is _ops.IN and all(o is _ops.LITERAL for o, _ in arg[2][0][1]):
        found = [chr(c) for _, c in arg[2][0][1]]  # one class of signs, repeated
    one = lambda c: ord(c) >= 0x370 and len(c.lower()) == len(c.upper()) == 1 and c.upper().lower() == c.lower()
    if not found or not all(one(c) for f in found for c in f):
        return None
    return sorted({f.lower() for f in found})


def needed(pattern: str) -> list[str] | None:
    """Lower-case texts of which any text that the pattern matches holds one, as far as
    lower-casing (after FOLDED) shows; None where the pattern asks for none."""
    try:
        found = _needed(_parser.parse(pattern))
    except PatternError:  # a pattern of Java's dialect alone
        return None
    if not found or not all(f.isascii() for f in found):
        return None
    return sorted({f.lower() for f in found})
