"""Patterns written for a JavaScript-like engine, rewritten for Java's."""

from __future__ import annotations

import re

_WORD = "0-9A-Za-z_"
_SPACE = r"\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_INNER = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_META = re.compile(r"[.*+?^${}()|\[\]\\]")


def literal(text: str) -> str:
    """text as a pattern that matches just itself."""
    return _META.sub(lambda m: "\\" + m.group(), text)


def _tokens(pattern: str) -> list[str]:
    out, i, inside = [], 0, False
    while i < len(pattern):
        n = 2 if pattern[i] == "\\" and i + 1 < len(pattern) else 1
        tok = pattern[i : i + n]
        if n == 1 and tok == "[":
            inside = True
        out.append(("class:" if inside else "") + tok)
        if n == 1 and tok == "]":
            inside = False
        i += n
    return out


def _is_word(tok: str | None) -> bool:
    return tok is not None and (re.fullmatch(f"[{_WORD}]", tok) is not None or tok in (r"\d", r"\w"))


def translate(pattern: str) -> str:
    r"""Word boundaries count ASCII letters only, `\s` takes every Unicode space, case folds as in Unicode.

    A boundary beside a plain word character needs one lookaround only, which is much cheaper.
    """
    toks = _tokens(pattern)
    out = []
    for i, tok in enumerate(toks):
        nxt = toks[i + 1] if i + 1 < len(toks) else None
        after = toks[i + 2] if i + 2 < len(toks) else None
        prev = toks[i - 1] if i else None
        if tok == r"\b":
            if _is_word(nxt) and after not in ("?", "*", "{"):
                out.append(f"(?<![{_WORD}])")
            elif _is_word(prev):
                out.append(f"(?![{_WORD}])")
            else:
                out.append(_BOUNDARY)
        elif tok == r"\B":
            out.append(_INNER)
        elif tok == r"\s":
            out.append(f"[{_SPACE}]")
        elif tok == r"class:\s":
            out.append(_SPACE)
        elif tok == r"\S":
            out.append(f"[^{_SPACE}]")
        else:
            out.append(tok.removeprefix("class:"))
    return "(?iu)" + "".join(out)


def valid(pattern: str) -> bool:
    """Whether it is a pattern at all; Python's engine stands in for the driver's check."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compiled(pattern: str) -> str:
    """The pattern translated, or the text itself where it is no valid pattern."""
    return translate(pattern) if valid(pattern) else "(?iu)" + literal(pattern)


def any_of(patterns: list[str]) -> str:
    """One alternation of several: a row is scanned once."""
    return "(?iu)" + "|".join(f"(?:{compiled(p).removeprefix('(?iu)')})" for p in patterns)
