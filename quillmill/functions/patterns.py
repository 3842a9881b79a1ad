r"""Patterns of Python's re, whose \w, \s and \b know all of Unicode, in the spelling of other engines."""

from __future__ import annotations

import re

#: What Python's \s matches.
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
BORDER = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def _classes(pattern: str) -> str:
    """Classes spelled out, within brackets and outside of them."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\w", WORD).replace(r"\s", SPACE), pattern)
    return inside.replace(r"\s", f"[{SPACE}]").replace(r"\w", f"[{WORD}]")


def for_spark(pattern: str) -> str:
    """The pattern for Java's engine. A border before a letter is a look behind, which is faster than the full form."""
    spelled = _classes(pattern).replace("(?i)", "(?iu)")
    spelled = re.sub(r"^(\(\?iu\))?\\b(?=\(\?:[a-z]|\[A-Za-z\])", lambda m: f"{m[1] or ''}(?<![{WORD}])", spelled)
    return spelled.replace(r"\b", BORDER)


def for_re2(pattern: str) -> tuple[str, int]:
    """The pattern for engines without look-around, and the group that is the match: what a look behind refuses is a
    character of the pattern there, and borders know ASCII alone."""
    spelled = _classes(pattern)
    head = re.match(r"\(\?<!\[([^\]]*)\]\)", spelled)
    return (f"(?:^|[^{head[1]}])({spelled[head.end() :]})", 1) if head else (spelled, 0)
