"""Rule patterns in Python's sense, for Java's regular expressions and for those of SQL engines with RE2.

In Python ``\\s`` and ``\\d`` are of all of Unicode, a word border lies between letters, digits or underscores of any script and
anything else, and ``.`` and ``$`` know the line feed alone. Java and RE2 need explicit classes and borders for that."""

from __future__ import annotations

SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"


def _translated(pattern: str, border: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            escape, i = pattern[i : i + 2], i + 2
            known = {"\\s": SPACE, "\\d": DIGIT}.get(escape)
            out.append(known if known and inside else f"[{known}]" if known else border if escape == "\\b" and not inside else escape)
            continue
        inside = (pattern[i] == "[" or inside) and not (pattern[i] == "]" and inside)
        out.append(pattern[i])
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """For ``rlike``."""
    folded = ignore_case or pattern.startswith("(?i)")
    flags = "(?iud)" if folded else "(?d)"
    return flags + _translated(pattern.removeprefix("(?i)"), f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For a search that asks only whether there is a match: a border takes up the character beyond the word. One before spaces
    and a colon or equals sign always holds and is left out."""
    folded = "(?i)" if ignore_case or pattern.startswith("(?i)") else ""
    return folded + _translated(pattern.removeprefix("(?i)").replace(r"\b\s*[:=]", r"\s*[:=]"), f"(?:^|$|[^{WORD}])")
