"""The unicode_math_symbols rule.

Symbols are taken one kind after the other, and what one of them has claimed is closed to
those that follow, so a document is a sequential scan.  It runs as an Arrow UDF, and only
on documents that hold a symbol.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from doctide.operators.symbol_table import SYMBOLS

ARROWS = "→←↔↦⇒⇐⇔↪↠"
#: Words that are never taken for variables.
WORDS = frozenset(
    "the a an is are was were be been have has had do does did will would could should may might must shall can "
    "of to in for on with at by from as or and but if then that this it its we they he she not so up value values".split())
REACH = 100

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_SET = r"[A-Za-z_][A-Za-z0-9_×⊗]*"
_BEFORE = {
    "function": re.compile(rf"([A-Za-zαβγδεζηθικλμνξπρστυφχψω][A-Za-z0-9_]*)\s*:\s*({_SET})\s*$"),
    "math": re.compile(r"\$([^$]+)\$(\s*)$"),
    "name": re.compile(rf"({_NAME}\s*)$"),
    "variable": re.compile(rf"({_NAME}|\)|\])\s*$"),
}
_AFTER = {
    "set": re.compile(rf"\s*({_SET})"),
    "math": re.compile(r"(\s*)\$([^$]+)\$"),
    "name": re.compile(rf"\s*({_NAME})"),
    "variable": re.compile(rf"\s*({_NAME}|\(|\[)"),
}
_ANY = re.compile("[" + "".join(SYMBOLS) + "]")


def symbol_order() -> list[str]:
    """Arrows first, the last of the table leading; then the others as they come."""
    arrows = [c for c in SYMBOLS if c in ARROWS]
    return arrows[::-1] + [c for c in SYMBOLS if c not in ARROWS]


class _Dollars:
    """Whether a place is in math mode, from the sorted places of dollar signs."""

    def __init__(self, text: str):
        self.all = [m.start() for m in re.finditer(r"\$", text)]
        self.escaped = [k for k in self.all if k > 0 and text[k - 1] == "\\"]

    def odd(self, at: int) -> bool:
        """Among the 200 characters before at; a sign that starts them counts, whatever stands before it."""
        low = max(0, at - 200)
        count = lambda places, start: bisect_left(places, at) - bisect_left(places, start)
        return (count(self.all, low) - max(count(self.escaped, low + 1), 0)) % 2 == 1


def rewrite(symbol: str, before: str, after: str) -> tuple[int, int, str]:
    """(characters claimed before the symbol, after it, new text)."""
    latex = SYMBOLS[symbol]
    left = {k: p.search(before) for k, p in _BEFORE.items()}
    right = {k: p.match(after) for k, p in _AFTER.items()}
    size = lambda m: len(m.group(0)) if m else 0
    text = lambda m: m.group(0) if m else ""

    if symbol in ARROWS and left["function"] and right["set"]:
        f = left["function"]
        return size(f), size(right["set"]), f"${f.group(1)} \\colon {f.group(2)} {latex} {right['set'].group(1)}$"
    if left["math"] and right["math"]:
        return size(left["math"]), size(right["math"]), f"${left['math'].group(1)} {latex} {right['math'].group(2)}$"
    if left["math"]:
        return size(left["math"]), size(right["name"]), f"${left['math'].group(1)} {latex}{text(right['name'])}$"
    if right["math"]:
        return size(left["name"]), size(right["math"]), f"${text(left['name']).strip()} {latex} {right['math'].group(2)}$"
    if left["variable"] and right["variable"]:
        return size(left["variable"]), size(right["name"]), f"${text(left['variable']).strip()} {latex} {text(right['name']).strip()}$"
    if left["variable"]:
        name = text(left["variable"]).strip()
        if name.lower() in WORDS:
            return 0, 0, f"${latex}$"
        return size(left["variable"]), 0, f"${name}^{{{latex}}}$" if symbol in "◦∗∞" else f"${name} {latex}$"
    if right["variable"]:
        return 0, size(right["name"]), f"${latex} {text(right['name']).strip()}$"
    return 0, 0, f"${latex}$"


def symbol_issues(text: str | None) -> list[tuple]:
    """(line, start, old, new, None) of each issue, stable by line."""
    if not text or not (places := [(m.group(), m.start()) for m in _ANY.finditer(text)]):
        return []
    dollars, taken, out = _Dollars(text), bytearray(len(text)), []
    by_symbol: dict[str, list[int]] = {}
    for c, at in places:
        by_symbol.setdefault(c, []).append(at)
    for c in symbol_order():
        for at in by_symbol.get(c, ()):
            if taken[at] or dollars.odd(at):
                continue
            a, b, new = rewrite(c, text[max(0, at - REACH):at], text[at + 1:at + 1 + REACH])
            a, b = at - a, at + 1 + b
            taken[a:b] = b"\1" * (b - a)
            out.append((text.count("\n", 0, at) + 1, at, text[a:b], new, None))
    out.sort(key=lambda x: x[0])
    return out


def expression(body, kind: str):
    """Issues of the given array type; null for a body without symbols."""
    from pyspark.sql import functions as F

    return F.udf(symbol_issues, kind, useArrow=True)(F.when(body.rlike("[" + "".join(SYMBOLS) + "]"), body))
