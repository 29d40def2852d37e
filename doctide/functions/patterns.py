"""Text primitives: matches with places, lines, math mode.

Everything here is a column expression over one document, so rules built from them
need neither a shuffle nor Python.  Patterns are Java regular expressions with ``(?U)``
(Unicode classes) and ``(?d)`` (only a newline ends a line).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<start:int,line:int,txt:string,g:array<string>>"
MATCHES = f"array<{MATCH}>"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


#: Items of an array that are folded together: each step of Spark's aggregate copies what it has gathered.
CHUNK = 128


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(items: Column, state: Column, kind: str, step, done=None) -> Column:
    """Array of what a fold over items gives out, of element type kind, in order.

    step(state, item) gives (the next state, an element or null for none); done(state) gives a
    last element or null.  A first pass keeps the state before each chunk of items only; a second
    gathers each chunk's elements, so that n of them cost n * CHUNK copies and not n * n.
    """
    none = F.array().cast(f"array<{kind}>")

    def gathered(out, element):
        return F.when(element.isNotNull(), F.concat(out, F.array(element))).otherwise(out)

    def inner(acc, x):
        new, element = step(acc["state"], x)
        return F.struct(new.alias("state"), gathered(acc["out"], element).alias("out"))

    def passed(acc, chunk):
        now = F.aggregate(chunk, acc["now"], lambda state, x: step(state, x)[0])
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all"))

    def over(chunks):
        no_states = F.filter(F.array(state), lambda x: F.lit(False))
        states = F.aggregate(chunks, F.struct(state.alias("now"), no_states.alias("all")), passed)

        def out(known):
            parts = F.transform(chunks, lambda chunk, k: F.aggregate(
                chunk, F.struct(F.get(known["all"], k).alias("state"), none.alias("out")), inner, lambda acc: acc["out"]))
            if done:
                parts = F.concat(parts, F.array(gathered(none, done(known["now"]))))
            return F.flatten(parts)

        return let(states, out)

    def cut(every):
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / CHUNK).cast("int"))
        return let(F.transform(numbers, lambda k: F.slice(every, k * CHUNK + 1, CHUNK)), over)

    return let(items, cut)


def found(body: Column, pattern: str, groups: int = 0) -> Column:
    """All matches in order: start (from 0), line (from 1), text and groups.

    Matches and the text between them are cut out by two passes of the pattern; their
    lengths and newlines add up to the places.  Texts without a match cost one search.
    """
    every = [F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    rows = F.arrays_zip(every[0], F.split(body, pattern, -1), *every[1:])

    def step(state, e):
        start = state["start"] + F.length(e["1"])
        line = state["line"] + newlines(e["1"])
        one = F.struct(
            start.alias("start"), line.alias("line"), e["0"].alias("txt"),
            F.array(*[e[str(k + 1)] for k in range(1, groups + 1)]).cast("array<string>").alias("g"),
        )
        new = F.struct((start + F.length(e["0"])).alias("start"), (line + newlines(e["0"])).alias("line"))
        return new, F.when(e["0"].isNotNull(), one)

    matches = fold(rows, F.struct(F.lit(0).alias("start"), F.lit(1).alias("line")), MATCH, step)
    return F.when(body.rlike(pattern), matches).otherwise(F.array().cast(MATCHES))


def lines(body: Column) -> Column:
    """array<struct<i, s>>: lines from 1."""
    return F.transform(F.split(body, "\n", -1), lambda s, i: F.struct((i + 1).alias("i"), s.alias("s")))


def in_math(body: Column, start: Column) -> Column:
    """An odd number of unescaped dollar signs in the 200 characters before start."""
    before = F.substring(body, F.greatest(start - 200, F.lit(0)) + 1, F.least(start, F.lit(200)))
    count = lambda s: (F.length(before) - F.length(F.replace(before, F.lit(s), F.lit("")))) / len(s)
    return (count("$") - count("\\$")) % 2 == 1
