"""Canonical composition (NFC) of text in Spark expressions, without a Python stage.

Text is cut at characters that never join what stands before them (starters whose quick check is Yes). Only pieces
that hold anything else are touched: a character and the marks, conjoining letters or replaced characters after it. Each
different piece of a text is normalised once, and the text is put together again around the results:

1. decomposition by table (Hangul syllables by arithmetic),
2. reordering of marks by combining class, where two stand in the wrong order,
3. composition: one scan that joins starters with what follows unblocked, by a table of pairs.

The tables are built from Python's own Unicode data by its rules and enter the plan as literal arrays, so a look-up is
an index. Code points are integers; a piece becomes text again through UTF-32.

A piece costs time in proportion to its length, times, where its marks are out of order, the starters in it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hangul syllables and the letters they are composed of
SYLLABLES, N_SYLLABLES, LEADS, N_LEADS, VOWELS, N_VOWELS, TAILS, N_TAILS = 0xAC00, 11172, 0x1100, 19, 0x1161, 21, 0x11A7, 28


def _is_syllable(c: int) -> bool:
    return SYLLABLES <= c < SYLLABLES + N_SYLLABLES


@lru_cache(maxsize=1)
def _tables() -> dict:
    """Properties of all code points: the row of a code point is values[pages[c >> 8] * 256 + (c & 255)]."""
    decomposed, pairs = {}, {}
    odd = set(range(VOWELS, VOWELS + N_VOWELS)) | set(range(TAILS + 1, TAILS + N_TAILS))
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or _is_syllable(c):
            continue
        ch = chr(c)
        if unicodedata.combining(ch):
            odd.add(c)
        raw = unicodedata.decomposition(ch)
        if raw and raw[0] != "<":
            decomposed[c] = [ord(x) for x in unicodedata.normalize("NFD", ch)]
            if unicodedata.normalize("NFC", ch) != ch:
                odd.add(c)                          # never composed again
            else:
                a, b = (int(x, 16) for x in raw.split())
                pairs[a, b] = c
                odd.add(b)
    firsts = {a: i for i, a in enumerate(sorted({a for a, _ in pairs}), 1)}
    seconds = {b: i for i, b in enumerate(sorted({b for _, b in pairs}), 1)}
    composed = [0] * ((len(firsts) + 1) * (len(seconds) + 1))
    for (a, b), c in pairs.items():
        composed[firsts[a] * (len(seconds) + 1) + seconds[b]] = c
    rows: dict[tuple, int] = {(0, 0, 0, 0, 0): 0}
    flat: list[int] = []
    pages, blocks, values = [], {}, []
    for page in range((sys.maxunicode >> 8) + 1):
        block = []
        for c in range(page << 8, (page + 1) << 8):
            parts = decomposed.get(c, [])
            marks = unicodedata.combining(chr(c)) if c in odd else 0
            row = (marks, len(parts), len(flat) if parts else 0, firsts.get(c, 0), seconds.get(c, 0))
            flat += parts
            block.append(rows.setdefault(row, len(rows)))
        key = tuple(block)
        if key not in blocks:
            blocks[key] = len(blocks)
            values += block
        pages.append(blocks[key])
    columns = list(zip(*rows))
    return {"odd": odd, "pages": pages, "values": values, "class": columns[0], "length": columns[1], "start": columns[2], "first": columns[3],
            "second": columns[4], "parts": flat, "composed": composed, "width": len(seconds) + 1}


def _ranges(codes: set[int], gap: int = 1) -> list[tuple[int, int]]:
    """The code points as ranges, holes of less than ``gap`` filled."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c <= out[-1][1] + gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _class(ranges: list[tuple[int, int]]) -> str:
    """A regular expression's class body for the ranges, halved again and again: a character is compared with the ranges
    near it only, and one far from all of them with two."""
    def span(a: int, b: int) -> str:
        return f"\\x{{{a:X}}}-\\x{{{b:X}}}"

    if len(ranges) <= 3:
        return "".join(span(a, b) for a, b in ranges)
    half = len(ranges) // 2
    return "".join(f"[{span(part[0][0], part[-1][1])}&&[{_class(part)}]]" for part in (ranges[:half], ranges[half:]))


@lru_cache(maxsize=1)
def _patterns() -> tuple[str, str]:
    """(a character that may join the one before it or is replaced, a piece to normalise). The class may hold more than it
    must."""
    odd = _tables()["odd"]
    # white space, the ASCII range and common letters stay outside when holes are filled
    inside = _class(_ranges({c for c in odd if c < 0x10000}, 16) + _ranges({c for c in odd if c >= 0x10000}, 1024))
    return f"[{inside}]", f"[^{inside}]?[{inside}]+"


def _literal(numbers) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def _at(table: Column, index: Column) -> Column:
    return F.get(table, index)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _piece(text: Column) -> Column:
    """The composed form of one piece."""
    t = _tables()
    pages, values = _literal(t["pages"]), _literal(t["values"])
    column = {name: _literal(t[name]) for name in ("class", "length", "start", "first", "second", "parts", "composed")}

    def row(c: Column) -> Column:
        return _at(values, _at(pages, F.shiftright(c, 8)) * 256 + c.bitwiseAND(F.lit(255)))

    def combining(c: Column) -> Column:
        return _at(column["class"], row(c))

    def parts(c: Column) -> Column:
        s = c - SYLLABLES
        lead_vowel = [F.floor(s / (N_VOWELS * N_TAILS)).cast("int") + LEADS, (F.floor(s / N_TAILS) % N_VOWELS).cast("int") + VOWELS]
        syllable = F.when(s % N_TAILS == 0, F.array(*lead_vowel)).otherwise(F.array(*lead_vowel, s % N_TAILS + TAILS))
        plain = _let(row(c), lambda r: F.when(_at(column["length"], r) == 0, F.array(c)).otherwise(
            F.slice(column["parts"], _at(column["start"], r) + 1, _at(column["length"], r))))
        return F.when(c.between(SYLLABLES, SYLLABLES + N_SYLLABLES - 1), syllable).otherwise(plain)

    def ordered(codes: Column) -> Column:
        def sort(of: Column) -> Column:
            starters = F.filter(F.transform(of, lambda x, i: F.when(x["k"] == 0, i)), lambda i: i.isNotNull())
            keyed = _let(starters, lambda s: F.transform(of, lambda x, i: F.struct(
                F.size(F.filter(s, lambda p: p <= i)).alias("run"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))
            return F.transform(F.array_sort(keyed), lambda x: x["c"])

        def check(of: Column) -> Column:
            wrong = F.exists(F.zip_with(of, F.slice(of, F.lit(2), F.size(of)), lambda a, b: F.coalesce((b["k"] > 0) & (a["k"] > b["k"]), F.lit(False))), lambda x: x)
            return F.when(wrong, sort(of)).otherwise(F.transform(of, lambda x: x["c"]))

        return _let(F.transform(codes, lambda c: F.struct(combining(c).alias("k"), c.alias("c"))), check)

    def pair(a: Column, b: Column) -> Column:
        """The composite of two code points, 0 without."""
        lead = F.when(b.between(VOWELS, VOWELS + N_VOWELS - 1), ((a - LEADS) * N_VOWELS + (b - VOWELS)) * N_TAILS + SYLLABLES).otherwise(F.lit(0))
        tail = F.when(((a - SYLLABLES) % N_TAILS == 0) & b.between(TAILS + 1, TAILS + N_TAILS - 1), a + (b - TAILS)).otherwise(F.lit(0))
        listed = _at(column["composed"], _at(column["first"], row(a)) * t["width"] + _at(column["second"], row(b)))
        return (F.when(a < 0, F.lit(0)).when(a.between(LEADS, LEADS + N_LEADS - 1), lead)
                .when(a.between(SYLLABLES, SYLLABLES + N_SYLLABLES - 1), tail).otherwise(listed)).cast("int")

    def composed(codes: Column) -> Column:
        kind = "struct<at:int,code:int,last:int,i:int,changes:array<struct<at:int,code:int>>>"
        zero = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("code"), F.lit(0).alias("last"), F.lit(0).alias("i"),
                        F.array().cast("array<struct<at:int,code:int>>").alias("changes")).cast(kind)

        def scan(acc: Column, c: Column) -> Column:
            def judge(x: Column) -> Column:
                joins = (x["pair"] > 0) & ((acc["last"] == 0) | (acc["last"] < x["k"]))
                change = lambda at, code: F.struct(at.alias("at"), code.cast("int").alias("code"))
                joined = F.struct(acc["at"].alias("at"), x["pair"].alias("code"), acc["last"].alias("last"), (acc["i"] + 1).alias("i"), F.concat(
                    acc["changes"], F.array(change(acc["at"], x["pair"]), change(acc["i"], F.lit(-1)))).alias("changes"))
                starter = F.struct(acc["i"].alias("at"), c.alias("code"), F.lit(0).alias("last"), (acc["i"] + 1).alias("i"), acc["changes"].alias("changes"))
                mark = F.struct(acc["at"].alias("at"), acc["code"].alias("code"), x["k"].alias("last"), (acc["i"] + 1).alias("i"), acc["changes"].alias("changes"))
                return F.when(joins, joined.cast(kind)).when(x["k"] == 0, starter.cast(kind)).otherwise(mark.cast(kind))

            return _let(F.struct(combining(c).alias("k"), pair(acc["code"], c).alias("pair")), judge)

        def apply(changes: Column) -> Column:
            def new(c: Column, i: Column) -> Column:
                return _let(F.filter(changes, lambda x: x["at"] == i), lambda own: F.when(F.size(own) > 0, F.element_at(own, -1)["code"]).otherwise(c))

            return F.when(F.size(changes) == 0, codes).otherwise(F.filter(F.transform(codes, new), lambda c: c >= 0))

        return _let(F.aggregate(codes, zero, scan)["changes"], apply)

    codes = F.flatten(F.transform(F.split(text, ""), lambda c: parts(F.ascii(c))))
    out = _let(_let(codes, ordered), composed)
    return F.decode(F.unhex(F.array_join(F.transform(out, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def compose(text: Column) -> Column:
    """``text`` in NFC. ASCII text, and text without characters that may change, is returned as it is; null stays null."""
    inside, piece = _patterns()

    def rebuilt(t: Column) -> Column:
        def put(found: Column) -> Column:
            kinds = F.array_distinct(found)
            def joined(table: Column) -> Column:
                return F.array_join(F.zip_with(F.split(t, piece, -1), found, lambda a, b: F.concat(a, F.coalesce(F.element_at(table, b), F.lit("")))), "")

            return _let(_let(kinds, lambda k: F.map_from_arrays(k, F.transform(k, _piece))), joined)

        return _let(F.regexp_extract_all(t, F.lit(piece), 0), put)

    def judged(t: Column) -> Column:
        return F.when(F.length(t) == F.octet_length(t), t).when(~t.rlike(inside), t).otherwise(rebuilt(t))

    return _let(text, judged)
