"""Personal data: surrogates that keep type, format, script and gender.

Entities are found by pattern: e-mail addresses, telephone numbers, IPv4 addresses, card numbers (with a fitting
check digit), secrets (quoted hexadecimal strings) and names after a title; a document's names are then looked for
in the rest of its text, where they count without a title if not in small letters. An entity's canonical form (digits of a number, a name
in lower case) with a secret key gives its surrogate: digits for digits in the mention's own punctuation,
hexadecimal for hexadecimal, a pronounceable name in the same script and letter case, with an ending that
fits the title's gender. Mentions of one entity in any document and format get one surrogate (coreference);
"Mr Smith" and "Mr John Smith" share the surname's. A name without a telling title takes the gender of the nearest
earlier mention in its document that has one (else of the first later one); failing that, the only one
known for it in the corpus.

Distinctness is checked over the corpus: the distinct entities are listed once, and those whose surrogate
is also another one's, or is itself an entity of the corpus, draw again with the next attempt until no
collision is left. Rewriting computes first attempts in place; only documents that mention an entity with a
later attempt are joined with it.

Defined cases: null texts stay null and have no entities; rows that repeat are rewritten alike; a surrogate
never equals its original; extra columns pass through.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmod.llm.frames import cut, row_keys
from chatmod.llm.spans import frugal

# Titles and the gender they tell (f, m, or n for none)
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f",
          "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f",
          "Dr": "n", "Prof": "n", "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f"}
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))++"      # possessive: nothing after a name makes it shorter
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@\w(?:[\w-]*\w)?(?:\.\w(?:[\w-]*\w)?)+)"
    r"|(?P<secret>(?<=[\"'])[0-9A-Fa-f]{32,128}(?=[\"']))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w))"
    r"|(?P<plain>(?<![\w+])(?<!\d[.-])(?:(?:1[ .-])?\d{3}[ ./-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-](?:\d{5,8}|\d{3,4}[ -]\d{3,4}|\d{2,3}(?:[ -]\d{2,3}){2,3})|0\d(?:[ .]\d\d){4})(?!\w)(?![.-]\d))"
    r"|(?P<card>(?<![\w.+])(?<!\D-)\d(?:[ -]?\d){12,18}(?!\w))"
    rf"|(?P<title>\b(?:{'|'.join(TITLES)})\b\.?\s+)(?P<name>{_NAME}(?: {_NAME})?)")
KINDS = ("email", "secret", "ip", "phone", "card", "name")
_HINTS = ("@", *TITLES)
_NUMBER = re.compile(r"\d")
_DIGITS = re.compile(r"\d+")
_OWNER = re.compile(r"['’][sS]\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")

# Syllables of made-up names by script, and endings by gender
_SYLLABLES = {"latin": ("bal cor den fal gar hol jen kel lam mar nor pel ras sol tam vel wen zor bri dan".split(), {"m": "o", "f": "a", "n": "en"}),
              "cyrillic": ("бал вор ген дал зор кел лам мар нор пел рас сол там вел жан".split(), {"m": "ов", "f": "ова", "n": "ко"}),
              "greek": ("βαλ γορ δεν ζαλ κελ λαμ μαρ νορ πελ ρασ σολ ταμ".split(), {"m": "ος", "f": "α", "n": "ι"})}


def _script(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "").lower()
        for script in ("cyrillic", "greek"):
            if name.startswith(script):
                return script
    return "latin"


def _digest(key: bytes, kind: str, canonical: str, attempt: int) -> int:
    return int.from_bytes(hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), sha256).digest() * 2, "big")


def _draw(n: int, choices: str, length: int) -> str:
    out = []
    for _ in range(length):
        n, i = divmod(n, len(choices))
        out.append(choices[i])
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check sum of a card number: 0 if it is valid."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def entities(kind: str, mention: str, gender: str = "n") -> list[tuple[str, str]]:
    """The (kind, canonical form) parts a mention consists of."""
    if kind == "email":
        local, _, domain = mention.lower().rpartition("@")
        return [("local", local), ("domain", domain)]
    if kind in ("phone", "card"):
        digits = re.sub(r"\D", "", mention)
        national = kind == "phone" and len(digits) == 10 and digits[0] != "0" and not mention.startswith("+")
        return [(kind, "1" + digits if national else digits)]      # ten digits are those after +1
    if kind == "name":
        return [(f"name:{gender}:{_script(w)}", w.lower()) for w in mention.split()]
    return [(kind, mention.lower())]


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form's replacement, itself in canonical form and never equal to it."""
    while True:
        n = _digest(key, kind, canonical, attempt)
        if kind in ("phone", "card"):
            keep = max(len(canonical) - 10, canonical[0] == "0", 0) if kind == "phone" else 0    # the country code or the 0 stays
            out = canonical[:keep] + _draw(n, "123456789", 1) + _draw(n >> 8, "0123456789", len(canonical) - keep - 1)
            if kind == "card" and _luhn(canonical) == 0:        # a valid number gets a valid one
                out = out[:-1] + str((int(out[-1]) - _luhn(out)) % 10)
        elif kind == "ip":
            out = ".".join(str(1 + (n >> 8 * k) % 254) for k in range(4))
        elif kind == "secret":
            out = _draw(n, "0123456789abcdef", len(canonical))
        elif kind == "local":
            out = re.sub(r"[^\W\d_]+|\d+", lambda m: _draw(n >> (7 * m.start() % 200), "0123456789" if m[0].isdigit() else "abcdefghijklmnopqrstuvwxyz", len(m[0])), canonical)
            if len(out) < 6:
                out += _draw(n >> 60, "abcdefghijklmnopqrstuvwxyz", 6)
        elif kind == "domain":
            out = _draw(n, "abcdefghijklmnopqrstuvwxyz", 10) + ".example"
        else:
            _, gender, script = kind.split(":")
            parts, endings = _SYLLABLES[script]
            size = max(2, min(5, len(canonical) // 3)) + attempt // 8
            drawn = []
            for _ in range(size):
                n, i = divmod(n, len(parts))
                drawn.append(parts[i])
            out = "".join(drawn) + endings[gender]
        if out != canonical:
            return out
        attempt += 1


def _like(mention: str, canonical: str) -> str:
    """``canonical`` in the letter case of a mention."""
    return canonical.upper() if mention.isupper() and len(mention) > 1 else canonical.capitalize() if mention[:1].isupper() else canonical


def render(kind: str, mention: str, parts: list[str]) -> str:
    """Surrogate parts in the format of a mention."""
    if kind in ("phone", "card"):
        digits = iter(parts[0][len(parts[0]) - len(re.sub(r"\D", "", mention)):])       # without a country code the mention lacks
        return re.sub(r"\d", lambda _: next(digits), mention)
    if kind == "email":
        out = f"{parts[0]}@{parts[1]}"
        return out.upper() if mention.isupper() else out
    if kind == "name":
        return " ".join(_like(w, p) for w, p in zip(mention.split(), parts))
    return parts[0].upper() if mention.isupper() else parts[0]


def _card(text: str, start: int, end: int) -> int:
    """The end of the longest valid card number of whole groups of digits at ``start``, or 0."""
    best, digits = 0, ""
    for m in _DIGITS.finditer(text, start, end):
        if digits and len(m[0]) > 12:       # a group of 13 or more digits is a number of its own
            break
        digits += m[0]
        if len(digits) > 12 and _luhn(digits) == 0:
            best = m.end()
        if len(m[0]) > 12:
            break
    return best


def _patterns(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """What ``PATTERN`` finds, left to right."""
    m = PATTERN.search(text)
    while m:
        kind = {"plain": "phone"}.get(m.lastgroup, m.lastgroup)
        start, end = m.span(m.lastgroup)
        if kind == "card":
            end = _card(text, start, end)
        elif kind == "name":
            owner = _OWNER.search(text, start, end)
            end = owner.start() if owner else end
        if end:
            yield kind, text[start:end], TITLES[m["title"].strip().rstrip(".")] if kind == "name" else "n", start, end
        m = PATTERN.search(text, end or _DIGITS.match(text, start).end())


def _coreference(text: str, found: list[tuple[str, str, str, int, int]]) -> list[tuple[str, str, str, int, int]]:
    """``found`` with the other mentions of its names, and with the gender known for names without a telling title."""
    def known(named: list) -> dict[str, tuple[list[int], list[str]]]:
        out: dict[str, tuple[list[int], list[str]]] = {}
        for _, mention, gender, start, _ in named:
            for w in mention.lower().split():
                at, genders = out.setdefault(w, ([], []))
                if gender != "n":
                    at.append(start)
                    genders.append(gender)
        return out

    def gender(words: list[str], start: int, people: dict) -> str:
        for w in reversed(words):
            at, genders = people.get(w, ((), ()))
            if at:
                return genders[max(bisect_right(at, start) - 1, 0)]
        return "n"

    people = known([f for f in found if f[0] == "name"])
    found = [(k, m, gender(m.lower().split(), a, people) if k == "name" and g == "n" else g, a, b) for k, m, g, a, b in found]
    people = known([f for f in found if f[0] == "name"])
    names = {w.lower() for k, m, *_ in found if k == "name" for i, w in enumerate(m.split()) if i == 0 or not w[0].islower()}
    sizes = sorted({len(_LETTERS.findall(w)) for w in names}, reverse=True)      # in parts: few sizes, however long a name is
    more, place = [], 0
    for token in _WORD.finditer(text):
        while place < len(found) and found[place][4] <= token.start():
            place += 1
        letters = [m.span() for m in _LETTERS.finditer(text, *token.span())]
        i = 0
        while i < len(letters):
            start, until = letters[i][0], i + 1
            for j in (i + size for size in sizes if i + size <= len(letters)):
                word = text[start:letters[j - 1][1]]
                free = place == len(found) or letters[j - 1][1] <= found[place][3]
                if free and not word[0].islower() and word.lower() in names:
                    more.append(("name", word, gender([word.lower()], start, people), start, start + len(word)))
                    until = j
                    break
            i = until
    return sorted(found + more, key=lambda f: f[3])


def find(text: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, mention, gender, start, end) of every entity of a text, left to right."""
    if not (_NUMBER.search(text) or any(h in text for h in _HINTS)):
        return []
    found = list(_patterns(text))
    return _coreference(text, found) if any(f[0] == "name" for f in found) else found


def _mentions(text_col: str):
    """Distinct entities of each row: (k1, k2, kind, canonical)."""
    @frugal
    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                found = {e for kind, mention, gender, _, _ in find(text or "") for e in entities(kind, mention, gender)}
                rows += [(k1[i], k2[i], *e) for e in sorted(found)]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                                             names=["k1", "k2", "kind", "canonical"])

    return mentions


def _draws(key: bytes):
    @frugal
    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "canonical", "attempt")),
                                              pa.array([surrogate(key, *r) for r in rows], pa.string())],
                                             names=["kind", "canonical", "attempt", "surrogate"])

    return draws


def _rewrite(text_col: str, key: bytes):
    @frugal
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, later = batch.column(text_col).to_pylist(), batch.column("__later").to_pylist()
            out, counts = [], np.zeros((batch.num_rows, len(KINDS)), np.int64)
            for i, text in enumerate(texts):
                if text is None:
                    out.append(None)
                    continue
                drawn = {(r["kind"], r["canonical"]): (r["drawn"], r["attempt"]) for r in later[i] or ()}
                parts, at = [], 0
                for kind, mention, gender, start, end in find(text):
                    counts[i, KINDS.index(kind)] += 1
                    made = []
                    for k, c in entities(kind, mention, gender):
                        k_drawn, attempt = drawn.get((k, c), (k, 0))
                        made.append(surrogate(key, k_drawn, c, attempt))
                    parts += [text[at:start], render(kind, mention, made)]
                    at = end
                out.append("".join(parts) + text[at:])
            names = [n for n in batch.schema.names if n != "__later"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out, pa.string()), pa.array(counts.sum(axis=1))]
                + [pa.array(counts[:, k]) for k in range(len(KINDS))],
                names=[*names, "safe_text", "n_entities", *[f"n_{k}" for k in KINDS]])

    return rewrite


def surrogates(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate) of all distinct entities, free of collisions."""
    ddl = "kind string, canonical string, attempt int, surrogate string"
    real = cut(mentions.select("kind", "canonical").distinct())
    drawn = cut(real.withColumn("attempt", F.lit(0)).mapInArrow(_draws(key), ddl))
    while True:
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = drawn.join(first, ["kind", "surrogate"]).where("canonical <> first").select("kind", "canonical", "attempt")
        taken = drawn.join(real.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_semi")
        again = cut(shared.union(taken.select("kind", "canonical", "attempt")).distinct())
        if again.isEmpty():
            return drawn
        redrawn = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(_draws(key), ddl)
        drawn = cut(drawn.join(again.select("kind", "canonical"), ["kind", "canonical"], "left_anti").union(redrawn))


def _known_genders(real: DataFrame) -> DataFrame:
    """(kind, canonical, drawn): distinct entities with the kind their surrogate is drawn for, which tells a neutral name's
    gender if the corpus has exactly one for it."""
    script, told = F.substring_index("kind", ":", -1), F.col("kind").rlike("^name:[fm]:")
    one = real.where(told).groupBy(script.alias("script"), "canonical").agg(F.min("kind").alias("told"), F.count("*").alias("n"))
    neutral = real.where(F.col("kind").startswith("name:n:")).withColumn("script", script)
    names = neutral.join(one.where("n = 1").drop("n"), ["script", "canonical"], "left").select(
        "kind", "canonical", F.coalesce("told", "kind").alias("drawn"))
    return names.union(real.where(~F.col("kind").startswith("name:n:")).select("kind", "canonical", F.col("kind").alias("drawn")))


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with safe_text, n_entities and n_<kind>. ``key``: the secret that fixes all surrogates."""
    results = ["safe_text", "n_entities", *[f"n_{k}" for k in KINDS]]
    rows = docs.drop(*results)
    mentions = rows.select(*row_keys(id_col, text_col), text_col).mapInArrow(_mentions(text_col), "k1 long, k2 long, kind string, canonical string")
    real = cut(_known_genders(cut(mentions.select("kind", "canonical").distinct())))
    made = surrogates(real.select(F.col("drawn").alias("kind"), "canonical"), key).select(F.col("kind").alias("drawn"), "canonical", "attempt")
    later = real.join(made, ["drawn", "canonical"]).where("attempt > 0 OR drawn <> kind")
    if later.isEmpty():
        marked = rows.withColumn("__later", F.lit(None).cast("array<struct<kind:string,canonical:string,drawn:string,attempt:int>>"))
    else:
        per_row = mentions.join(later, ["kind", "canonical"]).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
            F.collect_set(F.struct("kind", "canonical", "drawn", "attempt")).alias("__later"))
        keyed = rows.select("*", *[c.alias(f"__{k}") for c, k in zip(row_keys(id_col, text_col), ("k1", "k2"))])
        marked = keyed.join(per_row, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    schema = T.StructType([*marked.schema.fields[:-1], T.StructField("safe_text", T.StringType()),
                           *[T.StructField(n, T.LongType()) for n in results[1:]]])
    return marked.mapInArrow(_rewrite(text_col, key), schema)
