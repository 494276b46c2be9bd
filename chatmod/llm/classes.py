"""Split patterns whose letters, numbers and the like are those of the tokenizer's own library.

The libraries' Unicode tables differ in age from those of Python's ``regex``: a code point that is a letter here may be
unassigned there, which moves piece borders. The library is asked once, on the driver, which characters of a class it
knows, and the classes of the pattern are changed to that. Characters that no table assigns are in no class.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import regex


@lru_cache(maxsize=1)
def _assigned() -> str:
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    return "".join(regex.findall(r"[^\p{Cn}\p{Co}]", every))


def _ranges(chars: set[str]) -> str:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


def as_in_library(pattern: str, members: Callable[[str, str], set[str]]) -> str:
    """``pattern`` with every ``\\p{..}`` as the library understands it; ``members(class, text)`` are the characters of
    ``text`` that the library counts to a class."""
    changed = pattern
    for name in sorted(set(regex.findall(r"\\p\{\w+\}", pattern))):
        own, library = set(regex.findall(name, _assigned())), members(name, _assigned())
        new = name
        if own - library:
            new = f"[{new}--[{_ranges(own - library)}]]"
        if library - own:
            new = f"[{new}||[{_ranges(library - own)}]]"
        changed = changed.replace(name, new)
    return pattern if changed == pattern else "(?V1)" + changed


@lru_cache(maxsize=8)
def tiktoken_pattern(pattern: str) -> str:
    import tiktoken

    def members(name: str, text: str) -> set[str]:
        # what a pattern does not match is left out, and every byte is a token
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return set(bytes(probe.encode_ordinary(text)).decode("utf-8"))

    return as_in_library(pattern, members)


@lru_cache(maxsize=8)
def tokenizers_pattern(pattern: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    def members(name: str, text: str) -> set[str]:
        probe = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        return set("".join(piece for piece, _ in probe.pre_tokenize_str(text)))

    return as_in_library(pattern, members)
