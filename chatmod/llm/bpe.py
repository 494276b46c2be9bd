"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Compiling turns a rank file into a trie of the tokens' bytes and, for every token, the two tokens it was
merged from. Two neighbouring tokens can stand in an encoding exactly if no merge across their border comes
before the merges that finish both, which the border tokens of either side tell. The nondeterministic
transducer reads bytes, walks the trie from every possible token border and starts a new token where a
finished one fits its predecessor; only one border chain leads to any place. A state of the determinised
machine is the tree of borders that may still matter. As soon as all of them share a first token it is
emitted, so output lags input by at most the longest token that may still grow. States and transitions
are built when first needed, up to a bound; a piece that leaves the states built so far is finished by
following all borders at once, as the nondeterministic machine does.

Decoding feeds token bytes through a UTF-8 state machine whose transitions are compiled per token, so text
comes out as soon as its last byte is known, across any split of the ids.

Defined cases: a null text counts as empty and has no ids; decoding bytes that are not UTF-8 keeps the bytes
and replaces the broken sequences in the text; rows that repeat are encoded alike; extra columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatmod.llm.chunks import ChunkEncoder
from chatmod.llm.classes import tiktoken_pattern
from chatmod.llm.spans import at_task_end, frugal, ramp, utf8

MOST_STATES = 30_000        # determinised states a worker builds
MOST_FITS = 150_000         # judged token pairs a worker keeps
TABLE_ROWS = 1 << 19        # distinct chunks a worker remembers
MOST_PIECES = 1 << 17       # pieces a task remembers
SLICE_BYTES = 1 << 20       # of text encoded at a time
FEED = 1 << 16              # ids decoded at a time
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}                 # trie: node << 8 | byte to node
        self.token = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = rank
        self.parts: dict[int, tuple[int, int]] = {}     # token to the two it was merged from
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.fits: dict[int, bool] = {}
        # a state: borders in text order, each (border it comes from, token before it, trie node after it or -1)
        start = ((-1, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: dict[int, tuple[int, ...]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token`` (None: a single byte)."""
        text = self.bytes[token]
        if len(text) == 1:
            return None
        if token not in self.parts:
            parts = [text[i:i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank >= token:
                    raise ValueError(f"token {token} cannot be made by merges of lower rank")
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.parts[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return self.parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Tokens at one end of ``token`` while it is made, from its outer byte to itself, each with the rank of
        the merge that takes it up. side 0: the left end, 1: the right end."""
        key = token, side
        if key not in self.edges:
            out, until = [], NEVER
            at: int | None = token
            while at is not None:
                out.append((self.bytes[at], until))
                until, parts = at, self._split(at)
                at = None if parts is None else parts[side]
            self.edges[key] = out[::-1]
        return self.edges[key]

    def _fit(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens side by side (any right token fits the start, -1)."""
        if left < 0:
            return True
        key = left << 32 | right
        ok = self.fits.get(key)
        if ok is None:
            a, b = self._edge(left, 1), self._edge(right, 0)
            i = j = 0
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.ranks.get(x + y, NEVER)
                ok = not (rank < x_until and rank <= y_until and rank < NEVER)   # at equal rank the leftmost pair merges first
                if not ok or x_until == y_until == NEVER:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        borders = []
        new = None
        for i, (parent, token, node) in enumerate(self.states[state]):
            node = self.child.get(node << 8 | byte, -1) if node >= 0 else -1
            borders.append((parent, token, node))
            if node >= 0 and new is None:
                made = self.token[node]
                if made >= 0 and self._fit(token, made):
                    new = (i, made, 0)
        if new is None:
            raise ValueError(f"no token ends with byte {byte}")
        borders.append(new)
        wanted = [node >= 0 for _, _, node in borders]
        for i in range(len(borders) - 1, 0, -1):
            if wanted[i]:
                wanted[borders[i][0]] = True
        children = [0] * len(borders)
        for i in range(1, len(borders)):
            if wanted[i]:
                children[borders[i][0]] += 1
        root, emitted = 0, []
        while borders[root][2] < 0 and children[root] == 1:     # all that may still matter goes on with one token
            root = next(i for i in range(root + 1, len(borders)) if wanted[i] and borders[i][0] == root)
            emitted.append(borders[root][1])
        place = {root: 0}
        kept = [(-1, borders[root][1], borders[root][2])]
        for i in range(root + 1, len(borders)):
            if wanted[i] and borders[i][0] in place:
                place[i] = len(kept)
                kept.append((place[borders[i][0]], borders[i][1], borders[i][2]))
        key = tuple(kept)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        out = self.number[key], tuple(emitted)
        self.next[state << 8 | byte] = out
        return out

    def _end(self, state: int) -> tuple[int, ...]:
        borders, out = self.states[state], []
        i = len(borders) - 1
        while borders[i][0] >= 0:
            out.append(borders[i][1])
            i = borders[i][0]
        self.last[state] = tuple(out[::-1])
        return self.last[state]

    def _follow(self, state: int, rest: bytes) -> list[int]:
        """Tokens of what the state holds and ``rest``, following every border without building states."""
        child, token, fit = self.child, self.token, self._fit
        origin = [parent for parent, _, _ in self.states[state]]
        before = [t for _, t, _ in self.states[state]]
        live = [(i, node) for i, (_, _, node) in enumerate(self.states[state]) if node >= 0]
        for byte in rest:
            after = []
            made = -1
            for i, node in live:
                node = child.get(node << 8 | byte)
                if node is not None:
                    after.append((i, node))
                    if made < 0 and token[node] >= 0 and fit(before[i], token[node]):
                        made, source = token[node], i
            after.append((len(before), 0))
            origin.append(source)
            before.append(made)
            live = after
        out = []
        i = len(before) - 1
        while origin[i] >= 0:
            out.append(before[i])
            i = origin[i]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, known = 0, self.next
        for i, byte in enumerate(piece):
            step = known.get(state << 8 | byte)
            if step is None:
                if len(self.states) >= self.most_states:
                    return out + self._follow(state, piece[i:])
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        end = self.last.get(state)
        out += self._end(state) if end is None else end
        return out


# States of a UTF-8 reader. 0 is between characters, 1 to 3 want that many continuation bytes, the
# others want a first continuation byte in the named range. A byte that does not fit is read again in state 0
_RANGES = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1),
           6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
_LEADS = [(0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
          (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]


def _byte_steps() -> np.ndarray:
    step = np.zeros((8, 256), np.uint8)
    for a, b, to in _LEADS:
        step[:, a:b + 1] = to
    for state, (a, b, to) in _RANGES.items():
        step[state, a:b + 1] = to
    return step


class Decoder:
    """Ids to bytes and text. ``steps[id, state]``: the reader's state after all bytes of a token."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        texts = [tokens.get(i, b"") for i in range(size)]
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        step = _byte_steps()
        self.steps = np.tile(np.arange(8, dtype=np.uint8), (size, 1))
        length = np.diff(self.at)
        for k in range(int(length.max(initial=0))):
            rows = np.flatnonzero(length > k)
            self.steps[rows] = np.take_along_axis(step[:, self.data[self.at[rows] + k]].T, self.steps[rows].astype(np.int64), axis=1)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ramp(self.at[ids], self.at[ids + 1] - self.at[ids])]


class Utf8Stream:
    """Text of a stream of ids; an unfinished character waits for the next ids."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.held = decoder, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters known after these ids; broken bytes count as characters."""
        ids = np.asarray(ids, np.int64)
        steps = self.decoder.steps
        odd = np.flatnonzero(steps[ids, 0])          # tokens after which a reader that was between characters is not
        ready, state, i = 0, self.state, 0           # tokens before ``ready`` end between characters
        while i < len(ids):
            if state == 0:                           # on to the next such token
                k = int(np.searchsorted(odd, i))
                i = int(odd[k]) if k < len(odd) else len(ids)
                ready = i
                if i == len(ids):
                    break
            state = int(steps[ids[i], state])
            i += 1
            if state == 0:
                ready = i
        known, rest = (self.decoder.bytes(part).tobytes() for part in (ids[:ready], ids[ready:]))
        if ready:
            known, self.held = self.held + known, rest
        else:
            self.held += rest
        self.state = state
        return known

    def finish(self) -> bytes:
        """What is left: the bytes of an unfinished character."""
        out, self.held, self.state = self.held, b"", 0
        return out


_CHUNKS: dict[tuple[str, str], ChunkEncoder] = {}       # stays with a worker: some 60 bytes for each of TABLE_ROWS chunks


@lru_cache(maxsize=1)
def _machine(path: str) -> Transducer:
    return Transducer(read_ranks(path))


@lru_cache(maxsize=1)
def _pieces(path: str) -> dict[str, list[int]]:
    """Pieces encoded in this task: new chunks are mostly known pieces with other marks around them."""
    return {}


def _encoder(path: str, pattern: str) -> ChunkEncoder:
    if (path, pattern) not in _CHUNKS:
        pieces = regex.compile(pattern).findall

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            machine, known = _machine(path), _pieces(path)
            ids: list[int] = []
            ends = [0]
            for chunk in chunks:
                for piece in pieces(chunk.decode("utf-8")):
                    made = known.get(piece)
                    if made is None:
                        made = machine.encode(piece.encode("utf-8"))
                        if len(known) < MOST_PIECES:
                            known[piece] = made
                    ids += made
                ends.append(len(ids))
            return np.array(ids, np.uint32), np.diff(ends)

        _CHUNKS.clear()
        _CHUNKS[path, pattern] = ChunkEncoder(encode, TABLE_ROWS, SLICE_BYTES)
    return _CHUNKS[path, pattern]


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder({rank: token for token, rank in read_ranks(path).items()})


@at_task_end
def _forget() -> None:
    _machine.cache_clear()          # quickly built again, and large
    _pieces.cache_clear()
    _decoder.cache_clear()


def _encode(path: str, pattern: str, text: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for lo, hi, ids, at in encoder.texts(data, offsets):
                part = batch.slice(lo, hi - lo)
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(at)), ids], names=[*batch.schema.names, "n_tokens", "ids"])

    return encode


def _decode(path: str, text: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            raw = []
            for ids in batch.column("ids"):
                ids = np.frombuffer(ids.as_py() or b"", "<u4").astype(np.int64)
                stream = Utf8Stream(decoder)
                raw.append(b"".join([stream.feed(ids[a:a + FEED]) for a in range(0, len(ids), FEED)]) + stream.finish())
            columns, names = [*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"]
            if text:
                columns.append(pa.array([b.decode("utf-8", "replace") for b in raw], pa.string()))
                names.append("decoded_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return decode


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids (binary: little-endian unsigned 32-bit integers)."""
    pattern = tiktoken_pattern(pattern)         # letters and numbers as the library knows them
    rows = docs.drop("n_tokens", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(frugal(_encode(ranks_path, pattern, text_col)), schema)


def decode_ids(rows: DataFrame, ranks_path: str, text: bool = True) -> DataFrame:
    """``rows`` with decoded (the bytes of ``ids``) and, if wanted, decoded_text."""
    rows = rows.drop("decoded", *["decoded_text"] * text)
    return rows.mapInArrow(frugal(_decode(ranks_path, text)), _decoded_schema(rows.schema, text))


def _decoded_schema(schema: T.StructType, text: bool) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType()), *[T.StructField("decoded_text", T.StringType())] * text])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids and decoded: encoding and decoding in one pass through Python."""
    pattern = tiktoken_pattern(pattern)
    rows = docs.drop("n_tokens", "ids", "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    @frugal
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode(ranks_path, False)(_encode(ranks_path, pattern, text_col)(batches))

    return rows.mapInArrow(both, _decoded_schema(schema, False))
