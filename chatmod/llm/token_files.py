"""Token ids of a corpus in Huffman-coded files, in ascending id order, and reading them back.

1. Texts are tokenised (the tokenizers library) into a table of ids, the end id appended to each. Every task adds a row
   with how often it used each id.
2. These counts, summed over the whole corpus, fix one canonical code of at most ``LIMIT`` bits.
3. Each document becomes a bit string with a checkpoint (bits since the last one) every ``STRIDE`` ids. Documents are dealt
   to ranges of the id by percentiles, sorted, and joined to blocks of about ``BLOCK_IDS`` ids.

A set of files is a folder: ``code`` (id, length), ``blocks`` (one row per block: its range, its number
therein, documents, counts, checkpoints, bits) and ``parts`` (ids per range, for global positions). Blocks
are decoded independently, all their segments at once.

Defined cases: a null text counts as empty and has the end id only; rows that repeat are written as often as
they occur; null ids come first; an empty table makes empty files. Extra columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmod.llm.chunks import ChunkEncoder, joinable
from chatmod.llm.classes import tokenizers_pattern
from chatmod.llm.huffman import Code, code_lengths, pack, place
from chatmod.llm.spans import frugal, ramp, slices, utf8
from chatmod.session import shared_dir

LIMIT = 16              # bits of the longest code (at least the bits of the vocabulary's size)
STRIDE = 128            # ids between checkpoints
BLOCK_IDS = 1 << 18
SLICE_IDS = 1 << 19     # ids coded at a time
RANGES_PER_PARTITION = 4

# Fixed value: how the byte-level pre-tokenizer splits texts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"    # the same, ASCII texts
PIECES = 1000           # new pieces whose ids are made at a time
KNOWN_BYTES = 48 << 20  # of memory for the pieces a worker remembers; then it starts over
PIECE_BYTES = 200       # about what a piece takes beside its text and ids

_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def _alphabet(byte_level) -> np.ndarray:
    """The character by which the byte-level pre-tokenizer writes each byte, which none but it can tell; 0: bytes of no text."""
    out = np.zeros(256, "<u2")
    for last in [chr(c) for c in (*range(0x80), *range(0x80, 0x800, 0x40), *range(0x80, 0xC0), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000))
                 if not 0xD800 <= c <= 0xDFFF]:
        for byte, char in zip(last.encode("utf-8"), "".join(piece for piece, _ in byte_level.pre_tokenize_str(last))):
            out[byte] = ord(char)
    return out


def _tokenizer(path: str, added_tokens: bool = False, pattern: str = PATTERN) -> ChunkEncoder:
    """Encoder of a tokenizer file. Distinct chunks are split here and their new pieces passed on to its model,
    if the file's pre-tokenizer is the plain byte-level one; else each is a text of its own. With ``added_tokens`` the strings
    of the file's added tokens get their ids, as in the library by default: chunks that hold one are texts of their own."""
    if (path, added_tokens) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        setup = json.loads(tokenizer.to_str())
        marks = [t["content"].encode("utf-8") for t in setup["added_tokens"]] if added_tokens else []
        if added_tokens and any(t["rstrip"] or regex.search(r"\s", t["content"]) for t in setup["added_tokens"]):
            raise ValueError(f"{path}: an added token holds or takes white space, which may lie in two chunks")
        if not added_tokens:
            tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text

        def whole(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            made = [e.ids for e in tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)

        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if setup["normalizer"] is None and plain.items() <= (setup["pre_tokenizer"] or {}).items():
            split, split_ascii = regex.compile(pattern).findall, re.compile(ASCII).findall
            n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
            for token, i in tokenizer.get_vocab().items():
                n_bytes[i] = len(token)             # the byte-level alphabet has a character per byte
            alphabet = _alphabet(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
            merged = tokenizer.model.tokenize       # the ids of a piece written in the alphabet
            known: dict[str, bytes] = {}            # pieces and their ids: new chunks are mostly known pieces with other marks around them
            held = 0

            def learn(pieces: list[str]) -> None:
                nonlocal held
                if held > KNOWN_BYTES:
                    known.clear()
                    held = 0
                new = list(set(pieces).difference(known))
                for lo in range(0, len(new), PIECES):
                    part = new[lo:lo + PIECES]
                    text = [piece.encode("utf-8") for piece in part]
                    ends = list(accumulate(map(len, text)))
                    written = alphabet[np.frombuffer(b"".join(text), np.uint8)].tobytes().decode("utf-16-le")
                    ids = [[token.id for token in merged(written[a:b])] for a, b in zip([0, *ends], ends)]
                    raw = np.array([i for some in ids for i in some], np.uint32).tobytes()
                    at = list(accumulate((4 * len(some) for some in ids), initial=0))
                    known.update(zip(part, [raw[a:b] for a, b in pairwise(at)]))
                    held += PIECE_BYTES * len(part) + ends[-1] + len(raw)

            def in_pieces(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                size = np.array([len(c) for c in chunks])
                plain, wide = joinable(np.frombuffer(b"".join(chunks), np.uint8), size)
                groups = [np.flatnonzero(plain & ~wide), np.flatnonzero(plain & wide), np.flatnonzero(~plain)]
                ascii, other, odd = ([chunks[i] for i in group.tolist()] for group in groups)
                pieces = split_ascii(b"".join(ascii).decode("ascii"))
                pieces += split(b"".join(other).decode("utf-8"))
                pieces += [piece for chunk in odd for piece in split(chunk.decode("utf-8"))]
                learn(pieces)
                ids = np.frombuffer(b"".join([known[piece] for piece in pieces]), np.uint32)
                order = np.concatenate(groups)
                n = np.empty(len(chunks), np.int64)
                # tokens cover all bytes
                n[order] = part = np.diff(np.searchsorted(np.cumsum(n_bytes[ids]), np.cumsum(size[order])) + 1, prepend=0)
                first = np.empty(len(chunks), np.int64)
                first[order] = np.cumsum(part) - part
                return ids[ramp(first, n)], n

            def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                every = b"".join(chunks) if marks else b""
                marked = [i for i, c in enumerate(chunks) if any(m in c for m in marks)] if any(m in every for m in marks) else []
                if not marked:
                    return in_pieces(chunks)
                rest = sorted(set(range(len(chunks))) - set(marked))
                out: list = [None] * len(chunks)
                for at, how in ((marked, whole), (rest, in_pieces)):
                    if at:
                        ids, n = how([chunks[i] for i in at])
                        for i, part in zip(at, np.split(ids, np.cumsum(n)[:-1])):
                            out[i] = part
                return np.concatenate(out), np.array([len(part) for part in out])
        else:
            encode = whole

        _ENCODERS.clear()
        _ENCODERS[path, added_tokens] = ChunkEncoder(encode)
    return _ENCODERS[path, added_tokens]


def _tokenise(path: str, end_id: int, added_tokens: bool, pattern: str):
    @frugal
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(path, added_tokens, pattern)
        counts = np.zeros(0, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            data, offsets = utf8(batch.column("text"))
            for lo, hi, ids, at in encoder.texts(data, offsets):
                n = np.diff(at) + 1
                out = np.empty(len(ids) + hi - lo, "<u4")
                last = np.cumsum(n) - 1
                body = np.ones(len(out), bool)
                body[last] = False
                out[body], out[last] = ids, end_id
                one = np.bincount(out, minlength=len(counts))
                one[:len(counts)] += counts
                counts = one
                ends = np.concatenate([[0], 4 * (last + 1)])
                rows = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), rows, pa.nulls(hi - lo, pa.binary())],
                                                 names=["doc_id", "tie", "ids", "counts"])
        if kind is not None:            # a last row of the task: each id it used, and how often
            at = np.flatnonzero(counts)
            pairs = np.stack([at, counts[at]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())],
                                             names=["doc_id", "tie", "ids", "counts"])

    return tokenise


def _ids(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column of ids: rows lo to hi, their ids, and where each row's start."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, 4 * SLICE_IDS):
        yield lo, hi, data[offsets[lo]:offsets[hi]].view("<u4"), (offsets[lo:hi + 1] - offsets[lo]) // 4


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs in batch.column("counts"):
            at, n = np.frombuffer(pairs.as_py(), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_pydict({"id": pa.array(at), "n": pa.array(n)})


def _bits(lengths: np.ndarray, bounds: list):
    @frugal
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for lo, hi, ids, at in _ids(batch.column("ids")):
                rows = batch.slice(lo, hi - lo)
                doc = rows.column("doc_id")
                part = np.zeros(hi - lo, np.int32)
                known = np.flatnonzero(~np.asarray(doc.is_null()))
                if len(bounds) and len(known):
                    part[known] = np.searchsorted(np.array(bounds), doc.take(pa.array(known)).to_numpy(zero_copy_only=False), "left")
                # every document starts at a word of 64 bits
                length = code.lengths[ids]
                end = np.concatenate([[0], np.cumsum(length)])
                n_bits = np.diff(end[at])
                word = np.concatenate([[0], np.cumsum(-(-n_bits // 64))])
                n = np.diff(at)
                shift = np.repeat(64 * word[:-1] - end[at[:-1]], n)
                packed = place(code.codes[ids], length, end[:-1] + shift, int(word[-1]))
                segments = -(-n // STRIDE)
                mark = ramp(np.zeros(len(n), np.int64), segments) * STRIDE + np.repeat(at[:-1], segments)
                until = np.minimum(mark + STRIDE, np.repeat(at[1:], segments))
                marks = (end[until] - end[mark]).astype("<u2")
                mark_at = np.concatenate([[0], np.cumsum(segments)])
                binary = lambda ends, data: pa.Array.from_buffers(
                    pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), doc, rows.column("tie"), pa.array(n), pa.array(n_bits), binary(2 * mark_at, marks), binary(8 * word, packed)],
                    names=["part", "doc_id", "tie", "n_tokens", "n_bits", "marks", "bits"])

    return bits


def _join(strings: list[bytes], n_bits: np.ndarray) -> bytes:
    """Bit strings, each filled up to words of 64 bits, one right after the other."""
    words = -(-n_bits // 64)
    value = np.frombuffer(b"".join(strings), ">u8").astype(np.uint64)
    length = np.full(len(value), 64, np.int64)
    last = np.cumsum(words) - 1
    some = words > 0
    length[last[some]] = (n_bits - 64 * (words - 1))[some]
    value = value >> (64 - length).astype(np.uint64)
    return pack(value, length)[0]


_BLOCK_DDL = "part int, block int, start long, doc_ids array<{}>, n_tokens array<long>, n_bits long, marks binary, bits binary"


@frugal
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, doc_id) to blocks; ``start`` counts the ids of the part before the block."""
    part, number, start = None, 0, 0
    held: list[tuple] = []
    size = 0
    kind = None

    def block():
        nonlocal held, size, number, start
        n = np.array([h[1] for h in held], np.int64)
        bits = _join([h[4] for h in held], np.array([h[2] for h in held], np.int64))
        marks = b"".join(h[3] for h in held)
        out = pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()),
            "doc_ids": pa.array([[h[0] for h in held]], pa.list_(kind)), "n_tokens": pa.array([n.tolist()], pa.list_(pa.int64())),
            "n_bits": pa.array([sum(h[2] for h in held)], pa.int64()), "marks": pa.array([marks], pa.binary()),
            "bits": pa.array([bits], pa.binary())})
        start, number, held, size = start + size, number + 1, [], 0
        return out

    for batch in batches:
        kind = batch.column("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "n_bits", "marks", "bits")]
        for p, *row in zip(*columns):
            if p != part:
                if held:
                    yield block()
                part, number, start = p, 0, 0
            held.append(tuple(row))
            size += row[1]
            if size >= BLOCK_IDS:
                yield block()
    if held:
        yield block()


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0, added_tokens: bool = False) -> str:
    """Writes the files of ``docs`` and returns their folder (by default a new one in the shared folder). ``added_tokens``:
    whether the strings of the tokenizer's added tokens get their ids; else they are ordinary text."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, f"token-files-{uuid.uuid4().hex}")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    pattern = tokenizers_pattern(PATTERN)       # letters and numbers as the library knows them
    rows.mapInArrow(_tokenise(tokenizer, end_id, added_tokens, pattern), f"doc_id {kind}, tie long, ids binary, counts binary").write.option(
        "compression", "zstd").parquet(f"{path}/ids")
    made = spark.read.parquet(f"{path}/ids")
    ids = made.where("counts is null").drop("counts")

    counted = made.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id in use
    weights = np.zeros(max([r.id for r in counted], default=0) + 1, np.int64)
    for r in counted:
        weights[r.id] = r.n
    lengths = code_lengths(weights, max(LIMIT, (len(counted) - 1).bit_length()))
    code = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "id long, length int").coalesce(1).write.parquet(f"{path}/code")

    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)]).alias("b")).first().b or []
    bits = ids.mapInArrow(_bits(lengths, sorted(set(cuts))), f"part int, doc_id {kind}, tie long, n_tokens long, n_bits long, marks binary, bits binary")
    dealt = bits.repartition(ranges // RANGES_PER_PARTITION, "part").sortWithinPartitions("part", "doc_id", "tie")
    dealt.mapInArrow(_blocks, _BLOCK_DDL.format(kind)).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    totals.coalesce(1).write.parquet(f"{path}/parts")
    return path


def _read(lengths: np.ndarray, base: dict[int, int]):
    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                n = np.asarray(batch.column("n_tokens")[row].values, np.int64)
                segments = -(-n // STRIDE)
                last = np.cumsum(segments) - 1
                count = np.full(int(segments.sum()), STRIDE, np.int64)
                count[last] = n - STRIDE * (segments - 1)
                marks = np.frombuffer(batch.column("marks")[row].as_py(), "<u2").astype(np.int64)
                ids = code.decode(batch.column("bits")[row].as_py(), np.cumsum(marks) - marks, count)
                ends = np.concatenate([[0], np.cumsum(n)])
                start = base[batch.column("part")[row].as_py()] + batch.column("start")[row].as_py() + ends[:-1]
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, pa.array(start), pa.array(n), raw],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    return read


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ids as little-endian unsigned 32-bit integers."""
    code = spark.read.parquet(f"{path}/code").collect()                 # a row per id in use
    lengths = np.zeros(max([r.id for r in code], default=0) + 1, np.int64)
    for r in code:
        lengths[r.id] = r.length
    base, before = {}, 0
    for r in sorted(spark.read.parquet(f"{path}/parts").collect()):     # a row per range
        base[r.part], before = before, before + r.n
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_read(lengths, base), f"doc_id {kind}, start long, n_tokens long, ids binary")
