"""Piece borders on every code point are those of the tokenizer libraries."""

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatmod.llm import bpe, classes, token_files


def texts():
    """Every code point with letters, digits and marks beside it, 300 to a text."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    known = [c for c in codes if regex.match(r"[^\p{Cn}\p{Co}]", chr(c))]
    codes = known + [c for c in codes if c % 97 == 0]
    out = [" ".join(f"a{chr(c)}b1{chr(c)}!{chr(c)}" for c in codes[i:i + 300]) for i in range(0, len(codes), 300)]
    return out + ["\U0001DF36桲", "\U000190F0눖"]


def test_patterns_differ_only_where_the_library_does():
    assert classes.as_in_library(r"\p{L}+|x", lambda name, text: set(regex.findall(name, text))) == r"\p{L}+|x"
    fewer = classes.as_in_library(r"[^\s\p{L}]+|\p{L}+", lambda name, text: set(regex.findall(name, text)) - {"é", "ü"})
    assert regex.findall(fewer, "aé über") == ["a", "é", "ü", "ber"]
    more = classes.as_in_library(r"\p{N}+", lambda name, text: set(regex.findall(name, text)) | {"x"})
    assert regex.findall(more, "1x2 y") == ["1x2"]


def test_ids_equal_the_libraries_on_every_code_point(spark, tmp_path):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode_texts(docs, path, P.PATTERN).select("doc_id", "ids").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(rows[r.doc_id][1]), r.doc_id
    tokenizer = P.path("byte_bpe_50k.json")
    folder = token_files.write_token_files(docs, tokenizer, str(tmp_path / "files"), added_tokens=True)
    plain = Tokenizer.from_file(tokenizer)
    for r in token_files.read_token_files(spark, folder).select("doc_id", F.col("ids")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist()[:-1] == plain.encode(rows[r.doc_id][1], add_special_tokens=False).ids, r.doc_id
