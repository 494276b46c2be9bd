"""The registered training-data queries and the pipeline as a whole, over a small planted folder, against SQL or plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as E
import corpus_pipeline
from chatmod.llm import bpe, pii, queries, toxicity
from chatmod.llm.frames import table
from test_operators import fingerprint, lower, roots

TOXIC = ["zorkbad", "quixevil", "vrontnasty"]


def planted():
    """(documents, labels, benchmark): toxic texts, copies but for white space, near copies, leaked passages, personal data."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, toxic = [], []
    for i in range(400):
        w = words(40)
        toxic.append(int(i % 4 == 0))
        for x in TOXIC * toxic[-1]:
            w.insert(rng.randrange(len(w)), x)
        texts.append(" ".join(w))
    long = [words(400) for _ in range(3)]
    passage = words(14)
    more = [texts[1].replace(" ", "  ", 3), texts[1], texts[2] + "\n", *[" ".join([*w[:k], "other", *w[k + 1:]]) for w in long for k in (7, 200, 390)],
            *[" ".join(words(9) + passage + words(9)) for _ in range(4)], "Passage: " + " ".join(passage[:9]).upper(),
            "Mr John Smith (ann.lee@mail.example.org) said: +1 (212) 555-0147. Smith left.", "Dr Smith: 10.20.30.40, é", "", None]
    texts += more
    toxic += [0] * len(more)
    documents = list(enumerate(texts))
    rng.shuffle(documents)
    return documents, list(enumerate(toxic)), [(3, " ".join(passage)), (4, "not there"), (5, None)]


DOCUMENTS, LABELS, BENCHMARK = planted()
TEXT = dict(DOCUMENTS)
PAGES = list(enumerate([None, "", "no address", "http://Example.COM/en/a?x=1", "https://www.example.com/en/b#c", "http://a.example.com/en/", "http://example.com/de/",
                        "ftp://x.net/es/1", "ftp://x.net/es", "http://net/fr/?q", "http://notnet/fr/", "http://www.example.com", "http://a.org/en/", "http://x.net/es/1"]))


def vectors():
    """Rows of eight components around ten centres; some labels, vectors and components are null or not finite."""
    rng = random.Random(8)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(10)]
    rows = [[i, i % 10, [x + rng.uniform(-0.7, 0.7) for x in centres[i % 10]]] for i in range(420)]
    rows[11][1], rows[12][2], rows[13][2][3], rows[15][2][0], rows[16][2][7] = None, None, None, float("nan"), float("inf")
    return [tuple(r) for r in rows]


EMBEDDINGS = vectors()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(EMBEDDINGS, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def encoding():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    found = E.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(want.fetchall())


def test_simhash_query(spark, folder):
    fp = {i: fingerprint(t) for i, t in DOCUMENTS}
    root = roots(set(fp.values()), 2)
    least = {}
    for i in sorted(fp):
        least.setdefault(root[fp[i]], i)
    assert sorted(map(tuple, queries.op5_simhash(spark, folder).collect())) == [(i, f"{fp[i]:016x}", least[root[fp[i]]]) for i in sorted(fp)]


def test_toxicity_query(spark, folder):
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, folder).collect()}
    assert {i: (r.held_out, r.predicted) for i, r in rows.items()} == {i: (zlib.crc32(str(i).encode()) % 5 == 0, t) for i, t in LABELS}
    assert {i: r.n_hits for i, r in rows.items() if r.predicted} == {i: 3 for i, t in LABELS if t}
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    assert {r.doc_id: r.score for r in toxicity.score(docs, model).collect()} == {i: r.score for i, r in rows.items()}


def test_byte_bpe_query(spark, folder):
    code = encoding()
    want = []
    for i, t in sorted(DOCUMENTS):
        ids = np.array(code.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, queries.op9_byte_bpe(spark, folder).collect())) == want


def test_surrogates_query(spark, folder):
    rows = {r.doc_id: r for r in queries.op10_surrogates(spark, folder).collect()}
    assert sorted(rows) == sorted(TEXT)
    for i, t in DOCUMENTS:
        safe, n = t, Counter()
        for kind, mention, gender, start, end in reversed(pii.find(t or "")):
            gender = "m" if kind == "name" else gender      # Smith is known as Mr
            made = [pii.surrogate(queries.SURROGATE_KEY, k, c) for k, c in pii.entities(kind, mention, gender)]
            safe = safe[:start] + pii.render(kind, mention, made) + safe[end:]
            n[kind] += 1
        assert (rows[i].text, rows[i].n_entities, *[rows[i][f"n_{k}"] for k in pii.KINDS]) == (safe, sum(n.values()), *[n[k] for k in pii.KINDS])
    assert sum(r.n_name for r in rows.values()) == 3


def test_shards_query(spark, folder):
    rows = queries.op6_balanced_shards(spark, folder).collect()
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32((t or "").encode()) for i, t in DOCUMENTS}
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(DOCUMENTS) and sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in sizes.items())


def test_pipeline_against_plain_python(spark, folder):
    kept = {i: t for i, t in DOCUMENTS if not dict(LABELS)[i]}
    sizes = [len(kept)]
    groups = {}
    for i, t in sorted(kept.items()):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    sizes.append(len(kept))
    root = roots({fingerprint(t) for t in kept.values()}, 2)
    least = {}
    for i in sorted(kept):
        least.setdefault(root[fingerprint(kept[i])], i)
    kept = {i: kept[i] for i in least.values()}
    sizes.append(len(kept))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {tuple(w[a:a + 10]) for _, t in BENCHMARK for w in [cut(t)] for a in range(max(1, len(w) - 9)) if w}
    holds = lambda w: any(tuple(w[a:a + len(x)]) == x for x in windows for a in range(len(w) - len(x) + 1))
    kept = {i: t for i, t in kept.items() if not holds(cut(t))}
    sizes.append(len(kept))
    assert sizes == sorted(set(sizes), reverse=True) and len(kept) > 250         # every stage drops some
    code = encoding()
    want = Counter()
    for i, t in kept.items():
        ids = np.array(code.encode_ordinary(t or ""), "<u4")
        want[i, t, len(ids), ids.tobytes(), sha((t or "").encode())] += 1
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded_sha256"]
    assert Counter((r.doc_id, r.text, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in out.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and E.queries()["pipeline"] is corpus_pipeline.run
