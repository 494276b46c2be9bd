"""Every training-data operator against brute force on small tables with nulls, ties, copies and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chatmod.llm import bpe, components, decontaminate, exact_dedup, huffman, language_id, pii, queries, sharding, simhash
from chatmod.llm import spans, substring_dedup, token_files, toxicity

SPACE = r"[^\x20\x09-\x0D]+"
DDL = "doc_id long, text string, score string, n_words string, k1 string, id string, lang string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    texts = [None, None, "", " \n\t ", "one", "two words", "A\x00b \x1c x y", "same " * 200, "é" * 5000, " ".join(words(6000))]
    texts += [" ".join(words(rng.randint(1, 90))) for _ in range(40)]
    texts += ["\n".join(words(20) + passage + words(rng.randint(0, 9))) for _ in range(6)]
    copy = " ".join(words(80))
    texts += [copy] * 30 + [copy.replace(" ", "\n\n", 3)] * 2 + [copy + " end", copy + " End", " " + copy]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), (None, "no id"), (3, texts[20]), (50, copy), (50, copy)]
    rng.shuffle(rows)
    return [(i, t, "x", "y", "z", "w", "en") for i, t in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_substring_dedup(spark, docs, empty):
    found = [(r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text, r.score) for r in substring_dedup.remove_repeated_windows(docs).collect()]
    lists = [re.findall(SPACE, t or "") for _, t, *_ in ROWS]
    times = Counter(tuple(w[i:i + 35]) for w in lists for i in range(len(w) - 34))
    want = []
    for (i, t, *_), w in zip(ROWS, lists):
        out = set()
        for k in range(len(w) - 34):
            if times[tuple(w[k:k + 35])] > 1:
                out.update(range(k, k + 35))
        want.append((i, t, len(w), len(out), " ".join(x for k, x in enumerate(w) if k not in out), "x"))
    assert Counter(found) == Counter(want)
    assert any(n for _, _, _, n, _, _ in want)
    assert substring_dedup.remove_repeated_windows(empty).collect() == []


def test_substring_dedup_with_frequent_runs(spark, docs, monkeypatch):
    plain = substring_dedup.remove_repeated_windows(docs).select("doc_id", "n_removed", "kept_text").collect()
    monkeypatch.setattr(substring_dedup, "frequent_cells", lambda *_: list(range(0, 1 << 16, 2)))
    assert Counter(substring_dedup.remove_repeated_windows(docs).select("doc_id", "n_removed", "kept_text").collect()) == Counter(plain)


def test_exact_dedup(spark, docs, empty):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[key(t)].append((-len(t or ""), i is None, i or 0, i))
    for size in (16, 1):        # one-byte identifiers collide and are drawn again
        rows = exact_dedup.exact_duplicates(docs, id_bytes=size).collect()
        want = Counter((i, min(groups[key(t)])[3], len(groups[key(t)]), hashlib.sha256(key(t).encode()).hexdigest()) for i, t, *_ in ROWS)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
        assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    assert Counter(key(r.text) for r in kept) == Counter(groups.keys())
    assert exact_dedup.exact_duplicates(empty).collect() == [] == exact_dedup.drop_duplicates(empty).collect()


def test_chunks_depend_on_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 200_000).astype(np.uint8)
    moved = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), data])
    a, b = (exact_dedup._cuts(x, np.array([0, len(x)]))[0] for x in (data, moved))
    assert all(y - x <= exact_dedup.MOST for x, y in zip([0, *a], a))
    assert len({x + 777 for x in a} & set(b)) > len(a) * 0.8


def test_decontaminate(spark, docs, empty):
    texts = [t for _, t, *_ in ROWS if t and len(t.split()) > 30]
    items = [(7, " ".join(texts[0].split()[5:30])), (7, " ".join(texts[0].split()[5:30])), (10, texts[1].split()[2]), (2, "Two  WORDS"), (3, None), (4, "!!"),
             (None, " ".join(texts[2].split()[:12]).upper()), (11, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a:a + k])].add("null" if i is None else str(i))
    want = []
    for i, t, *_ in ROWS:
        w, hit, found = cut(t), set(), set()
        for x, names in windows.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a:a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    found |= names
        want.append((i, t, len(w), len(hit), tuple(sorted(found))))
    for block in (1 << 20, 300):
        rows = decontaminate.find_benchmark(docs, bench, block_bytes=block).collect()
        assert Counter((r.doc_id, r.text, r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == Counter(want)
    assert all(r.clean_text == r.text for r in rows if not r.n_hit)
    assert all(len(cut(r.clean_text)) == r.n_words - r.n_hit for r in rows)
    assert decontaminate.remove_documents(docs, bench).count() == sum(not n for _, _, _, n, _ in want)
    assert decontaminate.remove_spans(docs, bench).count() == len(ROWS)
    assert decontaminate.remove_documents(empty, bench).collect() == []
    assert decontaminate.remove_documents(docs, bench.limit(0)).count() == len(ROWS)


def test_decontaminate_holds_one_block_at_a_time(spark, docs, monkeypatch):
    words = [t for _, t, *_ in ROWS if t and len(t.split()) > 30][0].split()
    bench = spark.createDataFrame([(i, " ".join(words[i:i + 12])) for i in range(12)] + [(i, f"no such item {i}") for i in range(12, 40)], "item_id long, text string")
    blocks, broadcast = [], spark.sparkContext.broadcast

    def watched(value):
        assert all(b.gone for b in blocks)
        block = broadcast(value)
        block.gone, destroy = False, block.destroy
        block.destroy = lambda *a: (destroy(*a), setattr(block, "gone", True))
        blocks.append(block)
        return block

    monkeypatch.setattr(spark.sparkContext, "broadcast", watched)
    many = decontaminate.find_benchmark(docs, bench, block_bytes=200)
    assert len(blocks) > 5 and all(b.gone for b in blocks)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.undo()
    one = decontaminate.find_benchmark(docs, bench)
    assert many.schema == one.schema
    assert Counter(map(str, many.collect())) == Counter(map(str, one.collect())) and one.where("size(items) > 1").count()


def fingerprint(text):
    w = re.findall(SPACE, lower(text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(values, radius):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_simhash(spark, docs, empty):
    fp = {t: fingerprint(t) for _, t, *_ in ROWS}
    root = roots(set(fp.values()), 2)
    least = {}
    for i, t, *_ in ROWS:
        least.setdefault(root[fp[t]], []).append((i is None, i or 0, i))
    want = Counter((i, fp[t], min(least[root[fp[t]]])[2]) for i, t, *_ in ROWS)
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == want
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len(least) and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(empty).collect() == [] == simhash.drop_near_duplicates(empty).collect()


@pytest.mark.parametrize("rows", [2048, 3])
def test_links_find_every_component(spark, rows):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = set(centres)
    for c in centres[:12]:
        for _ in range(40):         # chains and clusters
            c ^= 1 << rng.randrange(64)
            fps.add(c)
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    frame = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    found = components.connected_components(simhash.links(frame, 2, rows)).collect()
    got = defaultdict(set)
    for r in found:
        got[r.root].add(r.node % (1 << 64))
    want = defaultdict(set)
    for v, r in roots(fps, 2).items():
        want[r].add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_sharding(spark, docs, empty):
    rows = sharding.balanced_shards(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ROWS)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = defaultdict(set)
    for r in rows:
        shards[r.digest].add(r.shard)
    assert sum(len(x) for x in shards.values()) < len(ROWS) * 0.8       # most copies stay together
    assert sharding.balanced_shards(empty).collect() == []


def test_sharding_keeps_groups_together(spark):
    texts = [f"pair {i // 2}" for i in range(200)] + ["hot"] * 160 + [f"alone {i}" for i in range(120)]
    rows = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert set(Counter(r.shard for r in rows).values()) == {20}
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert len(shards["hot"]) <= 16 and sum(len(shards[f"pair {i}"]) > 1 for i in range(100)) <= 10


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    special = spark.createDataFrame([(999, "<|endoftext|> it's 'll  x\n\n y'reé 12a", *"xyzwv")], DDL)
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs.union(special), path)).collect()
    want = Counter()
    for i, t, *_ in [*ROWS, (999, "<|endoftext|> it's 'll  x\n\n y'reé 12a")]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(ids), ids.tobytes()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows) == want
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate([[0], np.cumsum([r.n_tokens for r in order])])[:-1].tolist()
    ids = [r.doc_id for r in order if r.doc_id is not None]
    assert ids == sorted(ids) and order[0].doc_id is None
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, path)).collect() == []


def test_token_files_count_ids_while_tokenising(spark, scratch):
    """Every task writes how often it used each id: counting takes no second pass over the ids."""
    rows = [(i, f"word word{i % 7}, {'é' * (i % 3)} {i}") for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"), f"{scratch}/files")
    table = spark.read.parquet(f"{folder}/ids")
    used, counted = Counter(), Counter()
    for r in table.collect():
        if r.counts is None:
            used.update(np.frombuffer(r.ids, "<u4").tolist())
        else:
            counted.update(dict(np.frombuffer(r.counts, "<i8").reshape(-1, 2).tolist()))
    assert used == counted and used[0] == 42
    assert table.where("counts is not null").count() <= 3


@pytest.mark.parametrize("memory", [0, token_files.KNOWN_BYTES])
def test_pieces_are_learned_once_whatever_surrounds_them(monkeypatch, memory):
    """Known pieces are not handed to the library again, and ids equal the library's on whole texts."""
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    asked = []
    real = Tokenizer.from_file(path)

    class Counting:
        def __init__(self):
            self.model = self

        def __getattr__(self, name):
            return getattr(real, name)

        def tokenize(self, piece):
            asked.append(piece)
            return real.model.tokenize(piece)

    monkeypatch.setattr(token_files, "_ENCODERS", {})
    monkeypatch.setattr(token_files, "KNOWN_BYTES", memory)
    monkeypatch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: Counting())}))
    encoder = token_files._tokenizer(path, True, token_files.tokenizers_pattern(token_files.PATTERN))
    odd = ["", " ", "a ", " a", "a\x1c b", "a \x1c", "\x1f\x1f  x", "a\u2003\u3000b c\u00a0", "it's  we'll\n\n d'été", "3½ ²x", "x\u0085y", "日本 語。", "a<|endoftext|>b",
           " b,", " b.", " (b", "b\t\tb\r\n", "\U0001f600 \U0001f600!", "'s 's's", "\u00e9t\u00e9 \u00c9T\u00c9", "0 00 0a"]
    for texts in (odd, odd[::-1], [t + " é " + u for t in odd for u in odd[::3]]):
        data, offsets = spans.utf8(token_files.pa.array(texts, token_files.pa.string()))
        got = [part.tolist() for _, _, ids, at in encoder.texts(data, offsets) for part in np.split(ids, at[1:-1])]
        assert got == [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]
    if memory:
        assert asked and len(asked) == len(set(asked))


def test_token_files_query_gives_added_tokens_their_ids(spark, scratch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "plain text", "a<|endoftext|><|endoftext|>  b \n <|endoftext|>", "<|endoftext|>", None, "é <|endoftext|", "it's  <|endoftext|>it's"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    rows = queries.op7_token_files(spark, scratch).collect()
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows)) == want and want[0][2] == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=2, max_size=300), st.integers(9, 16))
def test_huffman_round_trip(weights, limit):
    weights = np.array(weights) + 1
    lengths = huffman.code_lengths(weights, limit)
    assert lengths.max() <= limit and abs((2.0 ** -lengths).sum() - 1) < 1e-9
    code = huffman.Code(lengths)
    symbols = np.arange(len(weights)).repeat(3)[::-1]
    data, bits, offset = code.encode(symbols)
    assert bits == lengths[symbols].sum()
    assert (code.decode(data, offset[::7], np.minimum(7, len(symbols) - np.arange(0, len(symbols), 7))) == symbols).all()


def toxic_tables(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for x in rng.sample(["zorkbad", "quixevil", "vrontnasty"], 2):
                w.insert(rng.randrange(40), x if i % 8 else x[:2] + "x" + x[3:])       # half of them misspelled
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    extra = [(600, None), (601, ""), (None, "zorkbad quixevil"), (5, rows[5][1])]
    return spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity(spark, empty):
    docs, labels, truth = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    blank = [r.score for r in rows if not r.text]
    assert len(set(blank)) == 1 and blank[0] < 0.5
    changed = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs, changed) == model                 # held-out labels are not read
    assert toxicity.score(empty, toxicity.fit(empty.select("doc_id", "text"), labels.limit(0))).collect() == []


def test_toxicity_without_labels_of_both_classes_keeps_documents(spark, scratch):
    import corpus_pipeline

    docs, labels, _ = toxic_tables(spark)
    for name, some in (("none", labels.limit(0)), ("toxic", labels.where("toxic = 1")), ("clean", labels.where("toxic = 0")),
                       ("elsewhere", labels.withColumn("doc_id", toxicity.F.col("doc_id") + 100_000))):
        some.write.parquet(f"{scratch}/{name}/labels.parquet")
        with pytest.warns(UserWarning, match="no text will be called toxic"):
            kept = corpus_pipeline.drop_toxic(spark, docs, f"{scratch}/{name}").collect()
        assert Counter(kept) == Counter(docs.collect())


def test_toxicity_samples_labels_of_the_documents(spark):
    docs, labels, _ = toxic_tables(spark)
    others = spark.range(10_000, 60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    assert toxicity.fit(docs, labels.union(others), sample_rows=600) == toxicity.fit(docs, labels, sample_rows=600)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=9))
def test_lexicon_automaton_finds_what_edit_distance_finds(terms, word):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    machine = toxicity.LexiconAutomaton([(t, False, 1.0) for t in terms], edits=1, edit_length=4)
    near = [distance(t, word) for t in terms if distance(t, word) == 0 or len(t) >= 4]
    found = machine.find(word)
    assert (found is not None) == bool(near and min(near) <= 1)
    if found:
        assert found[1] == min(near) == distance(terms[found[0]], word)


def test_quoted_hits_count_less():
    machine = toxicity.LexiconAutomaton([("badword", False, 3.0)])
    data, offsets = spans.utf8(token_files.pa.array(['he said "you badword" to us', "you badword there", 'a "b" badword "c"']))
    x, _ = toxicity._features(machine, data, offsets)
    assert x[0, 0] < x[1, 0] == x[2, 0] and x[0, 4] == 1 and x[1, 4] == x[2, 4] == 0


def test_quotations_do_not_depend_on_the_row_before():
    machine = toxicity.LexiconAutomaton([("badword", False, 3.0)])
    texts = ['he said "badword"', 'badword he said "so badword" there', "", 'a "', "badword"]
    alone = [toxicity._features(machine, *spans.utf8(token_files.pa.array([t])))[0][0].tolist() for t in texts]
    assert [a[4] for a in alone] == [1, 0.5, 0, 0, 0]
    for order in ([0, 1, 2, 3, 4], [1, 0, 2, 3, 4], [3, 0, 4, 1, 2], [0, 0, 3, 2, 1]):
        x, _ = toxicity._features(machine, *spans.utf8(token_files.pa.array([texts[i] for i in order])))
        assert x.tolist() == [alone[i] for i in order]


def test_bpe(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(docs, path, P.PATTERN).collect()
    want = Counter((i, t, np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.text, bytes(r.ids)) for r in rows) == want
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4 for r in rows)
    again = bpe.decode_ids(bpe.encode_texts(docs, path, P.PATTERN), path).collect()
    assert all(r.decoded_text == (r.text or "") for r in again)
    assert bpe.round_trip(empty, path, P.PATTERN).collect() == []


def test_transducer_agrees_with_merging_and_decodes_any_split():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoder = bpe.Decoder({rank: token for token, rank in ranks.items()})
    tokens = list(ranks)
    for states in (bpe.MOST_STATES, 1):         # with and without built states
        machine, rng = bpe.Transducer(ranks, states), random.Random(1)
        for _ in range(1500):
            piece = rng.choice([b"".join(rng.choice(tokens) for _ in range(rng.randint(0, 4))), rng.randbytes(rng.randint(0, 9)),
                                rng.choice([b"a", b"ab", b" "]) * rng.randint(0, 40)])
            ids = machine.encode(piece)
            assert ids == (encoding._encode_single_piece(piece) if piece else [])
            stream = bpe.Utf8Stream(decoder)
            parts = [stream.feed(np.array([i])) for i in ids]
            assert b"".join(parts) + stream.finish() == piece
            with_text = "é€😀a".encode() * 2
            stream = bpe.Utf8Stream(decoder)
            for part in [stream.feed(np.array([i])) for i in machine.encode(with_text)]:
                part.decode("utf-8")            # only whole characters come out


def test_surrogates(spark, empty):
    x = ["Write to Ann.Lee22@Mail.example.org or ann.lee22@mail.example.org.", "Mrs Anna Smith met Mrs SMITH; 10.20.30.40, 10.20.30.41",
         "+1 (212) 555-0147 and +1 212 555 0147", 'key = "0123456789abcdef0123456789abcdef" 4111 1111 1111 1111', "госпожа Иванова", None, "", "plain text 42"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(x)] + [(0, x[0], "c"), (None, x[2], "c")], "doc_id long, text string, n_email string")
    rows = pii.replace_personal_data(docs, b"k").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[5].safe_text is None and by[6].safe_text == "" and by[7].safe_text == x[7]
    found = {i: [(k, m) for k, m, *_ in pii.find(r.safe_text or "")] for i, r in by.items()}
    for i, t in enumerate(x):
        before = [(k, m) for k, m, *_ in pii.find(t or "")]
        assert [k for k, _ in found[i]] == [k for k, _ in before]
        assert not {m.lower() for _, m in found[i]} & {m.lower() for _, m in before}
    assert len({m.lower() for _, m in found[0]}) == 1                       # one address, one surrogate
    assert len({m for k, m in found[1] if k == "ip"}) == 2
    names = [m for k, m in found[1] if k == "name"]
    assert names[0].split()[1].upper() == names[1]                          # the surname is shared
    assert len({re.sub(r"\D", "", m) for _, m in found[2]}) == 1 and found[2][0][1].startswith("+1 (")
    assert pii._luhn(re.sub(r"\D", "", dict(found[3])["card"])) == 0 and re.search("[А-я]", dict(found[4])["name"])
    assert Counter(r.safe_text for r in rows)[by[0].safe_text] == 2
    assert rows == pii.replace_personal_data(docs, b"k").collect() and by[0].safe_text != pii.replace_personal_data(docs, b"j").first().safe_text
    assert pii.replace_personal_data(empty, b"k").collect() == []


def test_names_phones_and_cards_in_every_form():
    found = lambda t: [(k, m, g) for k, m, g, _, _ in pii.find(t)]
    assert found("Mr John Smith came. Smith said he saw SMITH's smith; Smithson and Smith-led, John") == [
        ("name", "John Smith", "m"), ("name", "Smith", "m"), ("name", "SMITH", "m"), ("name", "Smith", "m"), ("name", "John", "m")]
    assert found("Dr Smith, Mrs Smith's house") == [("name", "Smith", "f"), ("name", "Smith", "f")]
    assert [g for *_, g in found("Mr Lee. Dr Lee. Mrs Lee. Lee")] == ["m", "m", "f", "f"]
    assert found("Mrs Smith-Jones; Smith-Jones, Smith") == [("name", "Smith-Jones", "f")] * 2
    assert found("Mr Smith came. He came. Came") == [("name", "Smith came", "m")]
    for phone in ("212-555-0147", "212.555.0147", "212 555-0147", "1-212-555-0147", "(212) 555-0147", "020 7946 0958", "0171/1234567", "01 42 68 53 00"):
        assert found(f"call {phone} 24 h") == [("phone", phone, "n")]
    assert not found("2024-01-15 10:30, 1.234.567, 100 200 300, id 4111111111111112 9807915762804490")
    card = "4111111111111111"
    for text in (card, f"7 {card} 3", f"12-{card}", f"9807915762804490 {card}", f"{card} 212", "1 4111 1111 1111 1111"):
        assert card in [re.sub(r"\D", "", m) for k, m, _ in found(text) if k == "card"], text
    assert found(f"{card} 212-555-0147") == [("card", card, "n"), ("phone", "212-555-0147", "n")]


def test_one_surrogate_per_entity(spark):
    x = ["Dr Smith", "Mr John Smith came. Smith said", "Prof Lee", "Mr Lee and Mrs Lee", "212-555-0147, +1 (212) 555-0147", "Dr Kim"]
    rows = pii.replace_personal_data(spark.createDataFrame(list(enumerate(x)), "doc_id long, text string"), b"k").collect()
    safe = {r.doc_id: r.safe_text for r in rows}
    smith = safe[0].split()[1]
    assert safe[1].split()[2] == smith == safe[1].split()[4] and smith.endswith("o") and "Smith" not in safe[1]
    assert safe[2].split()[1] not in safe[3].split()            # two people: the title tells neither
    plain, other = safe[4].split(", ")
    assert re.sub(r"\D", "", other) == "1" + re.sub(r"\D", "", plain) and len(plain) == 12 and "555-0147" not in safe[4]
    assert {r.doc_id: r.n_name for r in rows} == {0: 1, 1: 2, 2: 1, 3: 2, 4: 0, 5: 1}


def test_surrogate_collisions_are_drawn_again(spark, monkeypatch):
    true = pii.surrogate
    # first attempts of all addresses meet in one surrogate
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, c, attempt=0: "9.9.9.9" if kind == "ip" and attempt == 0 else true(key, kind, c, attempt))
    drawn = {}
    for attempt in range(2):
        drawn[attempt] = pii.surrogate(b"k", "ip", "1.2.3.4", attempt)
    assert drawn[0] == "9.9.9.9" != drawn[1]
    monkeypatch.undo()
    many = [(i, 0, "name:f:latin", f"aa{i}") for i in range(3000)]          # more names than short surrogates
    made = pii.surrogates(spark.createDataFrame(many, "k1 long, k2 long, kind string, canonical string"), b"k").collect()
    assert len(made) == 3000 == len({r.surrogate for r in made}) and max(r.attempt for r in made) > 0
    text = " ".join(f"Mrs Aa{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(600))
    row = pii.replace_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    names = [m for _, m, *_ in pii.find(row.safe_text)]
    assert len(names) == 600 == len(set(names))


def test_language_id(spark, empty):
    rng = random.Random(2)
    speak = {"de": ["der", "und", "schön", "nicht", "wir"], "fr": ["le", "et", "où", "pas", "nous"]}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(speak[l]) for _ in range(60)), l) for i in range(60) for l in [rng.choice("de fr".split())]],
                                 "doc_id long, text string, lang string")
    page = lambda l, d: f'<html lang="{d}"><script>x</script><p>{" ".join(rng.choice(speak[l]) for _ in range(30))}</p>'
    rows = [(i, f"http://h{l}.example.{l}/x", page(l, l)) for i in range(40) for l in ["de" if i % 2 else "fr"]]
    rows += [(100, "http://hde.example.de/", None), (101, None, ""), (102, "http://hde.example.de/", '<html lang="de"><p>1 2 3</p>'), (102, "bad url", page("fr", "fr"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = language_id.identify(pages, docs).collect()
    assert len(found) == len(rows)
    assert all(r.lang == ("de" if r.page_id % 2 else "fr") for r in found if r.page_id < 40)
    assert [r.lang for r in found if r.page_id == 100] == ["de"]            # host and suffix alone
    assert all(abs(sum(r.p) - 1) < 1e-6 for r in found)
    assert language_id.identify(pages.limit(0), docs).collect() == []
    assert language_id.identify(pages, docs.limit(0)).count() == len(rows)


def test_language_query_without_labelled_documents(spark, scratch):
    pages = [(1, "http://h.example.de/x", '<html lang="de"><p>x</p>'), (2, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{scratch}/pages.parquet")
    for name, rows in (("none", []), ("unlabelled", [(1, "some text", None)])):
        documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        normal = language_id.identify(spark.read.parquet(f"{scratch}/pages.parquet"), spark.createDataFrame([(1, "ein text", "de")], documents.schema))
        found = language_id.identify(spark.read.parquet(f"{scratch}/pages.parquet"), documents)
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in normal.schema]
        documents.write.parquet(f"{scratch}/{name}/documents.parquet")
        spark.read.parquet(f"{scratch}/pages.parquet").write.parquet(f"{scratch}/{name}/pages.parquet")
        out = sorted(map(tuple, queries.op2_language_id(spark, f"{scratch}/{name}").collect()))
        assert out == [(1, "h.example.de", "de", "de", None, None, None), (2, "", "", "", None, None, None)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab \n é\x1c'1!")), max_size=30), max_size=8))
def test_words_and_groups(texts):
    data, offsets = spans.utf8(token_files.pa.array(texts, token_files.pa.string()))
    words = spans.Words(data, offsets, ~spans.SPACES)
    lists = [re.findall(SPACE, t) for t in texts]
    assert np.diff(words.first).tolist() == [len(w) for w in lists]
    flat = [w.encode() for ws in lists for w in ws]
    i = np.arange(len(words))
    start, end = words.span(i, i + 1)
    assert [words.data[a:b].tobytes() for a, b in zip(start, end)] == flat
    group, first = words.group(start, end)
    assert len(first) == len(set(flat)) and all((group[a] == group[b]) == (flat[a] == flat[b]) for a in range(len(flat)) for b in range(len(flat)))


def test_groups_hold_when_hashes_collide(monkeypatch):
    data, offsets = spans.utf8(token_files.pa.array(["aa bb cc aa bb dd cc"]))
    words = spans.Words(data, offsets, ~spans.SPACES)
    monkeypatch.setattr(spans.Bytes, "hash", lambda self, a, b: np.zeros(len(a), spans.U64))
    i = np.arange(len(words))
    group, first = words.group(*words.span(i, i + 1))
    assert len(first) == 4 and group[0] == group[3] and group[1] == group[4] and group[2] == group[6]


# -- hostile texts and ids of other types -----------------------------------------------------------------------------

@pytest.mark.parametrize("part", ["<", "<!--", "<html ", "<script>", "<script></script ", "<html lang", "&", "--><!"])
def test_pages_are_read_in_one_pass(part):
    page = part * (1_000_000 // len(part))
    begin = time.process_time()
    language_id.visible_text(page), language_id.declared_language(page)
    assert time.process_time() - begin < 2


def test_scanners_equal_their_patterns():
    hidden = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
    declared = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")
    rng = random.Random(1)
    bits = ["<", "<!--", "-->", "<html ", "<HTML>", "lang=", "lang = 'de'", ' LANG="fr"', ">", "<script>", "</script >", "</ScRipt\n>", "<style", "</style>",
            "<noscript a>", "x", "é ", "slang=en", "<htmlx lang=es>", "\n", " ", "--", "!", " lang"]
    for _ in range(5000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert language_id.visible_text(page) == re.sub(r"<[^>]*>", " ", hidden.sub(" ", page))
        found = declared.search(page)
        assert language_id.declared_language(page) == (found[1].lower()[:2] if found else "")


@pytest.mark.parametrize("part", ["A-", "1 ", "Mr ", "9", "a@", "a.", "Ab ", "+1 "])
def test_personal_data_is_found_in_one_pass(part):
    text = "Mr " + part * (200_000 // len(part))
    begin = time.process_time()
    pii.find(text)
    assert time.process_time() - begin < 20


def test_ids_may_be_text(spark):
    copy = "one two three four five six"
    docs = spark.createDataFrame([("b", copy), ("a", copy.replace(" ", "  ")), ("x1", "other words here"), (None, None)], "doc_id string, text string")
    exact = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert exact["b"] == ("a", False) and exact["a"] == ("a", True) and exact["x1"] == ("x1", True)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near["a"] == near["b"] == "a" and near["x1"] == "x1"
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs).collect()) == ["None", "a", "x1"]
    assert substring_dedup.remove_repeated_windows(docs).count() == 4
    assert pii.replace_personal_data(docs, b"key").count() == 4
