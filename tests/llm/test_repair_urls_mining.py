"""Conversation repair, URL filters and hard negatives against brute force and SQL, with nulls, ties, copies, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chatmod.llm import conversations, hard_negatives, queries, url_filters

# -- conversation repair ---------------------------------------------------------------------------------------------


def least_edits(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, digest) by a forward search over whole edit lists."""
    seen, fault = set(), []
    for row in rows:
        core = re.findall(r"[^\x20\x09-\x0D]", row[1])
        fault.append("blank" if not core else "duplicate" if row in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add(row)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = cost + 3, audit + "I", (*out, (role, ""))
                best[role[0]] = min(best.get(role[0], new), new)
        return best

    best = inserted({"": (0, "", ())})
    for row, kind in zip(rows, fault):
        after = {}
        for state, (cost, audit, out) in best.items():
            role = "assistant" if state == "u" else "user"
            options = [(state, cost + 4, "D", ())]
            if kind not in ("blank", "duplicate"):
                cost += 3 * (kind == "truncated")
                options.append((role[0], cost + 3, "R", ((role, row[1]),)))
                options += [(to, cost, "K", (row,)) for to in {role[0], "s" if state == "" else role[0]} if row[0][:1] == to]
            for to, c, e, r in options:
                new = c, audit + e, out + r
                after[to] = min(after.get(to, new), new)
        best = inserted(after)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return *[fault.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest


def repaired(table):
    """What op11 returns for rows (conv_id, turn, role, text)."""
    text = lambda v: " " if v is None else str(v)
    kept = defaultdict(list)
    for conv, turn, role, x in table:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", text(x)) if kind == 2 else text(x)
        kept[conv] += [(turn, "user" if kind == 4 else text(role), x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        turns = [r[0] for r in rows if r[0] is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *least_edits([r[1:] for r in rows])))
    return sorted(out, key=str)


def talks():
    rng = random.Random(3)
    texts = ["ok.", "no", "why? ", "", "  \n", "fine!", "good.\t", "x", None]
    table = []
    for conv in [*range(250), None]:
        for t in range(rng.randint(1, 12)):
            x = rng.choice(texts)
            table.append((conv, None if rng.random() < 0.05 else t + rng.randint(0, 1), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                          x if x is None or rng.random() < 0.3 else x + str(rng.randint(0, 3)) + rng.choice([".", ""])))
    # one conversation of a large part of all rows, one of equal texts, one of equal rows
    table += [(1000, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "ok."])) for t in range(900)]
    table += [(1001, t, "user", "same.") for t in range(200)] + [(1002, 5, "assistant", "again.")] * 200
    return table


TALKS = talks()


@pytest.mark.parametrize("segment, chunk", [(1 << 14, 32), (40, 4), (7, 3)])
def test_repairs_equal_brute_force(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(conversations.Chunks.__init__, "__defaults__", (chunk,))
    frame = spark.createDataFrame([(*r, "x", 1) for r in TALKS], "conv_id long, turn long, role string, text string, audit string, n int").repartition(5)
    rows, known = conversations.damage(frame)
    found = conversations.find_repairs(rows, segment=segment, **known)
    got = sorted([tuple(r) for r in conversations.repaired(rows, found, digests=True, **known).collect()], key=str)
    assert got == repaired(TALKS)


def test_repaired_rows_follow_the_grammar(spark):
    frame = spark.createDataFrame([("a", 1, "user", "hi."), ("a", 2, "user", "hi."), ("a", 3, "user", "hello."), ("b", 1, "system", ""), ("c", 1, "system", "s."),
                                   ("c", 2, "assistant", "no!")], "conv_id string, turn long, role string, text string")
    found = conversations.find_repairs(frame)
    rows = [tuple(r) for r in conversations.repaired(frame, found).orderBy("conv_id", "position").collect()]
    assert {r.conv_id: (r.cost, r.audit, r.duplicate, r.blank, r.illegal) for r in found.collect()} == {
        "a": (7, "KDR", 1, 0, 2), "b": (4, "D", 0, 1, 0), "c": (3, "KIK", 0, 0, 1)}
    assert rows == [("a", 0, "user", "hi."), ("a", 1, "assistant", "hello."), ("c", 0, "system", "s."), ("c", 1, "user", ""), ("c", 2, "assistant", "no!")]
    nothing = frame.limit(0)
    assert conversations.repaired(nothing, conversations.find_repairs(nothing), digests=True).collect() == []
    absent = conversations.find_repairs(frame.where("conv_id = 'b'"), absent=F.lit(True)).collect()
    assert [tuple(r) for r in absent] == [("b", 0, 0, 0, 0, 0, 0, "")]


def test_chunks_converge_to_one_long_search():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 400):
        role, late = rng.integers(0, 4, size).astype(np.uint8), 3 * rng.integers(0, 2, size).astype(np.int32)
        bounds, goal = np.array([0, size]), conversations.GOAL[None]
        whole = conversations.Chunks(role, late, bounds, goal, chunk=10_000)
        parts = conversations.Chunks(role, late, bounds, goal, chunk=3)
        assert whole.passes == 0 and (np.ptp(whole.left - parts.left, axis=1) == 0).all()
        for a, b in zip(whole.trace()[:2], parts.trace()[:2]):
            begin, _ = parts.chain(parts.trace()[2], np.array([0]))
            assert (a[0] == b[np.repeat(begin, parts.hi - parts.lo), np.arange(size)]).all()
        assert parts.passes <= 12        # of 134 chunks: costs of any two starts soon differ by a constant


# -- URL filters ------------------------------------------------------------------------------------------------------

URLS = ["http://www.example.com/en/1", "https://x.net/es/12/x?q=1", None, "", "nope", "HTTP://NET?x", "a://c.org/ads/1", "x://z.a-b.org/q.r/a", "x://com",
        "x://com/é", "x://y\nz.com/\n", "http://EXAMPLE.com/en/?a", "http://notexample.com/en/", "http://example.com/en", "http://a.www.example.com/en/x",
        "http://b.net/fr/", "http://b.net/FR/", "://net/es/", "http://x/y://net/es/"] + ["http://hot.example.com/en/" + "a" * 3000] * 40


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def fitting(url, rules):
    host, path = split(url)
    fits = []
    for h, p, action in rules:
        h, p = (h or "").lower(), p or ""
        glob = "".join(".*" if c == "*" else re.escape(c) for c in p)
        if action and (h == "" or host == h or host.endswith("." + h)) and re.match("(?s)" + glob, path):
            fits.append((len(h + p), [-ord(c) for c in h + p], action, h + p))
    best = max(fits, default=None)
    return (host, path, best and best[3], best[2] if best else "allow")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es*/x", "block"), (None, "/ads*", "block"), ("a-b.org", "/q.r/", "allow"),
         ("Net", "/es", "allow"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), ("net", "/fr/", "allow"), ("com", None, None)]


@pytest.mark.parametrize("rules", [RULES, queries.RULES, []])
@pytest.mark.parametrize("index_rows", [1, 1000])
def test_url_rules(spark, rules, index_rows):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)], "page_id long, url string, rule string, host string")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    got = url_filters.judge(pages.repartition(3), frame, index_rows=index_rows).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *fitting(u, rules)) for i, u in [*enumerate(URLS), (None, URLS[0])]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = url_filters.keep_allowed(pages, frame)
    assert kept.columns == pages.columns and kept.count() == sum(w[4] == "allow" for w in want)


def test_url_rules_are_filed_under_their_rarest_token(spark):
    rules = url_filters.compile_rules(spark.createDataFrame(RULES, "host string, path string, action string"))
    pages = spark.createDataFrame([("www.example.com//en/",), ("a.com//en/",), ("a.net//es/",)], "address string")
    index = {r.rule: r.token for r in url_filters.index_rules(rules, pages).collect()}
    assert index["com/"] == "com" and index["example.com/en/"] == "example" and index["/ads*"] == "" and index["net/es"] == "net"


# -- hard negatives ---------------------------------------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(420):
        v = [float(np.float32(x)) for x in rng.normal(0, 0.2, 12) + 0.25]
        rows.append((i, int(rng.integers(0, 3)), v))
    hot = rows[7][2]
    rows = [(i, y, hot if i % 3 == 0 and i > 200 else v) for i, y, v in rows]          # one vector of a large part of all rows
    rows += [(500, None, hot), (600, 1, None), (700, 1, [1.0, None]), (800, 1, [float("nan")]), (900, 1, [float("inf")]), (1000, 2, []), (None, 1, hot),
             (1100, 2, [0.5, 0.5]), (100, 1, hot), (7, 0, hot)]
    return rows


def mined(rows, positives=5, negatives=5):
    kept = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in kept:
        if i is None or i % 100:
            continue
        ranked = sorted([(-dot(v, w), j is None, j or 0, j, z) for j, z, w in kept], key=lambda r: r[:3])
        for s, _, _, j, _ in [r for r in ranked if r[4] == y and r[3] != i][:positives]:
            hard = [r for r in ranked if r[4] != y and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(i, j, k, r[3], -s, -r[0]) for k, r in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile_rows", [37, 4096])
def test_hard_negatives_equal_brute_force(spark, tile_rows):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, tile string, rank int").repartition(4)
    got = hard_negatives.mine(frame, F.col("id") % 100 == 0, tile_rows=tile_rows)
    assert sorted([tuple(r) for r in got.collect()], key=str) == mined(rows)
    assert hard_negatives.mine(frame.limit(0), F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(frame, F.lit(False)).collect() == []


def test_residues_give_exact_products():
    rng = np.random.default_rng(1)
    for high, depth, bound in ((300, 3000, 3000 * 300.0 ** 2), (1 << 28, 3, 3 * 2.0 ** 56), (1, 1, 1.0)):
        a, b = rng.integers(-high, high + 1, (40, depth)), rng.integers(-high, high + 1, (30, depth))
        primes = hard_negatives.moduli(bound)
        assert (hard_negatives.exact_products(a, b, primes) == a @ b.T).all()
    assert len(hard_negatives.moduli(65536.0)) == 3
    with pytest.raises(ValueError, match="inner products"):
        hard_negatives.moduli(2.0 ** 70)


def test_too_long_vectors_are_refused(spark):
    frame = spark.createDataFrame([(100, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="inner products"):
        hard_negatives.mine(frame, F.col("id") % 100 == 0)


# -- the registered queries -------------------------------------------------------------------------------------------

def test_registered_queries(spark, tmp_path):
    kept = [r for r in vectors()[:420]]
    pq.write_table(pa.table({"vec_id": [r[0] for r in kept], "label": pa.array([r[1] for r in kept], pa.int32()), "embedding": pa.array([r[2] for r in kept], pa.list_(pa.float32()))}),
                   tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"page_id": list(range(len(URLS))), "url": URLS, "html": URLS}), tmp_path / "pages.parquet")
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*TALKS))))), tmp_path / "conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == repaired(TALKS)
    con = duckdb.connect()
    for name, source in (("op12_url_filters", "pages"), ("op13_hard_negatives", "embeddings")):
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet'")
        want = con.execute(queries.SQL[name])
        columns = [d[0] for d in want.description]
        rows = queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted([tuple(r) for r in rows], key=str) == sorted(want.fetchall(), key=str)
