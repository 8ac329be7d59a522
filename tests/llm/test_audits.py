"""Source divergence, Merkle manifest and exact groups: oracles, plain versions, properties and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import divergence, exact_dup, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white texts, copies of a whole row, one long text, and extra columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Word", "en", None, 4), (4, "Word", "en", None, 4), (4, "word", "en", None, 4),
        (5, "x Y z " * 300_000, "de", "b", 1_800_000), (None, "no id here", "fr", "b", 10), (None, "No id here", "fr", "", 10), (6, "ÅÄÖ é ß 漢字", "sv", "c", 10), (-7, "word", "en", "", 4), (2**62, "WORD", "en", "a", 4),
    ] + [(100 + i, f"shared common words {'left' if i % 2 else 'Right right'} é", "en", "ab"[i % 2], i) for i in range(24)]
    df = spark.createDataFrame(rows, DOCS)
    names = "rank n tree block node leaf now root path part item value term kind side left right other terms rep row digest top top_row kept keep_id _tie _at".split()
    return df.withColumns({c: F.lit("clash") for c in names})


def against(df, sql):
    """The oracle's rows over a Spark table."""
    c = duckdb.connect()
    documents = df.select("doc_id", "text", "lang", "source", "n_chars").toArrow()  # noqa: F841  the SQL reads it
    c.execute("CREATE TABLE documents AS SELECT * FROM documents")
    return c.execute(sql).df()


@pytest.mark.parametrize("f,sql", [(divergence.audit, divergence.OP11_SQL), (lambda d: merkle.manifest(d, F.when(merkle.fold("doc_id", 5) == 0, F.translate("text", merkle.UPPER, merkle.SMALL)).otherwise(F.col("text"))), merkle.OP12_SQL), (exact_dup.exact_groups, exact_dup.OP13_SQL)])
def test_odd_rows_match_the_oracle(odd, f, sql):
    oracle.same(f(odd).toPandas(), against(odd, sql))


@pytest.mark.parametrize("f", [divergence.audit, merkle.manifest, exact_dup.exact_groups])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0


# --- 11 -------------------------------------------------------------------------------------------


def brute_audit(rows):
    docs = Counter()
    counts = {}
    for lang, source, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        counts.setdefault((lang, source), Counter()).update(words)
        docs.update({(lang, w) for w in words})
    out = set()
    for lang in {k[0] for k in counts}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= 10)
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        far = lambda p, q: {w: (p[w] - q[w]) ** 2 // (p[w] + q[w]) for w in p}
        mine = {s: c for (g, s), c in counts.items() if g == lang}
        q = share(sum(mine.values(), Counter()))
        p = {s: share(c) for s, c in mine.items()}
        for a in mine:
            pairs = sorted(((-sum(far(p[a], p[b]).values()), b.encode()) for b in mine if b != a))
            f = far(p[a], q)
            terms = sorted((-f[w], w.encode()) for w in kept if mine[a][w] > 0 and p[a][w] > q[w])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, a, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_in_many_tiles(spark, monkeypatch, seed):
    """Blocks of few terms and of few sources, and counts passed on early, give what one matrix gives."""
    rng = random.Random(seed)
    words = [f"w{'é' * (i % 3)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(f"l{i % 2}", f"s{rng.randrange(9)}", " ".join(rng.choices(words[: 60 - 20 * (i % 2)], k=rng.randrange(0, 15)))) for i in range(400)]
    df = spark.createDataFrame([(i, t, g, s, 0) for i, (g, s, t) in enumerate(rows)], DOCS).repartition(3)
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "GROUPS", 2)
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df).collect()}
    assert got == brute_audit(rows)


def test_shares_are_exact_at_any_count():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 10**12, (3, 50))
    totals = counts.sum(axis=1) + rng.integers(0, 10**14, 3)
    want = [[1 + 10**9 * (int(c) + 2) // (int(t) + 2 * 50) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert divergence.shares(counts, totals, 50).tolist() == want
    assert divergence.shares(np.array([[7]]), np.array([7]), 1).tolist() == [[1 + 10**9]]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = b"short and averyveryverylongterm then some  more"
    assert [w for piece in divergence._pieces(text) for w in piece] == text.split()


# --- 12 -------------------------------------------------------------------------------------------


def brute_tree(leaves):
    """Root and each leaf's siblings by building all levels."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([merkle.joined(*below[i : i + 16]) for i in range(0, len(below), 16)])
    out = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            path += ["".join(run[: i % 16]), "".join(run[i % 16 + 1 :])]
            i //= 16
        out.append(path)
    return levels[-1][0], out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096])
def test_traversal_gives_every_path(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    height = merkle.depth(n)
    root, want = brute_tree(leaves)
    got = list(merkle.paths(leaves, height))
    assert got == want and merkle.top_node(leaves, height) == root
    assert all(merkle.folded(leaf, path) == root for leaf, path in zip(leaves, got, strict=True))


def test_treehash_holds_few_nodes():
    t = merkle.Treehash(3)
    for i in range(4095):
        t.feed(str(i))
        assert all(len(level) < 16 for level in t.open)
    assert not t.done
    t.feed("4095")
    assert len(t.done) == 1 and not any(t.open)


def test_manifest_over_several_tiers(spark):
    """Trees of more than one block of blocks, over many partitions, with more sources than a block has nodes."""
    rows = [(i * 3 % 901, f"Text {i}", "en", None if i % 3 == 0 else f"s{i % 40:02}" if i % 5 == 0 else "hot", i) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = {r["doc_id"]: r for r in merkle.manifest(df, F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.col("text")), tier=1).collect()}
    told = lambda *fields: merkle.joined(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
    by_source = {}
    for doc, text, lang, source, n in sorted(rows):
        by_source.setdefault(source, []).append((doc, told(doc, source, lang, n, text), told(doc, source, lang, n, "other")))
    order = sorted(by_source, key=lambda s: (s is not None, s or ""))
    trees = {s: brute_tree([x[1] for x in by_source[s]]) for s in order}
    root, above = brute_tree([trees[s][0] for s in order])
    assert len(got) == 900
    for s, up in zip(order, above, strict=True):
        for (doc, leaf, changed), path in zip(by_source[s], trees[s][1], strict=True):
            r = got[doc]
            assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, trees[s][0], root, merkle.joined(*path, *up))
            now = changed if doc % 7 == 0 else leaf
            assert r["folded_root"] == merkle.folded(now, path + up) and r["verified"] == (doc % 7 != 0)


def test_tampering_is_where_five_divides_the_checksum(spark, data):
    r = merkle.op12_merkle_manifest(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(x["verified"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 != 0 or not any("A" <= c <= "Z" for c in x["text"])) for x in r)


# --- 13 -------------------------------------------------------------------------------------------


def test_index_against_a_set():
    """Insertions, deletions and look-ups in random order, with resizing and with digests that many texts share."""
    for width in (1, 2, 32):
        rng, index, held = random.Random(width), exact_dup.CuckooIndex(2), set()
        digest = exact_dup._digest(width)
        for _ in range(6000):
            text = f"text {rng.randrange(900)}".encode()
            found = index.find(digest(text), text)
            assert (found >= 0) == (text in held)
            if rng.random() < 0.6 and found < 0:
                index.insert(digest(text), text)
                held.add(text)
            elif rng.random() < 0.5:
                assert index.delete(digest(text), text) == (text in held)
                held.discard(text)
        assert {index.texts[e] for e in index.live()} == held and index.bytes == sum(map(len, held))
        assert index.resizes > 0


@pytest.mark.parametrize("width,held", [(32, 1 << 20), (1, 300)])
def test_groups_do_not_rest_on_digests(spark, width, held):
    """Digests of one byte, which different texts share, and indexes that pass on what they hold after a few texts."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["Hot Text", "hot text", f"text {rng.randrange(300)}", f"TEXT {rng.randrange(300)}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dup.exact_groups(df, width=width, held=held).collect()} == want


def test_live_index_over_batches(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, text string")
    state = lambda live: {(r["doc_id"], bytes(r["text"])) for r in live.collect()}
    one = exact_dup.update_index(None, docs((1, "A"), (2, "a"), (3, "b"), (4, None)))
    assert state(one) == {(2, b"a"), (3, b"b"), (4, b"")}
    two = exact_dup.update_index(one, docs((5, "B"), (6, "c"), (0, "a")), withdrawn=docs((4, ""), (1, "a"), (9, "zz")))
    assert state(two) == {(2, b"a"), (5, b"b"), (6, b"c")}
    three = exact_dup.update_index(two, docs((7, "A")), withdrawn=docs((2, "a"), (5, "b")))
    assert state(three) == {(7, b"a"), (6, b"c")}
