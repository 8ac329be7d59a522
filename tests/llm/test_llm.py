"""The training-data operators against brute force, planted cases and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import decontaminate, embedding_dup, html_extract, langid, linear, mixing, near_dup, quality, registry, suffix_dup, token_shards, toxicity
from cohortlens.llm import kernels as K
from cohortlens.llm.common import Workspace, components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, one long text, and extra columns with clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "word", "en", None), (4, "word", "en", None), (5, "x y z " * 40000, "de", "b"), (None, "no id here at all", "fr", "b"), (6, "ÅÄÖ é ß 漢字", "sv", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({"score": F.lit(1), "spans": F.lit("x"), "size": F.lit(2), "n": F.lit(3), "n_chars": F.length("text").cast("bigint"), "component_id": F.lit(0), "label": F.lit(1)})


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, data, name):
    oracle.same(registry.QUERIES[name](spark, data).toPandas(), oracle.run(registry.ORACLES[name], data))


# --- kernels and components -----------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    a = pa.array(["one two one", None, "", "two one"])
    for _, _, raw, at, _ in K.chunks(a):
        s, e, first = K.word_spans(raw, at, K.NOT_SPACE)
        h = K.span_hash(K.prefix_hash(raw), s, e)
        assert first.tolist() == [0, 3, 3, 3, 5] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a bigint, b bigint")
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "t"), df).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components(Workspace(spark, "t"), df.limit(0)).count() == 0


# --- 1 --------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark, data):
    r = langid.op1_ppm_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert r.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_code_lengths_are_exact(spark):
    """The table's lengths equal a plain walk over escape probabilities."""
    texts = ["abracadabra abra", "banana bandana"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    grams: dict[bytes, int] = {}
    for t in texts:
        b = t.encode()
        for o in range(3):
            for i in range(o, len(b)):
                grams[b[i - o : i + 1]] = grams.get(b[i - o : i + 1], 0) + 1
    grams = {g: n for g, n in grams.items() if n > 1 or len(g) < 3}
    model = langid.train(df, order=2)

    def bits(ctx: bytes, s: int) -> float:
        out = 0.0
        while True:
            seen = {g[-1]: n for g, n in grams.items() if g[:-1] == ctx}
            n, q = sum(seen.values()), len(seen)
            if s in seen:
                return out + np.log2((n + q) / seen[s])
            if q:
                out += np.log2((n + q) / q)
            if not ctx:
                return out + 8
            ctx = ctx[1:]

    for t in ["abra banana", "zebra!", "a"]:
        b = t.encode()
        want = sum(bits(b[max(0, i - 2) : i], b[i]) for i in range(len(b)))
        assert model.lengths(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0, 0] == pytest.approx(want, rel=1e-5)


def test_language_edges(spark, odd):
    model = langid.train(odd.filter("lang <> 'sv'"))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[6]["lang_pred"] != "und"
    assert langid.train(odd.limit(0)) is None
    assert langid.identify(odd, None).filter("lang_pred <> 'und'").count() == 0


# --- 2 --------------------------------------------------------------------------------------------


def test_labelled_pages_come_back():
    for page in html_extract.PAGES:
        begin, end = page.index("[["), page.index("]]")
        got = html_extract.main_text(page.replace("[[", "").replace("]]", ""))
        want = re.sub(r"<[^>]*>", " ", page[begin + 2 : end])
        assert re.findall(r"\w+", got) == re.findall(r"\w+", want)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<nav><a>Home</a></nav>", ""),
        ("<p>a&amp;b &lt;c&gt;<br>next</p><p> two\n lines </p>", "a&b <c> next\n\ntwo lines"),
        ("<article><p>one</p><aside>x</aside><p>two</p></article><div class='comments'><p>spam spam spam</p></div>", "one\n\ntwo"),
        ("<script>var t='</p>';</script><p>kept words here</p><style>p{}</style>", "kept words here"),
        ("<p>broken <b>bold <p>next para", "broken bold\n\nnext para"),
        ("<nav>" + "<div>" * 5 + "<ul>" + "<b>" * 70 + "</ul></nav><p>the article body text</p>", "the article body text"),
        ("<nav><dl>" + "<dt>a<dd>b" * 80 + "</dl></nav><p>the article body text</p>", "the article body text"),
        ("<SCRIPT>var a=1;</SCRIPT><p>hello world body</p>\u0130", "hello world body\n\n\u0130"),
        ("<div class='content reply-box'><p>the article body text</p></div>", "the article body text"),
        ("<p>the article body text</p><div class='no-print nav'>Home News Sport</div>", "the article body text"),
        ("<table><tr><td>one<td>two<tr><td>three</table>", "one\n\ntwo\n\nthree"),
        ("<div class=cookie-notice>We use cookies</div><main><h1>T</h1><p>body of text</p></main>", "T\n\nbody of text"),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


WRAPPERS = [
    'class="entry-content share-enabled"', 'class="article-search"', 'class="social-post"', 'class="login-story-body"', 'class="notice-article"', 'class="post-body comment-open"', 'class="td-post-content ad-wrapper"',
    'class="entry-header-wrap"', 'class="article-body promo"', 'class="news-alert-body"', 'class="widget-content"', 'class="search-result-article"', 'class="sponsored-article"', 'id="comment-policy"', 'class="plain"',
]


@pytest.mark.parametrize("in_form", [False, True])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_articles_in_wrappers_with_marks(wrapper, in_form):
    blocks = ["Seven bridges", *(f"Bridge number {i} was built of stone in the year {1700 + i} and still stands, though carts may no longer cross it." for i in range(1, 7))]
    article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    around = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy two get one free</div>", "<div class='share-bar'>Share this page</div><div class='comments'><div class='comment-body'><p>" + "I walked over all of them last year. " * 5 + "</p></div></div><footer>Bridge Post</footer>"
    body = f"{around[0]}<div {wrapper}>{article}</div>{around[1]}"
    page = f"<html><body>{f'<form action=x>{body}</form>' if in_form else body}</body></html>"
    assert html_extract.main_text(page) == "\n\n".join(blocks)


def test_extract_gives_each_row_its_own_text(spark):
    rows = [(1, "u", "<p>one two</p>"), (1, "u", "<p>one two</p>"), (2, None, None), (3, "v", ""), (None, "w", "<p>caf&eacute; " + "long " * 50000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", "one two", 7)] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", ("café " + "long " * 50000).strip(), 250004)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_best_region_is_the_best():
    rng = random.Random(1)
    for _ in range(50):
        found = [html_extract.Token("word" if rng.random() < 0.5 else "div", 1, False, False, 0, None) for _ in range(20)]
        w = {"word": rng.random(), "div": -rng.random()}
        b, e = html_extract.best_region(found, w)
        score = lambda i, j: sum(w[t.kind] for t in found[i:j])  # noqa: E731, B023
        assert score(b, e) == pytest.approx(max([0, *(score(i, j) for i in range(20) for j in range(i + 1, 21))]))


# --- 3 --------------------------------------------------------------------------------------------


def brute_near(texts: dict[int, str | None], width: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_near_duplicates_with_long_lists(spark, monkeypatch):
    """Groups of near copies larger than a list may be, loose ones among them, and unrelated texts with the same frequent pairs."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts: dict[int, str | None] = {}
    base = [rng.choice(words) for _ in range(60)]
    loose = [rng.choice(words) for _ in range(60)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(1, 3)):
            t[rng.randrange(60)] = f"n{i}"
        texts[len(texts)] = " ".join(t)
        t = list(loose)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(60)] = f"m{i}"
        texts[len(texts)] = " ".join(t)
        texts[len(texts)] = "of the most of the " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: "one", len(texts) + 3: "ONE", len(texts) + 4: "one two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_near(texts, 2)
    for most, block in ((8, 256), (8, 16), (48, 256)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, width=2, most=most).collect()}
        assert got == want


def test_overlaps_of_blocks():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in (0, 1, 5, 60, 200)]
    got = near_dup._overlaps(sets, sets[::-1], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
    assert near_dup._overlaps(sets[:1], sets[:1]).tolist() == [[0]]


@pytest.mark.parametrize("seed", [1267, 4305])
def test_near_duplicates_of_two_groups_joined_by_followers(spark, seed):
    """Two groups of near copies, leaders at about 0.53 with an estimate of under 0.4; only a follower of each link."""
    rng = random.Random(seed)
    steps = [[f"a{rng.randrange(10**6)}" for _ in range(220)]]
    for at in (0, 60, 120):
        t = list(steps[-1])
        t[at : at + 22] = [f"b{rng.randrange(10**6)}" for _ in range(22)]
        steps.append(t)
    a, x, y, b = steps
    rows = [a, *([*a[:-1], f"m{i}"] for i in range(40)), b, *([*b[:-1], f"n{i}"] for i in range(40)), x, y]
    texts: dict[int, str | None] = {i: " ".join(t) for i, t in enumerate(rows)}
    want = brute_near(texts, 2)
    assert set(want.values()) == {0}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, width=2).collect()} == want


def test_near_duplicate_edges(spark, odd):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] == 4} == {4} and [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_several_texts_of_a_doc_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(3, a), (5, a + " x"), (5, b), (7, b), (7, b), (9, "other words entirely"), (9, None), (None, a)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (None, None, True)], key=str)


# --- 4 --------------------------------------------------------------------------------------------


def brute_repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def digest(df):
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("most", [2000, 3])
def test_repeats(spark, most):
    """Shared passages at different places, periodic texts, exact copies; with a small ``most``, spread anchors too."""
    rng = random.Random(2)
    letters = "abcdefgh é"
    passage = "".join(rng.choice(letters) for _ in range(260))
    rows = []
    for i in range(40):
        noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
        k = rng.randrange(0, 120)
        rows.append((i, noise(rng.randrange(50)) + passage[k : k + rng.randrange(90, 140)] + noise(rng.randrange(200))))
    rows += [(50, "ab" * 200), (51, "x" * 350), (52, rows[3][1]), (53, passage + passage), (54, None), (55, ""), (56, "y" * 99)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digest(suffix_dup.remove_repeats(df, most=most)) == brute_repeats(rows, 100)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for alphabet in (2, 20):
        text = rng.integers(97, 97 + alphabet, 700).astype(np.uint8)
        text[300:420] = text[10:130]
        words = suffix_dup.packed(text)
        order = suffix_dup.suffix_array(words)
        b = text.tobytes()
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        got = suffix_dup.common_prefixes(words, order, 100)
        for s in range(1, len(order)):
            x, y = b[order[s] :], b[order[s - 1] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert min(got[s], 100) == min(n, 100)


def test_repeat_edges(spark, odd):
    assert suffix_dup.remove_repeats(odd).count() == odd.count()
    assert suffix_dup.remove_repeats(odd.limit(0)).count() == 0


def test_rows_without_an_id_stand_after_any_id(spark):
    text = "".join(random.Random(8).choices("abcdefghij", k=800))
    rows = [(2**62 + 2**61 + 5, text), (None, text), (2**63 - 1, text[:300]), (3, "x" + text[500:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: sum(s["end"] - s["begin"] for s in r["spans"]) for r in suffix_dup.remove_repeats(df).collect()}
    assert got == {3: 0, 2**62 + 2**61 + 5: 300, 2**63 - 1: 300, None: 800}


def test_several_texts_of_a_doc_id_are_several_documents(spark):
    long = "".join(f"{i:03d} " for i in range(200))
    df = spark.createDataFrame([(1, long), (1, "short"), (2, long[:300]), (2, "x" * 20), (2**62 + 5, long[200:500]), (None, long[:200])], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_bytes"]): sum(x["end"] - x["begin"] for x in r["spans"]) for r in suffix_dup.remove_repeats(df).collect()}
    assert got == {(1, 800): 0, (1, 5): 0, (2, 300): 300, (2, 20): 0, (2**62 + 5, 300): 300, (None, 200): 200}


# --- 5 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1025])
def test_permutation(n):
    got = token_shards.permute(np.arange(n), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != np.arange(n)).mean() > 0.9


def test_token_round_trip(spark, odd, tmp_path):
    """Every row's text comes back from its sequences, the repeated one twice."""
    shards = token_shards.write_shards(odd, str(tmp_path / "s"), length=16, per_shard=500)
    rows = shards.toPandas()
    assert sorted(rows["slot"]) == list(range(len(rows))) and (rows["slot"] // 500 == rows["shard"]).all()
    assert set(rows["tokens"].map(len)) == {32}
    told = token_shards.read_shards(spark, str(tmp_path / "s"), 16, 500, digests=True).toPandas()
    assert dict(zip(told["slot"], told["tokens_sha256"], strict=True)) == {r.slot: hashlib.sha256(r.tokens).hexdigest() for r in rows.itertuples()}
    with open(token_shards.VOCABULARY, "rb") as f:
        enc = token_shards.tokenizer(f.read())
    back: dict = {}
    for r in rows.sort_values("seq").itertuples():
        back.setdefault(None if r.doc_id != r.doc_id else r.doc_id, {}).setdefault(r.seq, []).append(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    counts: dict = {}
    for r in odd.filter("text <> ''").collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        got = back[r["doc_id"]]
        assert enc.decode([t for seq in sorted(got) for t in got[seq][0]]) == r["text"] and all(v == got[seq][0] for seq in got for v in got[seq])
    assert counts[4] == 2 and {d: {len(v) for v in got.values()} for d, got in back.items()} == {d: {n} for d, n in counts.items()}
    assert token_shards.write_shards(odd.limit(0), str(tmp_path / "e")).count() == 0


def shard_bytes(spark, path):
    return [open(r["file"].removeprefix("file:"), "rb").read() for r in token_shards.read_manifest(spark, path).orderBy("shard").collect()]


def test_slots_are_those_of_a_plain_permutation(spark, tmp_path):
    docs = docs_of(spark, [f"document {i} " * (i % 40) for i in range(60)])
    shards = token_shards.write_shards(docs.repartition(5), str(tmp_path / "s"), length=8, per_shard=100, key=5, by_key=True)
    rows = sorted(shards.collect(), key=lambda r: (r["doc_id"], r["seq"]))  # the order of numbers
    want = token_shards.permute(np.arange(len(rows)), len(rows), 5)
    assert [r["slot"] for r in rows] == want.tolist()
    for i in (0, 7, len(rows) - 1):  # walked one by one
        half = max(1, ((len(rows) - 1).bit_length() + 1) // 2)
        x = i
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for r in range(1, 7):
                k = int(K.mix(np.array([r], np.uint64) + np.uint64(5))[0])
                left, right = right, left ^ (int(K.mix(np.array([right ^ k], np.uint64))[0]) & ((1 << half) - 1))
            x = left << half | right
            if x < len(rows):
                break
        assert x == want[i]


def test_same_bytes_for_any_partitioning(spark, tmp_path):
    docs = docs_of(spark, [f"document {i % 50} " * (i % 37) for i in range(120)])
    docs = docs.union(docs.limit(20))
    out = []
    for n, parts in enumerate((docs.coalesce(1), docs.repartition(3), docs.repartition(7, "text"))):
        token_shards.write_shards(parts, str(tmp_path / f"s{n}"), length=8, per_shard=64, by_key=True)
        out.append(shard_bytes(spark, str(tmp_path / f"s{n}")))
    assert out[0] == out[1] == out[2] and len(out[0]) > 3


def test_same_bytes_for_any_split_of_the_files(spark, tmp_path):
    docs_of(spark, [f"document {i} " * (i % 37) for i in range(3000)]).coalesce(2).write.option("parquet.block.size", "4096").parquet(str(tmp_path / "docs"))
    out = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs = spark.read.parquet(str(tmp_path / "docs"))
        token_shards.write_shards(docs, str(tmp_path / size), length=8, per_shard=5000)
        out.append((docs.rdd.getNumPartitions(), shard_bytes(spark, str(tmp_path / size))))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out[0][0] != out[1][0] and out[0][1] == out[1][1]


def test_a_reader_seeks_and_resumes(spark, tmp_path):
    docs = docs_of(spark, [f"document {i} " * (i % 37) for i in range(100)])
    at = str(tmp_path / "s")
    rows = sorted(token_shards.write_shards(docs, at, length=8, per_shard=50).collect(), key=lambda r: r["slot"])
    m = token_shards.read_manifest(spark, at).collect()
    assert {r["stride"] for r in m} == {token_shards.stride(8)} and all(r["bytes"] == r["stride"] * min(50, r["sequences"] - 50 * r["shard"]) for r in m)
    for first in (0, 1, 49, 50, 137, len(rows) - 1, len(rows)):
        got = list(token_shards.sequences_from(m, first))
        assert [(s, d, q, i.tobytes()) for s, d, q, i in got] == [(r["slot"], r["doc_id"], r["seq"], r["tokens"][: 2 * r["n_tokens"]]) for r in rows[first:]]
    raw = shard_bytes(spark, at)[2]
    size = token_shards.stride(8)
    assert np.frombuffer(raw, token_shards.HEADER, 1, 37 * size)[0].tolist()[:2] == (rows[137]["doc_id"], rows[137]["seq"])


# --- 6 --------------------------------------------------------------------------------------------


def test_passages_in_blocks(spark):
    """Several blocks of items find what one finds, short items too; borders of words count."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(20)] + [(90, None), (91, "--"), (None, "zz yy")]
    texts = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            t += (items[i % 20][1] or "").upper().split()
        texts.append("-".join(t))
    df, bench = docs_of(spark, [*texts, None, ""]), spark.createDataFrame(items, "item_id bigint, text string")
    one = decontaminate.benchmark_passages(df, bench).toPandas().set_index("doc_id")
    many = decontaminate.benchmark_passages(df, bench, block_bytes=64).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        w = re.findall("[0-9a-z]+", t.lower())
        hit, found = set(), set()
        for name, text in items:
            p = re.findall("[0-9a-z]+", (text or "").lower())
            m = min(13, len(p))
            for k in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[k : k + m]:
                        hit |= set(range(j, j + m))
                        found.add("" if name is None else str(name))
        for got in (one.loc[i], many.loc[i]):
            assert (got["n_words"], got["n_hit"], sorted(got["items"])) == (len(w), len(hit), sorted(found))


def test_passage_edges(spark, odd):
    bench = spark.createDataFrame([(1, "x y")], "item_id int, text string")
    got = decontaminate.contamination(decontaminate.benchmark_passages(odd, bench))
    assert got.count() == odd.count() and [r["doc_id"] for r in got.filter("contaminated").collect()] == [5]
    assert decontaminate.benchmark_passages(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


# --- 7 and 8 --------------------------------------------------------------------------------------


def test_swapping_names():
    assert toxicity.swapped("Muslim women and a GAY man", 1) == "Jewish men and a STRAIGHT girl"
    assert toxicity.swapped("nothing here", 1) == "nothing here"


def test_counterfactual_penalty_levels_groups(spark):
    """A group that training texts abuse more often is not itself a sign once changes are paid for."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        who = "muslim" if rng.random() < (0.8 if toxic else 0.2) else "christian"
        rows.append((i, f"the {who} {'idiot' if toxic and rng.random() < 0.7 else 'teacher'} went {rng.choice(['home', 'out', 'away'])} today w{rng.randrange(50)}"))
        labels.append((i, toxic))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(0, "the muslim teacher went home"), (1, "the christian teacher went home"), (2, "the christian idiot went home")], "doc_id bigint, text string")
    few = linear.labelled_sample(df, lab, "toxic", 2000)
    made = few.mapInArrow(toxicity._twins(2), "doc_id bigint, label int, text string").mapInArrow(linear._extract(linear.word_and_stem), "doc_id bigint, label int, features array<int>").toArrow()
    ids = np.sort(made.column("doc_id").to_numpy())

    def gap(penalty):
        s = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(probe, toxicity.fit(linear.Sample(made), ids, 2, penalty=penalty)).collect()}
        assert s[2] > 0.5 and s[2] > s[1]
        return abs(s[0] - s[1])

    assert gap(40.0) < 0.5 * gap(0.0)


@pytest.mark.parametrize(("f", "label"), [(toxicity.op7_counterfactual_toxicity, "toxic"), (quality.op8_nbsvm_quality, "quality")])
def test_classifiers_on_held_out(spark, f, label):
    folder = "/root/testdata/sf0.01"
    r = f(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    one, two = r[r[label] == 1]["score"].to_numpy(), r[r[label] == 0]["score"].to_numpy()
    assert (one[:, None] > two[None, :]).mean() > 0.9
    assert r["score"].between(0, 1).all()


def test_classifier_edges(spark, odd):
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, quality int").withColumn("toxic", F.col("quality"))
    m = quality.train(odd, labels)
    assert quality.quality_scores(odd, m).filter("score between 0 and 1").count() == odd.count()
    assert toxicity.toxicity_scores(odd, toxicity.train(odd, labels)).filter("score between 0 and 1").count() == odd.count()
    none = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert linear.above(odd, none.weights, none.offset, linear.word_and_shape, 0.3).columns == odd.columns


def test_toxicity_takes_ids_of_any_size(spark):
    rows = [(2**62 + i, f"the women met the old {'fools' if i % 2 else 'friends'} number {i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    texts, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    got = toxicity.toxicity_scores(texts, toxicity.train(texts, labels)).join(labels, "doc_id").groupBy("toxic").agg(F.avg("score").alias("s")).collect()
    by = {r["toxic"]: r["s"] for r in got}
    assert by[1] > by[0]
    assert toxicity.train(texts, labels.limit(0))[1] == 0.0


# --- 9 --------------------------------------------------------------------------------------------


def test_mix_hits_targets_and_caps(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 30))), "abcd"[min(3, int(rng.random() ** 2 * 5))] if i % 17 else None) for i in range(1500)]
    r = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    total = r["size"].sum()
    assert (r["taken"] <= 3 * r["size"]).all() and (r["taken"][r["size"] > 0] % r["size"][r["size"] > 0] == 0).all()
    by = r.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert by["target"].sum() == pytest.approx(total) and (by["target"] <= 3 * by["source_size"] + 1e-6).all()
    assert (by["taken"] - by["target"]).abs().max() <= 31
    assert r["taken"].sum() <= total


def test_mix_edges(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.filter("size = 0 and taken > 0").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.filter("doc_id <= 3")).filter("target > 0").count() == 0


@pytest.mark.parametrize("polytopes", [2, 3, 4, 5, 6])
def test_recall_of_codes_does_not_fall_with_polytopes(polytopes):
    rng = np.random.default_rng(polytopes)
    x = rng.normal(size=(400, 384))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = int(np.ceil(6 * embedding_dup.MORE_TABLES[polytopes]))
    a, b = embedding_dup.codes(x, tables, polytopes, 11), embedding_dup.codes(y, tables, polytopes, 11)
    met = np.mean([len(np.intersect1d(u, v)) > 0 for u, v in zip(a, b, strict=True)])
    assert met >= 0.985


# --- 10 -------------------------------------------------------------------------------------------


def smallest_reachable(n, links):
    """For each of n nodes the smallest one that links lead to."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed = changed or low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def brute_vectors(rows):
    ok = {}
    for i, (v, x, lab) in enumerate(rows):
        if v is not None and lab is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            ok[i] = np.array(x, float) / np.linalg.norm(x)
    links = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.93] for i in ok}
    by_id = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: rows[i][0])
    place = {i: n for n, i in enumerate(by_id)}
    low = smallest_reachable(len(by_id), [(place[i], place[j]) for i in links for j in links[i]])
    return {rows[i][0]: (len(links.get(i, [])), rows[by_id[low[place[i]]]][0]) for i in by_id}


@pytest.mark.parametrize("most", [64, 10])
def test_embedding_links(spark, most):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        centre = rng.normal(size=24)
        rows += [(len(rows) + j, [float(v) for v in centre + rng.normal(0, 0.12 if g < 8 else 0.05, 24)], g % 3) for j in range(25)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [float("nan")] * 24, 0), (2004, [None] + [1.0] * 23, 0), (2005, rows[0][1], None), (2006, [2 * v for v in rows[0][1]], 0), (None, rows[0][1], 0), (2007, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("component_id", F.lit(1))
    got = embedding_dup.embedding_duplicates(df, most=most).collect()
    assert len(got) == len(rows)
    want = brute_vectors(rows)
    found = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert all(found[i]["n_links"] <= want[i][0] for i in want) and sum(r["n_links"] for r in found.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert {i: (r["component_id"], r["kept"]) for i, r in found.items()} == {i: (c, c == i) for i, (_, c) in want.items()}
    assert embedding_dup.embedding_duplicates(df.limit(0)).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_keep_their_promises(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ws = Workspace(spark, "test-pipeline")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(ws.keep(stage(spark, seen[-1], data), name))
    start, good, single, clean, mixed, tokens = seen
    assert all(d.columns == docs.columns for d in seen[:-1])
    m = quality.train(start, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.quality_scores(start, m).filter("score >= 0.3").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    roots = brute_near({r["doc_id"]: r["text"] for r in good.collect()}, 5)
    assert {r["doc_id"] for r in single.collect()} == set(roots.values())
    bad = {r["doc_id"] for r in decontaminate.contamination(decontaminate.benchmark_passages(single, spark.read.parquet(f"{data}/benchmark.parquet"))).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(roots.values()) - bad
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(clean).collect() if r["size"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    assert tokens.select("slot").distinct().count() == tokens.count()
    assert {r["doc_id"] for r in tokens.select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed.collect()}


def test_pipeline_stages_on_odd_and_empty_tables(spark, data, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, data)
        assert stage(spark, docs.limit(0), data).count() == 0
        if name == "tokens":
            assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {3, 4, 5, 6, None}  # those with a text
            continue
        assert got.columns == docs.columns
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        if name == "near_dedup":  # the copy of a whole row goes; rows without words are linked with nothing
            assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, 6, None]))
        elif name == "decontamination":
            assert len(ids) == docs.count()
        elif name == "mixing":
            assert not {1, 2, 3} & set(ids) and set(ids) <= {4, 5, 6, None}
        else:
            assert set(ids) <= {1, 2, 3, 4, 5, 6, None}
