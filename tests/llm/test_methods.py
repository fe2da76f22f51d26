"""Operators against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest

from ebbflow.llm import components, exact, htmltext, mixing, near, neighbours, packing, queries, quality, repeats, secrets, toxicity, warc, wordhash

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, sf)) == compare.sql_rows(sf, queries.ORACLES[name])


def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_word_kernels():
    r = random.Random(0)
    texts = ["".join(r.choice("ab é☃\n\t#") for _ in range(r.randint(0, 60))) for _ in range(700)] + [None, "", "x" * 700_000]
    seen = 0
    for c in wordhash.chunks(pa.array(texts)):
        for k in range(c.rows):
            words = WORD.findall(texts[c.first + k] or "")
            assert c.n_words()[k] == len(words)
            seen += 1
    assert seen == len(texts)


def shingles(text, n=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_components(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 75 * (len(x) + len(y) - k):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {d: find(d) for d in docs}


def family(seed, n=140, words=90):
    """Near copies around the threshold: chains, hubs with no links, isolates."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    docs, last = {}, base
    for k in range(n):
        source = last if r.random() < 0.4 else base
        w = list(source)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        docs[k * 3 + 1] = " ".join(w)
        last = w
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components_are_exact(spark, seed):
    docs = family(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cfg = near.NearConfig(block=16)
    got = {r.doc_id: r.component_id for r in near.near_components(df, cfg).collect()}
    assert got == brute_components(docs)


def test_bit_estimate(spark):
    docs = family(3, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cfg = near.NearConfig()
    from pyspark.sql import functions as F

    s = near.signatures(df, cfg).select("doc_id", "signature")
    t = s.select(F.col("doc_id").alias("other"), F.col("signature").alias("sig2"))
    rows = s.join(t, F.col("doc_id") < F.col("other")).select("doc_id", "other", near.estimate(F.col("signature"), F.col("sig2"), cfg).alias("e")).collect()
    sets = {d: shingles(x) for d, x in docs.items()}
    errors = [r.e - len(sets[r.doc_id] & sets[r.other]) / len(sets[r.doc_id] | sets[r.other]) for r in rows]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06 and max(map(abs, errors)) < cfg.margin


def test_connected_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            merged = root[a] | root[b]
            for x in merged:
                root[x] = merged
    assert got == {x: min(s) for x, s in root.items()}


def test_with_previous(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = sorted((r.a, r.b, r.prev_b) for r in neighbours.with_previous(df, ["a", "b"], ["b"]).collect())
    ordered = sorted(rows)
    assert got == [(a, b, ordered[k - 1][1] if k else None) for k, (a, b) in enumerate(ordered)]


def test_packing_round_trip(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark, sf)
    docs |= {-1: "", -2: "end <|endoftext|> of text Рус 中文\x85 x", -3: "a  b\t\n  c 123's"}
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(slow.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in docs.items()}
    df = spark.createDataFrame([(d, t, f"s{d % 3}") for d, t in docs.items()], "doc_id long, text string, source string")
    cfg = packing.PackConfig(bucket_tokens=60_000, window_tokens=8192)
    rows = packing.pack(df, cfg, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d])
            at += p.length
        assert at == len(ids[d])
    assert set(by_doc) == set(docs)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0


def test_both_tokenizers_agree():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    fast, slow = packing.encoder(packing.PackConfig()), packing.encoder(packing.PackConfig(ranks=None))

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet=" \t\n'sté!.1aB", max_size=60))
    def same(text):
        assert fast([text])[0].tolist() == slow([text])[0].tolist()

    same()


def test_deal_fills_windows_to_shares():
    avail = {"a": 6000, "b": 3000, "c": 1000}
    share, deficit = {"a": 0.6, "b": 0.3, "c": 0.1}, dict.fromkeys("abc", 0.0)
    total = dict.fromkeys("abc", 0)
    for _ in range(10):
        for s, n in packing.deal(avail, share, deficit, 1000).items():
            total[s] += n
            avail[s] -= n
            assert abs(n - 1000 * share[s]) <= 1
    assert total == {"a": 6000, "b": 3000, "c": 1000} and packing.cut_points(2500, 1024).tolist() == [1024, 2048, 2304, 2432, 2496, 2500]


def test_warc_rolls_and_is_deterministic(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    cfg = warc.WarcConfig(roll_bytes=20_000)
    one = warc.write_archive(pages, f"file://{tmp_path}/a", cfg, shards=3)
    two = warc.write_archive(pages.repartition(5), f"file://{tmp_path}/b", cfg, shards=3)
    assert [(m["file"], m["sha256"], m["records"]) for m in one] == [(m["file"], m["sha256"], m["records"]) for m in two] and len(one) > 3
    assert all(m["bytes"] < 20_000 + 30_000 for m in one) and not list((tmp_path / "a").glob("_temporary*"))
    back = {r.page_id: bytes(r.payload).decode() if r.payload is not None else r.refers_to for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert all((html[v] if isinstance(v, int) else v) == html[k] for k, v in back.items()) and set(back) == set(html)
    import gzip

    first = gzip.open(tmp_path / "a" / one[0]["file"]).read()
    assert first.startswith(b"WARC/1.1\r\n")


def test_line_alignment():
    r = random.Random(6)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        for bits in (1 << 28, 10):
            s = htmltext.shared(a, b, bits)
            assert len(s) == length(a, b) and all(a[i] == b[j] for i, j in s) and s == sorted(s)


def test_html_differencing(spark):
    def page(k):
        return f"<html><head><title>T{k}</title></head><body><div>Site name of all pages</div><div class='x'>Home News Contact</div><p>Story number {k} &amp; <b>bo</b>ld {k * 7}</p><p>More of story {k}</p><div>All rights reserved</div></body></html>"

    def article(k):
        return f"<nav>menu {k}</nav><div class='cookie-notice'>We use cookies</div><article><h1>Title {k}</h1><p>Text\n  {k}<br>line</p><div class='comments'><p>nice {k}</p></div><p>Licensed alike</p></article><footer>f {k}</footer>"

    rows = [(k, f"http://h/s/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://g/s/{k}", article(k) if k < 3 else article(k).replace("Licensed alike", f"own {k}")) for k in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Story number 2 & bold 14 More of story 2"
    assert got[11] == "Title 1 Text 1 line Licensed alike" and got[15] == "Title 5 Text 5 line own 5"


def brute_passages(docs, least=50):
    seen = {}
    for d, w in docs.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in docs.items():
        mark = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                mark[i : i + least] = [True] * least
        if any(mark):
            out[d] = mark
    return out


def test_repeated_passages(spark, sf):
    r = random.Random(8)
    docs = {d: WORD.findall(t) for d, t in documents(spark, sf).items()}
    passage = [f"p{k}" for k in range(51)]
    for k in range(40):
        filler = [f"f{r.randrange(10**6)}" for _ in range(120)]
        at = r.randrange(120)
        docs[10_000 + k] = filler[:at] + passage + filler[at:]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    expected = brute_passages(docs)
    got = {}
    for x in repeats.repeated_passages(df.repartition(6)).collect():
        mark = got.setdefault(x.doc_id, [False] * len(docs[x.doc_id]))
        mark[x.start_word : x.end_word] = [True] * x.n_words
        assert x.other_doc_id != x.doc_id and x.n_words == x.end_word - x.start_word >= 50
    assert set(got) == set(expected)
    assert got == expected


def test_minimisers_cover_windows():
    cfg = repeats.RepeatConfig()
    r = random.Random(9)
    for text in (" ".join(f"w{r.randrange(50)}" for _ in range(3000)), "same " * 500, "a b c " * 300):
        for c in wordhash.chunks(pa.array([text])):
            at, _ = repeats.minimisers(c, cfg)
            gaps = np.diff(np.concatenate([[-1], at, [len(c.word) - cfg.anchor + 1]]))
            assert gaps.max() <= cfg.window and len(at) < len(c.word) / 5


def test_toxicity_held_out(spark):
    r = random.Random(10)
    bad = ["vile", "nasty", "rotten", "foul"]
    rows = []
    for d in range(1500):
        w = [f"w{r.randrange(3000)}" for _ in range(80)]
        toxic = d % 5 == 2
        for _ in range(3 if toxic else 0):
            w[r.randrange(80)] = r.choice(bad)
        rows.append((d, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.fit(df, df.select("doc_id", "toxic"))
    scored = {x.doc_id: x for x in toxicity.score(df, weights).collect()}
    assert all(scored[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in rows)
    held = [(scored[d].predicted, t) for d, _, t in rows if scored[d].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert len(weights) < 5000


def test_secrets_held_out(spark):
    df = spark.createDataFrame([(1, 'the token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f at a.72@mail3.example.com')], "doc_id long, text string")
    assert [(r.start, r.is_secret) for r in secrets.scan(df).orderBy("start").collect()][:2] == [(13, True), (65, False)]
    known = frozenset(range(0, 26**3, 7))
    forest = secrets.train(secrets.example_findings(2000, 1), known)
    test = secrets.example_findings(800, 2)
    x = np.array([secrets.describe(a[-48:], s, b[:48], known) for a, s, b, _ in test])
    assert ((secrets.forest_score(x, forest) >= 0.5) == np.array([f[3] for f in test])).mean() > 0.97


def test_trigram_dictionary_is_exact(spark):
    texts = ["Abc abd", None, "xyz" * 5, "ab", "c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    grams = {t.lower()[k : k + 3] for t in texts if t for k in range(len(t) - 2) if t[k : k + 3].isalpha()}
    code = {(ord(g[0]) - 97) * 676 + (ord(g[1]) - 97) * 26 + ord(g[2]) - 97 for g in grams}
    assert secrets.dictionary(df) == code


def test_mixing_fit_is_optimal(spark):
    r = np.random.default_rng(3)
    rows = [(int(n), [float(x) for x in p], float(u)) for n, p, u in zip(r.integers(1, 400, 300), r.dirichlet([0.5, 0.3, 0.3], 300), r.random(300), strict=True)]
    for budget in (None, 0.4):
        cfg = mixing.MixConfig(targets=(0.8, 0.15, 0.05), ridge=0.05, steps=200, tolerance=0.0, draw_steps=1, budget=budget)
        fitted, fit = mixing.fit_rates(spark.createDataFrame(rows, "__n long, __p array<double>, __u double"), cfg)
        got = fitted.collect()
        rate, p, n = np.array([x["__rate"] for x in got]), np.array([x["__p"] for x in got]), np.array([x["__n"] for x in got])
        totals = (p * (n * rate)[:, None]).sum(0) / n.sum()
        weights = np.array(fit.weights)
        pull = (totals - weights * (totals.sum() if budget is None else budget)) / weights
        slope = p @ pull - (pull @ weights if budget is None else 0.0)
        assert np.abs(np.clip(1 - slope / cfg.ridge, (p[:, 0] >= cfg.clean) * (budget is None), 1) - rate).max() < 0.02 and 0 < rate.min() + rate.max() < 2
        replay = [x["r"] for x in fitted.select(fit.rate(fitted["__p"], cfg).alias("r")).collect()]
        assert replay == pytest.approx(list(rate)) and fit.expected == pytest.approx(list(totals))


def test_quality_thresholds_adapt(spark):
    r = random.Random(11)

    def text(mark):
        return " ".join(f"w{r.randrange(10**6)}{'#' * mark if r.random() < 0.9 else ''}" for _ in range(80))

    rows = [(k, text(0), "en", "plain") for k in range(300)] + [(1000 + k, text(1), "en", "tagged") for k in range(300)] + [(2000, text(1), "en", "plain")]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(2000) and all(got.values())


def test_digest_rule(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "a b")], "doc_id long, text string")
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact.DigestIndex.fresh(spark, 2).assign(df).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
