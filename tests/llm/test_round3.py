"""Source divergence (11), url verdicts (12) and vector codes (13) against their SQL and brute force, on awkward rows."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import covertree, divergence, langid, simhash, suffixes, templates


def with_clashes(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("mine"))
    return df


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


# 11: divergence


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["stone", "Water", "été", "ÉTÉ", "中文", "a", "light", "x1y", "don't", "Straße", "ſ"]
    out = []
    for k in range(300):
        lang = ("en", "de", None)[k % 3]
        mine = words[: 4 + k % 7]
        out.append((k % 290, " ".join(rng.choice(mine) for _ in range(rng.randint(0, 30))), lang, f"s{k % 4}" if k % 11 else None))
    out += [(None, None, "en", "only null"), (900, "", "fr", "alone"), (901, " 12 ", "fr", "other"), (902, "", "", ""), (903, "stone " * 300_000, "en", "s0"), (904, "q" * 3_000_000, "en", "s1"), (905, "stone", None, "s1")]
    return out


def check_divergence(spark, rows, **more):
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "id", "count", "block", "rank", "term", "total")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    got = divergence.divergence(df, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted_rows(got.collect())
    assert got == sorted_rows(con.execute(divergence.SQL).fetchall())
    return got


def test_divergence_equals_its_sql(spark, texts, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 1000)
    got = check_divergence(spark, texts)
    assert {r[:4] for r in got if r[0] == "fr"} == {("fr", "alone", "pair", "other"), ("fr", "other", "pair", "alone")}
    assert all(r[4] == 0 for r in got if r[0] == "fr")


def test_divergence_in_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BITS", 1)
    monkeypatch.setattr(divergence, "RUN", 2)
    check_divergence(spark, texts)


def test_divergence_of_nothing(spark):
    assert check_divergence(spark, []) == []


def test_terms():
    plain = lambda t: collections.Counter(w for w in "".join(c.lower() if c.isascii() else c for c in t).translate({c: " " for c in range(128) if not chr(c).isalpha()}).split(" ") if w)
    for text in ("Ab1cD é-É\x00ß ſ İ", "", "x" * 5000, "a b " * 900, " " * 3000 + "y" * 2500 + " é" * 700):
        for size in (7, 1000, 1 << 20):
            divergence.PIECE_BYTES, kept = size, divergence.PIECE_BYTES
            got = divergence.terms_of(text.encode())
            divergence.PIECE_BYTES = kept
            assert {k.decode(): n for k, n in got.items()} == plain(text)


def test_prices_are_exact():
    rng = random.Random(4)
    for _ in range(200):
        total = rng.choice([rng.randint(1, 50), rng.randint(1, 9 * 10**15)])
        counts = [rng.randint(0, total) for _ in range(5)]
        assert divergence.prices(np.array(counts), total).tolist() == [1 + 10**9 * c // total for c in counts]


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (3, 4000), (2000, 2000), (1, 1)])
def test_galloping_merge_equals_a_plain_one(sizes):
    rng = np.random.default_rng(sum(sizes))
    terms = 5000
    a, b = ((np.sort(rng.choice(terms, n, replace=False)).astype(np.int64) * 3, rng.integers(1, 50, n), 10_000 + n) for n in sizes)
    ca, cb = (dict(zip(x[0].tolist(), x[1].tolist())) for x in (a, b))
    want = 0
    for k in range(0, 3 * terms, 3):
        p, q = 1 + 10**9 * (ca.get(k, 0) + 2) // a[2], 1 + 10**9 * (cb.get(k, 0) + 2) // b[2]
        want += (p - q) ** 2 // (p + q)
    assert divergence.pair_value(a, b, terms) == divergence.pair_value(b, a, terms) == want


# 12: urls


def check_urls(spark, rows, rules=templates.RULES):
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string"), "host", "path", "n", "salt", "template", "label", "html")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    if rows:
        con.executemany("insert into pages values (?, ?)", rows)
    got = templates.url_verdicts(df, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "template", "verdict"]
    got = got.collect()
    assert sorted_rows(got) == sorted_rows(con.execute(templates.templates_sql(rules)).fetchall())
    return {r.page_id: r for r in got}


def test_rules_and_parts(spark):
    urls = [
        None, "", "no scheme", "http://", "://A.B", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://example.com/en", "http://example.com?x", "http://example.com#/en/",
        "http://badexample.com/en/1", "http://a.b.net/es/1", "http://net/fr/", "http://x.net/ES/1", "a://b://c/d", "http://É.ÄCOM/É", "http://x.com:80/", "http://u@h.com/y\nz?a", "http://m.www.example.com/en/q",
        "http://deep.org/" + "a/" * 5000, "http://long.org/" + "b" * 100_000,
    ]
    got = check_urls(spark, [*enumerate(urls), (None, "http://x.com/"), (5, urls[5])])
    want = {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.b", "", None), 5: ("www.example.com", "/en/x", "www.example.com/en/"), 6: ("example.com", "/en/", "example.com/en/"),
            7: ("example.com", "/en", "com/"), 8: ("example.com", "", None), 9: ("example.com", "", None), 10: ("badexample.com", "/en/1", "com/"), 11: ("a.b.net", "/es/1", "net/es/"), 12: ("net", "/fr/", "net/fr/"),
            13: ("x.net", "/ES/1", None), 14: ("b:", "//c/d", None), 15: ("É.Äcom", "/É", None), 16: ("x.com:80", "/", None), 17: ("u@h.com", "/y\nz", "com/"), 18: ("m.www.example.com", "/en/q", "www.example.com/en/")}
    assert {k: (got[k].host, got[k].path, got[k].rule) for k in want} == want
    assert [got[k].verdict for k in (0, 5, 6, 7, 11, 13)] == ["allow", "allow", "block", "allow", "block", "allow"]


def test_templates_carry_labels_to_unruled_pages(spark):
    """Rules name some items of a shop by number; the template that they share is rejected, others are not."""
    rng = random.Random(1)
    numbers = rng.sample(range(1000, 9999), 400)
    rules = [("block", "shop.org", f"/item/{n}/") for n in numbers[:60]] + [("allow", "shop.org", "/help/")]
    urls = [f"http://shop.org/item/{n}/" for n in numbers[:200]] + [f"http://shop.org/help/{n}" for n in numbers[:50]] + [f"http://shop.org/news/{n}.html" for n in numbers[:100]]
    urls += [f"http://free.org/item/{n}/" for n in numbers[:50]]
    got = check_urls(spark, list(enumerate(urls)), rules)
    assert {r.verdict for k, r in got.items() if k < 200} == {"block"}
    assert {r.template for k, r in got.items() if k < 200 and r.rule is None} == {"/item/*/"}
    assert {r.verdict for k, r in got.items() if k >= 200} == {"allow"}


def test_similar_branches_merge(spark):
    """Branches alike in what lies below share their labels; one that differs keeps its own."""
    rules = [("block", "h.org", f"/{b}/{k}") for b in ("a", "b") for k in range(10, 90, 8)]
    urls = [f"http://h.org/{b}/{k}" for b in ("a", "b") for k in range(10, 100)] + [f"http://h.org/c/{k}.html" for k in range(100)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    name, verdict = templates.ruled(F.col("host"), F.col("path"), rules)
    tree = templates.template_tree(templates.parsed(df).select("host", "path", verdict.alias("label"))).collect()
    assert {r.template for r in tree} == {"/a|b/*", "/c/*.html"}
    assert {(r.blocked, r.allowed, r.rejected) for r in tree} == {(20, 0, True), (0, 0, False)}
    check_urls(spark, list(enumerate(urls)), rules)


def test_no_pages(spark):
    assert check_urls(spark, []) == {}


# 13: codes


def codes_by_brute_force(rows, rounds=6):
    kept = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([8, *[-(-len(v) // 8) * 8 for _, v, _ in kept]])
    whole = lambda v: [int(math.floor(x)) * 4096 + math.floor((x - math.floor(x)) * 4096) for x in v] + [0] * (width - len(v))
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(k, whole(v), label) for k, v, label in kept]
    w = width // 8
    parts = [[v[p * w : p * w + w] for p in range(8)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:16]] for p in range(8)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (apart(x, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            groups = collections.defaultdict(list)
            for x in parts:
                groups[nearest(x[p], books[p])].append(x[p])
            for e, mine in groups.items():
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (k, _, label), x in zip(kept, parts):
        code = [nearest(x[p], books[p]) for p in range(8)]
        out.append((k, bytes(code).hex(), sum(apart(x[p], books[p][c]) for p, c in enumerate(code)), label))
    sums = collections.Counter()
    for r in out:
        sums[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return [(k, code, min(error, most), min(sums[label], most), digest) for k, code, error, label in out] if kept else []


def check_codes(spark, rows, tmp_path, sql=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with_clashes(df, "code", "error", "salt", "part", "vector", "of").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = covertree.op13_cover_tree_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted_rows(got.collect())
    assert got == sorted_rows(codes_by_brute_force(rows))
    if sql:
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted_rows(con.execute(covertree.SQL).fetchall())


def vectors(rng, n, width=16):
    middle = rng.normal(size=(6, width))
    return [(k, (middle[k % 6] + 0.2 * rng.normal(size=width)).tolist(), int(k % 3) if k % 4 else None) for k in range(n)]


def test_codes_equal_brute_force_and_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 100)
    rows = vectors(np.random.default_rng(1), 300)
    rows += [(500, None, 1), (501, [None] + [0.0] * 15, 1), (502, [math.nan] * 16, 2), (503, [math.inf] * 16, 2), (504, [0.0] * 16, 1), (3, rows[3][1], 1), (3, rows[9][1], 1)]
    rows += [(600 + k, rows[0][1], 7) for k in range(150)] + [(800, [-0.0] * 16, 1)]
    check_codes(spark, rows, tmp_path)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(1, [0.5] * 8, 1)], [(None, [0.5] * 8, None), (2, [0.25] * 8, None)], [(1, [], 1), (2, [1.0], 1)],
    [(k, [float(k % 3)] * (5 + k % 9), 1) for k in range(40)], [(k, [1e200 * (k % 5), -1e30, 0.1 * k, 3.0], k % 2) for k in range(40)],
    [(k, [float(2**40 + k % 7) / 4096] * 8, 1) for k in range(30)],
], ids=["empty", "none usable", "one", "null ids", "no components", "ragged", "huge", "large"])
def test_codes_of_odd_tables(spark, tmp_path, rows):
    check_codes(spark, rows, tmp_path, sql=False)


def test_trees_cover():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(3000, 8)) * 500)
    points[1000:1500] = points[7]
    tree = covertree.cover_tree(points)
    assert sorted(tree.order) == list(range(3000)) and (points[tree.order] == tree.points).all()
    for k, (start, stop, first, count) in enumerate(tree.nodes):
        assert np.sqrt(((tree.points[start:stop] - tree.points[start]) ** 2).sum(1)).max() <= tree.radii[k]
        if count:
            ranges = tree.nodes[first : first + count, :2]
            assert ranges[0, 0] == start and ranges[-1, 1] == stop and (ranges[1:, 0] == ranges[:-1, 1]).all()
            centres = tree.points[ranges[:, 0]]
            apart = covertree.squared_distances(centres, centres)
            spread = 2.0 ** (np.ceil(np.log2(tree.radii[k])) - 1)
            assert (apart[~np.eye(count, dtype=bool)] > (spread / 2) ** 2).all()
    entries = points[:16]
    found = np.full(3000, -1)
    compared = 0
    for start, stop, entry in covertree.assigned(tree, entries):
        found[covertree.places(start, stop - start)] = np.repeat(entry, stop - start)
        compared += len(start)
    assert (found == covertree.squared_distances(tree.points, entries).argmin(1)).all()
    assert compared <= 2600  # equal vectors go as one


# Additions to the tests of earlier operators


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of 50 to 200 words in several documents: each of 400 bytes and more goes whole, no other byte does."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(n) for n in (50, 55, 60, 65, 70, 80, 100, 150, 200) for _ in range(2)]
    assert min(len(p) for p in passages) < 400 < max(len(p) for p in passages)
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        for copy in range(2 + k % 4):
            doc = 100 * k + copy
            # different letters on both sides, so that the shared run is the passage and nothing more
            rows.append((doc, f"{own(20 + copy)}{'ABCDEF'[copy]}{passage}{'ghijkl'[copy].upper()}{own(15)}"))
            planted[doc] = len(passage)
    rows += [(10_000 + k, own(rng.randint(1, 300))) for k in range(60)]
    got = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {k: planted[k] if planted.get(k, 0) >= 400 else 0 for k, _ in rows}
    assert all(r.n_spans == (r.n_removed > 0) for r in got.values())


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9_language_mixture(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", F.col("lang").alias("own")), "doc_id").where("own is not null").collect()
    assert len(got) > 150 and np.mean([r.own == r.lang_pred for r in got]) > 0.95


def test_pairs_under_ranges(monkeypatch):
    rng = random.Random(6)
    for at_once in (1, 7, 10_000):
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
        ranges = [(a, a + rng.randint(1, 6), b, b + rng.randint(1, 6)) for a, b in ((rng.randint(0, 50), rng.randint(0, 50)) for _ in range(20))]
        parts = list(simhash.pairs_under(*np.array(ranges).T))
        assert [(a, b) for i, j in parts for a, b in zip(i.tolist(), j.tolist())] == [(a, b) for p, q, r, t in ranges for a in range(p, q) for b in range(r, t)]
        assert all(len(i) <= max(at_once, 36) for i, _ in parts)


def test_groups_of_many_near_texts(spark, monkeypatch):
    """Texts of one cluster, many of them near but not linked, in many tiles: the same groups as by comparing all pairs."""
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 2000)
    monkeypatch.setattr(simhash, "COLUMNS_AT_ONCE", 50)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for k in rng.sample(range(0, 120, 4), rng.randint(1, 6)):
            words[k] = f"new{rng.randint(0, 400)}"
        texts.append(" ".join(words))
    sets = [set(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert 10 < len(set(group)) < 140
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(group))


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS_AT_ONCE", 16)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 60))) for _ in range(40)]
    got = simhash.shared_counts(np.concatenate(sets), np.array([len(x) for x in sets]))
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (np.triu(got, 1) == np.triu(want, 1)).all()
