"""The corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tidegrid.llm import chunks, collisions, common, deepshallow, forest, langid, lmscore, mixing, packing, queries, rans, simhash, suffixes, tokens

WORDS = {
    "en": "the of and to in that is for with house water light under stone people morning which would there about".split(),
    "de": "der die und das nicht mit sich auch haus wasser licht unter steine menschen morgen welche würde über für".split(),
    "fr": "le la les des et dans pour avec maison eau lumière sous pierre gens matin laquelle été où être".split(),
}
# Names that the operators use inside, as columns of the input.
CLASHES = "place component_id row found key known spans worker leaf_of domain bucket0 rest held_out rank score digest wanted".split()


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + ("x" * rng.randint(0, 2) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    passage = prose(rng, "en", 90)
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        text = prose(rng, lang, rng.randint(5, 150))
        if k % 7 == 0:
            text = text[:40] + " " + passage + " " + text[40:]
        out.append((k, text, lang, f"src{k % 5}" if k % 4 else "src0"))
    out += [(100 + k, out[1][1], "de", "src1") for k in range(4)]  # copies
    near = out[20][1].split()
    for k in range(3):
        out.append((200 + k, " ".join([*near[:30], f"other{k}", *near[31:]]), "fr", None))
    out += [
        (300, None, None, None), (301, "", "en", "src0"), (302, " \t\n ", "en", "src0"), (303, "12 34 !!", "en", "src1"),
        (304, "one", "en", "web"), (305, "É", None, "src9"), (306, "two words", "", ""), (None, "no id " * 40, "en", "src2"),
        (307, prose(rng, "en", 40_000), "en", "src3"), (308, "z" * 50_000, "en", "src3"),
        (5, out[5][1], out[5][2], out[5][3]), (6, "another text of the same id", "en", "src1"), (309, "a\x00b <|endoftext|> ﬁ Σας 中文", "en", "src4"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.selectExpr("*", f"'mine' as {name}")
    return df.cache()


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def in_(remainder, by, doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % by == remainder


def test_words_of_tokens_equal_the_library():
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    own = tokens.encoder(tokens.VOCABULARY)
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x250), 0x300, 0x301, 0x3A3, 0x2019, 0x2028, 0x3000, 0x1C5, 0xFB01, 0x4E2D, 0x1F600]]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(" 's're") for _ in range(40)) for _ in range(2000)]
    texts += ["", " ", "It's <|endoftext|> <|startoftext|>x", "don''t're"]
    for text, x in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert own.ids(text.encode()).tolist() == x.ids


def test_token_cache_may_forget(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 3 * tokens.ENTRY_BYTES)
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    text = "alpha beta gamma delta alpha epsilon beta Żółć alpha"
    assert own.ids(text.encode()).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(300, 360)] + [(9, k) for k in range(10, 200)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(300)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 and 4: embeddings


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist(), int(k % 3)) for k in range(240)]
    base = rng.normal(size=8)
    rows += [(1000 + k, (base + 0.02 * rng.normal(size=8)).tolist(), 1) for k in range(30)]
    rows += [(1100 + k, base.tolist(), 1) for k in range(25)] + [(1200, base.tolist(), None), (1201, base.tolist(), 2)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("inf")] + [1.0] * 7, 1), (2004, [None] + [1.0] * 7, 1), (2005, [1.0, 2.0], 1), (2006, [], 1), (None, base.tolist(), 1)]
    rows += [(40, rows[40][1], 1), (2020, (3 * base).tolist(), 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'mine' as node", "1 as weight", "2 as shard").cache()


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]


def test_nearest_by_inner_product(vectors):
    rows, df = vectors
    found = collections.defaultdict(list)
    for r in forest.neighbours(df, df.where("vec_id % 20 = 0"), 20).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in usable(rows)]
    hit = total = 0
    for q in {i for i, _ in good if i % 20 == 0}:
        own = min((v.tolist() for i, v in good if i == q))
        best = sorted((-float(v @ np.array(own)), i) for i, v in good if i != q and len(v) == len(own))[:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(best) + 1))
        assert [(g[2], -g[1]) for g in got] == sorted([(g[2], -g[1]) for g in got], reverse=True)
        scores = [-float(np.dot(v, own)) for i, v in good for g in got if i == g[1] and i != 40]
        assert all(any(abs(s + g[2]) < 1e-9 for s in scores) for g in got if g[1] != 40)
        hit += len({g[1] for g in got} & {i for _, i in best})
        total += len({i for _, i in best})
    assert hit >= 0.9 * total


def test_a_forest_of_several_shards_keeps_recall(vectors, monkeypatch):
    monkeypatch.setattr(forest, "SHARD_ROWS", 60)
    monkeypatch.setattr(forest, "QUERY_ROWS", 5)
    test_nearest_by_inner_product(vectors)


def test_near_vectors(vectors, monkeypatch):
    rows, df = vectors
    for block in (1024, 7):
        monkeypatch.setattr(collisions, "BLOCK_ROWS", block)
        got = sorted(tuple(-9 if x is None else x for x in r) for r in collisions.near_vectors(df).collect())
        good = {id(r): r for r in usable(rows) if r[2] is not None}
        unit = {k: np.array(r[1], np.float32).astype(float) for k, r in good.items()}
        unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
        near = {a: [b for b in good if b != a and good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98] for a in good}
        want = []
        for r in rows:
            if id(r) not in good:
                want.append((-9 if r[0] is None else r[0], 0, -9 if r[0] is None else r[0], r[0] is not None))
                continue
            seen, todo = {id(r)}, [id(r)]
            while todo:
                for b in near[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            least = min(good[k][0] for k in seen)
            want.append((r[0], len(near[id(r)]), least, least == r[0]))
        assert got == sorted(want)


def test_no_vectors(spark, vectors):
    empty = spark.createDataFrame([], vectors[1].schema)
    assert forest.neighbours(empty, empty, 20).count() == 0
    assert forest.neighbours(vectors[1], empty, 20).count() == 0
    assert collisions.near_vectors(empty).count() == 0


# 2: mixing


def test_mixing_equals_its_sql(docs, rows, nothing):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [(r[0], r[1] and r[1].replace("\x00", "?"), *r[2:]) for r in rows])
    for share, epochs in ((0.5, 4), (1.0, 2), (3.0, 2), (0.01, 1)):
        want = con.execute(mixing.mixing_sql(share, epochs)).fetchall()
        got = [tuple(r) for r in mixing.mixed_sources(docs, share, epochs).collect()]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
    assert mixing.mixed_sources(nothing, 0.5, 4).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {}, "lang": {}, "source": {}}
    got = {r.source: r.full * t[3] + r.rest for r in mixing.budgets(df, 400 / 3010 + 1e-9, 1, weights).collect() for t in leaves if t[2] == r.source}
    assert got == {"1": 10, "2": 90, "3": 100, "4": 200}  # only the sibling of 1 makes up for it
    got = {r.source: r.full * t[3] + r.rest for r in mixing.budgets(df, 2800 / 3010 + 1e-9, 1, weights).collect() for t in leaves if t[2] == r.source}
    assert got["4"] == 1000 and got["1"] == 10 and got["2"] + got["3"] == 1790


# 3: scoring


def test_scores(docs, rows, nothing):
    own = common.documents_of(docs)
    got = lmscore.scored(own, own.where("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 != 2, true)")).collect()
    end = object()
    tokens_ = [[*words_of(r[1]), end] for r in rows]
    counts = collections.Counter(w for r, t in zip(rows, tokens_) if not in_(2, 7, r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if r[0] is None else r[0], len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens_))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.bits_per_byte) for r in got)
    same = [r.score for r in got if r.doc_id in (1, 100, 101, 102, 103)]
    assert len(same) == 5 and max(same) - min(same) < 1e-9
    assert lmscore.scored(common.documents_of(nothing), common.documents_of(nothing)).count() == 0
    few = lmscore.scored(own, common.documents_of(nothing)).collect()
    assert len(few) == len(rows) and all(math.isfinite(r.score) for r in few)


def test_paths_are_a_code():
    begin, length, nodes, bits = lmscore.huffman(np.array([5, 1, 1, 30, 2, 8, 1]))
    codes = ["".join(map(str, bits[b : b + n])) for b, n in zip(begin, length)]
    assert sum(2.0**-n for n in length) == 1.0 and all(not b.startswith(a) for a in codes for b in codes if a != b)
    assert all(nodes[b] == 5 for b in begin)  # all paths begin at the root


def test_long_text_in_pieces(monkeypatch):
    text = b"word " * 5000
    at = np.array([0, 10, 10 + len(text)])
    monkeypatch.setattr(lmscore, "TEXT_BYTES", 1000)
    parts = list(lmscore.pieces_of(b"x" * 10 + text, at))
    assert b"".join(p[1] for p in parts) == b"x" * 10 + text and [p[4] for p in parts].count(True) == 2


# 5: repeated strings


def removed_by_brute_force(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                keep[i : i + length] = False
        runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
        out.append((len(t), int((~keep).sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[keep].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length, most_zones, segment", [(40, 20_000, 4 << 20), (40, 2, 4 << 20), (57, 20_000, 300)])
def test_suffix_array_dedup(spark, monkeypatch, length, most_zones, segment):
    monkeypatch.setattr(suffixes, "SEGMENT_BYTES", segment)
    rng = random.Random(length)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    base = [some(200, "abé ") for _ in range(4)]
    rows = [(k, "".join(rng.choice(base)[rng.randint(0, 80) : rng.randint(90, 200)] if rng.random() < 0.6 else some(rng.randint(0, 50), "abcdefg") for _ in range(rng.randint(0, 5)))) for k in range(60)]
    rows += [(200, "a" * 300), (201, "ab" * 90), (202, None), (203, ""), (5, rows[5][1]), (204, "x" * (length - 1)), (205, "q" * length), (206, some(3000, "ab")), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "'x' as spans")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(df, length, most_zones).collect())
    want = removed_by_brute_force([(t or "").encode() for _, t in rows], length)
    assert got == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want))


def test_suffix_array_dedup_of_awkward_rows(docs, rows, nothing):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs).collect())
    want = removed_by_brute_force([(r[1] or "").encode() for r in rows], 400)
    assert got == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want))
    assert suffixes.without_repeats(nothing).count() == 0


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))).encode() for _ in range(300)]
    strings += [b"a" * 80 + s[:20] for s in strings] + strings[:10] + [b"", b"\0", b"\0\0"]
    for shallow in (0, 8, 64):
        order, shared = deepshallow.ordered(strings, shallow)
        line = [strings[k] for k in order]
        if shallow == 0:
            assert line == sorted(strings)
        for a, b, n in zip(line, line[1:], shared[1:]):
            assert n == deepshallow.common(a, b) or (n == 0 and deepshallow.common(a, b) < max(shallow, 1) + 8)
            assert a <= b or a.rstrip(b"\0") == b.rstrip(b"\0")


# 6: SimHash


def fingerprint(text, width=3):
    w = words_of(text)
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, rows, nothing):
    got = simhash.near_groups(docs, 3, 64, 3).collect()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), format(f, "016x")) for i, f in prints)
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min(prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None) for g in set(group) if any(prints[k][0] is not None for k in range(len(prints)) if group[k] == g)}
    want = sorted((str(i), "None" if i is None else str(least[g])) for (i, _), g in zip(prints, group))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    assert simhash.near_groups(nothing, 3, 64, 3).count() == 0


@pytest.mark.parametrize("budget", [1, 3, 6])
def test_trie_finds_all_links(budget, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    words = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(10)]))
    labels = simhash.trie_links(words[:, None], np.zeros(len(words), np.int64), budget)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= budget
    want = np.arange(len(words))
    for _ in range(len(words)):
        new = np.array([want[near[k]].min() for k in range(len(words))])
        if (new == want).all():
            break
        want = new
    assert (labels == want).all()


def test_wide_fingerprints_group_near_copies(docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert {got[k] for k in (100, 101, 102, 103)} == {1}
    assert got[2] == 2 and got[10] == 10


def changed(words, rng, n):
    """The text with n of its words replaced, no two of them within five words."""
    words = list(words)
    for k in rng.choice(np.arange(5, len(words) - 5, 6), n, replace=False):
        words[k] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def similarity(x, y):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_groups_link_what_the_texts_confirm(spark):
    rng = np.random.default_rng(5)
    texts, want = [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 204)]
        for other in (4, 5, 6, 7):  # similarities of 0.82, 0.78, 0.74 and 0.70
            own = [f"{w}.{other}" for w in words]
            texts += [" ".join(own), changed(own, rng, other)]
            want.append(similarity(*texts[-2:]) >= 0.8)
    # repeated lines do not take part: the sets are nearly the same
    line = " ".join(f"line{x}" for x in range(12))
    base = " ".join(f"v{x}" for x in range(150))
    texts += [base, base + f" {line}" * 60]
    want.append(similarity(*texts[-2:]) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(len(want))]
    assert sum(want) == 151 and not any(x and not y for x, y in zip(linked, want))
    assert linked[-1] and sum(linked) >= 0.97 * sum(want)


def test_blocks_propose_all_pairs_at_the_similarity(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 184)]  # 180 shingles, of which 160 are left: 0.8
        texts += [" ".join(words), changed(words, rng, 4)]
    assert all(similarity(*texts[k : k + 2]) == 0.8 for k in range(0, 800, 2))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == k - k % 2 for k in range(800))
    # a text's blocks are the same in a table of any size
    alone = simhash.bands_of(simhash.shingle_set(texts[0].encode(), 5), np.array([180]))
    sets = [simhash.shingle_set(t.encode(), 5) for t in ["", *texts]]
    assert (simhash.bands_of(np.concatenate(sets), np.array([len(x) for x in sets]))[1] == alone[0]).all()


# 7: chunks


def test_passages_of_later_documents_go(docs, rows, nothing):
    got = {(r.doc_id, r.row.text): r for r in chunks.without_repeats(docs).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    passage = next(r[1] for r in rows if r[0] == 0).split()[10:90]
    middle = " ".join(passage[20:60])
    holders = [r.doc_id for r in got.values() if middle in r.text]
    assert holders == [0]
    for k in (2, 3, 4):
        r = next(r for r in got.values() if r.doc_id == k)
        assert r.text == r.row.text and r.n_removed == 0 and r.row.component_id == "mine"
    assert all(r.n_bytes - r.n_removed == len(r.text.encode()) for r in got.values())
    assert chunks.without_repeats(nothing).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(4)
    text = prose(rng, "fr", 400).encode()
    moved = b"inserted words before " + text
    def digests(t):
        data = np.frombuffer(t, np.uint8)
        return set(chunks.pair_digests(t, 0, chunks.chunk_ends(data, np.array([0, len(t)]))[0]).tolist())
    assert len(digests(text) & digests(moved)) >= 0.8 * len(digests(text))


def test_repeats_within_a_document(spark):
    rng = random.Random(8)
    line = prose(rng, "en", 60)
    df = spark.createDataFrame([(1, f"{line} {line} {line}")], "doc_id long, text string")
    assert chunks.without_repeats(df).first().n_removed == 0
    assert chunks.without_repeats(df, within=True).first().n_removed > len(line)


# 8: token files


def test_token_files_give_back_all_ids(spark, docs, rows, nothing, tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    ids = sorted(((r[0] is not None, r[0] or 0, zlib.crc32(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()), len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows))
    start, want = 0, []
    for there, i, crc, n in ids:
        want.append((i if there else None, start, n, crc))
        start += n
    rans.write(common.stored(rans.token_rows(docs, tokens.VOCABULARY)), f"{tmp_path}/files")
    got = sorted((tuple(r) for r in rans.read(spark, f"{tmp_path}/files").collect()), key=lambda r: r[1])
    assert got == want
    rans.write(common.stored(rans.token_rows(nothing, tokens.VOCABULARY)), f"{tmp_path}/none")
    assert rans.read(spark, f"{tmp_path}/none").count() == 0


def test_many_parts_and_blocks(spark, docs, monkeypatch, tmp_path):
    want = sorted(tuple(r) for r in rans.token_rows(docs, tokens.VOCABULARY).where("doc_id is not null").select("doc_id", "n_tokens", "ids_crc32").collect())
    monkeypatch.setattr(rans, "PART_BYTES", 4000)
    rans.write(common.stored(rans.token_rows(docs.where("doc_id is not null"), tokens.VOCABULARY)), f"{tmp_path}/files")
    back = rans.read(spark, f"{tmp_path}/files")
    assert sorted(tuple(r) for r in back.select("doc_id", "n_tokens", "ids_crc32").collect()) == want
    assert spark.read.parquet(f"{tmp_path}/files/blocks").select("part").distinct().count() > 3


def test_blocks_decode_from_any_checkpoint():
    ids = np.random.default_rng(1).zipf(1.3, 150_000) % 3000
    coder = rans.Coder(rans.shares(np.arange(3000), np.bincount(ids, minlength=3000) + 0) if np.bincount(ids, minlength=3000).all() else rans.shares(np.unique(ids), np.bincount(ids)[np.unique(ids)]))
    cuts = [ids[k : k + rans.BLOCK_IDS] for k in range(0, len(ids), rans.BLOCK_IDS)]
    grid = np.full((len(cuts), rans.BLOCK_IDS), -1, np.int32)
    for row, c in zip(grid, cuts):
        row[: len(c)] = c
    coded = coder.encode(grid.reshape(len(cuts), -1, rans.LANES), len(cuts), rans.BLOCK_IDS // rans.LANES)
    assert (np.concatenate(coder.decode([(len(c), *x) for c, x in zip(cuts, coded)])) == ids).all()
    for first in (1, 3):
        back = coder.decode([(len(cuts[0]), *coded[0])], first)[0]
        assert (back == cuts[0][first * rans.CHECKPOINT_STEPS * rans.LANES :]).all()


def test_a_broken_block_is_noticed(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    rans.write(common.stored(rans.token_rows(docs, tokens.VOCABULARY)), f"{tmp_path}/files")
    spark.read.parquet(f"{tmp_path}/files/blocks").withColumn("ids_crc32", F.col("ids_crc32") + 1).write.parquet(f"{tmp_path}/bad/blocks")
    for name in ("frequencies", "documents"):
        spark.read.parquet(f"{tmp_path}/files/{name}").write.parquet(f"{tmp_path}/bad/{name}")
    with pytest.raises(Exception, match="check sum"):
        rans.read(spark, f"{tmp_path}/bad").count()


# 9: languages


def test_languages(docs, rows, nothing):
    got = langid.identified(docs, langid.training_rows(docs)).collect()
    for r in got:
        name = next((x[2] for x in rows if x[0] == r.doc_id and x[1] == r.text), None)
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.found.lang_pred == "und" and r.found.score == 0
        elif r.doc_id is not None and r.doc_id < 60 and r.doc_id != 6 and r.doc_id % 7:
            assert r.found.lang_pred == name
        assert 0 <= r.found.score <= 1
    assert langid.identified(nothing, langid.training_rows(nothing)).count() == 0
    untaught = langid.identified(docs, langid.training_rows(nothing)).select("found.*").distinct().collect()
    assert [tuple(r) for r in untaught] == [("und", 0.0)]


def test_a_mixture_has_the_shares_of_its_languages(docs):
    rng = random.Random(11)
    langs, table = langid.learn(langid.training_rows(docs.where("doc_id < 60")))
    predict = langid.predictor(langs, table)
    import pyarrow as pa

    half = " ".join(prose(rng, "de", 40) if k % 2 else prose(rng, "fr", 40) for k in range(10))
    one, three = predict(pa.array([half, prose(rng, "en", 5)])).to_pylist()
    assert one["lang_pred"] in ("de", "fr") and 0.4 < one["score"] < 0.65
    assert three["lang_pred"] == "en" and three["score"] == 1.0


# 10: packing


def test_packing(docs, rows, nothing):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = collections.Counter()
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want[(r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))] += 1
            at += n
        assert at == len(ids)
    got = packing.pack(docs, tokens.VOCABULARY).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    check_sequences(got)
    assert packing.pack(nothing, tokens.VOCABULARY).count() == 0


def check_sequences(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding / sum(r.length for r in got)


def test_packing_by_many_workers(spark, monkeypatch):
    monkeypatch.setattr(packing, "WORKER_PIECES", 20)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = random.Random(6)
    rows = [(k, s, n, k, 9) for k in range(1500) for s, n in enumerate(packing.piece_lengths(rng.randint(1, 5000)))]
    got = packing.packed(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == sorted(r[:3] for r in rows)
    assert check_sequences(got) < 0.01


# all of it


def test_queries_are_complete():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 14))


def test_pipeline(spark, docs, rows, nothing, tmp_path):
    import corpus_pipeline as pipeline

    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    now, names = spark.read.parquet(f"{tmp_path}/some/documents.parquet"), docs.columns
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = now.collect()
        assert k == 4 or now.columns == names
        assert k == 4 or now.where("component_id = 'mine'").count() == len(kept[name])
    ids = {n: [r.doc_id for r in x] for n, x in kept.items()}
    assert not {300, 301, 302, 303} & set(ids["language"]) and {0, 304, 305, 306, None} <= set(ids["language"])
    assert not {100, 101, 102, 103, 200, 201, 202} & set(ids["near duplicates"]) and {1, 20, 2, 3, None} <= set(ids["near duplicates"])
    assert collections.Counter(map(str, ids["repeated passages"])) == collections.Counter(map(str, ids["near duplicates"]))
    assert all(r.n_chars == len(r.text) for r in kept["repeated passages"])
    assert set(map(str, ids["packing"])) == set(map(str, ids["mixture"]))
    check_sequences(kept["packing"])
    for n, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert pipeline.run(spark, f"{tmp_path}/some").count() == len(kept["packing"])


def test_language_stage_goes_by_the_inference(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    junk = ["".join(rng.choice("bcdfghjkmpqvwxz") for _ in range(n)) for n in (40, 200)] + [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(40))]
    own = [(k, prose(rng, lang, n), lang) for k, (lang, n) in enumerate((lang, n) for lang in WORDS for n in (3, 10, 60, 200, 400) * 8)]
    rest = [(1000, prose(rng, "de", 50), None), (1001, prose(rng, "fr", 50), None), (1002, "12 34", None), *[(2000 + k, x, None) for k, x in enumerate(junk)]]
    docs = spark.createDataFrame(own + rest, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in pipeline.language(spark, docs, "").collect()}
    assert got == {k: lang for k, _, lang in own} | {1000: "de", 1001: "fr"}
    # where nothing can be learnt, letters are enough
    got = pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert sorted(r.doc_id for r in got) == sorted([k for k, *_ in own + rest if k != 1002]) and {r.lang for r in got} == {None}


def test_first_weights_come_from_all_training_documents(spark, monkeypatch):
    rng = random.Random(5)
    lines = [(k, " ".join(rng.choice(WORDS["en" if k % 2 else "de"]) for _ in range(rng.randrange(1, 60)))) for k in range(700)]
    lines.append((700, "long " * 20000))  # longer than 64 KB
    docs = common.documents_of(spark.createDataFrame(lines, "doc_id long, text string"))
    seen, fitted = [], []
    plain = lmscore.Mixer.fit

    def fit(self, cell, n, true, codes):
        seen.append(n.sum())
        plain(self, cell, n, true, codes)
        fitted.append((self.weights.tobytes(), self.refined.tobytes()))

    monkeypatch.setattr(lmscore.Mixer, "fit", fit)
    for parts in (1, 5):
        training = docs.repartition(parts).select("doc_id", "text")
        model, *_ = lmscore.trained(training, lmscore.word_counts(training))
        m = model.value
        raw = [t.encode() for _, t in lines]
        symbols, *_ = m.texts(b"".join(raw), np.cumsum([0, *map(len, raw)]), True)
        assert seen[-1] == m.word_tree[1][symbols].sum()  # each decision of each document, once
    assert fitted[0] == fitted[1]
