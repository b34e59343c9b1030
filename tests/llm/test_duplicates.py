"""SimHash links and substring removal against brute force."""

import random
from itertools import pairwise

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from newsloom.llm import shingles, simhash, substring


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def components(ids, fps, distance=3):
    low = {i: i for i in range(len(fps))}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_definition_and_spark_hash(spark):
    texts = ["", " \t", "one", "One TWO", "a b c", "É a B c\x0bd e", "x " * 5000, "a b c d " * 40]
    assert [simhash.simhash(t.encode()) for t in texts] == [plain_simhash(t) for t in texts]
    assert spark.sql("select xxhash64('a b c') h").first().h % 2**64 == simhash.simhash(b"a b c")


def test_blocks_of_a_long_text_give_the_same(monkeypatch):
    from newsloom.llm import common

    text = " ".join(random.Random(1).choices("abcdefgh", k=4000)).encode()
    whole = simhash.simhash(text)
    monkeypatch.setattr(shingles, "word_blocks", lambda d: common.word_blocks(d, 50))
    assert simhash.simhash(text) == whole


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_links_match_all_pairs(spark, distance, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(distance)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(rng.randrange(7)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    own = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    got = [(r.src % 2**64, r.dst % 2**64) for r in simhash.links(own, distance).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    want = components(fps, fps, distance)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[find(a)] = find(b)
    assert len({find(x) for x in fps}) == len(set(want.values()))


def test_near_duplicates_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (5, base), (3, base + " end"), (9, None), (8, ""), (None, "zz yy xx"), (None, None), (4, "zz yy xx"), (1, "other words here at all")]
    got = simhash.near_duplicates(frame(spark, [(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = [plain_simhash(t or "") for _, t in rows]
    want = components([i for i, _ in rows], fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(rows[i][0]), f"{fps[i]:016x}", str(want[i])) for i in range(len(rows)))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = (t or "").encode().split()
        for x in range(len(w) - 49):
            k = tuple(w[x : x + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for x in range(len(w) - 49):
            if i is not None and first[tuple(w[x : x + 50])] < i:
                gone |= set(range(x, x + 50))
        out.append((i, len(w), len(gone), b" ".join(v for k, v in enumerate(w) if k not in gone).decode()))
    return out


def check_repeats(spark, rows):
    got = {(r.doc_id, r.kept_text): r.n_words for r in substring.remove_repeats(frame(spark, rows)).collect()}
    want = {(i, kept): n for i, n, gone, kept in brute_repeats(rows) if gone}
    assert got == want


def corpus(rng, words, docs, size):
    pool = [[rng.choice(words) for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))] for _ in range(6)]
    pool += [[rng.choice(words)] * rng.choice([20, 60, 130]), ["p", "q"] * 60, [w for w in rng.choices(words, k=20) for _ in range(3)]]
    rows = []
    for i in range(docs):
        text = []
        while len(text) < size:
            text += rng.choice(pool) if rng.random() < 0.5 else rng.choices(words, k=rng.randrange(1, 60))
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("seed,alphabet,crowd", [(1, 3, 2000), (2, 50, 2000), (3, 2000, 2000), (4, 5, 2), (5, 300, 1)])
def test_removal_matches_brute_force(spark, seed, alphabet, crowd, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", crowd)
    rng = random.Random(seed)
    check_repeats(spark, corpus(rng, [f"w{i}" for i in range(alphabet)], 25, 260))


def test_removal_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(120))
    rows = [(2, long), (2, long), (7, long), (7, "a " + long), (None, long), (4, None), (5, ""), (6, " ".join(f"v{i}" for i in range(49))), (9, "x " * 400), (8, "x " * 51)]
    check_repeats(spark, rows)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_long_documents_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 3000).astype(np.uint64)
    whole = next(iter(substring._blocks(iter([(0, words)]))))
    monkeypatch.setattr(substring, "BLOCK", 256)
    cut = list(substring._blocks(iter([(0, words)])))
    assert (np.concatenate([c[2] for c in cut]) == whole[2]).all()
    assert (np.concatenate([c[1] for c in cut]) == whole[1]).all() and len(cut) > 5


def test_equal_windows_have_equal_keys():
    rng = random.Random(11)
    for _ in range(300):
        size = rng.choice([1, 2, 3, 10, 1000])
        body = [rng.randrange(size) + 1 for _ in range(50)]
        keys = set()
        for _ in range(4):
            left, right = ([rng.choice(body[:3] + [rng.randrange(size) + 1]) for _ in range(rng.randrange(90))] for _ in range(2))
            words = substring._mix(np.array(left + body + right, np.uint64))
            k, _ = substring.window_keys(np.r_[words, np.uint64(5)], np.r_[np.zeros(len(words), bool), True])
            keys.add(int(k[len(left)]))
        assert len(keys) == 1 and keys != {2**64 - 1}
    assert len(list(pairwise(body))) == 49


# Shingle sets


@pytest.mark.parametrize("small, chunk", [(32, 1024), (2, 3)])
def test_stage_links_at_shingle_similarity(spark, small, chunk, monkeypatch):
    import corpus_pipeline as c

    s = shingles
    monkeypatch.setattr(s, "SMALL", small)
    monkeypatch.setattr(s, "CHUNK", chunk)
    monkeypatch.setattr(s, "SAMPLED", 2)
    rng = random.Random(small)
    texts = ["", None, "one two", "One TWO", "a b c d e", "a b c d e f"]
    for _ in range(25):
        words = rng.choices([f"w{k}" for k in range(500)], k=rng.choice([8, 60, 200])) + ["all", "rights", "of", "this", "text", "reserved"]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if low[j] < low[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    low[i] = low[j]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in c.near_duplicates(spark, docs, "").collect()}
    assert kept == set(low)
    over = [i for i in range(len(texts)) if i not in kept and texts[i] and (simhash.simhash(texts[i].encode()) ^ simhash.simhash(texts[low[i]].encode())).bit_count() > 3]
    assert over  # copies that three bits would not reach


def test_keep_one_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(90))
    rows = [(7, long, 1), (7, long, 1), (7, long, 2), (3, long + " end", 1), (None, long, 1), (None, "only here " * 9, 5), (None, "only here " * 9, 5), (None, None, 4), (8, "", 1), (9, " \t", 2), (5, "x " * 300_000, 1), (6, "x " * 300_001, 1)]
    kept = simhash.keep_one(frame(spark, rows, "doc_id long, text string, name long"))
    assert kept.columns == ["doc_id", "text", "name"]
    assert sorted((str(r.doc_id), r.name) for r in kept.collect()) == [("3", 1), ("5", 1), ("8", 1), ("None", 5)]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for m in (0, 3, n // 2):
            b = np.unique(np.r_[a[m:], rng.integers(0, 2**63, 7).astype(np.uint64)])
            apart = shingles.sketches_differ(*(np.frombuffer(shingles.sketch(x), np.uint64) for x in (a, b)))
            assert apart <= len(np.setxor1d(a, b)) and (n < 30 or not m or apart > 0)
