"""MinHash near-duplicates against plain Python over whole sets."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from ledgerloom.llm import minhash, queries


def words(text):
    return brute.SPACE.findall((text or "").encode().lower())


def sets_of(texts, shingle=2):
    out = {}
    for d, t in texts.items():
        w = words(t)
        out[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    return out


def linked(sets, of=None):
    """Pairs (a, b), a < b, of similar sets; of: those with an a or b in it only."""
    index, pairs = defaultdict(list), set()
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for d in of or sets:
        both = defaultdict(int)
        for x in sets[d]:
            for e in index[x]:
                both[e] += 1
        pairs |= {(min(d, e), max(d, e)) for e, n in both.items() if e != d and 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n)}
    return pairs


def expected(texts, shingle=2):
    sets = sets_of(texts, shingle)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in linked(sets):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_matches_brute_force(spark, sf_dir, documents):
    want = expected({r.doc_id: r.text for r in documents.collect()})
    assert got(queries.op11_minhash(spark, sf_dir)) == want and sum(not k for _, _, k in want.values()) > 5


def test_small_sets(spark):
    """Texts of 1 to 12 shingles, where one shingle more or less decides."""
    rng = random.Random(2)
    texts = {}
    for i in range(0, 1200, 4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 13))]
        for j, w in enumerate((base, base[:-1], [*base, "x"], ["y", *base[1:]])):
            texts[i + j] = " ".join(w)
    assert got(minhash.near_duplicates(table(spark, texts))) == expected(texts)


def test_a_family_just_under_and_pairs_over(spark, monkeypatch):
    """Texts of one template of which most pairs have 0.7, and pairs over 0.8 among them; in parts, too."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(150):
        both = rng.sample(range(3, 397, 3), 14)
        for j in range(2):
            own = list(base)
            for k, at in enumerate([*both, *rng.sample([x for x in range(3, 397, 3) if x not in both], 6)]):
                own[at] = f"edit{i}" if k < 14 else f"edit{i}.{j}"
            texts[2 * i + j] = " ".join(own)
    want = expected(texts)
    assert len({c for _, c, _ in want.values()}) == 150
    assert got(minhash.near_duplicates(table(spark, texts))) == want
    monkeypatch.setattr(minhash, "PART", 40)
    assert got(minhash.near_duplicates(table(spark, texts))) == want


def test_hub_that_is_similar_to_few(spark):
    """The smallest ids are the odd ones out of a large group of near copies, and of exact copies."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    texts = {i: " ".join(base[: 200 - 3 * i] + [f"{i}.{k}" for k in range(3 * i)]) for i in range(1, 30)}
    texts |= {100 + i: " ".join(base[: i % 199] + ["edit%d" % i] + base[i % 199 + 1 :]) for i in range(400)}
    texts |= {600 + i: " ".join(base) for i in range(300)}
    assert got(minhash.near_duplicates(table(spark, texts))) == expected(texts)


def test_no_pairs_are_written(spark, tmp_path, monkeypatch):
    """Texts of one template at 0.6: what the rounds write grows with their number, not with its square."""
    sizes, places = {}, minhash.rest_places

    def counted(members):
        df = places(members)
        sizes[members.select("node").distinct().count()] = df.count()
        return df

    monkeypatch.setattr(minhash, "rest_places", counted)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(800):
        own = list(base)
        for at in rng.sample(range(300), 35):
            own[at] = f"e{i}.{at}"
        texts[i] = " ".join(own)
    for n in (200, 800):
        minhash.near_duplicates(table(spark, {i: texts[i] for i in range(n)})).collect()
    (a, x), (b, y) = sorted(sizes.items())
    assert b == 800 and y <= minhash.BANDS * b and y / b < 2 * max(x / a, minhash.BANDS / 2)


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for size in (5, 40, 600):
        agree = []
        for _ in range(300):
            values = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            pair = [np.unique(values[:size]), np.unique(values[size // 8 : size + size // 8])]
            s = [minhash.signatures(np.zeros(len(v), np.int64), v)[1][0] for v in pair]
            agree.append((s[0] == s[1]).mean())
        common = size - size // 8
        assert abs(np.mean(agree) - common / (size + size // 8)) < 0.02


def test_awkward(spark, nasty):
    rows = minhash.near_duplicates(nasty).collect()
    own = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == nasty.count() and own[2] == (13, 1, False) and own[3] == (0, 3, True) and own[5] == (0, 5, True)
    assert own[8] == (1, 8, True) and own[7] == (1, 7, True) and own[None] == (4, None, True)
    assert minhash.near_duplicates(nasty.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(named).collect()} == {("a", "a"), ("b", "a"), (None, "a")}


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.1')", reason="no large table")
def test_recall_on_a_larger_table(spark):
    """Every doc_id that 50 divides, against all rows of sf0.1: each link is within one component."""
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = got(minhash.near_duplicates(table(spark, texts)))
    pairs = linked(sets_of(texts), [d for d in texts if d % 50 == 0])
    assert len(pairs) > 20 and all(found[a][1] == found[b][1] for a, b in pairs)
