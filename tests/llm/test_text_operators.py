"""Operators over documents: brute force on small tables, and the awkward cases of each."""

import hashlib
import itertools
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from ledgerloom.llm import bpe, components, decontam, flac, fm_dedup, queries, secrets, simhash, toxicity
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_simhash_matches_brute_force(spark, sf_dir, documents):
    fps = {d: brute.simhash(t) for d, t in texts_of(documents).items()}
    want = brute.components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{x:016x}", want[d]) for d, x in fps.items()}


@pytest.mark.parametrize("blocks", [2, 3])
def test_simhash_links_dense_and_sparse(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base[:60] for _ in range(3)]
    ball = [int(base[0]) ^ 1 << i ^ 1 << j for i in range(0, 30, 2) for j in range(1, 30, 2)]
    fps = np.unique(np.array([*base.tolist(), *near, *ball], np.uint64))
    want = brute.components({int(f): int(f) for f in fps})
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = {(r.a, r.b) for r in simhash.link_fingerprints(df, 4, blocks).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    root = {f: f for f in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a & (1 << 64) - 1), find(b & (1 << 64) - 1)
        root[max(p, q)] = min(p, q)
    assert {f: find(f) for f in want} == want


def test_simhash_awkward(spark, nasty):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(nasty).collect()}
    assert {c for (d, _), c in got.items() if d in (1, 2)} == {1}
    assert {c for (d, f), c in got.items() if d in (3, 4, 5)} == {3} and got[3, "0" * 16] == 3
    assert simhash.near_duplicates(nasty).count() == nasty.count()
    assert simhash.near_duplicates(nasty.limit(0)).count() == 0


def test_near_copies(spark, documents):
    text = texts_of(documents)
    got = {r.doc_id: r.group_id for r in simhash.near_copies(documents).collect()}
    assert got == brute.copies(text) and len(set(got.values())) < len(got)


def test_near_copies_of_one_text(spark):
    """A large group around one text: single edits, equal word sets in other order, and exact copies."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
    docs = [(i, " ".join(base[: i % 118] + ["edit%d" % i] + base[i % 118 + 1 :])) for i in range(300)] + [(400, " ".join(base)), (401, " ".join(base)), (402, " ".join(sorted(base))), (403, " ".join(base).upper())]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.copies(dict(docs)) and got[402] == 402 and got[403] == 0


def test_near_copies_cut_and_appended(spark):
    """Copies that miss words at the end or have words of another text appended, from a similarity of 0.8 on."""
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") * 2 + str(rng.randrange(500)) for _ in range(rng.randrange(60, 240))] for _ in range(150)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    docs += [(1000 + i, " ".join(w[: int(len(w) * (0.82, 0.86, 0.9)[i % 3])])) for i, w in enumerate(base)]
    docs += [(2000 + i, " ".join(w + base[i - 1][: int(len(w) * (0.1, 0.15, 0.2)[i % 3])])) for i, w in enumerate(base)]
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute.copies(dict(docs))
    assert sum(got[d] == g for d, g in want.items() if d >= 1000) >= 299 and sum(d != g for d, g in want.items()) > 290


def test_near_copies_among_failing_ones(spark):
    """Texts of which most pairs have a similarity of about 0.7, and pairs just over 0.8 among them."""
    rng = random.Random(9)
    base = ["w%d" % i for i in range(400)]
    docs = []
    for i in range(120):
        both = rng.sample(range(5, 395, 6), 3)
        for j in range(2):
            text = list(base)
            for k, at in enumerate([*both, *rng.sample([x for x in range(5, 395, 6) if x not in both], 4)]):
                text[at] = f"edit{i}" if k < 3 else f"edit{i}.{j}"
            docs.append((2 * i + j, " ".join(text)))
    got = {r.doc_id: r.group_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute.copies(dict(docs))
    assert got == want and len(set(want.values())) == 120


def test_near_copies_awkward(spark, nasty):
    got = sorted((r.doc_id, r.group_id) for r in simhash.near_copies(nasty).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (6, 6), (7, 7), (8, 8)]
    assert simhash.near_copies(nasty.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z")], "doc_id long, text string")
    assert {r.group_id for r in simhash.near_copies(twice).collect()} == {1}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(40))
    assert all(got[a] == got[b] for a, b in edges if a != b) and all(got[r] == r for r in got.values())
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_matches_library(spark, sf_dir, documents):
    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    for d, t in texts_of(documents).items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False)))


def test_bpe_strings():
    lib, own = tokenizers.Tokenizer.from_file(VOCABULARY), bpe.Tokenizer(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(1)
    cases = ["", "<|endoftext|>", "a<|endoftext|>b", "aaaaaaaaa", "  \n\n x", "I'LL they'll", "日本語 😀é"]
    cases += ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in ("abt he", "aé ñ日😀　\x1c_-", "0123 '\n\t.,Az") for _ in range(400)]
    for s in cases:
        ids = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_tables_start_anew(monkeypatch):
    """Tables that overflow within a word or a batch change nothing; words and texts of one batch don't mix."""
    lib, spec = tokenizers.Tokenizer.from_file(VOCABULARY), open(VOCABULARY, encoding="utf-8").read()
    monkeypatch.setattr(bpe, "STATES", 7)
    monkeypatch.setattr(bpe, "KEPT", 3)
    own, rng = bpe.Tokenizer(spec), random.Random(3)
    texts = ["".join(rng.choice("'sltre vmd\n1.é日") for _ in range(rng.randrange(0, 40))) for _ in range(600)] + ["", "x<|endoftext|>", "<|endoftext|><|endoftext|> y"]
    for at in range(0, len(texts), 50):
        batch = texts[at : at + 50]
        want = [e.ids for e in lib.encode_batch(batch, add_special_tokens=False)]
        ids, many = own.encode_batch([t.encode() for t in batch])
        assert (ids.tolist(), many.tolist()) == ([i for x in want for i in x], list(map(len, want)))
        assert [t.decode() for t in own.decode_batch(ids, many)] == batch


def test_bpe_refuses_other_tokenizers():
    import json

    spec = json.load(open(VOCABULARY, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"dropout": 0.1}}):
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(spec | change))


def test_bpe_awkward(spark, nasty):
    got = bpe.digests(nasty, VOCABULARY).collect()
    assert len(got) == nasty.count() and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    ids = bpe.encode_table(nasty, VOCABULARY)
    back = {r.doc_id: r.text for r in bpe.decode_table(ids, VOCABULARY).collect()}
    assert back[6] == "é ß 😀 日本 \x00 \x1c\x85 tab\tend" and back[3] == ""
    assert bpe.digests(nasty.limit(0), VOCABULARY).count() == 0


def test_toxicity_held_out(spark, documents, sf_dir):
    """Accuracy on labelled rows that the fit has not seen."""
    wide = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{wide}/documents.parquet"), spark.read.parquet(f"{wide}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    scored = toxicity.score(docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi"), toxicity.fit(docs, train))
    r = scored.withColumnRenamed("toxic", "said").join(labels, "doc_id").agg(F.count_if(F.expr("said and toxic = 1")).alias("tp"), F.count_if(F.expr("said and toxic = 0")).alias("fp"), F.count_if(F.expr("not said and toxic = 1")).alias("fn")).first()
    assert r.tp / (r.tp + r.fp) > 0.97 and r.tp / (r.tp + r.fn) > 0.8


def test_toxicity_chain_feeds_earlier_categories(spark):
    rng = np.random.default_rng(0)
    a = [int(x) for x in rng.integers(0, 2, 400)]
    docs = spark.createDataFrame([(i, f"{'bad' if x else ''} word{i % 13}") for i, x in enumerate(a)], "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame([(i, 1 - x, x) for i, x in enumerate(a)], "doc_id long, quality int, toxic int"))
    assert [len(m.chained) for m in chain.models] == [0, 1, 2] and chain.models[1].chained[0] > 0
    assert [r.toxic for r in toxicity.score(docs, chain).orderBy("doc_id").collect()] == [x == 1 for x in a]


def test_toxicity_sample_is_one_row_a_document(spark):
    """Repeated doc_ids and labels without a document don't use up the sample."""
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1000)], "doc_id long, quality int, toxic int")
    assert toxicity._sample(docs, labels, 15).count() == 15 and toxicity._sample(docs, labels, 50).count() == 20


def test_toxicity_awkward(spark, nasty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(nasty, labels)
    scored = toxicity.score(nasty, chain).collect()
    assert len(scored) == nasty.count() and all(0 <= r.toxic_score <= 1 for r in scored)
    assert toxicity.reject_toxic(nasty, chain).columns == nasty.columns
    empty = toxicity.fit(nasty.limit(0), labels.limit(0))
    assert toxicity.score(nasty, empty).count() == nasty.count() and toxicity.score(nasty.limit(0), chain).count() == 0


def test_decontamination_finds_planted(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 30, 14, 25, 5])]
    docs = [(i, " ".join(word() for _ in range(200)), "x") for i in range(30)]
    plant = lambda t, k: " ".join([word() for _ in range(50)] + [word() if k and j % k == k - 1 else x for j, x in enumerate(t.split())] + [word() for _ in range(50)])
    docs += [(100, plant(items[0][1], 0), "x"), (101, plant(items[0][1], 7), "x"), (102, plant(items[2][1], 0), "x"), (103, plant(items[3][1], 8), "x"), (104, plant(items[1][1].upper(), 0), "x"), (105, plant(items[1][1], 2), "x"), (106, None, None), (None, items[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, (9, None), (None, items[0][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()} == {(100, 0), (101, 0), (102, 2), (103, 3), (104, 1)}
    assert decontam.decontaminate(d, b).count() == len(docs) - 5
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def test_decontamination_seeds_miss_no_pattern():
    """Every choice of substitutions that leaves an overlap leaves a seed."""
    for n in range(decontam.SPAN, decontam.WINDOW + 1):
        for gone in map(set, itertools.combinations(range(n), n - math.ceil(decontam.SHARE * n))):
            assert any(gone.isdisjoint(at + k for k in m) for m in decontam.MASKS for at in range(n - m[-1]))
    for n in range(1, decontam.SPAN):
        for gone in map(set, itertools.combinations(range(n), n - math.ceil(decontam.SHARE * n))):
            assert any(gone.isdisjoint(m) for m in decontam.short_masks(n))


def test_decontamination_short_items_and_all_patterns(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 4, 5, 8, 10, 11, 12, 15, 20)}
    docs, want = [], set()
    for n, words in items.items():
        gone = list(itertools.combinations(range(n), n - math.ceil(0.8 * n)))
        for g in gone[:: max(1, len(gone) // 60)]:
            docs.append((len(docs), " ".join(["before"] * 3 + ["x" if k in g else w for k, w in enumerate(words)] + ["after"] * (len(docs) % 2))))
            want.add((docs[-1][0], n))
        docs.append((len(docs), " ".join("x" if k <= n - math.ceil(0.8 * n) else w for k, w in enumerate(words))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()} == want


def test_decontamination_without_filter(spark, sf_dir, monkeypatch):
    show = lambda: sorted(map(tuple, queries.op3_decontamination(spark, sf_dir).collect()))
    want = show()
    monkeypatch.setattr(decontam, "FILTER_KEYS", 0)
    assert want and show() == want


def test_fm_dedup_matches_brute_force(spark, sf_dir, documents):
    want = brute.dedup(texts_of(documents))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_fm_dedup(spark, sf_dir).collect()}
    assert got == {d: (len(w), len(w) - len(k), brute.sha(b" ".join(k))) for d, (w, k) in want.items()}
    assert sum(n for _, n, _ in got.values()) > 0


@pytest.mark.parametrize("part", [3, 1000])
def test_fm_dedup_salts_and_ties(spark, part, monkeypatch):
    """Few words, so that windows repeat within texts and many segments share a key."""
    monkeypatch.setattr(fm_dedup, "PART", part)
    rng = random.Random(part)
    pool = [" ".join(rng.choice("ab") for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.dedup(dict(docs), 10)
    got = {r.doc_id: (r.n_removed, r.kept) for r in fm_dedup.dedup(df, 10).collect()}
    assert got == {d: (len(w) - len(k), b" ".join(k).decode()) for d, (w, k) in want.items()}


def test_fm_dedup_of_repeated_ids(spark):
    """Different texts with one doc_id, equal rows, and a periodic text."""
    passage = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(1, passage), (1, "short one"), (2, passage), (2, passage), (3, other), (3, passage + " " + other), (4, other), (5, "tick tock " * 3000), (6, "tick tock " * 100), (6, "x " + passage + " y")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in fm_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first, want = {}, []
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            at = tuple(w[i : i + 50])
            first[at] = min(d, first.get(at, d))
    for d, t in rows:
        w = t.split()
        gone = {k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    with pytest.raises(TypeError):
        fm_dedup.dedup(spark.createDataFrame([("a", passage)], "doc_id string, text string"))


def test_fm_dedup_awkward(spark, nasty):
    got = fm_dedup.dedup(nasty).collect()
    assert len(got) == nasty.count() and {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert next(r for r in got if r.doc_id == 7).n_removed == 0  # repeats within one document stay
    assert fm_dedup.dedup(nasty.limit(0)).count() == 0


def test_secrets_match_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op9_secrets(spark, sf_dir).collect()}
    for d, t in texts_of(documents).items():
        spans = brute.secrets(t)
        assert got[d].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))


SECRETS = ["password=abc", "secret: token = abcdef1", "PASSWORD = 'abcdef' token:token=abcdefgh", "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 12, "0123456789abcdef01234567 deadbeef", "apikey=" + "0123456789abcdef" * 2 + "!", "😀é api_key: \"xyz.123\"", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 30, "ſecret=abcdefg toKen=abcdefg", ""]


def test_secrets_spans_and_ledger(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(50, SECRETS[1]), (1, SECRETS[2]), (None, SECRETS[0]), (60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = f"file://{tmp_path}/ledger"
    found = secrets.scan_history(df, ledger).collect()
    assert len(found) == len(rows)
    by_blob = {r.blob_id: [(s.start, s.stop, s.kind) for s in r.spans if s.kind in ("assign", "access", "hex")] for r in found}
    for _, t in rows:
        assert by_blob[brute.sha(t or "")] == [(a, b, k) for a, _, b, k in brute.secrets(t)]
    n = spark.read.parquet(ledger).count()
    assert n == len({t or "" for _, t in rows})
    secrets.scan_history(df.limit(3), ledger).count()  # nothing unseen
    assert spark.read.parquet(ledger).count() == n
    more = (*secrets.RULES, secrets.Rule("word", "deadbeef"))
    again = secrets.scan_history(df, ledger, more).collect()  # only the new rule runs
    assert spark.read.parquet(ledger).where(F.size("scanned") == 1).count() == n
    assert sum(s.kind == "word" for r in again for s in r.spans) == 1
    assert sum(s.kind == "hex" for r in again for s in r.spans) == sum(s.kind == "hex" for r in found for s in r.spans)
    empty = secrets.scan_history(df.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_secrets_redaction(spark, nasty):
    rows = [(1, "a token=abcdef b", 3), (None, "x AKIA" + "Z" * 20, None), (3, None, 1), (4, "clean", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact_documents(df).collect()}
    assert got == {1: ("a [REDACTED] b", 14), None: ("x [REDACTED]", 12), 3: (None, 1), 4: ("clean", 5)}
    out = secrets.redact_documents(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    data = [flac.payload(t)[0] for t in ("", "a", "x" * 64, "hello " * 3000, "é" * 9000)]
    data += [rng.integers(0, 256, 64 * int(k), dtype=np.uint8).tobytes() for k in rng.integers(1, 200, 12)]
    data += [bytes([0] * 2000 + [255] + [0] * 2095 + [7] * 64), bytes(np.cumsum(rng.integers(-2, 3, 8192)).astype(np.uint8))]
    files = flac.encode_streams(data)
    assert [b"".join(x for _, x in blocks) for _, blocks in flac.decode_streams(files)] == data
    assert [f for f, _ in next(iter(flac.decode_streams(files[3:4])))[1]] == list(range(0, len(data[3]), flac.BLOCK))
    broken = bytearray(files[3])
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        list(flac.decode_streams([bytes(broken)]))


def test_flac_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8


def test_flac_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op10_flac(spark, sf_dir).collect()}
    for d, t in texts_of(documents).items():
        raw = (t or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_flac_awkward(spark, nasty):
    media = flac.encode_table(nasty)
    rows = flac.digests(media).collect()
    assert len(rows) == nasty.count()
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert flac.pcm_blocks(media).where("doc_id = 8").count() == -(-200_000 // flac.BLOCK)
    assert flac.digests(flac.encode_table(nasty.limit(0))).count() == 0
