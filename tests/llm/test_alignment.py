"""Cross-tokenizer alignment against the tokenizers' libraries and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers
from ledgerloom.llm import alignment, queries
from ledgerloom.llm.bpe import byte_alphabet

PLAIN = byte_alphabet()


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def plain(texts, libraries):
    a, b = libraries
    rows, count = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.encode(t or "")
        bytes_a = [bytes(PLAIN[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append(None)
            continue
        groups, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
        while i < len(ids_a) or j < len(ids_b):
            if x <= y:
                x += len(bytes_a[i])
                own[0].append(ids_a[i])
                i += 1
            else:
                y += len(bytes_b[j])
                own[1].append(ids_b[j])
                j += 1
            if x == y:
                groups.append(own)
                own = ([], [])
        rows.append(groups)
        count.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for groups in rows:
        if groups is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest(), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links)))
    return out


def test_query_matches_plain_python(spark, sf_dir, documents, libraries):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {d: w for (d, _), w in zip(rows, plain([t for _, t in rows], libraries), strict=True)}
    got = {r[0]: tuple(r)[1:] for r in queries.op12_alignment(spark, sf_dir).collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 100


def test_awkward_texts(spark, libraries, monkeypatch):
    rng = random.Random(3)
    parts = [*" \n\t ab'sT.,é日😀\x00\x1c\x85 ﬁ\r▁", "  ", "   ", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", " word", "word,", "don't", "x" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    texts += [None, "", " ", "  ", "\n", "a ", "é" * 5000, "same text", "same text", "=" * 3000 + "ab" * 3000, "word " * 50_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in alignment.statistics(docs, queries.VOCABULARY, queries.PIECES).collect()}
    want = dict(enumerate(plain(texts, libraries)))
    assert [i for i in want if got[i] != want[i]] == []
    assert sum(w[0] > 0 for w in want.values()) > 300 < sum(w[0] == 0 for w in want.values()) + 200


def test_small_tables_give_the_same(libraries):
    """Chunk tables that start anew all the time, and wide groups by distinct ids."""
    with open(queries.PIECES, "rb") as f:
        t = alignment.Aligner(open(queries.VOCABULARY, encoding="utf-8").read(), f.read())
    texts = [f"text {i} of {'some ' * (i % 5)}words\n" .encode() for i in range(50)]
    whole = t.align(texts)
    for size in (1, 7):
        t._forget()
        parts = [t.align(texts[i : i + size]) for i in range(0, 50, size)]
        assert [x for p in parts for x in p[1]] == whole[1] and [x for p in parts for x in p[0].tolist()] == whole[0].tolist()
    old, alignment.WIDE = alignment.WIDE, 0
    try:
        t._forget()
        again = t.align(texts)
    finally:
        alignment.WIDE = old
    for a, b in zip(whole[2] + whole[3], again[2] + again[3], strict=True):
        assert a.tolist() == b.tolist()


def test_counts_in_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 50)
    rng = random.Random(1)
    docs = [[(rng.randrange(40), rng.randrange(30)) for _ in range(rng.randrange(30))] for _ in range(200)]
    docs = [sorted(set(d)) for d in docs] + [[(3, 4)]] * 150
    rows = [(i, [p for p, _ in d], [q for _, q in d], [1] * len(d)) for i, d in enumerate(docs)]
    aligned = spark.createDataFrame(rows, "doc_id long, a array<int>, b array<int>, m array<long>").repartition(6)
    partial = alignment.partial_counts(aligned).cache()
    counts = alignment.write_counts(partial, 40, f"file://{tmp_path}/c")
    want = Counter(x for d in docs for x in d)
    assert len(counts.shards) > 1
    got = {r.doc_id: (r.n_best, r.count_sum) for r in alignment.with_counts(aligned, counts).collect()}
    best = {a: max(n for (x, _), n in want.items() if x == a) for a, _ in want}
    assert got == {i: (sum(want[x] == best[x[0]] for x in d), sum(want[x] for x in d)) for i, d in enumerate(docs)}


def test_awkward_rows(spark, nasty):
    got = alignment.statistics(nasty, queries.VOCABULARY, queries.PIECES).collect()
    assert len(got) == nasty.count() and [r for r in got if r.doc_id == 3][0][1:] == (0, 0, 0, 0, "", 0, 0)
    assert alignment.statistics(nasty.limit(0), queries.VOCABULARY, queries.PIECES).count() == 0
