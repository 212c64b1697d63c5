"""URL filters, archives and chat formatting, and the pipeline."""

import hashlib

import brute
import corpus_pipeline
import pytest
from ledgerloom.llm import chat, queries, url_filters, warc

from oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir).execute(queries.SQL[name]))


URLS = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://example.com": ("example.com", "", None, "allow"), "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://a.www.example.com/en/x?q#f": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/?a=://b": ("x.net", "/es/", "net/es/", "block"), "http://x.net?/es/": ("x.net", "", None, "allow"), "http://x.org/a/ads/1": ("x.org", "/a/ads/1", None, "block"), "http://com/": ("com", "/", "com/", "allow"), "x://a\nb.net/fr/\n": ("a\nb.net", "/fr/\n", "net/fr/", "block"), "http://é.com/É": ("é.com", "/É", "com/", "allow"),
}


@pytest.mark.parametrize("most", [0, 20_000])
def test_url_rules(spark, most, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", most)
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] * 2 + [(None, "http://a.net/es/1", None, None)], "page_id long, url string, rule string, token string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got == dict(enumerate(URLS.values())) | {None: ("a.net", "/es/1", "net/es/", "block")}
    assert url_filters.judge(df).count() == df.count() and url_filters.judge(df.limit(0)).count() == 0


def test_url_rarest_token(spark):
    rules = [url_filters.Rule("block", "/ads/banner/", False), url_filters.Rule("block", "/ads/x/", False), url_filters.Rule("block", "*zz*", False)]
    assert {r.rule: r.token for r in url_filters.rules_table(spark, rules).collect()} == {"/ads/banner/": "banner", "/ads/x/": "x", "*zz*": ""}
    df = spark.createDataFrame([(1, "http://h/ads/banner/1"), (2, "http://h/azzb"), (3, "http://h/ads/banners/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_warc_awkward(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a.b/1", big, 0), (5, "http://a.b/1", big, 0), (3, "http://c", big, 0), (2, "http://s", "small", 0), (4, "http://s", "small", 0), (6, None, None, 0), (None, "u", "é" * 600, 0), (7, "http://x/\r\nWARC-Type: y", "é" * 600, 0), (8, "http://w", "", 0), (5, "http://a.b/1", big, 0), (9, "http://long", "😀z" * 200_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    got = sorted(tuple(r) for r in warc.archive_and_read(df, f"file://{tmp_path}/w").collect() if r.page_id is not None)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        best = max(q for q, _, g, _ in rows if q is not None and (g or "") == (h or "")) if len(b) >= 1000 else None
        if p is not None:
            want.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if best in (None, p) else "revisit", None if best in (None, p) else best))
    assert got == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_and_read(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_index_is_two_level(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = f"file://{tmp_path}/w"
    shards = warc.write_index(warc.write_archives(pages, f"{root}/a"), f"{root}/i")
    assert len(shards) > 1 and len(warc.Index(f"{root}/i", shards[0][1]).firsts) > 1
    with pytest.raises(KeyError):
        warc.Index(f"{root}/i", shards[0][1]).find(b"nothing")


def test_chat_awkward(spark):
    rows = [(1, 0, "user", chat.PROBE, 9), (1, 1, "assistant", "\\\\###\n</turn>\n### User: hi </turn>\n", 9), (1, 1, "assistant", "tie", 9), (2, None, None, None, 9), (None, 0, "user", "x", 9), (3, 0, "we]ird\\", "y", 9), (4, 0, "user", "é😀" * 100_000, 9), (4, 1, "assistant", "", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    formatted = chat.segments(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    order = lambda c: sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c in (1, 2, None, 3, 4):
        assert got[c].n_turns == len(order(c))
        assert got[c].turns_sha256 == brute.sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order(c)))
        loss = "".join(r[3] for r in order(c) if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    assert got[4].valid and not got[1].valid and not got[3].valid
    assert sum(len(r.text) for r in chat.formatted_text(formatted).collect()) == sum(r.formatted_chars for r in got.values())
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


def test_pipeline_matches_brute_force(spark, sf_dir):
    """The stages' decisions one by one, then run()'s rows."""
    from ledgerloom.llm import decontam, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, chain).collect() if not r.toxic}
    groups = brute.copies({d: text[d] for d in clean})
    kept = {d for d in clean if groups.get(d, d) == d}
    leaks = {r.doc_id for r in decontam.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    kept -= leaks
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.select("doc_id").distinct().count() == got.count()
    found = {r.doc_id: r.decoded_sha256 for r in got.collect()}
    assert set(found) == kept
    plain = {d for d in kept if not brute.secrets(text[d])}
    assert all(found[d] == brute.sha(text[d]) for d in plain if "PRIVATE KEY" not in text[d] and "ghp_" not in text[d] and "eyJ" not in text[d] and "xox" not in text[d])
    assert all(found[d] != brute.sha(text[d]) for d in kept - plain)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, nasty, sf_dir, stage):
    docs = nasty.where("text not like 'x%' or text is null")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} >= {None, 3, 4, 5}
