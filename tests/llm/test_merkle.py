"""The Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from ledgerloom.llm import merkle, queries
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(r, more=0):
    shown = [None if v is None else str(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])]
    return h(*["-" if s is None else f"{len(s.encode('utf-8', 'surrogatepass'))}:{s}" for s in shown])


def tree(nodes, arity):
    """(root, siblings of each node bottom up with their places)."""
    groups, proofs, level = [[i] for i in range(len(nodes))], [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        up, joined = [], []
        for i in range(0, len(level), arity):
            own = level[i : i + arity]
            for k in range(len(own)):
                for leaf in groups[i + k]:
                    proofs[leaf].append((own[:k], own[k + 1 :]))
            up.append(h(*own))
            joined.append([x for g in groups[i : i + arity] for x in g])
        level, groups = up, joined
    return level[0], proofs


def manifest(rows, arity=2):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r, leaf_of(r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        own = by[lang] = sorted(by[lang], key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        done[lang] = tree([leaf for _, leaf in own], arity)
    root, over = tree([done[x][0] for x in langs], arity) if langs else (None, [])
    out = []
    for k, lang in enumerate(langs):
        for (r, leaf), inner in zip(by[lang], done[lang][1], strict=True):
            proof = inner + over[k]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf_of(r, 1) if hit else leaf
            for before, after in proof:
                now = h(*before, now, *after)
            out.append((r["doc_id"], leaf, done[lang][0], root, h(*[x for b, a in proof for x in (*b, *a)]), now, now == root))
    return out


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query_matches_plain_python(spark, sf_dir, documents):
    got = [tuple(r) for r in queries.op13_merkle(spark, sf_dir).collect()]
    want = manifest(rows_of(documents))
    assert sorted(got) == sorted(want) and 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize(("arity", "levels"), [(2, 2), (3, 1), (4, 3)])
def test_strips_of_any_size(spark, documents, arity, levels):
    """Many strips over groups of one row, of two and of many."""
    docs = documents.limit(80).withColumn("lang", F.expr("case when doc_id = 3 then null when doc_id in (5, 9) then 'é' when doc_id < 20 then '' else lang end"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    leaves = docs.select("doc_id", "lang", merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    found = merkle.manifest(leaves, "lang", "doc_id", arity, levels)
    proof = F.concat(merkle.siblings(F.col("path"), F.col("pos"), arity), merkle.siblings(F.col("over"), F.col("g"), arity))
    back = merkle.refolded(merkle.refolded(F.col("leaf"), F.col("path"), F.col("pos"), arity), F.col("over"), F.col("g"), arity)
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256), back).collect()
    want = {w[0]: w for w in manifest(rows_of(docs), arity)}
    assert len(got) == 80
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and r[5] == r.root


def test_awkward(spark, nasty):
    got = [tuple(r) for r in merkle.tampered(nasty).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(manifest(rows_of(nasty)), key=key)
    assert merkle.tampered(nasty.limit(0)).count() == 0
    one = nasty.where("doc_id = 4")
    (r,) = merkle.tampered(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h()


def test_a_third_of_rows_equal(spark):
    rows = [(i if i % 3 else -1, None, "en" if i % 3 else "de", 3, "abc") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(tuple(r) for r in merkle.tampered(docs).collect()) == sorted(manifest(rows_of(docs)))


def test_every_changed_field_is_seen(spark, documents):
    docs = documents.limit(20)
    for c, v in (("text", F.concat("text", F.lit(" "))), ("source", F.lit(None).cast("string")), ("lang", F.lit("xx")), ("doc_id", F.col("doc_id") + 1000)):
        assert [r.verified for r in merkle.verify(docs, {c: v}, F.lit(True)).collect()] == [False] * 20


def test_sql(sf_dir):
    """The SQL against plain Python, too, so that the three agree."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = con.execute(queries.SQL["op13_merkle"]).fetchall()
    rows = con.execute("select doc_id, source, lang, n_chars, text from documents")
    names = [d[0] for d in rows.description]
    assert sorted(got) == sorted(manifest([dict(zip(names, r, strict=True)) for r in rows.fetchall()]))
