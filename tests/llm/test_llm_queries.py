"""Registered queries against their SQL on the smallest tables, and the pipeline against its operators."""

import os

import duckdb
import pytest

from catalith.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in registry.QUERIES[name](spark, DATA).collect()) == want


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = registry.table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert final == {r["doc_id"] for r in docs.collect()}


def test_stages_against_plain_python(spark):
    """Null, repeated and equal ids, copies, leaks, personal data: each stage's rows by all pairs, patterns and the library."""
    import random

    import sentencepiece

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from catalith.llm import pii_crf

    r = random.Random(1)
    word = lambda: "".join(r.choices(["an", "ber", "co", "de", "er", "fi", "ga"], k=r.randint(2, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    base, copied = text(80), text(70)
    rows = [(k, text(r.randint(30, 90))) for k in range(80)]
    rows += [(100, base), (101, base), (101, base), (101, base + " end"), (None, base + " more"), (None, copied), (None, copied), (None, text(40)), (None, None), (102, None), (103, ""), (104, "few words")]
    rows += [(105, " ".join(w + "###" for w in text(50).split())), (None, " ".join(w + "$$$" for w in text(50).split())), (105, text(60))]
    rows += [(106, text(20) + " " + leak + " " + text(20)), (None, text(25) + " " + leak), (107, text(30) + " mail a.b@c.example now +1 (212) 555-0100"), (7, rows[7][1])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], columns)
    stages, read = dict(corpus_pipeline.STAGES), lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)

    good = [(k, t) for k, t in rows if t and len(t.split()) >= 10 and "###" not in t and "$$$" not in t]
    kept = stages["quality rules"](spark, docs, DATA)
    assert read(kept) == sorted(good, key=str)

    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    left = []
    for k, t in sorted(good, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        near = [u for _, u in left if 100 * len(shingles(t) & shingles(u)) >= 75 * len(shingles(t) | shingles(u))]
        if not near:
            left.append((k, t))
    unique = stages["n-gram Jaccard join"](spark, kept, DATA)
    assert read(unique) == sorted(left, key=str) and len(left) == len(good) - 6

    clean = [(k, t) for k, t in left if leak not in t]
    found = stages["benchmark decontamination"](spark, unique, DATA)
    assert read(found) == sorted(clean, key=str) and len(clean) == len(left) - 2

    redacted = [(k, t.replace("a.b@c.example", "<email>").replace("+1 (212) 555-0100", "<phone>")) for k, t in clean]
    private = stages["PII"](spark, found, DATA)
    assert read(private) == sorted(redacted, key=str) and any("<phone>" in t for _, t in redacted)
    assert all(x["n_chars"] == len(x["text"]) for x in private.collect()) and private.columns == docs.columns
    assert pii_crf.base_spans(redacted[-1][1]) == []

    library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
    tokens = stages["SentencePiece"](spark, private, DATA).collect()
    assert sorted(str((x["doc_id"], x["n_tokens"])) for x in tokens) == sorted(str((k, len(library.encode(t)) + 1)) for k, t in redacted)

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
