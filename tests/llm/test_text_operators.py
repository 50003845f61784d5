"""The text operators against plain Python and the public libraries, on rows that hurt."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from catalith.llm import (
    partenum_join,
    pii_crf,
    quality_mcd,
    secret_scan,
    sentencepiece_bpe,
    substring_dedup,
    template_decontam,
    textkit,
    token_store,
)
from catalith.llm.textkit import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    out = defaultdict(list)
    for row in df.collect():
        out[row["doc_id"]].append(tuple(row[c] for c in columns))
    return {k: sorted(v, key=str) for k, v in out.items()}


def expected(rows, function):
    out = defaultdict(list)
    for row in rows:
        out[row[0]].append(function(row))
    return {k: sorted(v, key=str) for k, v in out.items()}


# ------------------------------------------------------------ op3


def test_token_store(spark, edge_docs, edge_rows, no_docs):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ordered = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, defaultdict(list)
    for row in ordered:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [2]
        want[row[0]].append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    store = token_store.write_store(edge_docs, P.path("word_bpe_49k.json"), shared_dir(spark, "t"), 2)
    found = token_store.read_store(spark, store, token_store.document_keys(edge_docs))
    assert by_id(found, "start", "n_tokens", "ids_crc32") == {k: sorted(v, key=str) for k, v in want.items()}
    unknown = spark.createDataFrame([(10**6 + k, 0) for k in range(200)], "doc_id long, repeat long")
    assert token_store.lookup(store, unknown).count() == 0
    empty = token_store.write_store(no_docs, P.path("word_bpe_49k.json"), shared_dir(spark, "t"), 2)
    assert token_store.read_store(spark, empty, token_store.document_keys(no_docs)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 5000])
def test_perfect_hash_is_minimal(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    _, slots = token_store.perfect_hash(h)
    assert sorted(slots.tolist()) == list(range(n))
    # Keys of one bucket share a remainder.
    _, slots = token_store.perfect_hash(h // np.uint64(12) * np.uint64(12) + np.uint64(5))
    assert sorted(slots.tolist()) == list(range(n))


def test_buckets_with_equal_hashes_get_a_seed():
    """Two keys of one 64-bit hash are told apart by their fingerprints; the first seed does not, so another is stored."""
    h = np.array([5, 5, 9], dtype=np.uint64)
    fingerprint = np.array([1, 2, 3], dtype=np.uint64)
    assert len(np.unique(token_store.seeded(h, fingerprint, 0))) == 2
    again = token_store.seeded(h, fingerprint, 1)
    assert len(np.unique(again)) == 3 and sorted(token_store.perfect_hash(again)[1].tolist()) == [0, 1, 2]


def test_word_encoder_equals_the_library_on_odd_words():
    import random

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, encoder, r = Tokenizer.from_file(path), token_store.encoder(path, 2), random.Random(2)
    parts = "a 's ' '' don't STOP'RE É ß İ ſ e\u0301 =\u0338 1 ٣ 12 . ... <|startoftext|> <|EndOfText|> <|endoftext|> <| |> x 漢 😀 \x00 \x1c Ω ÿ ÷ × µ K".split(" ")
    parts += [" ", "  ", "\n", "\u00a0"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(5000)] + [None]
    ids, counts = encoder.encode_all(pa.array([None, "", "x", *texts]).slice(3))
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="white space"):
        token_store.WordEncoder(P.path("byte_bpe_50k.json"), 2)


# ------------------------------------------------------------ op4


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at, covered = defaultdict(list), set()
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    for starts in at.values():
        if len(starts) > 1:
            covered.update(k for i in starts for k in range(i, i + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_counts(edge_docs, edge_rows, no_docs):
    got = by_id(quality_mcd.assess(edge_docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == expected(edge_rows, lambda r: base_counts(r[1]))
    assert quality_mcd.assess(no_docs).count() == 0


def mcd(z):
    """The estimate of one group in numpy: three starts, concentration, least determinant, one reweighting."""
    grid, guard = quality_mcd.GRID, np.eye(4) * quality_mcd.GUARD
    moments = lambda x: (x.mean(0), np.cov(x.T, bias=True))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c + guard), z - m)
    center = np.quantile(z, 0.5, axis=0)
    spread = np.diag((1.4826 * np.quantile(np.abs(z - center), 0.5, axis=0)) ** 2)
    found = []
    for start in ((center, spread), (center, np.eye(4)), moments(z)):
        least = np.inf
        while True:
            place = np.floor(distance(*start) * (1 << 20))
            start = moments(z[place <= np.quantile(place, quality_mcd.H)])
            now = np.linalg.slogdet(start[1] + guard)[1]
            if now > least - 1e-9:
                break
            least = now
        found.append((now, start))
    m, c = min(found, key=lambda f: f[0])[1]
    m, c = moments(z[distance(m, c * quality_mcd.CONSISTENCY) <= quality_mcd.WITHIN])
    return m, c * quality_mcd.WITHIN_CONSISTENCY, distance(m, c * quality_mcd.WITHIN_CONSISTENCY)


def test_mcd_equals_numpy_and_resists_outliers(spark):
    """Groups of normal data with a tenth of far rows: the estimates are those of the rest, distances near chi-square."""
    r, rows, groups = np.random.default_rng(5), [], {}
    for g, shift in (("a", 6.0), ("b", -9.0), ("c", 0.0)):
        z = r.normal(size=(1500, 4)) @ (r.normal(size=(4, 4)) * 0.4) + 5
        z[:150] += shift
        q = np.floor(64 * z + 0.5).astype(int)
        groups[g] = q / 64
        rows += [(g, *map(int, x)) for x in [*q, q[0]]] if g == "c" else [(g, *map(int, x)) for x in q]
        groups[g] = np.r_[groups[g], groups[g][:1]] if g == "c" else groups[g]
    vectors = spark.createDataFrame(rows, "g string, z0 long, z1 long, z2 long, z3 long").groupBy("g", "z0", "z1", "z2", "z3").count().withColumnRenamed("count", "n")
    got = {x["g"]: x for x in quality_mcd.estimate(vectors).collect()}
    for g, z in groups.items():
        m, c, d = mcd(z)
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], m, atol=1e-9)
        assert np.allclose([got[g][f"c{i}_{j}"] for i, j in quality_mcd._PAIRS], [c[i, j] for i, j in quality_mcd._PAIRS], atol=1e-9)
        d = d[150:]
        assert 3.0 < np.median(d) < 3.7 and 7.0 < np.quantile(d, 0.9) < 8.6
        assert np.median(mcd(z)[2][:150]) > quality_mcd.CUTOFF or g == "c"


def test_quality_rejects_symbol_junk(spark):
    r, rows = np.random.default_rng(5), []
    for k in range(300):
        w = ["".join(r.choice(list("abcdefgh"), r.integers(3, 8))) for _ in range(int(r.integers(30, 200)))]
        rows.append((k, " ".join(x + "###" * (k % 10 == 0) for x in w) + " | $" * (k % 7 == 0), "en", "s"))
    rows += [(1000, " ".join(["abcde"] * 3 + [f"abcd{i}" for i in range(20)]), None, None), (1001, "too few words", "", "")]
    out = {x["doc_id"]: x for x in quality_mcd.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(k for k, x in out.items() if not x["kept"]) == [*range(0, 300, 10), 1001]


def test_quality_base_counts_equal_their_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.execute(quality_mcd.BASE_SQL.replace("FROM documents", f"FROM '{path}'")).fetchall()
    out = quality_mcd.base_counts(spark.read.parquet(path))
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_quality_small_groups_use_all_documents_of_the_wider_level(spark, monkeypatch):
    """One junk document that is alone in its source, or in its language, beside large sources; joins by salted keys."""
    monkeypatch.setattr(textkit, "BROADCAST_ROWS", 0)
    r = np.random.default_rng(6)
    text = lambda junk=False: " ".join("".join(r.choice(list("abcdefgh"), r.integers(3, 8))) + "###" * junk for _ in range(60))
    rows = [(k, text(), "en" if k % 2 else "de", "big") for k in range(200)]
    rows += [(200, text(True), "en", "alone"), (201, text(), "en", "other"), (202, text(True), "fr", "lone"), (203, text(), "it", "lone")]
    out = {x["doc_id"]: x for x in quality_mcd.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(k for k, x in out.items() if not x["kept"]) == [200, 202]


# ------------------------------------------------------------ op5


def test_substring_dedup(edge_docs, edge_rows, no_docs):
    first = {}
    key = lambda d: -1 if d is None else d
    cut = [(key(r[0]), WORD.findall(r[1] or "")) for r in edge_rows]
    for d, w in cut:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = defaultdict(list)
    for d, w in cut:
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[None if d < 0 else d].append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = by_id(substring_dedup.remove_repeats(edge_docs), "n_words", "n_removed", "kept_sha256")
    assert got == {k: sorted(v, key=str) for k, v in want.items()}
    assert any(v[0][1] for v in got.values())
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_cover_meets_every_shift():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            assert any((a + s) % 7 in substring_dedup.COVER and (b + s) % 7 in substring_dedup.COVER for s in range(7))


# ------------------------------------------------------------ op6


def test_template_decontam(spark, no_docs):
    item = "In total Anna Berg bought 12 apples and Anna Berg sold 5 kg of them to the shop before noon"
    other = "the quick brown fox jumps over the lazy dog while the sleepy cat watches from a distance"
    docs = [
        (1, "Before. " + item + " after that"),
        (2, "So: in total Otto Kern bought 31 apples and Otto Kern sold 9 kg of them to the shop before noon."),
        (3, "So: in total Otto Kern bought 31 apples and Ida Voss sold 9 kg of them to the shop before noon."),
        (4, "nothing of the kind is written in this one at all really"),
        (5, None), (6, ""), (7, "short text"), (8, other.upper()), (8, other.upper()),
    ]
    items = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "too short")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in template_decontam.leaks(table, items).collect()}
    assert found == {(1, 10): True, (2, 10): False, (8, 11): True}
    assert sorted(r["doc_id"] for r in template_decontam.decontaminate(table, items).collect()) == [3, 4, 5, 6, 7]
    assert template_decontam.leaks(no_docs, items).count() == 0
    assert template_decontam.leaks(table, items.limit(0)).count() == 0


def test_template_decontam_finds_copies_beside_changes_and_of_dense_and_short_items(spark):
    plain = " ".join(f"{w}" for w in "a long story about the river and its many old bridges that people cross each day".split())
    long = f"She paid 7 coins there. {plain} and then she paid 7 coins again to them"
    dense = "Der Lehrer Hans Maier kauft 12 Hefte und 8 Stifte fuer 20 Euro"
    items = spark.createDataFrame([(1, long), (2, dense), (3, "who wrote the first book?"), (4, "Paris")], "item_id long, text string")
    docs = [
        (1, long.replace("7 coins again", "9 coins again")), (2, "Hier: " + dense + " heute"), (3, dense.replace("12", "13").replace("8", "9")),
        (4, "Tell me who wrote the first book and when"), (5, "who wrote a first book"), (6, "paris."), (7, "They live in Paris now"),
    ]
    found = template_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 2), (4, 3), (6, 4)]
    assert all(r["exact"] for r in found)


def test_template_decontam_equals_its_sql_on_edge_rows(spark, edge_docs, edge_rows):
    """Dense, short, changed and plain items against long, empty, null and marked texts with clashing columns."""
    import random

    import duckdb

    r = random.Random(3)
    words = "He paid 12 euros to Anna Berg, and (maybe) 5 kg of $3.50 tea! Was 7kg 8 min 40% far? --- * $ x. Then Otto 1,000 km".split()
    items = [" ".join(r.choices(words, k=k)) for k in (3, 5, 7, 8, 9, 14, 30) for _ in range(4)] + ["Compute 12 plus 7 minus 4 times 9 over 3 equals 25", "alone", None, "", edge_rows[7][1]]
    texts = [f"{' '.join(r.choices(words, k=5))} {t or ''} {' '.join(r.choices(words, k=5))}" for t in items] + items
    texts += [(t or "").replace("12", "13").replace("Anna", "Ida") for t in items]
    docs = [(1000 + k, t) for k, t in enumerate(texts)] + [(d[0], d[1]) for d in edge_rows[:-2]]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    connection.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(items)))
    cursor = connection.execute(template_decontam.SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as at", "'x' as item_id")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "'y' as doc_id")
    got = sorted(tuple(x[c] for c in names) for x in template_decontam.leaks(table, benchmark).collect())
    assert got == want and len(want) > 60
    rest = template_decontam.decontaminate(table, benchmark)
    assert rest.columns == table.columns and {x["doc_id"] for x in rest.collect()} == {d[0] for d in docs} - {w[names.index("doc_id")] for w in want}


def test_release_removes_this_applications_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textkit, "checkpoint_root", lambda _: f"file://{tmp_path}")
    textkit.cut(spark.range(3).toDF("x"))
    assert textkit.release(spark) == 1 and textkit.release(spark) == 0


# ------------------------------------------------------------ op7


def test_sentencepiece(edge_docs, edge_rows, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def one(row):
        ids = library.encode(row[1] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids) + 1, sha(" ".join(map(str, [*ids, 2]))), sha(library.decode(ids))

    got = by_id(sentencepiece_bpe.encode_decode(edge_docs, P.path("piece_bpe_32k.model")), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == expected(edge_rows, one)
    assert sentencepiece_bpe.encode_decode(no_docs, P.path("piece_bpe_32k.model")).count() == 0


def test_merge_rounds_on_random_strings():
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    codec = sentencepiece_bpe.codec(P.path("piece_bpe_32k.model"))
    r = random.Random(1)
    parts = [" ", "   ", "\n", "▁", "a", "aa", "the", "ing", "é", "😀", "\x00", "漢", "<0x0A>", "</s>", "abab"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(1500)] + ["a" * 700, " " * 301, "ab" * 300]
    for text, (ids, _, decoded) in zip(texts, codec.encode_all(texts), strict=True):
        plain = library.encode(text)
        assert ids == " ".join(map(str, [*plain, 2])) and decoded.decode("utf-8", "replace") == library.decode(plain)


# ------------------------------------------------------------ op8


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_partenum_join(edge_docs, edge_rows, no_docs):
    rows = [r for r in edge_rows if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(partenum_join.link_documents(edge_docs.filter("doc_id is not null")), "n_shingles", "component_id")
    assert got == expected(rows, lambda r: (len(sets[r[0]]), find(r[0])))
    assert partenum_join.link_documents(no_docs).count() == 0
    assert partenum_join.link_documents(edge_docs).filter("doc_id is null").count() == 1


@pytest.mark.parametrize("size", [1, 2, 5, 20, 63, 64, 65, 150, 300, 900])
def test_linked_sets_share_a_signature(size):
    """Sets at exactly the threshold share a part in the larger one's band."""
    r = np.random.default_rng(size)
    for _ in range(20):
        larger = r.integers(0, 2**64, size, dtype=np.uint64)
        least = -(-3 * size // 4)
        smaller = larger[: int(r.integers(least, size + 1))]
        row = np.repeat([0, 1], [len(larger), len(smaller)])
        sizes = np.array([len(larger), len(smaller)])
        rows, up, sig = partenum_join.signatures(row, np.r_[larger, smaller], sizes)
        assert set(sig[(rows == 0) & (up == 0)]) & set(sig[rows == 1])


def linked(texts):
    """(component, number of linked distinct sets) of each text, by all pairs."""
    sets = [shingles(t) for t in texts]
    near = [{frozenset(y) for y in sets if y != x and 100 * len(x & y) >= 75 * len(x | y)} for x in sets]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if frozenset(sets[j]) in near[i] or sets[j] == x:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {k: [(root[k], len(near[k]))] for k in range(len(sets))}


def test_partenum_join_in_large_buckets(spark):
    """A passage of 200 long-tailed documents and a few short-tailed ones: only the latter link."""
    new = iter(range(10**6))
    tail = lambda n: " ".join(f"t{next(new)}" for _ in range(n))
    texts = []
    for p in range(3):
        passage = " ".join(f"p{p}x{k}" for k in range(38))
        texts += [f"{passage} {tail(13)}" for _ in range(200)] + [f"{passage} {tail(2)}" for _ in range(2)]
    got = by_id(partenum_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "component_id", "n_links")
    want = linked(texts)
    assert got == want and sum(n for [(_, n)] in want.values()) == 6


def test_partenum_join_counts_all_links(spark):
    """Near copies in more than one block, whose chains leave most pairs unlinked or link them all."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[:k], f"x{n}", *words[k + 1 :]]) for n in range(4) for k in range(0, 120, 2)]
    texts += [" ".join(f"w{k}" for k in range(s, s + 100)) for s in range(500, 800, 3)] + [texts[0], texts[0]]
    texts += [" ".join([*words[:40], f"y{n}", *words[41:]]) for n in range(80)]
    got = by_id(partenum_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "component_id", "n_links")
    assert got == linked(texts)


# ------------------------------------------------------------ op9, op10


def test_secret_scan(spark, no_docs):
    hexa, key = "0123456789abcdef01234567", "AKIA" + "ABCD2345" * 2
    rows = [
        (1, None), (2, ""), (3, f'é {key} and token = "{hexa}" x'), (4, "password=abc and token=token:abcdefgh"),
        (5, "Api_Key: Zx9Qw7Lk2Pv5Rt8Yb3Nm6Hc1Jd4Gf0Sa"), (6, "see qJ8vX2mZ7kL4wP9tR6yB3nH5cD1gF0sA1uE here"),
        (7, "550e8400-e29b-41d4-a716-446655440000 and D41D8CD98F00B204E9800998ECF8427E and 12345678901234567890123"),
        (8, "international-organisation-of-standards is_a_long_identifier_2024"),
    ]
    out = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert [out[3][c] for c in ("n_assign", "n_access", "n_hex")] == [1, 1, 1]
    assert out[3]["spans"] == f"access:2:{2 + len(key)},assign:27:{36 + len(hexa)},hex:36:{36 + len(hexa)}"
    assert out[3]["base_sha256"] == hashlib.sha256(out[3]["spans"].encode()).hexdigest()
    assert out[4]["n_assign"] == 0 and out[5]["n_assign"] == 1
    assert out[6]["spans"] == "random:4:39" and out[6]["n_random"] == 1
    assert all(out[k]["spans"] == "" for k in (1, 2, 7, 8))
    assert secret_scan.scan(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_pii_patterns(spark, no_docs):
    rows = [
        (1, None), (2, ""), (3, "é mail a.b@x-y.example.com, ip 10.0.0.255 or 10.0.0.256"), (4, "card 4111 1111 1111 1111 and 4111111111111112"),
        (5, "phone +1 (212) 555-0100 end"), (6, "Plain prose without anything.\nAnother line"),
    ]
    out = {r["doc_id"]: r for r in pii_crf.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3]["spans"] == "email:7:26,ip:31:41" and (out[3]["n_email"], out[3]["n_ip"]) == (1, 1)
    assert out[4]["n_card"] == 1 and out[5]["n_phone"] == 1 and out[5]["spans"].startswith("phone:6:23")
    assert all(out[k]["spans"] == "" for k in (1, 2, 6))
    assert pii_crf.scan(no_docs).count() == 0


def test_crf_on_held_out_lines():
    model = pii_crf.default_model()
    held = pii_crf.training_table(size=300, seed=99)
    words = [w for line, _ in held for w in line]
    first = np.cumsum([0] + [len(line) for line, _ in held])
    got = [pii_crf.LABELS[k] for k in model.decode(model.classes(words), first)]
    want = [x for _, labels in held for x in labels]
    right = sum(a == b for a, b in zip(got, want, strict=True)) / len(want)
    missed = sum(b != "O" and a == "O" for a, b in zip(got, want, strict=True)) / sum(b != "O" for b in want)
    assert right > 0.98 and missed < 0.1


def test_viterbi_is_exact():
    """Decoding by batches against all paths, on short lines."""
    from itertools import product

    model = pii_crf.default_model()
    lines = [words[:5] for words, _ in pii_crf.training_table(size=60, seed=5)]
    classes = model.classes([w for line in lines for w in line])
    first = np.cumsum([0] + [len(line) for line in lines])
    got = model.decode(classes, first)
    table, edge = np.stack(model._tables), model.weights[:, -1]
    for k in range(len(lines)):
        c = classes[first[k] : first[k + 1]]
        emit = np.array([
            table[c[t], 0] + (table[c[t - 1], 1] if t else edge[1]) + (table[c[t + 1], 2] if t + 1 < len(c) else edge[2]) for t in range(len(c))
        ])
        score = lambda p: model.begin[p[0]] + sum(emit[t, x] for t, x in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        best = max(score(p) for p in product(range(3), repeat=len(c)))
        assert score(got[first[k] : first[k + 1]].tolist()) == pytest.approx(best)


HELD_OUT = """
Ring me on [0161 496 0423] after lunch.
His cell is [(212) 555-0156], the desk knows.
Dial [646-555-0111] for the guard.
phone: [555-0163]
Marque [611 222 333] si llega tarde.
Tel: [04 91 22 33 44] ou au guichet.
Handy: [0172 5550123]
Das Fax [0221 987654] ist neu.
Number [457-55-5462] was on the card.
ssn [321-54-9876]
passport: [C4567890B]
NIF: [23456789D]
IBAN: [NL91 ABNA 0417 1643 00]
Pay into [CH93 0076 2011 6238 5295 7] today.
Bitte [DE12500105170648489890] nutzen.
Name: [Ruth Keller] and friends
Nombre: [Pedro Lopez]
Herr [Otto Lang] ging fort.
account: [00987654321]
The play opened on 2018-11-02 with 340 guests.
Invoice 55021 lists 7 items at $89 each.
Release 3.4.1 closed 27 issues.
The Old Bridge near Green Valley fell in 1911.
Chapters 12-15 and figure 4.5 were cut.
They won 21-14 in week 9.
Serial 7781-C was scrapped in 1999.
La obra de 1605 tiene 52 capítulos.
Der Band von 1790 kostet 12 Taler.
"""


def test_crf_on_held_out_written_lines():
    """Lines of other wording, names and numbers than those trained on: spans found and missed."""
    model, rows = pii_crf.default_model(), pii_crf.labelled_lines(HELD_OUT)
    texts = [" ".join(words) for words, _ in rows]
    want = set()
    for k, (words, labels) in enumerate(rows):
        at = np.cumsum([0, *(len(w) + 1 for w in words)])
        begins = [i for i, x in enumerate(labels) if x == "B"]
        for i in begins:
            j = i + 1
            while j < len(labels) and labels[j] == "I":
                j += 1
            want.add((k, int(at[i]), int(at[j - 1]) + len(words[j - 1].rstrip(".,;:!?"))))
    got = {(k, a, b) for k, spans in enumerate(model.spans(texts)) for _, a, b in spans}
    assert len(want) == 19 and len(want & got) >= 17 and len(got - want) <= 2
    # A line that begins inside a span begins one of its own; many spans in one text stay cheap.
    whole = "\n".join(texts)
    assert len(model.spans([whole])[0]) == len(got)
    assert len(model.spans(["\n".join(["tel: 555-0147"] * 20_000)])[0]) == 20_000


def test_outside_equals_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(200):
        make = lambda n: [("x", int(a), int(a + b)) for a, b in zip(r.integers(0, 60, n), r.integers(1, 9, n), strict=True)]
        spans, others = make(10), make(int(r.integers(0, 10)))
        assert secret_scan.outside(spans, others) == [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in others)]


def test_token_efficiency_on_keys_and_identifiers():
    import random
    import string

    r, model = random.Random(11), secret_scan._model(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    letters = string.ascii_letters + string.digits
    alphabets = {letters: (16, 20, 32), letters + "+/": (40, 64), string.ascii_uppercase + "234567": (32,), string.ascii_lowercase + string.digits: (24,), string.ascii_letters: (24,)}
    keys = ["".join(r.choices(a, k=n)) for a, sizes in alphabets.items() for n in sizes for _ in range(100)]
    parts = "get user name list http request parse config value index table spark window batch stream token reader model layer block".split()
    other = []
    for _ in range(400):
        chosen = r.choices(parts, k=r.randint(3, 6))
        other += ["_".join(chosen), "".join(map(str.capitalize, chosen)), "/".join(chosen) + str(r.randint(0, 99)), "-".join(chosen) + "-2024", chosen[0] + "".join(map(str.capitalize, chosen[1:])) + "V2"]
    found = lambda text: bool(secret_scan.random_spans(text, model, 1.8))
    hits, false = sum(map(found, keys)), sum(map(found, other))
    assert hits / len(keys) > 0.95 and hits / (hits + false) > 0.98


def test_base_spans_equal_plain_scans(edge_rows):
    """Base kinds by scanning with single patterns and checking every match by hand."""
    import random

    r = random.Random(8)
    parts = ["a.b@c.de", "@", ".", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+12", " ", "\n", "é", "password=", "token: ", '"', "abcdef12", "AKIA" + "A1" * 8, "AKIAXY", "0123456789abcdef01234567", "f" * 23, "API-KEY=", "api_key='zzzzzzz'"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(800)] + [row[1] or "" for row in edge_rows]

    def luhn(digits):
        doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(digits[::-1])]
        return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    personal = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9](?:[ -]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
    ]
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    secret = [
        ("assign", rf"(?:{word})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for text in texts:
        for function, kinds in ((pii_crf.base_spans, personal), (secret_scan.base_spans, secret)):
            assert sorted(function(text)) == sorted((k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m))


def test_scans_of_edge_rows(spark, edge_docs, edge_rows):
    """Nulls, repeated rows, long texts and clashing columns: one row for every row."""
    for out in (secret_scan.scan(edge_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), pii_crf.scan(edge_docs)):
        assert sorted(str(x["doc_id"]) for x in out.select("doc_id").collect()) == sorted(str(r[0]) for r in edge_rows)


def test_personal_patterns_equal_their_regular_expressions():
    import re

    email, address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    r = random.Random(12)
    for alphabet in ("a@.", "a_@.-é", "1.", "12.9@ ", "0.a"):
        for _ in range(3000):
            text = "".join(r.choices(alphabet, k=r.randint(1, 24)))
            want = [("email", *m.span()) for m in re.finditer(email, text)]
            want += [("ip", *m.span()) for m in re.finditer(address, text) if all(int(p) <= 255 for p in m[0].split("."))]
            assert [s for s in pii_crf.base_spans(text) if s[0] in ("email", "ip")] == want, text


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6, "a@" * 500_000, "1." * 500_000, "0" * 5_000 + ".1.2.3", "+" * 10**6, "+1(" * 300_000, "1 " * 500_000, "a." * 400_000 + "@b.c", "1-" * 500_000], ids=range(10))
def test_personal_patterns_take_linear_time(text):
    began = time.perf_counter()
    spans = pii_crf.base_spans(text)
    assert time.perf_counter() - began < 3
    assert ("ip", 0, 5_006) in spans if text.endswith(".1.2.3") else True


def test_rows_without_an_id_lie_in_many_chunks(spark, monkeypatch):
    r = random.Random(14)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 9))
    passage = [word() for _ in range(30)]
    rows = [(None if k % 2 else 5, " ".join([*(word() for _ in range(20)), *(passage if k % 3 == 0 else [])])) for k in range(90)] + [(1, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.select(substring_dedup.chunk_of(8).alias("c")).distinct().count() == 8
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1000)
    found = substring_dedup.remove_repeats(docs).collect()
    order = lambda k: -1 if k is None else k  # noqa: E731  a missing id sorts before all others
    least: dict[tuple, int] = {}
    for k, text in rows:
        words = text.split()
        for i in range(len(words) - 12):
            w = tuple(words[i : i + 13])
            least[w] = min(order(k), least.get(w, order(k)))
    want = []
    for k, text in rows:
        words, gone = text.split(), set()
        for i in range(len(words) - 12):
            if least[tuple(words[i : i + 13])] < order(k):
                gone |= set(range(i, i + 13))
        want.append((k, len(words), len(gone)))
    assert sorted(map(str, want)) == sorted(str((x["doc_id"], x["n_words"], x["n_removed"])) for x in found) and sum(w[2] for w in want) > 400
