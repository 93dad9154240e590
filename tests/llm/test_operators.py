"""Edge cases of every operator, and brute force where SQL can't express it."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, fingerprints, line_dedup, mixing, near_dup, nearest, quality, token_files, toxicity, url_filter
from tilewright.llm.links import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id string, size string, class_id string"
LONG = " ".join(f"word{i % 977} other{i % 131}" for i in range(30000))
PASSAGE = " ".join(f"alpha{i}" for i in range(60))


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, "x", None, "y", None)


ROWS = [
    row(1, None), row(2, ""), row(3, " \n \t\n"), row(4, LONG, "b"), row(5, PASSAGE, None), row(6, PASSAGE, "b"), row(6, PASSAGE, "b"), row(7, PASSAGE + " tail", "a"),
    row(None, "no id here at all, but text enough", None), row(8, "one"), row(9, f"first line of some length\n{PASSAGE}\nlast line of some length", "c"), row(10, "日本語のテキスト😀é\nIDIOT idiot", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, none):
    assert fingerprints.fingerprints(none).count() == 0
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[1].fingerprint == by[2].fingerprint
    assert by[7].near_next == pytest.approx(by[7].near_next) and 0 <= by[7].near_edited <= 1
    order = sorted({r[0] for r in ROWS if r[0] is not None}, reverse=True) + [None]
    text = {r[0]: r[1] or "" for r in ROWS}
    for i, d in enumerate(order):
        t, n = text[d], text[order[(i + 1) % len(order)]]
        k = len(t) // 3
        assert by[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert by[d].n_chars == len(t)
    assert by[6].near_next == 1.0  # doc 5 follows and is equal


def test_difference_recovers_digests(spark):
    a, b = list(range(0, 4000, 7)), list(range(0, 4000, 5))
    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    assert frame.select(fingerprints.differing(F.col("a"), F.col("b"))).first()[0] == len(set(a) ^ set(b))
    few = frame.select(fingerprints.difference(F.slice("a", 1, 20), F.slice("a", 3, 20)).alias("g"), F.array_union(F.slice("a", 1, 2), F.slice("a", 21, 2)).alias("want")).first()
    assert few.g.done and {f.k for f in few.g.found} == set(few.want)


def test_token_files(docs, none, tmp_path):
    from tokenizers import Tokenizer

    assert token_files.read_tokens(token_files.write_tokens(none)).count() == 0
    got = token_files.read_tokens(token_files.write_tokens(docs)).collect()
    library = Tokenizer.from_file(token_files.default_tokenizer())
    want, at = [], 0
    for d, t in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_blocks_and_checkpoints():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 70000), 49407).astype(np.uint32)
    symbols, freq = token_files.frequency_table(ids)
    assert freq.sum() == 1 << token_files.SCALE and freq.min() >= 1
    dense = np.searchsorted(symbols, ids)
    block = token_files.encode_block(dense, freq, np.cumsum(freq) - freq, zlib.crc32(ids.astype("<u4").tobytes()), lanes=64, every=100)
    assert (token_files.decode_block(block, symbols, freq) == ids).all()
    parts = [token_files.decode_block(block, symbols, freq, part=i) for i in range(-(-70000 // 64 // 100) + 1)]
    assert (np.concatenate(parts) == ids).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(broken), symbols, freq)


def test_mixing(docs, none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    total = {r.source_size: r.target for r in got}
    sizes, weights = sorted(total), None
    assert sum(total.values()) == pytest.approx(sum(sizes))
    taken = {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[s] - total[s]) <= 1 for s in sizes), weights
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))


def test_lines(docs, none):
    assert line_dedup.dedup_lines(none).count() == 0
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert by[1].text is None and by[2].text == "" and by[3].kept_lines == 0 and by[3].text == " \n \t\n"
    assert by[5].text == PASSAGE and by[6].text == "" and by[7].text == ""
    assert by[9].text == "first line of some length\nlast line of some length" and by[9].n_lines == 3


def test_lines_of_large_buckets(spark):
    """Every copy is alike to the one original and to no other copy, and the original isn't its bucket's heaviest line."""
    rng = np.random.default_rng(4)
    word = lambda *at: hashlib.md5(repr(at).encode()).hexdigest()[:12]
    places = []
    while len(places) < 120:
        p = set(rng.choice(40, 3, replace=False).tolist())
        if all(len(p & q) <= 1 for q in places):
            places.append(p)
    lines = [" ".join(word(k) for k in range(40)), *[" ".join(word(i, k) if k in p else word(k) for k in range(40)) for i, p in enumerate(places)]]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    sets = [set(r.s) for r in frame.orderBy("doc_id").select(line_dedup.shingles(F.col("text")).alias("s")).collect()]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[0], s) >= 0.8 for s in sets[1:]) and max(like(s, t) for i, s in enumerate(sets[1:]) for t in sets[1 : i + 1]) < 0.8
    # all but the copies that share no band with the original, about one in 200
    assert line_dedup.dedup_lines(frame).where("kept_lines > 0").count() <= 3


def test_line_shingles(spark):
    """Windows begin at every character, in unspaced text too, and one letter changed in a line of 10 to 25 words leaves it alike."""
    cases = ["A bc Def", "日本語のテキスト😀é", "abc", "abcde", "😀a"]
    frame = spark.createDataFrame(enumerate(cases), "i int, t string").orderBy("i")
    want = [[t.lower()[k : k + 5] for k in range(max(1, len(t) - 4))] for t in cases]
    got = frame.select(F.regexp_extract_all(F.lower("t"), F.lit(line_dedup.SHINGLE), F.lit(1)).alias("s")).collect()
    assert [r.s for r in got] == want
    rng = np.random.default_rng(6)
    lines = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n)) for n in range(10, 26) for _ in range(6)]
    edited = [s[: (k := int(rng.integers(len(s)))) ] + "#" + s[k + 1 :] for s in lines]
    texts = [(i, s) for i, s in enumerate(lines + edited)]
    left = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).where("kept_lines > 0").count()
    assert left <= len(lines) + 2  # a band is missed by about one pair in 200


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (10, 12), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert {roots[i] for i in (1, 2, 3, 4)} == {1} and {roots[i] for i in (10, 11, 12)} == {10} and {roots[i] for i in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(docs, none):
    assert near_dup.near_duplicates(none).count() == 0
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[5].class_id == by[6].class_id == by[7].class_id == by[9].class_id == 9  # all are held by the ninth
    assert by[1].class_id == by[2].class_id == by[3].class_id and by[4].kept and by[8].kept and by[10].kept
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 8, 9, 10]


def test_near_duplicates_against_brute_force(spark):
    """Sets held at 0.8 by sets of 4 to 100 times their size, alike sets, a shared passage: classes are those of a comparison of all pairs."""
    rng = np.random.default_rng(1)
    made = iter(range(1 << 30))
    words = lambda n: [f"w{next(made)}" for _ in range(n)]
    texts = []
    for size in (12, 40, 200):
        for ratio in (4, 20, 40, 100):
            for _ in range(4):
                a, b = words(size + 4), words(size * ratio)
                edited = list(a)
                for j in range(size // 25):  # each takes five shingles of `size`
                    edited[3 + 9 * j] = f"z{next(made)}"
                at = int(rng.integers(len(b)))
                texts += [edited, b[:at] + a + b[at:]]
    passage = words(80)
    for _ in range(150):
        a = passage + words(60)
        texts += [a, a[:100] + ["zz"] + a[101:]]
    for _ in range(40):  # alike to the first of them only
        base = texts[-1]
        texts.append([w if rng.random() > 0.004 else f"y{next(made)}" for w in base])
    texts = [" ".join(t) for t in texts]
    sets = [set(near_dup.shingle_hashes(t).tolist()) for t in texts]
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {i: got[i].class_id for i in got} == brute_classes(sets)
    assert all(got[i].kept == (got[i].class_id == i) for i in got)


def brute_classes(sets, t=near_dup.THRESHOLD):
    """The classes of near_duplicates for documents 0, 1, ... with these sets, all pairs compared."""
    n = len(sets)
    rank = [(len(s), -i) for i, s in enumerate(sets)]
    where = {}
    for i, s in enumerate(sets):
        for v in s:
            where.setdefault(v, []).append(i)
    shared = {}
    for i, s in enumerate(sets):
        count = {}
        for v in s:
            for j in where[v]:
                count[j] = count.get(j, 0) + 1
        shared[i] = count
    comp = list(range(n))

    def find(x, up):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j, k in shared[i].items():
            if k >= t * (len(sets[i]) + len(sets[j]) - k):
                comp[find(i, comp)] = find(j, comp)
    comp = [find(i, comp) for i in range(n)]
    head = {}
    for i in range(n):
        if comp[i] not in head or rank[i] > rank[head[comp[i]]]:
            head[comp[i]] = i
    tree = {c: c for c in head}
    for c, h in head.items():
        ways = [(k / len(sets[h]), rank[j], comp[j]) for j, k in shared[h].items() if comp[j] != c and k >= t * len(sets[h]) and rank[j] > rank[h]]
        if ways:
            tree[c] = max(ways)[2]
    top = {}
    for i in range(n):
        r = find(comp[i], tree)
        if r not in top or rank[i] > rank[top[r]]:
            top[r] = i
    return {i: top[find(comp[i], tree)] for i in range(n)}


def test_bpe(docs, none):
    assert byte_bpe.encode_documents(none).count() == 0
    import tiktoken

    coder = byte_bpe.bpe(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    exact = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={})
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in byte_bpe.encode_documents(docs).collect():
        ids = exact.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    ids = [i for i, _, _ in coder.offsets(text[10])]
    assert "".join(coder.decode_stream(ids)) == text[10] and coder.offsets(text[10])[-1][2] == len(text[10].encode())


def test_urls(spark):
    urls = ["http://a.NET/x", "http://m.example.net/en/1", "https://shop.example.com/de/2?q=1", "x.org/fr/1", "ftp://b.org/fr/9#t", None, "", "http://bad.example.org/p.html", "https://www.bad.example.org/p", "http://a.net"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict int")
    listed = spark.createDataFrame([("bad.example.org/p",), (None,), ("bad.example.org/p",)], "canonical string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert [got[i].rule for i in range(10)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(10)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert url_filter.filter_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12))
    x[100:160] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (None, [1.0] * 12), (2020, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard=300).collect()
    hit = total = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id]) for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(np.lexsort((np.arange(900), -s))[:20].tolist())), total + 20
    assert hit / total > 0.95
    assert not [r for r in got if r.query_id >= 2000]
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_classifiers(spark, docs, none):
    rng = np.random.default_rng(2)
    clean = lambda: " ".join(f"w{rng.integers(3000)}" for _ in range(40))
    texts = [(i, clean() + (" idiot scum" if i % 4 == 0 else "") + (" $$$ !!! ***" * 8 if i % 5 == 0 else "")) for i in range(600)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    index = toxicity.fit(frame, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(frame, index).collect()}
    assert np.mean([got[i] == int(i % 4 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.95
    net = quality.fit(frame, labels)
    got = {r.doc_id: r.predicted for r in quality.score_documents(frame, net).collect()}
    assert np.mean([got[i] == int(i % 5 > 0) for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.9
    for score in (toxicity.score_documents(docs, index, keep=tuple(docs.columns)), quality.score_documents(docs, net, keep=tuple(docs.columns))):
        assert all(0 <= r.score <= 1 for r in score.collect())
    empty = labels.limit(0)
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, empty)).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.score_documents(docs, toxicity.fit(docs, empty)).collect())
    assert toxicity.score_documents(none, index).count() == quality.score_documents(none, net).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    examples = [(i, int(rng.integers(2)), {int(t): int(rng.integers(1, 4)) for t in rng.choice(50, 5, replace=False)}) for i in range(400)]
    index = toxicity.Index([f"t{i}" for i in range(50)], np.linspace(1, 4, 50), examples)
    for d, _, c in examples[:40]:
        v = np.zeros(50)
        ts, ws = index.unit(c)
        v[ts] = ws
        want = []
        for e, _, o in examples:
            ts, ws = index.unit(o)
            if e != d and v[ts] @ ws > 0:
                want.append((-round(float(v[ts] @ ws), 12), e))
        assert [x for _, x, _ in index.nearest(index.unit(c), without=d)] == [e for _, e in sorted(want)[:15]]
