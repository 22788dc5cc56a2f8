"""Token counts, centroid clustering and divergence of sources, against plain versions, over odd rows and at other settings."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from terraframe.llm import clustering, divergence, token_counts
from terraframe.llm.kernels import text_buffers
from terraframe.llm.queries import tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
ODD_TEXTS = [
    None, "", " ", "\n\n  x", "don't we'll I've 's ''s 'S they're", "a b c", "tail  ", "x<|endoftext|> y", " <|endoftext|><|endoftext|>", "12 345,6 ²½", "été naïve — “quoted”",
    "日本語 and English", "\U0001f642 \U0001f642", "\x00\x01 a\x7fb", "a Жb c", "w" * 5000, "supercalifragilistic " * 3, "\t'll\r\n're x 't", "×÷ ª",
]


# -- token counts --


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(BYTE_BPE))


@pytest.fixture(scope="module")
def table():
    return token_counts.prove(tokenizer_path(BYTE_BPE))


def test_all_proven_strings_are_one_token(library, table):
    assert table.left_out == 0 and int((table.size > 0).sum()) > 50_000
    strings = [" the", "the", "zzqj", "é", " " * 16, "!"]
    data = "".join(strings).encode() + bytes(8)
    end = np.cumsum([len(s.encode()) for s in strings])
    held = table.hold(np.frombuffer(data, np.uint8), end - [len(s.encode()) for s in strings], end)
    assert held.tolist() == [len(library.encode(s).ids) == 1 for s in strings]
    assert held[0] and not held[2]


def test_token_counts_of_random_texts(library, table):
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "23", ".", "!!", "—", " ", "日", "\x00", "²", "<|endoftext|>", "hello", " world", "×", "\r\n", "Ж", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(8000)] + ODD_TEXTS
    total, direct = token_counts.count(*text_buffers(pa.array(texts)), table, token_counts.Merger(tokenizer_path(BYTE_BPE)))
    assert total.tolist() == [len(library.encode(t or "").ids) for t in texts]
    assert (direct <= total).all() and direct.sum() > 0


def test_token_counts_query(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in __spark_entry__.queries()["op11_token_counts"](spark, small).collect()}
    for i, text in texts.items():
        n = len(library.encode(text).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len(text.encode()), n, n > 1024)
    assert len(found) == len(texts)


def test_token_counts_of_odd_rows(spark, library):
    rows = [(i if i else None, t, "x") for i, t in enumerate(ODD_TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(3)
    for name in (BYTE_BPE, "word_bpe_49k.json"):  # a file of another make goes through the library
        found = token_counts.count_tokens(df, tokenizer_path(name), keep=("text", "n_chars"), limit=3).collect()
        own = Tokenizer.from_file(tokenizer_path(name))
        assert len(found) == len(rows)
        for r in found:
            n = len(own.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit, r.n_chars) == (len((r.text or "").encode()), n, n > 3, "x")
    assert token_counts.count_tokens(df.limit(0), tokenizer_path(BYTE_BPE)).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.count_tokens(df.withColumnRenamed("n_chars", "n_tokens"), tokenizer_path(BYTE_BPE), keep=("n_tokens",))


# -- clustering --


def plain_clusters(rows, k, rounds, components):
    """Everything in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centroids = [[sum(c) // len(held[n]) for c in zip(*held[n], strict=True)] if held[n] else old for n, old in enumerate(centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = Counter()
    for _, c, d in out:
        total[c] += d
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), told[c]) for i, c, d in out), key=str)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 1024]) for i in range(60)]  # few different vectors, many ties
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60, 90)]
    rows += [(60, rows[60][1]), (60, rows[61][1]), (None, rows[3][1]), (91, None), (92, []), (93, [1.0] * 3), (94, [1.0, None, 0.0, 0.0]), (95, [1.0, float("nan"), 0.0, 0.0]), (96, [float("inf"), 0.0, 0.0, 0.0]), (97, [0.0] * 4)]
    rows += [(98, [100_000.0, -100_000.0, 100_000.0, -0.0]), (99, [100_000.0, -100_000.0, 99_999.99, 0.001])]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    for k, rounds in ((8, 10), (3, 0), (500, 2)):
        found = clustering.cluster(df, k=k, rounds=rounds, components=4).collect()
        assert sorted(map(tuple, found), key=str) == plain_clusters(rows, k, rounds, 4)
    assert clustering.cluster(df.limit(0), components=4).collect() == []
    assert clustering.cluster(df.filter("vec_id is null"), components=4).collect() == []
    with pytest.raises(Exception, match="larger than"):
        clustering.cluster(spark.createDataFrame([(1, [2e5] * 4)], "vec_id long, embedding array<float>"), components=4)


def test_screening_never_loses_the_nearest():
    """Near ties at sizes where float32 can't tell them apart: intervals overlap there, exact distances decide."""
    rng = np.random.default_rng(3)
    for size in (3, 1 << 10, 1 << 20, clustering.LARGEST // 2):
        centre = rng.integers(-size, size + 1, 64)
        centroids = centre + rng.integers(-2, 3, (12, 64))
        centroids[7] = centroids[3]
        vectors = np.concatenate([centre + rng.integers(-2, 3, (300, 64)), rng.integers(-size, size + 1, (100, 64)), centroids])
        exact = np.array([[((v.astype(object) - c.astype(object)) ** 2).sum() for c in centroids] for v in vectors])
        found, recomputed = clustering.nearest(vectors, centroids)
        assert found.tolist() == exact.argmin(axis=1).tolist()
        assert clustering.shortlist(vectors, centroids)[np.arange(len(vectors)), exact.argmin(axis=1)].all()
        assert recomputed or size == 3
    far = np.eye(64, dtype=np.int64)[:8] * 1000
    assert clustering.nearest(far, far)[1] == 0  # clear cases need no second look


# -- divergence of sources --


def plain_audit(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:last])]
    return sorted(out)


def test_audit_in_blocks_and_chunks(spark):
    rng = random.Random(4)
    words = [f"W{i}" if i % 3 else f"ü{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["The", "the", "THE", "a-b", "ÉtÉ", "日本"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([f"s{i}" for i in range(11)] + [None]), " ".join(rng.choices(words[: rng.randrange(5, 76)], k=rng.randrange(30)))) for _ in range(400)]
    rows += [("xx", "lonely", "once upon"), ("yy", "a", None), ("yy", "b", ""), ("en", "empty", "123"), ("en", "\U0001f642", "the the"), ("en", "￿", "the"), ("en", "s0", "x" * 100_000)] + rows[:5]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n long, term string").repartition(3)
    for least, chunk, block in ((3, 7, 3), (3, 1 << 14, 32), (10_000, 5, 2)):
        found = divergence.audit(df, least_docs=least, top=6, chunk=chunk, block=block).collect()
        assert sorted(map(tuple, found)) == plain_audit(rows, least, 6)
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_are_exact_beyond_doubles():
    counts = np.array([[0, 1, 7, 9_000_000_000_000], [3, 0, 0, 123_456_789_012]])
    total = counts.sum(axis=1)
    wanted = [[1 + 1_000_000_000 * (int(c) + 5) // (int(t) + 5 * 4) for c in row] for row, t in zip(counts, total, strict=True)]
    assert divergence.shares(counts, total, 4).tolist() == wanted


def test_strings_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.SpanHash, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    start, end, _ = divergence.terms(data, np.array([0, len(data)]))
    strings, which = divergence.distinct(data, start, end)
    assert [strings[i] for i in which] == [b"ab", b"cd", b"ab", b"ef"]
