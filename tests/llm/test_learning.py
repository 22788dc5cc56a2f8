"""What op6 and op7 learn, against plain versions: trigram counts, word weights, calibration."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terraframe.llm import language, quality
from terraframe.llm.kernels import SpanHash


def letters(text):
    """Runs of letters and bytes over 127, lower-cased as the model has it."""
    data = bytearray(text.encode())
    for i, b in enumerate(data):
        if 0x41 <= b <= 0x5A or (i and text.encode()[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            data[i] += 32
    return re.findall(rb"[a-z\x80-\xff]+", bytes(data))


def test_trigram_likelihoods(spark):
    rng = random.Random(1)
    parts = ["Straße", "ÀÉ×Þ", "the", "a", "日本", "Zürich-West", "x1y22z", "É", "\x00b", "ABC"]
    rows = [(rng.choice(["de", "en", "fr", None]), " ".join(rng.choices(parts, k=rng.randrange(12)))) for _ in range(120)] + [("xx", None), ("yy", "123"), ("en", "w" * 3000)]
    langs, model = language.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang")
    counts = {}
    for lang, text in rows:
        for word in letters(text) if lang and text else ():
            for a, b, c in zip(b" " + word[:-1], word, word[1:] + b" ", strict=True):
                bucket = (a << 16 | b << 8 | c) * 2654435761 % (1 << 32) >> 16
                counts.setdefault(lang, Counter())[bucket] += 1
    assert langs == sorted(counts) == ["de", "en", "fr"]
    for own, lang in zip(model, langs, strict=True):
        total = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
        wanted = np.full(language.BUCKETS, math.log(language.SMOOTHING / total))
        for bucket, n in counts[lang].items():
            wanted[bucket] = math.log((n + language.SMOOTHING) / total)
        assert np.allclose(own, wanted, rtol=1e-6)


def bucket(value, salt=0):
    data = np.frombuffer(value, np.uint8)
    return int((SpanHash(data).of(np.array([0]), np.array([len(data)]))[0] ^ np.uint64(salt)) >> np.uint64(46))


def every(text):
    """Feature buckets of a text, as often as they stand."""
    out, before = [], None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        core = stripped(word)
        out += [bucket(core), bucket(word[-3:], 0x5851F42D4C957F2D), (2 if core == before else 1) * 0x9E3779B97F4A7C15 % (1 << 64) >> 46]
        before = core
    return out


def stripped(word):
    signs = set(range(0x21, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x7F))
    left, right = 0, len(word)
    for _ in range(3):
        left += word[left] in signs and left < right - 1
        right -= word[right - 1] in signs and left < right - 1
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in word[left:right])


def test_word_weights_and_calibration(spark):
    rng = random.Random(2)
    good, bad = ["clear", "well-made", "(Noted)", "ends.", "über"], ["spam!!!!", "CLICK", "buy", "buy", "\"now\""]
    texts, labels = [], []
    for i in range(400):
        y = rng.randrange(2)
        texts.append((i, " ".join(rng.choices(good * (8 * y) + bad * (8 - 8 * y) + good[:2] + bad[:2] + ["the", "of", "and"], k=rng.randrange(1, 25)))))
        labels.append((i, y))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learn(docs, known, "quality", "doc_id", "text")
    fit = {r.doc_id for r in known.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(4)) == 0).collect()}
    assert 50 < len(fit) < 150
    held, number = [Counter(), Counter()], [0, 0]
    for (i, text), (_, y) in zip(texts, labels, strict=True):
        if i not in fit:
            held[y].update(set(every(text)))
            number[y] += 1
    wanted = np.zeros(quality.BUCKETS)
    for b in held[0].keys() | held[1].keys():
        odds = [math.log((held[y][b] + quality.SMOOTHING) / (number[y] + 2 * quality.SMOOTHING)) for y in (0, 1)]
        seen = held[0][b] + held[1][b]
        wanted[b] = (odds[1] - odds[0]) * seen / (seen + quality.RARE)
    assert np.allclose(model.weights, wanted, atol=1e-5) and np.abs(wanted).max() > 1
    # the fit is where the penalised likelihood of the other quarter has no slope
    x, y = [], []
    for (i, text), (_, label) in zip(texts, labels, strict=True):
        if i in fit:
            w = [wanted[b] for b in every(text)]
            x.append([np.mean(w), max(w), min(w), math.sqrt(np.mean([v > quality.STRONG for v in w])), math.sqrt(np.mean([v < -quality.STRONG for v in w])), 1.0])
            y.append(label)
    x, y = np.array(x), np.array(y)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ model.fit))) - np.array([0.1] * 5 + [1e-6]) * model.fit
    assert np.abs(slope).max() < 1e-3
