"""Language ID by mixture inference over n-gram likelihoods.

A word's likelihood in a language is the product of its byte trigrams' (a word is a run of letters
and bytes over 127, lower-cased, with its edges). A document is a mixture: each word comes from one
of its languages. Expectation-maximisation finds the proportions, from all words of the whole text;
then the languages are taken in order of proportion, and the set of best likelihood less a penalty
per language is kept. The language predicted is the one of largest proportion in that set, which is
also the score.

The model is counts per language and trigram bucket over all learning rows, summed by partial
aggregation; what reaches the driver has at most MAX_LANGUAGES * BUCKETS rows, whatever the corpus.

Defined results: a text that is null or has no letter is `und`, score 0; so is every text if there
is nothing to learn from; ties go to the language first by code point; repeated rows are predicted
each; other columns are kept but never read; those that begin with two underscores raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, bounded, pieces, text_buffers, words
from .tables import map_arrow, refuse_own_names

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Rows of this remainder of crc32(key) modulo FOLDS are held out.
FOLDS, HELD_OUT = 4, 2
SMOOTHING = 0.1
ROUNDS = 12
#: Nats by which each further language must raise the likelihood, times log(words + 1).
PENALTY = 3.0
#: Proportion that a language needs to be tried in a set.
TRIED = 0.02
#: An accepted document has a language of at least this proportion.
ACCEPTED = 0.5

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[128:] = np.arange(128, 256)
_KEPT = _LETTERS[LOWER]


def held_out(key: Column) -> Column:
    """Whether a row is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter byte; the first of each word; the row of each word."""
    flat = _KEPT[data]
    if len(flat) > 1:  # capitals of Latin-1 in UTF-8
        after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        flat[after] += 32
    start, end, row = words(flat, offsets)
    if not len(start):
        return np.empty(0, np.int64), start, row
    padded = np.concatenate([[0x20], flat, [0x20]]).astype(np.uint32)
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[start], right[end - 1] = 0x20, 0x20
    inside = flat != 0x20
    bucket = (left << np.uint32(16) | padded[1:-1] << np.uint32(8) | right)[inside] * np.uint32(2654435761) >> np.uint32(16)
    before = np.concatenate([[0], np.cumsum(inside)])
    return bucket.astype(np.int64), before[start], row


def learn(docs: DataFrame, text: str, language: str) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and the log likelihood of each bucket in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            langs = batch.column(language).to_pylist()
            names = sorted(set(langs))
            of_row = np.array([names.index(x) for x in langs], np.int64)
            for first, last in pieces(offsets):
                bucket, at, row = grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                if not len(at):
                    continue
                gram_lang = np.repeat(of_row[first + row], np.diff(at, append=len(bucket)))
                both = np.bincount(gram_lang * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + both[i]
        for name, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["lang", "bucket", "n"])

    known = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    if known.select(language).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = map_arrow(known.select(text, language), count, "lang string, bucket int, n long")
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), table["lang"].to_numpy(object)).astype(int) if len(table) else [], table["bucket"].to_numpy(int)] = table["n"]
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _proportions(like: np.ndarray, at: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """EM: proportions by row of languages from the likelihoods of words; `start` has zeros where a language is out."""
    mix = start
    spread = np.repeat(np.arange(len(n)), n)
    for _ in range(ROUNDS):
        share = like * mix[spread]
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
        mix = (np.add.reduceat(share, at, axis=0) / n[:, None]).astype(np.float32)
    return mix


def mixtures(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions (rows, languages) of the chosen set of each row; zeros for rows without letters."""
    out = np.zeros((len(offsets) - 1, len(model)), np.float32)
    bucket, first, row = grams(data, offsets)
    if not len(first) or not len(model):
        return out
    logs = np.stack([np.add.reduceat(m[bucket], first) for m in model], axis=1)
    best = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - best)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows, n = row[at], np.diff(at, append=len(row))
    full = _proportions(like, at, n, np.full((len(at), len(model)), 1 / len(model), np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    here = np.arange(len(at))
    chosen = np.zeros_like(full)
    chosen[here, order[:, 0]] = 1
    spread = np.repeat(here, n)
    value = np.add.reduceat(np.log(np.maximum(like[np.arange(len(like)), order[spread, 0]], 1e-30)), at)
    for size in range(2, len(model) + 1):
        todo = np.flatnonzero(full[here, order[:, size - 1]] >= TRIED)
        if not len(todo):
            break
        some = np.isin(spread, todo)
        part, count = like[some], n[todo]
        begin = np.cumsum(count) - count
        start = np.zeros((len(todo), len(model)), np.float32)
        for k in range(size):
            start[np.arange(len(todo)), order[todo, k]] = full[todo, order[todo, k]] + 1e-6
        start /= start.sum(axis=1, keepdims=True)
        mix = _proportions(part, begin, count, start)
        total = np.add.reduceat(np.log(np.maximum((part * np.repeat(mix, count, axis=0)).sum(axis=1), 1e-30)), begin)
        total -= PENALTY * (size - 1) * np.log(count + 1)
        better = total > value[todo]
        chosen[todo[better]] = mix[better]
        value[todo[better]] = total[better]
    out[rows] = chosen
    return out


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds __lang and __score; only the text is read for them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if not (drop_text and c == text)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "__lang string, __score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            found, score = [], []
            for first, last in pieces(offsets):
                part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                shares = mixtures(part, at, shared.value)
                plain = LOWER[part]
                ascii_letters = np.concatenate([[0], np.cumsum((plain >= 0x61) & (plain <= 0x7A))])
                top = shares.argmax(axis=1) if len(langs) else np.zeros(last - first, int)
                for i in range(last - first):
                    letters = ascii_letters[at[i + 1]] > ascii_letters[at[i]] or any(map(str.isalpha, part[at[i] : at[i + 1]].tobytes().decode(errors="replace")))
                    known = len(langs) and letters
                    found.append(langs[top[i]] if known else UNKNOWN)
                    score.append(float(shares[i, top[i]]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*keep, "__lang", "__score"])

    return map_arrow(docs, run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", drop_text: bool = False) -> DataFrame:
    """Learns from the rows that are not held out and predicts all of them."""
    refuse_own_names(docs)
    langs, model = learn(docs.filter(~held_out(F.col(key))), text, language)
    return predict(docs, langs, model, text, drop_text)


def accepted(rows: DataFrame) -> DataFrame:
    """Of predicted rows, those with a language, which takes up half of the text at least."""
    return rows.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= ACCEPTED)).drop("__lang", "__score")
