"""Language of each word of a text by a linear-chain conditional random field, and of the text by its words.

States are the languages. A word's features are its byte n-grams of one to four with marks at its ends (so affixes are
among them) and the word as a whole (lexicon), hashed to ``BUCKETS`` weights per language; transitions between the
languages of neighbouring words are learned as well. Training fits both by gradient ascent on the conditional likelihood
of word sequences made from labelled texts, half of them switching languages. Forward-backward over all words of a text
gives each word's language probabilities; the text's language is the one with the largest mean, which is the score.

Training reads a bounded sample: ``PER_LANG`` texts of a language (those with the smallest hash of their key, at most a
sixteenth of them from each of 64 hash buckets), ``CHARS`` characters of each from a place drawn by that hash. Prediction reads whole texts and nothing but texts.

Null text or text without a letter: ``und``, score 0. Words without letters have no evidence of their own and no vote.
Ties: the language that sorts first. Repeated rows: same results. No labelled text at all: ``und``. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.blocks import U64, chunks, flat, mix, runs, spans_hash, windows_hash, words

BUCKETS = 1 << 18
PER_LANG = 400
CHARS = 3000
LENGTH = 48
NGRAMS = (1, 2, 3, 4)
BATCH = 1 << 21  # bytes predicted at a time: some ten arrays of a number per word and language stand at once
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0xC2:] = True  # lead bytes; of these signs, _lettered() asks Unicode where no ASCII letter decides
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words one after the other, and how many each word has."""
    n = ends - starts
    size = n + 2
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), ord(" "), np.uint8)
    inner = np.repeat(at + 1, n) + runs(n)
    text[inner] = _LOWER[buf[np.repeat(starts, n) + runs(n)]]
    parts, counts = [], []
    for k in NGRAMS:
        own = np.maximum(size - k + 1, 0)
        f = windows_hash(text, k)
        place = np.repeat(at, own) + runs(own)
        parts.append((f[place] ^ U64(k * 0x9E37)) % U64(BUCKETS))
        counts.append(own)
    parts.append((spans_hash(text, at, at + size) ^ U64(0xFEED)) % U64(BUCKETS))
    counts.append(np.ones(len(starts), np.int64))
    owner = np.concatenate([np.repeat(np.arange(len(starts)), c) for c in counts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order].astype(np.int64), np.sum(counts, axis=0)


def emissions(weights: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features."""
    out = np.empty((len(starts), weights.shape[1]), np.float32)
    for i in range(0, len(starts), 1 << 13):
        j = min(len(starts), i + (1 << 13))
        f, n = features(buf, starts[i:j], ends[i:j])
        out[i:j] = np.add.reduceat(weights[f], np.cumsum(n) - n, axis=0)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each state for each word of many texts, laid one after the other; ``move`` and ``start`` are
    probabilities up to a factor, ``scores`` logarithms."""
    n_states = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    own = lengths[order]
    steps = int(own[0]) if len(own) else 0
    if not steps:
        return np.zeros((0, n_states), np.float32)
    active = np.searchsorted(-own, -np.arange(steps), "left")  # texts with a word at each step
    base = np.cumsum(active) - active
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = base[runs(lengths)] + np.repeat(rank, lengths)
    local = np.empty_like(scores, dtype=np.float64)
    local[place] = np.exp(np.clip(scores - scores.max(1, keepdims=True), -60, 0))
    ahead = np.empty_like(local)
    a = local[: active[0]] * start
    for t in range(steps):
        x = local[base[t] : base[t] + active[t]]
        if t:
            a = (a[: active[t]] @ move) * x
        a /= a.sum(1, keepdims=True)
        ahead[base[t] : base[t] + active[t]] = a
    back = np.ones((active[0], n_states))
    for t in range(steps - 1, -1, -1):
        cut = slice(base[t], base[t] + active[t])
        b = back[: active[t]]
        ahead[cut] *= b
        if t:
            b = (local[cut] * b) @ move.T
            back[: active[t]] = b / b.sum(1, keepdims=True)
    del local
    ahead /= ahead.sum(1, keepdims=True)
    return ahead[place]


class Model:
    """Weights of a fitted field; keeps emissions of words it has met, in a direct-mapped cache."""

    SLOTS = 1 << 19

    def __init__(self, langs: list[str], weights: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
        self.langs, self.weights, self.move, self.start = langs, weights, move, start
        self.keys = None

    def __getstate__(self):
        return self.langs, self.weights, self.move, self.start

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.keys is None:
            self.keys = np.zeros(self.SLOTS, U64)
            self.held = np.zeros((self.SLOTS, len(self.langs)), np.float32)
        h = spans_hash(buf, starts, ends, fold=True)
        slot = (h & U64(self.SLOTS - 1)).astype(np.int64)
        out = self.held[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            keys, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            got = emissions(self.weights, buf, starts[at], ends[at])
            out[miss] = got[back]
            slots = (keys & U64(self.SLOTS - 1)).astype(np.int64)
            self.keys[slots], self.held[slots] = keys, got
        return out

    def word_probabilities(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words before each text, whether each word has a letter, and its language probabilities."""
        starts, ends, first = words(buf, off)
        if not len(starts):
            return first, np.zeros(0, bool), np.zeros((0, len(self.langs)))
        voiced = np.add.reduceat(_LETTER[buf], starts) > 0 if len(buf) else np.zeros(0, bool)
        scores = self.scores(buf, starts, ends)
        scores[~voiced] = 0
        return first, voiced, forward_backward(scores, np.diff(first), self.move, self.start)

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and its words' certainty: the mean of their largest probabilities."""
        langs: list[str] = []
        scores, sure = [], []
        for i, j in chunks(off, BATCH):
            a = off[i]
            own, cut = buf[a : off[j]], off[i : j + 1] - a
            first, voiced, p = self.word_probabilities(own, cut)
            p *= voiced[:, None]
            top = np.concatenate([[0], np.cumsum(p.max(1))])
            votes = np.zeros((len(p) + 1, len(self.langs)))
            np.cumsum(p, axis=0, out=votes[1:])
            del p
            votes = votes[first[1:]] - votes[first[:-1]]
            n = np.diff(np.concatenate([[0], np.cumsum(voiced)])[first])
            ascii_letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[own] & (own < 0x80))])[cut])
            share = votes / np.maximum(n, 1)[:, None]
            share = np.round(share, 6)  # sums depend on the batch in their last digits
            best = np.argmax(share, axis=1)
            certain = np.round((top[first[1:]] - top[first[:-1]]) / np.maximum(n, 1), 6)
            for d in range(j - i):
                if n[d] and (ascii_letters[d] or any(c.isalpha() for c in own[cut[d] : cut[d + 1]].tobytes().decode())):
                    langs.append(self.langs[best[d]])
                    scores.append(min(1.0, max(0.0, float(share[d, best[d]]))))
                    sure.append(min(1.0, float(certain[d])))
                else:
                    langs.append(UND)
                    scores.append(0.0)
                    sure.append(0.0)
        return langs, np.array(scores), np.array(sure)


def marginals(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of one length: each word's state probabilities, and expected moves over all of them."""
    local = np.exp(scores - scores.max(2, keepdims=True))
    m, n, k = local.shape
    ahead, back = np.empty_like(local), np.ones_like(local)
    a = np.full((m, k), 1 / k)
    for t in range(n):
        a = (a @ move if t else a) * local[:, t]
        a /= a.sum(1, keepdims=True)
        ahead[:, t] = a
    for t in range(n - 2, -1, -1):
        b = (local[:, t + 1] * back[:, t + 1]) @ move.T
        back[:, t] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * move * (local * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, pair.sum((0, 1))


def sequences(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Word sequences of ``LENGTH`` with a language for each word; every other one switches between two texts."""
    buf, off = flat(pa.array(texts, pa.binary()))
    starts, ends, first = words(buf, off)
    n = np.diff(first)
    good = np.flatnonzero(n >= 4)
    out_words, out_labels = [], []
    for d in good.tolist():
        for at in range(0, int(n[d]), LENGTH):
            own = first[d] + (np.arange(at, at + LENGTH) % n[d])
            lab = np.full(LENGTH, labels[d])
            if rng.random() < 0.5:
                other = int(rng.choice(good))
                cuts = np.sort(rng.integers(2, LENGTH - 2, 2))
                swap = slice(cuts[0], cuts[1] + 1)
                own[swap] = first[other] + (np.arange(LENGTH)[swap] % n[other])
                lab[swap] = labels[other]
            out_words.append(own)
            out_labels.append(lab)
    return buf, starts, ends, np.array(out_words).reshape(-1, LENGTH), np.array(out_labels).reshape(-1, LENGTH)


def fit(texts: list[bytes], langs: list[str], epochs: int = 3, batch: int = 256, rate: float = 0.2, seed: int = 7) -> Model:
    """Conditional likelihood by Adagrad over emissions and transitions."""
    names = sorted(set(langs))
    k = len(names)
    rng = np.random.default_rng(seed)
    labels = np.array([names.index(x) for x in langs])
    buf, starts, ends, seqs, labs = sequences(texts, labels, rng)
    weights, move = np.zeros((BUCKETS, k), np.float64), np.zeros((k, k))
    grown, grown_move = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for i in range(0, len(order), batch):
            own = seqs[order[i : i + batch]].ravel()
            lab = labs[order[i : i + batch]]
            kinds, back = np.unique(own, return_inverse=True)
            f, n = features(buf, starts[kinds], ends[kinds])
            per_word = np.add.reduceat(weights[f], np.cumsum(n) - n, axis=0)
            scores = per_word[back]
            m = len(lab)
            step = np.exp(move)
            p, pair = marginals(scores.reshape(m, LENGTH, k), step)
            grad = np.eye(k)[lab] - p
            seen = np.zeros((k, k))
            np.add.at(seen, (lab[:, :-1].ravel(), lab[:, 1:].ravel()), 1)
            g_move = (seen - pair) / m
            grown_move += g_move**2
            move += rate * g_move / np.sqrt(grown_move)
            flat_grad = grad.reshape(-1, k)
            g_word = np.stack([np.bincount(back, flat_grad[:, c], len(kinds)) for c in range(k)], 1)
            rows = np.repeat(g_word, n, axis=0) / m
            g = np.stack([np.bincount(f, rows[:, c], BUCKETS) for c in range(k)], 1)
            hit = np.unique(f)
            grown[hit] += g[hit] ** 2
            weights[hit] += rate * g[hit] / np.sqrt(grown[hit])
    return Model(names, weights.astype(np.float32), np.exp(np.clip(move, -8, 8)), np.ones(k))


def train(docs: DataFrame, key: Column, per_lang: int = PER_LANG) -> Model:
    """A model from ``text, lang`` of rows where both are given; ``key`` orders the sample."""
    own = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64(key.cast("string"), F.lit(7)).alias("h"))
    own = own.withColumn("bucket", F.pmod("h", F.lit(64)))
    place = F.pmod("h", F.greatest(F.length("text") - CHARS, F.lit(1))).cast("int") + 1
    own = own.select("lang", "h", "bucket", F.substr("text", place, F.lit(CHARS)).alias("part"))
    # first in each hash bucket, then over buckets: no language's rows meet in one task
    for by, most in ((["lang", "bucket"], max(1, per_lang // 16)), (["lang"], per_lang)):
        own = own.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "part"))).filter(F.col("r") <= most)
    rows = own.select("lang", "h", "part").collect()
    rows.sort(key=lambda r: (r.lang, r.h, r.part))
    return fit([r.part.encode() for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The ``carry`` columns, predicted language and score of each row (under ``names``), with a third name also the
    certainty of its words; they depend on ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carry.index("text") if "text" in carry else len(carry)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            if field.langs:
                langs, *numbers = field.predict(*flat(batch.column(at)))
            else:
                langs, *numbers = [UND] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in numbers[: len(names) - 1])], [*carry, *names])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    own = docs.select(*carry) if "text" in carry else docs.select(*carry, "text")
    return own.mapInArrow(predict, f"{types}, `{names[0]}` string, " + ", ".join(f"`{x}` double" for x in names[1:]))
