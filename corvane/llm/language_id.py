"""Language ID: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import held, named_apart

#: Runs that may be words: letters with some numerals.
RUNS = re.compile(r"[^\W\d_]+").findall
#: Bytes of Latin-1 with all but letters made spaces.
LATIN = bytes(c if chr(c).isalpha() else 32 for c in range(256))
#: Weights that features are hashed to; one more row, always 0, is for no feature.
BUCKETS = 1 << 16
#: Words whose scores a worker keeps at most.
CACHE_WORDS = 300_000
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + 1) x langs
    moves: np.ndarray  # of a word's language (row) to the next word's
    lexicon: dict[str, int]  # frequent words and their buckets


def words(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        found = RUNS(text)
        return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for c in text).split()


def features(unseen: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a row for each character of ^word$, columns of features) and the row at which each word begins.

    A character has the n-grams of one to three characters that begin with it; a word's first row also has its
    prefix of four characters and its lexicon feature, its second row its suffix of four. The marks ^ and $
    make affixes of n-grams at the ends.
    """
    ends = np.cumsum([len(w) + 2 for w in unseen])
    starts = np.concatenate([[0], ends[:-1]])
    codes = np.frombuffer(f"^{'$^'.join(unseen)}$".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n, left = len(codes), np.repeat(ends, np.diff([0, *ends])) - np.arange(len(codes))  # characters up to the word's end
    padded = np.concatenate([codes, np.zeros(4, np.uint64)])
    out = np.full((n, 6), BUCKETS, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(4):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + n] + np.uint64(k + 1)
        mixed = gram ^ (gram >> np.uint64(29))
        bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
        if k < 3:
            out[:, k] = np.where(left > k, bucket, BUCKETS)
        else:
            long = (ends - starts) >= 4
            out[starts[long], 3] = bucket[starts[long]]
            out[starts[long] + 1, 4] = bucket[ends[long] - 4]
    out[starts, 5] = [lexicon.get(w, BUCKETS) for w in unseen]
    return out, starts


def gathered(weights: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return reduce(np.add, (weights[buckets[:, c]] for c in range(buckets.shape[1])))


def emissions(model: Model, unseen: list[str]) -> np.ndarray:
    """Scores of each word for each language."""
    out = [np.zeros((0, len(model.langs)), np.float32)]
    for at in range(0, len(unseen), 20_000):
        buckets, starts = features(unseen[at : at + 20_000], model.lexicon)
        out.append(np.add.reduceat(gathered(model.weights, buckets), starts, axis=0))
    return np.concatenate(out)


def marginals(scores: np.ndarray, lengths: list[int], moves: np.ndarray) -> np.ndarray:
    """Probabilities of labels at each word of sequences that lie one after another, longest first, by forward-backward.

    Sequences run side by side, each step over those that are as long. Products are rescaled at every 16th
    step, well before doubles underflow: a step divides them by e**40 at most.
    """
    n, k, longest = len(lengths), moves.shape[0], lengths[0]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-np.array(lengths), -np.arange(longest), side="left").tolist()  # sequences longer than t
    scaled = np.exp(np.maximum(scores - reduce(np.maximum, scores.T)[:, None], -20.0), dtype=np.float64)
    e = np.zeros((longest, n, k))
    for row, (at, m) in enumerate(zip(starts.tolist(), lengths, strict=True)):
        e[:m, row] = scaled[at : at + m]
    step, ones = np.exp(np.maximum(moves - moves.max(), -20.0), dtype=np.float64), np.ones(k)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    forward[0] = a = e[0]
    for t in range(1, longest):
        m = active[t]
        a = np.matmul(a[:m], step, out=forward[t, :m])
        a *= e[t, :m]
        if not t % 16:
            a /= (a @ ones)[:, None]
    step = np.ascontiguousarray(step.T)
    for t in range(longest - 2, -1, -1):
        m = active[t + 1]
        b = np.matmul(backward[t + 1, :m] * e[t + 1, :m], step, out=backward[t, :m])
        if not t % 16:
            b /= (b @ ones)[:, None]
    forward *= backward
    out = np.concatenate([forward[:m, row] for row, m in enumerate(lengths)])
    out /= (out @ ones)[:, None]
    return out


def train(samples: list[tuple[str, str]], rounds: int = 15, window: int = 24, penalty: float = 1e-4, lexicon_words: int = 500) -> Model | None:
    """A model from texts and their languages: all words of a text bear its language.

    Maximises the likelihood of windows of words, less a penalty on squared weights, by Adam over all windows.
    The lexicon has each language's most frequent words. None if there is no word to learn from.
    """
    langs = sorted({lang for _, lang in samples})
    tokens = [(words(text), langs.index(lang)) for text, lang in sorted(samples)]
    often: dict[int, Counter] = {k: Counter() for k in range(len(langs))}
    for ws, k in tokens:
        often[k].update(ws)
    frequent = {w for c in often.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]}
    lexicon = {w: zlib.crc32(w.encode()) % BUCKETS for w in sorted(frequent)}
    vocabulary = sorted({w for c in often.values() for w in c})
    if not vocabulary:
        return None
    number = {w: i for i, w in enumerate(vocabulary)}
    buckets, starts = features(vocabulary, lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff([*starts, len(buckets)]))
    flat, owner = buckets.ravel(), np.repeat(owner, buckets.shape[1])
    cut = [(ws[i : i + window], k) for ws, k in tokens for i in range(0, len(ws), window)]
    cut.sort(key=lambda x: -len(x[0]))
    ids = np.full((window, len(cut)), -1)
    for row, (ws, _) in enumerate(cut):
        ids[: len(ws), row] = [number[w] for w in ws]
    label, lengths = np.array([k for _, k in cut]), np.array([len(ws) for ws, _ in cut])
    active = [int((lengths > t).sum()) for t in range(window)]
    k, total = len(langs), int(lengths.sum())
    weights, moves = np.zeros((BUCKETS + 1, k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    hot = np.eye(k)[label]
    for r in range(1, rounds + 1):
        scores = np.add.reduceat(gathered(weights, buckets), starts, axis=0)
        scores = np.exp(scores - reduce(np.maximum, scores.T)[:, None])
        e = [scores[ids[t, : active[t]]] for t in range(window) if active[t]]
        step, ones = np.exp(moves - moves.max()), np.ones((k, 1))
        forward = [e[0] / (e[0] @ ones)]
        for t in range(1, len(e)):
            a = (forward[-1][: active[t]] @ step) * e[t]
            forward.append(a / (a @ ones))
        by_word, by_move, b = np.zeros((len(vocabulary), k)), np.zeros((k, k)), np.ones((len(cut), k))
        for t in range(len(e) - 1, -1, -1):
            m = active[t]
            g = forward[t] * b[:m]
            g = g / (g @ ones) - hot[:m]
            for j in range(k):
                by_word[:, j] += np.bincount(ids[t, :m], g[:, j], len(vocabulary))
            if t:
                x = b[:m] * e[t]
                before = forward[t - 1][:m]
                z = ((before @ step) * x) @ ones
                by_move += step * ((before / z).T @ x) - hot[:m].T @ hot[:m]
                x = x @ step.T
                b[:m] = x / (x @ ones)
        gradient = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS + 1) for j in range(k)], 1) / total + penalty * weights
        gradient[BUCKETS] = 0
        for value, g, i in ((weights, gradient, 0), (moves, by_move / total + 100 * penalty * moves, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            value -= 0.1 * (moments[i] / (1 - 0.9**r)) / (np.sqrt(moments[i + 1] / (1 - 0.99**r)) + 1e-9)
    return Model(langs, weights.astype(np.float32), moves.astype(np.float32), lexicon)


def fit(labelled: DataFrame, per_language: int = 100, max_chars: int = 20_000) -> Model | None:
    """A model from a bounded sample of labelled (text, lang): per_language texts of each language.

    They are those of the smallest hashes of the text among texts of at most max_chars characters, so that
    what the driver gets is bounded by per_language * max_chars for each language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text").between(1, max_chars)))
    order = Window.partitionBy("lang").orderBy("_h", "text")
    sample = usable.select("text", "lang", F.xxhash64("text").alias("_h")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    return train([(r["text"], r["lang"]) for r in sample.select("text", "lang").collect()])


class Labeler:
    """A worker's model with the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of all words, text after text."""
        if len(self.number) > CACHE_WORDS:
            self.number, self.table = {}, self.table[:0]
        number = self.number
        unseen = [w for w in set().union(*texts) if w not in number]
        if unseen:
            number.update(zip(unseen, range(len(number), len(number) + len(unseen)), strict=True))
            self.table = np.concatenate([self.table, emissions(self.model, unseen)])
        return self.table[np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))]

    def label(self, texts: list[str | None], at_once: int = 200_000) -> list[tuple[str, float, list[float], int]]:
        """Each text's language, score, shares of languages and number of switches between words."""
        langs = self.model.langs
        out: list[tuple[str, float, list[float], int]] = [(UNKNOWN, 0.0, [0.0] * len(langs), 0)] * len(texts)
        tokens = {i: ws for i, t in enumerate(texts) if t and (ws := words(t))}
        order, at = sorted(tokens, key=lambda i: -len(tokens[i])), 0
        while at < len(order):
            count = max(1, at_once // len(tokens[order[at]]))  # sequences are as long as the first at most
            group = order[at : at + count]
            at += count
            lengths = [len(tokens[i]) for i in group]
            p = marginals(self.scores([tokens[i] for i in group]), lengths, self.model.moves)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            shares = np.add.reduceat(p, starts, axis=0) / np.array(lengths)[:, None]
            named = p.argmax(axis=1)
            moved = np.concatenate([[0], named[1:] != named[:-1]])
            moved[starts] = 0
            switches = np.add.reduceat(moved, starts)
            for i, share, best, moves in zip(group, shares.tolist(), shares.argmax(axis=1).tolist(), switches.tolist(), strict=True):
                out[i] = (langs[best], min(1.0, share[best]), share, moves)
        return out


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, shares (array of doubles, in the order of model.langs) and n_switches (long).

    Words of the whole text are labelled by the model's forward-backward probabilities; a language's share is
    their mean over the text's words, lang_pred has the largest (the first by name among equals) and score is
    its share. n_switches: how often the likeliest language changes from one word to the next. Texts that are
    null or have no letter are `und` with score 0, as are all without a model. Only the text is used to
    predict. Rows stay as they are, repeated ones too; columns of docs that bear a new name are replaced.

    One pass without a shuffle. Workers hold one group of at most 200,000 words, or one text if that has more.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, shares array<double>, n_switches long")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        if model is None:
            got = [(UNKNOWN, 0.0, [], 0)] * len(texts)
        else:
            label = held(("languages", id(model)), lambda: Labeler(model)).label  # which holds the model, so that no other has its id
            got = [x for at in range(0, len(texts), 1000) for x in label(texts.iloc[at : at + 1000].tolist())]
        return pd.DataFrame(got, columns=["lang_pred", "score", "shares", "n_switches"])

    (label,) = named_apart(docs.columns, "_label")
    out = docs.withColumn(label, labelled(F.col(text_col)))
    return out.withColumns({k: F.col(f"{label}.{k}") for k in ("lang_pred", "score", "shares", "n_switches")}).drop(label)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; ids that are null count as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1
