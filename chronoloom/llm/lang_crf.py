"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between the languages of
neighbouring words are learned. Forward-backward gives every word's probabilities, so that texts
that switch language are labelled word by word; a document's language has the greatest mean. A text is one
chain, however long: messages run within stretches of it at the same time, and stretches are run again from
what their neighbours say until nothing changes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, utf8, with_id, words_of

#: Documents that training sees at most, each with its whole text, and languages that a model may have: of more, those of most documents.
MAX_TRAINING_DOCS, MAX_LANGUAGES = 240, 64
#: Buckets of hashed features; words of a stretch.
BUCKETS, STRETCH = 1 << 17, 128
LEXICON_WORDS = 200
UNKNOWN = "und"


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # languages x languages, of logarithms
    lexicon: dict[bytes, tuple[int, ...]]


def word_features(word: bytes, lexicon: dict[bytes, tuple[int, ...]]) -> list[int]:
    """Hashed features: the lexicons it is in, prefixes, suffixes and character n-grams."""
    s = word.decode("utf-8", "replace").lower()
    names = [f"l{k}" for k in lexicon.get(word, ())]
    names += [f"p{s[:k]}" for k in (1, 2, 3)] + [f"s{s[-k:]}" for k in (1, 2, 3, 4)]
    edged = f"^{s}$"
    names += [f"g{edged[i : i + 2]}" for i in range(len(edged) - 1)]
    names += [f"g{edged[i : i + 3]}" for i in range(len(edged) - 2)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in dict.fromkeys(names)]


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


class Messages:
    """Forward and backward messages of texts as chains: ``alpha`` and ``beta``, a row for each word, each summing to
    one. ``e``: exponentials of the words' scores; ``sizes``: words of each text."""

    def __init__(self, e: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, stretch: int = STRETCH):
        self.t = np.exp(transitions).astype(e.dtype)
        self.near = 1e-6 if e.dtype == np.float32 else 1e-12
        n, labels = e.shape
        within = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.flatnonzero(within % stretch == 0)
        self.first = within[starts] == 0
        lengths = np.diff(np.append(starts, n))
        self.alpha, self.beta = np.empty_like(e), np.empty_like(e)
        for lo, hi in _groups(lengths):
            self._within(e, starts[lo:hi], lengths[lo:hi], self.first[lo:hi])
        ends = starts + lengths - 1
        going = np.flatnonzero(~self.first)  # stretches with one before them
        said = np.full((len(starts), labels), 1 / labels, dtype=e.dtype)
        while len(going):  # what the stretch before says now, and did not when this one was run
            now = self.alpha[ends[going - 1]]
            new = np.abs(now - said[going]).max(axis=1) > self.near
            going, now = going[new], now[new]
            said[going] = now
            self._again(e, starts[going], lengths[going], now)
            going = going[(going + 1 < len(starts)) & ~np.append(self.first, True)[going + 1]] + 1
        going = np.flatnonzero(~self.first) - 1  # stretches with one after them
        heard = np.full((len(starts), labels), 1 / labels, dtype=e.dtype)
        while len(going):
            after = starts[going + 1]
            now = _unit((e[after] * self.beta[after]) @ self.t.T)
            new = np.abs(now - heard[going]).max(axis=1) > self.near
            going, now = going[new], now[new]
            heard[going] = now
            self._back(e, ends[going], lengths[going], now)
            going = going[~self.first[going]] - 1

    def _within(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> None:
        """All stretches from the same beginning and end, the longest first."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, first = starts[order], lengths[order], first[order]
        live = [int(x) for x in np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")]
        a = np.full((len(starts), e.shape[1]), 1 / e.shape[1], dtype=e.dtype)
        begun = np.where(first[:, None], a, _unit(a @ self.t))
        for k, m in enumerate(live):
            a = _unit(((a[:m] @ self.t) if k else begun[:m]) * e[starts[:m] + k])
            self.alpha[starts[:m] + k] = a
        ends = starts + lengths - 1
        b = np.full((len(starts), e.shape[1]), 1 / e.shape[1], dtype=e.dtype)
        self.beta[ends] = b
        for k, m in list(enumerate(live))[1:]:
            at = ends[:m] - k
            b = _unit((e[at + 1] * b[:m]) @ self.t.T)
            self.beta[at] = b

    def _again(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> None:
        """Forward from ``a``, until each stretch says what it said before."""
        k = 0
        while len(starts):
            a = _unit((a @ self.t) * e[starts + k])
            new = np.abs(a - self.alpha[starts + k]).max(axis=1) > self.near
            self.alpha[starts + k] = a
            k += 1
            go = new & (k < lengths)
            starts, lengths, a = starts[go], lengths[go], a[go]

    def _back(self, e: np.ndarray, ends: np.ndarray, lengths: np.ndarray, b: np.ndarray) -> None:
        k = 0
        while len(ends):
            at = ends - k
            new = np.abs(b - self.beta[at]).max(axis=1) > self.near
            self.beta[at] = b
            k += 1
            go = new & (k < lengths)
            ends, lengths = ends[go], lengths[go]
            b = _unit((e[at[go]] * b[go]) @ self.t.T)

    def marginals(self) -> np.ndarray:
        return _unit(self.alpha * self.beta)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def _groups(lengths: np.ndarray, most: int = 4096) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(lengths), most):
        yield lo, min(len(lengths), lo + most)


def fit_crf(chains: list[tuple[list[bytes], list[int]]], languages: tuple[str, ...], *, steps: int = 50, rate: float = 0.15, l2: float = 1e-6, enough: float = 0.002) -> LangModel:
    """Weights and transitions of greatest penalised conditional likelihood, by Adam on all chains, until the labels given have
    a mean probability of 1 - ``enough``, or for ``steps`` steps."""
    n_lang = len(languages)
    seen = [Counter() for _ in languages]
    for words, labels in chains:
        for w, y in zip(words, labels, strict=True):
            seen[y][w] += 1
    lexicon: dict[bytes, tuple[int, ...]] = {}
    for y, counts in enumerate(seen):
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicon[w] = (*lexicon.get(w, ()), y)
    types = {w: i for i, w in enumerate(sorted({w for words, _ in chains for w in words}))}
    features = [word_features(w, lexicon) if has_letter(w) else [] for w in types]
    at = np.repeat(np.arange(len(types)), [len(f) for f in features])
    cols = np.array([x for f in features for x in f], dtype=np.int64)
    used, cols = np.unique(cols, return_inverse=True)
    sizes = np.array([len(words) for words, _ in chains])
    ids = np.array([types[w] for words, _ in chains for w in words])
    gold = np.array([y for _, labels in chains for y in labels])
    total = len(ids)
    gold_types = np.zeros((len(types), n_lang))
    np.add.at(gold_types, (ids, gold), 1.0)
    follows = np.ones(total, dtype=bool)
    follows[np.cumsum(sizes) - sizes] = False
    after = np.flatnonzero(follows)
    gold_pairs = np.zeros((n_lang, n_lang))
    np.add.at(gold_pairs, (gold[after - 1], gold[after]), 1.0)
    w = np.zeros((len(used), n_lang))
    t = np.zeros((n_lang, n_lang))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(at, w[cols, y], len(types)) for y in range(n_lang)], axis=1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[ids]
        passed = Messages(e, sizes, t)
        marginals = passed.marginals()
        if marginals[np.arange(total), gold].mean() > 1 - enough:
            break
        joint = passed.alpha[after - 1][:, :, None] * np.exp(t)[None] * (e[after] * passed.beta[after])[:, None, :]
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        expected = np.stack([np.bincount(ids, marginals[:, y], len(types)) for y in range(n_lang)], axis=1)
        gap = (expected - gold_types) / total
        gw = np.stack([np.bincount(cols, gap[at, y], len(used)) for y in range(n_lang)], axis=1) + l2 * w
        gt = (pairs - gold_pairs) / total + l2 * t
        for p, g, m, v in ((w, gw, *moments[:2]), (t, gt, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    weights = np.zeros((BUCKETS, n_lang), dtype=np.float32)
    weights[used] = w
    return LangModel(languages, weights, t, lexicon)


def training_part(id_col: str = "doc_id") -> Column:
    """True for documents whose language may be learned from: crc32 of the id mod 4 is not 2."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAINING_DOCS, max_languages: int = MAX_LANGUAGES) -> LangModel | None:
    """Fit on at most ``max_docs`` documents with a language, outside the held-out part: those with the smallest hash of their id, in
    equal parts by language as far as there are any, and all of their texts, however long. Languages are those of the ``max_languages`` values
    of ``lang_col`` that most rows have (of equal counts the first by name); rows of other values, nulls, and null or empty texts teach nothing. Of rows that repeat an id
    one is used. A third of the chains join two documents, so that transitions are seen. Other columns are ignored. None if there is nothing to learn from, as
    in an empty table."""
    from pyspark.sql import Window

    labelled = docs.where(training_part(id_col) & column(lang_col).isNotNull() & (F.octet_length(utf8(text_col)) > 0))
    keys = labelled.select(column(id_col).alias("__k"), column(lang_col).cast("string").alias("__lang"))
    counted = keys.groupBy("__lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__lang").limit(max_languages)
    languages = sorted(r[0] for r in counted.collect())
    if not languages:
        return None
    keys = keys.where(F.col("__lang").isin(languages))
    labelled = labelled.where(column(lang_col).cast("string").isin(languages))
    share = max(1, max_docs // len(languages))
    order, salt = (F.xxhash64("__k"), F.col("__k")), F.pmod(F.xxhash64("__k", F.lit(1)), F.lit(64))
    chosen = keys
    for by in (("__lang", salt), ("__lang",)):  # the first of each salt, and of those the first of each language
        ranked = chosen.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        chosen = ranked.where(F.col("__r") <= share).drop("__r")
    chosen = chosen.select(F.col("__k").alias("__c")).distinct()
    rows = labelled.select(column(id_col).alias("k"), F.struct(F.xxhash64(column(text_col)), column(lang_col).cast("string").alias("lang"), utf8(text_col).alias("t")).alias("best"))
    rows = rows.join(F.broadcast(chosen), F.col("k") == F.col("__c")).groupBy("k").agg(F.max("best").alias("best")).select("k", "best.lang", "best.t").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.k).encode()), str(r.k), r.lang))
    index = {x: i for i, x in enumerate(languages)}
    parts = [(words_of(bytes(r.t)), index[r.lang]) for r in rows]
    parts = [(w, y) for w, y in parts if w]
    if not parts:
        return None
    chains = []
    for i, (words, y) in enumerate(parts):
        chains.append((words, [y] * len(words)))
        other, z = parts[(i * 7 + 3) % len(parts)]
        if i % 2 == 0 and z != y:
            chains.append((words + other, [y] * len(words) + [z] * len(other)))
    chains = [c for c in chains if c[0]]
    return fit_crf(chains, tuple(languages))


class Labeller:
    """Scores of words, remembered, and marginals of documents."""

    def __init__(self, model: LangModel, most: int = 300_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.letter = np.zeros(0, dtype=bool)
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)

    def _learn(self, new: list[bytes]) -> None:
        scores = np.zeros((len(new), self.scores.shape[1]), dtype=np.float32)
        letter = np.zeros(len(new), dtype=bool)
        for i, w in enumerate(new):
            if has_letter(w):
                letter[i] = True
                scores[i] = self.model.weights[word_features(w, self.model.lexicon)].sum(axis=0)
            self.index[w] = len(self.scores) + i
        self.scores = np.concatenate([self.scores, scores])
        self.letter = np.concatenate([self.letter, letter])

    def marginals(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's probabilities, whether it has a letter, and the number of its text."""
        if len(self.index) > self.most:
            self._reset()
        new = list({w for words in texts for w in words if w not in self.index})
        if new:
            self._learn(new)
        index = self.index
        ids = np.array([index[w] for words in texts for w in words], dtype=np.int64)
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        if not len(ids):
            return np.zeros((0, self.scores.shape[1])), np.zeros(0, bool), doc
        scores = self.scores[ids]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return Messages(e, sizes, self.model.transitions).marginals(), self.letter[ids], doc


def predict_languages(docs: DataFrame, model: LangModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``held_out`` (not ``training_part``), ``lang_pred``, ``score`` (the mean
    probability of that language over the words that have a letter) and ``n_switches`` (neighbouring
    words whose most probable languages differ).

    Only the text is read. A text that is null or has no letter, and any text without a model, is
    'und' with score 0. A null id is not held out. Words of the whole text are labelled, as one chain.
    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_id(docs, id_col, "held_out boolean,lang_pred string,score double,n_switches long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        labeller = Labeller(own) if own else None
        for batch in batches:
            langs, scores, switches = [], [], []
            texts = batch.column(2)
            at = 0
            while at < batch.num_rows:
                part, n = [], 0
                while at < batch.num_rows and (not part or n < 100_000):
                    part.append(words_of(texts[at].as_py()))
                    n += len(part[-1])
                    at += 1
                if labeller is None:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    switches += [0] * len(part)
                    continue
                p, letter, doc = labeller.marginals(part)
                count = np.bincount(doc[letter], minlength=len(part))
                mean = np.stack([np.bincount(doc[letter], p[letter, y], len(part)) for y in range(len(own.languages))], axis=1)
                mean = mean / np.maximum(count, 1)[:, None]
                best = mean.argmax(axis=1)
                top, where = p[letter].argmax(axis=1), doc[letter]
                moves = np.bincount(where[1:][(top[1:] != top[:-1]) & (where[1:] == where[:-1])], minlength=len(part))
                for i in range(len(part)):
                    langs.append(own.languages[best[i]] if count[i] else UNKNOWN)
                    scores.append(float(min(1.0, mean[i, best[i]])) if count[i] else 0.0)
                    switches.append(int(moves[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())],
                names=[id_col, "held_out", "lang_pred", "score", "n_switches"],
            )

    out = F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select(column(id_col), out.alias("__out"), utf8(text_col).alias("__text")).mapInArrow(scan, schema)
