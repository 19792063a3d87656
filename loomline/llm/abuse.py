"""Scores for abusive, hateful and sexual content by a convolutional text classifier.

A text is cut into sentences; veiled spelling is undone (invisible signs, letters set apart or repeated, digits and symbols in
place of letters; a word with masked letters becomes the marked word of the training sample that fits it). Words are hashed
to embeddings. Filters of several widths run over a sentence, each keeps its maximum, and a linear head per category
gives the sentence's score; a document's score is that of its strongest sentence. All of it is trained in numpy on a
bounded sample of labelled documents. Thresholds are calibrated per language on documents held out from training.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled documents that the classifier is fitted on at most; a seeded hash chooses them if there are more.
SAMPLE = 12_000
BUCKETS, DIMS, FILTERS, WIDTHS, LONGEST = 1 << 15, 20, 28, (1, 2, 3, 5), 36

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_](?:[\w@$!#*%'’-]*[\w@$*%])?|[@$#*%][\w@$!#*%]*[^\W_][\w@$*%]*", re.U)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_MASKED = re.compile(r"[@$!#*%\d]")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in plain spelling but with masked letters left."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    t = _APART.sub(lambda m: m[0].replace(" ", ""), t)
    t = _RUN.sub(r"\1", t)
    out = []
    for s in _SENTENCE.split(t):
        words = _WORD.findall(s)
        # long sentences in overlapping parts, so that every filter sees every place
        out += [words[i : i + LONGEST] for i in range(0, len(words), LONGEST - max(WIDTHS) + 1)] if len(words) > LONGEST else [words] if words else []
    return out


class Lexicon:
    """Marked words of the training sample, to read masked ones by."""

    def __init__(self, weight: dict[str, float]) -> None:
        self.weight = weight
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for w in sorted(weight, key=lambda w: (-weight[w], w)):
            self.by_size[len(w)].append(w)
        self.known: dict[str, str] = {}

    def plain(self, word: str) -> str:
        if not _MASKED.search(word) or word.isdigit():
            return word
        if (w := self.known.get(word)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            w = self.known[word] = self._plain(word)
        return w

    def _plain(self, word: str) -> str:
        leet = word.translate(_LEET)
        if leet in self.weight:
            return leet
        shape = "".join("[^ ]" if _MASKED.match(c) else re.escape(c) for c in word)
        if sum(c.isalpha() for c in word) >= 1 and re.search(r"[@$!#*%]|[a-z]\d|\d[a-z]", word):
            form = re.compile(shape)
            for w in self.by_size.get(len(word), ()):
                if form.fullmatch(w):
                    return w
        return leet if leet.isalpha() else "0" if any(c.isdigit() for c in word) else word


def bucket(word: str) -> int:
    return 1 + zlib.crc32(word.encode()) % (BUCKETS - 1)


@dataclass
class Model:
    lexicon: Lexicon
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    head: np.ndarray
    head_bias: np.ndarray
    thresholds: dict[str, list[float]] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)

    def encode(self, text: str) -> list[list[int]]:
        out = []
        for s in sentences(text):
            row = []
            for w in s:
                if (i := self.ids.get(w)) is None:
                    if len(self.ids) > 300_000:
                        self.ids.clear()
                    i = self.ids[w] = bucket(self.lexicon.plain(w))
                row.append(i)
            out.append(row)
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence logits of word ids (sentences, length); also what the backward pass needs."""
        e = self.embed[x]
        pooled, at = [], []
        n, length, _ = e.shape
        for w, k, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            h = np.zeros((n, length - w + 1, FILTERS), np.float32) + b
            for j in range(w):
                h += e[:, j : length - w + 1 + j] @ k[j]
            at.append(h.argmax(1))
            pooled.append(np.take_along_axis(h, at[-1][:, None], 1)[:, 0])
        p = np.maximum(np.concatenate(pooled, 1), 0)
        return p @ self.head + self.head_bias, p, np.stack(at), e

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability per category of each text; 0 for null and wordless ones."""
        out = np.full((len(texts), len(CATEGORIES)), -np.inf, np.float32)
        rows, owner = [], []
        for i, t in enumerate(texts):
            if t:
                s = self.encode(t)
                rows += s
                owner += [i] * len(s)
        by = sorted(range(len(rows)), key=lambda r: len(rows[r]))
        for at in range(0, len(by), 2048):
            part = by[at : at + 2048]
            logits = self.forward(_padded([rows[r] for r in part]))[0]
            np.maximum.at(out, [owner[r] for r in part], logits)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30))) * np.isfinite(out)


def _padded(rows: list[list[int]]) -> np.ndarray:
    longest = max(max(map(len, rows), default=0), max(WIDTHS))
    x = np.zeros((len(rows), longest + max(WIDTHS) - 1), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x


def _targets(labels: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Per document and category what raters say, and how much it counts.

    A rater names one category even if several apply, so a document given another category says little about the rest."""
    y, weight = np.zeros((len(labels), len(CATEGORIES)), np.float32), np.ones((len(labels), len(CATEGORIES)), np.float32)
    for i, own in enumerate(labels):
        marked = {x for x in own if x in CATEGORIES}
        for c, name in enumerate(CATEGORIES):
            if name in marked:
                y[i, c] = 1
                weight[i, c] = 1.0 if "none" not in own else 0.6
            elif marked:
                weight[i, c] = 0.15
    return y, weight


def _lexicon(texts: list[list[list[str]]], y: np.ndarray) -> tuple[Lexicon, dict[str, np.ndarray]]:
    """Log odds of words per category (documents counted), and the words marked by them."""
    n = Counter()
    pos: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CATEGORIES), np.float32))
    for doc, own in zip(texts, y, strict=True):
        for w in {w for s in doc for w in s}:
            n[w] += 1
            pos[w] += own
    base = y.mean(0) + 1e-3
    odds = {}
    for w, k in n.items():
        if k >= 3:
            share = (pos[w] + 2 * base) / (k + 2)
            odds[w] = np.log(share / (1 - np.minimum(share, 0.999))) - np.log(base / (1 - np.minimum(base, 0.999)))
    marked = {w: float(o.max()) for w, o in odds.items() if o.max() > 1.2 and len(w) > 2 and w.isalpha()}
    return Lexicon(marked), odds


def fit(texts: list[str], labels: list[list[str]], langs: list[str], seed: int = 0) -> Model:
    """The classifier of a labelled sample; without any labelled text it scores everything low."""
    rng = np.random.default_rng(seed)
    y, weight = _targets(labels)
    words = [sentences(t) for t in texts]
    lexicon, odds = _lexicon(words, y) if len(texts) else (Lexicon({}), {})
    embed = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    embed[0] = 0
    for w, o in odds.items():  # the first places tell what a word was met with
        embed[bucket(w), : len(CATEGORIES)] = np.clip(o, -2, 3) * 0.3
    filters = [rng.normal(0, 0.25 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in filters:
        for c in range(len(CATEGORIES)):  # some filters start out looking for one category
            k[:, c, c :: len(CATEGORIES) + 1] += 0.5 / len(k)
    head = rng.normal(0, 0.05, (FILTERS * len(WIDTHS), len(CATEGORIES))).astype(np.float32)
    for c in range(len(CATEGORIES)):
        for g in range(len(WIDTHS)):
            head[g * FILTERS + c : (g + 1) * FILTERS : len(CATEGORIES) + 1, c] += 0.15
    m = Model(lexicon, embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], head, np.full(len(CATEGORIES), -2.0, np.float32))
    m.thresholds[""] = [0.5] * len(CATEGORIES)
    if not y[[bool(w) for w in words]].any():
        m.head[:] = 0
        m.head_bias[:] = -6
        return m
    held = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 5 == 0 for t in texts])
    if len(texts) < 100:
        held[:] = False
    docs = [m.encode(t) for t in texts]
    train = np.array([i for i in np.flatnonzero(~held) if docs[i]], int)
    # half of what is shown has a category, half is labelled none
    sort = np.where(y[train].max(1) > 0, 0, 1)
    share = np.array([1 / max(1, (sort == k).sum()) for k in range(2)])[sort]
    _train(m, docs, train, share / share.sum(), y, weight, rng)
    m.ids.clear()
    _calibrate(m, texts, y, weight, np.array(langs), held if held.any() else np.ones(len(texts), bool))
    return m


def _train(m: Model, docs: list[list[list[int]]], train: np.ndarray, share: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    params = [m.embed, *m.filters, *m.bias, m.head, m.head_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = int(np.clip(len(train) / 4, 150, 800))
    mean, kept = [np.zeros_like(p) for p in params], 0
    for step in range(1, steps + 1):
        own = rng.choice(train, 48, p=share)
        rows = [s for i in own for s in docs[i]]
        owner = np.repeat(np.arange(len(own)), [len(docs[i]) for i in own])
        x = _padded(rows)
        hidden = rng.random(x.shape) < 0.08  # words left out now and then, so that no single one decides
        x = np.where(hidden, 0, x)
        logit, p, at, e = m.forward(x)
        best = np.full((len(own), len(CATEGORIES)), -np.inf, np.float32)
        np.maximum.at(best, owner, logit)
        prob = 1 / (1 + np.exp(-best))
        err = (prob - y[own]) * weight[own] / len(own)
        # the strongest sentence of a document carries its error
        d = np.where(logit == best[owner], err[owner], 0).astype(np.float32)
        g_head, g_bias = p.T @ d + 1e-4 * m.head, d.sum(0)
        dp = (d @ m.head.T) * (p > 0)
        g_embed, g_filters, g_fbias = np.zeros_like(e), [], []
        row = np.arange(len(x))[:, None]
        for i, (w, k) in enumerate(zip(WIDTHS, m.filters, strict=True)):
            own_d = dp[:, i * FILTERS : (i + 1) * FILTERS]
            g_fbias.append(own_d.sum(0))
            gk = np.zeros_like(k)
            for j in range(w):
                seen = e[row, at[i] + j]  # sentences, filters, dims
                gk[j] = np.einsum("sf,sfd->df", own_d, seen, optimize=True)
                np.add.at(g_embed, (row, at[i] + j), own_d[:, :, None] * k[j].T[None])
            g_filters.append(gk)
        flat = np.zeros_like(m.embed)
        touched = np.unique(x)
        np.add.at(flat, x.ravel(), g_embed.reshape(-1, DIMS))
        flat[0] = 0
        rate = 0.01 * (1 - 0.8 * step / steps)
        for j, (q, g) in enumerate(zip(params, [flat, *g_filters, *g_fbias, g_head, g_bias], strict=True)):
            part = touched if j == 0 else slice(None)  # only the rows of words that were met move
            first[j][part] = 0.9 * first[j][part] + 0.1 * g[part]
            second[j][part] = 0.99 * second[j][part] + 0.01 * g[part] ** 2
            q[part] -= rate * (first[j][part] / (1 - 0.9**step)) / (np.sqrt(second[j][part] / (1 - 0.99**step)) + 1e-7)
        if step > steps // 2 and step % 10 == 0:
            kept += 1
            for a, q in zip(mean, params, strict=True):
                a += (q - a) / kept
    for a, q in zip(mean, params, strict=True):  # the mean of the second half's states varies less than the last
        q[:] = a


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, middle: float = 0.5) -> float:
    """Threshold of the best weighted F1, in the middle of the gap it lies in; the fewer cases, the nearer to ``middle``."""
    if not y.any():
        return middle
    by = np.argsort(-p)
    p, y, weight = p[by], y[by], weight[by]
    hit, shown = np.cumsum(y * weight), np.cumsum(weight)
    f = 2 * hit / (shown + (y * weight).sum())
    last = np.r_[p[1:] < p[:-1], True]
    i = int(np.argmax(np.where(last, f, -1)))
    low = p[i + 1] if i + 1 < len(p) else 0.0
    # between the gap's ends on the scale of odds, not beyond what plain scores mean
    z = (np.log(p[i] / (1 - p[i] + 1e-9) + 1e-9) + np.log(low / (1 - low + 1e-9) + 1e-9)) / 2
    n = y.sum()  # few cases say little
    return float(np.clip((n / (1 + np.exp(-z)) + 40 * middle) / (n + 40), 0.25, 0.8))


def _calibrate(m: Model, texts: list[str], y: np.ndarray, weight: np.ndarray, langs: np.ndarray, held: np.ndarray) -> None:
    at = np.flatnonzero(held)
    p = m.scores([texts[i] for i in at])
    whole = [_best_threshold(p[:, c], y[at, c], weight[at, c]) for c in range(len(CATEGORIES))]
    m.thresholds[""] = whole
    for lang in sorted({*langs[at]} - {""}):
        own = langs[at] == lang
        m.thresholds[str(lang)] = [_best_threshold(p[own, c], y[at, c][own], weight[at, c][own], whole[c]) for c in range(len(CATEGORIES))]



def language(c: Column | str) -> Column:
    """One spelling of a language tag; empty where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})", 1), F.lit(""))


def fit_labels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Model:
    """The classifier of at most ``sample`` labelled documents, drawn by a seeded hash of their ids."""
    l = labels.where("doc_id is not null and label is not null").select("doc_id", F.lower(F.trim("label")).alias("label"))
    l = l.groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    l = l.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    d = documents.where(F.col("text").isNotNull()).select("doc_id", "text", language("lang").alias("lang"))
    rows = d.join(l, "doc_id").orderBy("doc_id", "text").limit(2 * sample).toPandas()
    return fit(rows["text"].tolist(), [list(x) for x in rows["labels"]], rows["lang"].tolist(), seed)


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``(doc_id, source, lang, abusive, hateful, sexual, categories)``: scores of every document and what passes the thresholds.

    Whole texts are scored. Null, empty and wordless texts score 0 and have no category; a null or unknown language has the
    thresholds of all languages together. Repeated rows each come out. Without labels nothing passes. The model that goes to
    the tasks has a fixed size, whatever the tables hold.
    """
    from loomline.llm.mixing import source_name

    model = documents.sparkSession.sparkContext.broadcast(fit_labels(documents, labels, sample, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            p = m.scores(b.column(3).to_pylist())
            limits = [m.thresholds.get(g, m.thresholds[""]) for g in b.column(2).to_pylist()]
            passed = [[c for c, v, t in zip(CATEGORIES, row, limit, strict=True) if v >= t and v > 0] for row, limit in zip(p, limits, strict=True)]
            scores = [pa.array(p[:, c].astype(np.float64)) for c in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *scores, pa.array(passed, pa.list_(pa.string()))], names=["doc_id", "source", "lang", *CATEGORIES, "categories"]
            )

    d = documents.select("doc_id", source_name("source").alias("source"), language("lang").alias("lang"), "text")
    return d.mapInArrow(run, "doc_id long, source string, lang string, abusive double, hateful double, sexual double, categories array<string>")


def rates(scored: DataFrame) -> DataFrame:
    """``(source, n_docs, abusive, hateful, sexual)``: per source its documents and the share with each category."""
    share = [F.avg(F.array_contains("categories", c).cast("int")).alias(c) for c in CATEGORIES]
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *share)
