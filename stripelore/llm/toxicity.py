"""Toxicity by a subsequence string kernel: Nyström landmarks, a linear support vector machine on them, scores of texts."""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_HAND, map_arrow, table

#: Length of the common subsequences and weight of each character that one spans.
ORDER, DECAY = 4, 0.8
#: Longer words are cut into windows of so many characters (one for the mark of a beginning) that begin every STEP characters.
UNIT, STEP = 12, 4
#: A window across spaces is scored if it has all characters of a landmark of so many letters or more, in their order, and at most so many others.
LETTERS, INSERTED = 5, 1
#: Bounds of the sample that a model is fitted on: documents of each label, in the order of a hash of their ids.
TOXIC_DOCS, CLEAN_DOCS = 500, 1500
#: Nyström landmarks drawn from windows of toxic sentences, and from those of clean ones, at most: the size of the model.
INSULTS, COMMON = 40, 12
#: Characters of text, and windows, that are worked out at a time.
LOT, STRIP = 1 << 20, 16384

_RUN = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
_SENTENCE = re.compile(r"[.!?]+\s+|\s*\n\s*")
_OUTSIDE = re.compile(r"[\W_]+")


def windows(letters: str) -> list[str]:
    return [letters[i : i + UNIT] for i in range(0, max(1, len(letters) - UNIT + STEP), STEP)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def _run(found: str) -> list[str]:
    """A run of short words with repeats in a row struck out, if three different neighbours are left."""
    words = found.split()
    words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
    spelled = [g.split() for g in " ".join(w if len(w) == 1 else "  " for w in words).split("   ")]
    return [" ".join(g) for g in (words, *spelled) if len(g) > 2]


def raw_units(text: str) -> set[str]:
    """What is scored of a text: its words and its runs of three or more words of one or two characters ("s o  b a d")."""
    low = text.lower()
    return set(low.split()).union(*[_run(m.group()) for m in _RUN.finditer(low)])


def bare(unit: str) -> list[str]:
    """A word's letters and digits behind a mark of its beginning, in windows."""
    letters = _OUTSIDE.sub("", unit)
    return windows("^" + letters) if len(letters) >= ORDER - 1 else []


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), max(1, size.max(initial=1))), np.uint32)
    for i, s in enumerate(strings):
        out[i, : size[i]] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


class _Landmarks:
    """Length of the longest common subsequence of strings with each landmark, all strings at once: a row of bits for each."""

    def __init__(self, landmarks: list[str]):
        codes, self.size = _codes(landmarks)
        kind = np.uint16 if codes.shape[1] <= 16 else np.uint64
        if codes.shape[1] > 64:
            raise ValueError("landmarks have 64 characters at most")
        alphabet = np.unique(codes[codes > 0])
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        self.bits = np.zeros((len(landmarks), len(alphabet) + 1), kind)
        for j in range(codes.shape[1]):
            on = codes[:, j] > 0
            self.bits[np.flatnonzero(on), self.symbol[codes[on, j]]] |= kind(1 << j)
        self.mark = self.symbol[ord("^")]

    def common(self, symbols: np.ndarray, more: int | None = None) -> Iterator[np.ndarray]:
        """For each landmark in turn, the lengths for strings given as columns of symbols, or for so many characters of
        them as the landmark has and `more`."""
        ones = np.full(symbols.shape[1], ~self.bits.dtype.type(0))
        for bits, size in zip(self.bits, self.size.tolist(), strict=True):
            rest = ones
            for row in bits.take(symbols if more is None else symbols[: size + more]):
                met = rest & row
                rest = (rest + met) | (rest - met)
            yield np.bitwise_count(~rest)


def subsequence_kernel(strings: list[str], landmarks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Sum over all common subsequences of `order` characters of decay ** (characters spanned in both), each string by each landmark.

    Only pairs that share a subsequence of that length are worked out: the others' kernel is 0."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    if not strings or not landmarks:
        return out
    s, s_size = _codes(strings)
    t, _ = _codes(landmarks)
    known = _Landmarks(landmarks)
    first, second = [], []
    for k in range(0, len(strings), STRIP):
        for j, common in enumerate(known.common(np.ascontiguousarray(known.symbol[s[k : k + STRIP]].T))):
            i = np.flatnonzero(common >= order)
            first.append(i + k)
            second.append(np.full(len(i), j))
    a, b = np.concatenate(first), np.concatenate(second)
    by_size = np.argsort(s_size[a], kind="stable")
    a, b = a[by_size], b[by_size]
    for k in range(0, len(a), 8192):
        i, j = a[k : k + 8192], b[k : k + 8192]
        out[i, j] = _weights(s[i, : s_size[i[-1]]], t[j], order, decay)
    return out


def _weights(x: np.ndarray, y: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of each row of x with the same row of y (codes, 0 behind the end)."""
    n, width = y.shape
    fall = np.triu(np.float32(decay) ** (np.arange(width)[None, :] - np.arange(width)[:, None]).clip(0)).astype(np.float32)
    # prefix[i][:, j]: weight of subsequences of i characters that start in x so far and in y before place j
    prefix = [np.ones((n, width + 1), np.float32)] + [np.zeros((n, width + 1), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for c in range(x.shape[1]):
        same = ((y == x[:, c : c + 1]) & (x[:, c : c + 1] != 0)).astype(np.float32) * np.float32(decay * decay)
        total += (same * prefix[order - 1][:, :-1]).sum(1)
        for i in range(order - 1, 0, -1):
            prefix[i] *= np.float32(decay)
            prefix[i][:, 1:] += (same * prefix[i - 1][:, :-1]) @ fall
    return total


def norms(strings: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Square root of each string's kernel with itself."""
    out = np.ones(len(strings), np.float32)
    codes, size = _codes(strings)
    by_size = np.argsort(size, kind="stable")
    for k in range(0, len(strings), 8192):
        i = by_size[k : k + 8192]
        x = codes[i, : max(1, size[i[-1]])]
        out[i] = np.sqrt(np.maximum(_weights(x, x, order, decay), 1e-12))
    return out


def normalised_kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel over the norms of both sides, 0 to 1."""
    if not strings or not landmarks:
        return np.zeros((len(strings), len(landmarks)), np.float32)
    out = subsequence_kernel(strings, landmarks)
    some = np.flatnonzero(out.any(axis=1))
    out[some] /= norms([strings[i] for i in some])[:, None] * norms(landmarks)[None, :]
    return out


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for letters and digits, 2 for white space, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for p in range(0x110000):
        c = chr(p)
        out[p] = 2 if c.isspace() else c.isalnum()
    return out


def across(texts: list[str], landmarks: _Landmarks, inserted: int = INSERTED) -> list[set[str]]:
    """Of each text, the runs of two or more whole words whose letters are those of a landmark, in their order, and at most `inserted`
    others: what is spelled out, or cut by spaces. Landmarks of few letters are left to words, as short words make them up by chance."""
    out: list[set[str]] = [set() for _ in texts]
    low = [t.lower() for t in texts]
    first = 0
    while first < len(low):
        last, size = first + 1, len(low[first])
        while last < len(low) and size + len(low[last]) <= LOT:
            size += len(low[last])
            last += 1
        own = out[first:last]  # the sets themselves
        _across(low[first:last], landmarks, inserted, own)
        first = last
    return out


def _across(low: list[str], landmarks: _Landmarks, inserted: int, out: list[set[str]]) -> None:
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    at = np.flatnonzero(kind == 1)
    if not len(at):
        return
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])[at]
    word = np.cumsum(kind == 2)[at]
    fresh = np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])))
    letters = codes[at]
    starts = np.flatnonzero(fresh)
    width = int(landmarks.size.max()) + inserted
    symbols = np.append(landmarks.symbol[letters], np.zeros(width, np.uint16))
    final = np.concatenate((fresh[1:], [True], np.zeros(width, bool)))  # the letter that ends a word
    owner = np.append(text, np.full(width, -1))
    # of words that are as long as a landmark the windows are the words' own
    longest = np.append(starts[1:], len(letters)) - starts < width
    starts = starts[longest]
    for k in range(0, len(starts), STRIP):
        some = starts[k : k + STRIP]
        columns, ends = np.empty((width, len(some)), np.uint16), np.zeros((width, len(some)), bool)
        columns[0] = landmarks.mark
        words = np.zeros(len(some), np.int8)
        for j in range(width - 1):
            here = owner[some + j] == text[some]
            columns[j + 1] = np.where(here, symbols[some + j], 0)
            ends[j + 1] = final[some + j] & here & (words > 0)
            words += final[some + j]
        for size, common in zip(landmarks.size.tolist(), landmarks.common(columns, inserted), strict=True):
            if size <= LETTERS:
                continue
            good = common == size
            for n in range(size, size + inserted + 1):
                for i in np.flatnonzero(good & ends[n - 1]).tolist():
                    a = int(some[i])
                    out[text[a]].add("^" + letters[a : a + n - 1].tobytes().decode("utf-32-le", "surrogatepass"))


@dataclass
class ToxicityModel:
    """Weights of landmarks (the machine's weights behind the Nyström projection), its bias, and the scale of scores."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.0
    #: how many of the landmarks, the first, are from toxic sentences
    insults: int = 0
    slope: float = 4.0
    offset: float = 0.0
    remembered: int = 250_000
    known: dict[str, float] = field(default_factory=dict, repr=False)
    aligned: _Landmarks | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "aligned": None}

    def values(self, strings: list[str]) -> np.ndarray:
        """The machine's value of each window."""
        if not self.landmarks or not strings:
            return np.full(len(strings), self.bias)
        return normalised_kernel(strings, self.landmarks) @ self.weights + self.bias

    def margins(self, units: list[str]) -> np.ndarray:
        """The machine's value of each word, the largest of its windows."""
        flat, owner = [], []
        for i, u in enumerate(units):
            for w in bare(u):
                flat.append(w)
                owner.append(i)
        out = np.full(len(units), self.bias, np.float64)
        np.maximum.at(out, owner, self.values(flat))
        return out

    def learn(self, units: set[str]) -> None:
        """Values of words that are not known yet; `remembered` bounds how many are kept."""
        new = units.difference(self.known)
        if new and len(self.known) > self.remembered:
            self.known.clear()
            new = units
        new = sorted(new)
        self.known.update(zip(new, self.margins(new).tolist(), strict=True))

    def document_margins(self, texts: list[str]) -> np.ndarray:
        """Of each text: the largest of its words and of its windows across spaces, since a sentence is as toxic as its most
        toxic part, and so is a text."""
        units = [raw_units(t) for t in texts]
        self.learn(set().union(*units))
        known = self.known.__getitem__
        out = np.array([max(map(known, u), default=self.bias) for u in units], np.float64)
        if self.insults:
            self.aligned = self.aligned or _Landmarks(self.landmarks[: self.insults])
            runs = across(texts, self.aligned)
            every = sorted(set().union(*runs))
            value = dict(zip(every, self.values(every).tolist(), strict=True))
            out = np.maximum(out, [max(map(value.__getitem__, r), default=self.bias) for r in runs])
        return out

    def margin(self, text: str) -> float:
        return float(self.document_margins([text])[0])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _parts(word: str) -> set[str]:
    return {word[i : i + n] for n in range(4, 10) for i in range(len(word) - n + 1)}


def _full(part: str) -> float:
    """Favours the longer of strings that are found about as often."""
    return len(part) / (len(part) + 1)


def insult_stems(toxic: list[set[str]], clean: list[set[str]], most: int = INSULTS) -> list[str]:
    """Strings of 4 to 9 characters inside windows that toxic documents have and clean ones (almost) never do: what the landmarks of toxic
    sentences are drawn from, and which of their windows are taken for toxic at first.

    Greedy: takes the string found in most toxic documents (of near equals the longest), strikes out the words that
    contain it, and goes on while so many documents could not have it by chance. Then the same among the documents
    without any of these strings, for such as are in three of them at least.
    """
    words: dict[str, set[int]] = defaultdict(set)
    for i, doc in enumerate(toxic):
        for w in doc:
            words[w].add(i)
    clean_words = Counter(w for doc in clean for w in doc)
    suspect = [w for w in words if len(words[w]) / len(toxic) > 4 * clean_words[w] / max(1, len(clean))]
    count: Counter[str] = Counter()
    for w in suspect:
        for p in _parts(w):
            count[p] += len(words[w])
    count = Counter({p: n for p, n in count.items() if n >= 3})
    in_clean = dict.fromkeys(count, 0)
    for w, n in clean_words.items():
        for p in _parts(w):
            if p in in_clean:
                in_clean[p] += n
    chance, share = len(count) / 0.01, len(toxic) / (len(toxic) + len(clean))
    count = Counter({p: n for p, n in count.items() if in_clean[p] <= 0.01 * n / len(toxic) * len(clean)})
    parts: dict[str, list[str]] = defaultdict(list)
    for w in suspect:
        for p in _parts(w):
            if p in count:
                parts[p].append(w)
    least = max(3, int(np.ceil(np.log(max(1.0, chance)) / -np.log(share)))) if clean else 3

    def is_rare(p: str, docs: int) -> bool:
        return in_clean[p] <= 0.01 * docs / len(toxic) * len(clean)

    found: list[str] = []
    struck: set[str] = set()
    reached: set[int] = set()
    for least, among in ((least, None), (3, set(range(len(toxic))))):
        if among is not None:
            among -= reached
        heap = [(-n * _full(p), -n, p) for p, n in count.items() if n >= least]
        heapq.heapify(heap)
        while heap and len(found) < most:
            _, n, p = heapq.heappop(heap)
            docs = set().union(*[words[w] for w in parts[p] if w not in struck])
            if among is not None:
                docs &= among
            if len(docs) < least:
                continue
            if len(docs) < -n:
                heapq.heappush(heap, (-len(docs) * _full(p), -len(docs), p))
            elif is_rare(p, len(docs)):
                found.append(p)
                struck.update(parts[p])
                reached |= docs
                if among is not None:
                    among -= docs
    return found


def _without_copies(docs: list[set[str]]) -> list[int]:
    """Places of one document of those whose long units have the same least hash under one of two functions: near copies do."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, doc in enumerate(docs):
        long_ = [w.encode() for w in doc if len(w) >= 10]
        keys = {(s, min(xxhash.xxh3_64_intdigest(w, s) for w in long_)) for s in (1, 2)} if long_ else set()
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        short = 1 - y * (x @ w)
        on = short > 0
        h = ridge + 2 * cost * (x[on] * weight[on, None]).T @ x[on]
        new = np.linalg.solve(h, 2 * cost * (x[on] * weight[on, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = w + 0.7 * (new - w)
    return w


def fit(toxic: list[list[str]], clean: list[list[str]]) -> ToxicityModel:
    """A model from labelled sentences, those of a document in a list. A clean document has clean sentences alone; of a toxic one at least
    one sentence, and of that at least one window, is toxic, and which is found in rounds (multiple-instance learning): the
    machine is trained on all windows of clean sentences against those of toxic sentences that hold insult stems, and in each
    round each toxic document adds the worst window of its worst sentence."""

    def parts(docs: list[list[str]]) -> tuple[list[list[str]], list[set[str]]]:
        sets = [{w for s in doc for u in raw_units(s) for w in bare(u)} for doc in docs]
        stay = _without_copies(sets)
        return [docs[i] for i in stay], [sets[i] for i in stay]

    (toxic, t_parts), (clean, c_parts) = parts(toxic), parts(clean)
    insults = insult_stems(t_parts, c_parts) if toxic and clean else []
    if not insults:
        return ToxicityModel()
    # a third of the clean documents is kept from the machine, so that the scale of scores is not set by what it has learned
    cut = (2 * len(clean) + 2) // 3
    counts = Counter(w for doc in c_parts[:cut] for w in doc)
    often = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    close = normalised_kernel(often, insults).max(1)
    landmarks = list(dict.fromkeys([*insults, *[often[i] for i in np.argsort(-close, kind="stable")[: COMMON // 2]], *often[: COMMON // 2]]))
    aligned = _Landmarks(insults)
    for docs, sets in ((toxic, t_parts), (clean, c_parts)):
        for own, runs in zip(sets, across(["\n".join(d) for d in docs], aligned), strict=True):
            own |= runs
    clean_parts = Counter(w for doc in c_parts[:cut] for w in doc)
    negative = sorted(clean_parts)
    often = np.array([clean_parts[u] for u in negative], np.float64)
    gram = normalised_kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
    project = vector / np.sqrt(np.maximum(value, 1e-3))
    every = sorted(set().union(*t_parts, *c_parts))
    at = {u: i for i, u in enumerate(every)}
    kernel = normalised_kernel(every, landmarks)
    x = kernel @ project
    rows = [at[u] for u in negative]
    joined = re.compile("|".join(map(re.escape, insults)))
    positive = {w for doc in t_parts for w in doc if joined.search(w) and w not in clean_parts}
    for _ in range(3):
        pos = sorted(positive)
        y = np.array([1.0] * len(pos) + [-1.0] * len(negative))
        # a clean window weighs by the documents that it is in, and both sides weigh the same
        weight = np.concatenate((np.full(len(pos), 0.5 / max(1, len(pos))), 0.5 * often / often.sum())) * len(y)
        w = _machine(x[[at[u] for u in pos] + rows], y, weight)
        model = ToxicityModel(landmarks, (project @ w[:-1]).astype(np.float32), float(w[-1]), insults=len(insults))
        value = dict(zip(every, (kernel @ model.weights + model.bias).tolist(), strict=True))
        for doc in t_parts:
            best = max(doc, default=None, key=lambda u: (value[u], u))
            if best is not None and best not in clean_parts and value[best] > 0:
                positive.add(best)
    apart = c_parts[cut:] or c_parts
    m = np.array([max((value[u] for u in doc), default=model.bias) for doc in [*t_parts, *apart]])
    model.slope, model.offset = _platt(m, np.array([1.0] * len(toxic) + [0.0] * len(apart)))
    return model


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), a clean document weighing twice a toxic one in all, with a
    weak prior: of the two errors, to lose clean text is the worse."""
    x = np.stack([m, np.ones_like(m)], axis=1)
    weight = np.where(y == 1, 1 / max(1, y.sum()), 2 / max(1, (1 - y).sum())) * len(y) / 3
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.5 * (w - [4.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        w = w - np.linalg.solve(h, g) * 0.8
    slope = float(max(w[0], 0.1))
    return slope, max(float(w[1]), -0.8 * slope)  # what stands at the machine's margin, 1, is toxic


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> ToxicityModel:
    """Fits a model on a sample of labelled documents that are not held out: at most toxic_docs and clean_docs of
    them, in the order of a hash of their ids. Only their sentences reach the driver. Rows without id, text or label take no part;
    without documents of both labels the model calls nothing toxic."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = ids.where("toxic = 1").orderBy(*order).limit(toxic_docs).unionByName(ids.where("toxic = 0").orderBy(*order).limit(clean_docs))
    sample = sample.select(F.col("doc_id").alias("__id"), "toxic")
    some = docs.where("text is not null").select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text"))
    some = some.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [sentences(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(units, pa.list_(pa.string()))], ["toxic", "units"])

    rows = map_arrow(some, run, "toxic int, units array<string>").toArrow()
    groups: tuple[list[list[str]], list[list[str]]] = ([], [])
    for label, units in sorted(zip(rows.column("toxic").to_pylist(), rows.column("units").to_pylist(), strict=True)):
        groups[label].append(units)
    return fit(groups[1], groups[0])


#: The model that this worker process scored with last; what it has learned of words serves the next task too.
_AT_HAND: list[ToxicityModel] = []
AT_HAND["toxicity"] = _AT_HAND


def _kept(model: ToxicityModel) -> ToxicityModel:
    if not _AT_HAND or _AT_HAND[0].landmarks != model.landmarks or _AT_HAND[0].bias != model.bias or not np.array_equal(_AT_HAND[0].weights, model.weights):
        _AT_HAND[:] = [model]
    return _AT_HAND[0]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns, with score (0 to 1) and predicted (1 if score >= 0.5). Whole texts are scored, of any length, word by
    word and by windows across spaces; null and empty texts get the score of a text without words. Nothing but text is an input, so equal
    texts have equal scores; one row for each row, an empty table stays empty, and columns named score or predicted are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    schema = T.StructType([T.StructField("row", docs.select(row).schema["row"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _kept(shared.value)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                m = model.document_margins([t.as_py() or "" for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.probability(m), pa.float64())], ["row", "score"])

    made = map_arrow(docs.select(row, F.col("text").cast("string").alias("text")), run, schema, "toxicity")
    return made.select(*[F.col(f"row.`{c}`") for c in rest], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not called toxic."""
    return score(docs, train(docs, labels)).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
