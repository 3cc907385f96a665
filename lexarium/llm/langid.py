"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed letter n-grams (smoothed log odds of
the two sides, a naive Bayes margin) predicts the bit. The codeword with the least logistic loss, weighted by each bit's
margin, wins; the loss of the runner-up gives a probability and flags ambiguity. A text's margins are the means over its
n-grams, which add up over words, so each distinct word is looked at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows of each language train the classifiers (whole texts).
TRAINING_ROWS = 1500
#: Hashed n-grams of 1 to 4 letters, word edges included.
BUCKETS, LONGEST = 1 << 17, 4
#: Training texts of each language, by the least hash, from which the scale of margins is taken (whole texts).
SCALE_ROWS = 100
#: Words in a worker's table of margins.
TABLE_WORDS = 1 << 19
UNDETERMINED = "und"


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language: the exhaustive code for up to 5, else a random dense code with distant rows and columns that split."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        columns = [[1, *(1 if b >> i & 1 else -1 for i in range(languages - 1))] for b in range(2 ** (languages - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, bits, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (abs(code.sum(0)) == languages).any():
            continue
        distance = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
        if distance > far:
            best, far = code, distance
    return best


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a lower-case text and where each begins; all that is no letter counts as a word edge."""
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    n = len(codes)
    hashes, starts = [], []
    rolling = np.full(n, 2166136261, np.uint32)
    inner = np.ones(n, bool)  # all letters between the first and the last of the window
    for length in range(1, LONGEST + 1):
        last = n - length + 1
        if last <= 0:
            break
        rolling = (rolling[:last] ^ codes[length - 1 :]) * np.uint32(16777619)
        if length > 2:
            inner = inner[:last] & letter[length - 2 : n - 1]
        fits = letter[:last] | letter[length - 1 :] if length <= 2 else inner[:last]
        at = np.flatnonzero(fits)
        h = rolling[at]
        hashes.append((h ^ h >> np.uint32(15)) & np.uint32(BUCKETS - 1))
        starts.append(at)
    return np.concatenate(hashes).astype(np.int64), np.concatenate(starts)


class Coder:
    """Trained bit classifiers and their codewords."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, scale: float):
        self.languages, self.code, self.weights, self.scale = languages, code, weights, scale

    @classmethod
    def trained(cls, examples: Iterable[tuple[str, str]]) -> Coder:
        """From (text, language): each document weighs the same."""
        examples = list(examples)
        languages = sorted({lang for _, lang in examples})
        code = codewords(len(languages))
        if not languages:
            return cls([], code, np.zeros((BUCKETS, 1), np.float32), 1.0)
        sums = np.zeros((len(languages), BUCKETS))
        docs: list[list[tuple]] = [[] for _ in languages]
        for text, lang in examples:
            found, _ = grams(text.lower())
            if len(found):
                y = languages.index(lang)
                buckets, times = np.unique(found, return_counts=True)
                sums[y, buckets] += times / len(found)
                docs[y].append((zlib.crc32(text.encode("utf-8", "replace")), len(found), buckets.astype(np.int32), (times / len(found)).astype(np.float32)))
                if len(docs[y]) >= 2 * SCALE_ROWS:
                    docs[y] = sorted(docs[y], key=lambda d: d[:2])[:SCALE_ROWS]
        rates = (sums + 1e-7) / (sums.sum(1, keepdims=True) + 1e-7 * BUCKETS)
        weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            one, other = rates[code[:, b] > 0], rates[code[:, b] < 0]
            if len(one) and len(other):
                weights[:, b] = np.clip(np.log(one.mean(0)) - np.log(other.mean(0)), -4, 4)
        margins = np.array([share @ weights[buckets] * code[y] for y, of in enumerate(docs) for _, _, buckets, share in sorted(of, key=lambda d: d[:2])[:SCALE_ROWS]])
        # A document's margin is sharpened so that a typical one decides its bit clearly.
        scale = 4 / max(1e-6, float(np.median(margins))) if margins.size else 1.0
        return cls(languages, code, weights, scale)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each row of mean margins, its probability, and the number of bits that disagree with it."""
        m = margins * self.scale
        losses = np.logaddexp(0, -m[:, None, :] * self.code[None]).sum(2)
        p = np.exp(losses.min(1, keepdims=True) - losses)
        p /= p.sum(1, keepdims=True)
        best = losses.argmin(1)
        return best, p[np.arange(len(p)), best], (m * self.code[best] < 0).sum(1)


class Scorer:
    """Mean margins of texts, with a bounded table of the words seen."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, self.coder.code.shape[1] + 1), np.float32)

    def _learn(self, chunks: list[str]) -> None:
        """The sums of the weights of each new chunk's n-grams, and their number; a space parts the chunks."""
        if not chunks:
            return
        first, n, bits = len(self.rows), len(chunks), self.table.shape[1] - 1
        while first + n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.rows.update(zip(chunks, range(first, first + n), strict=True))
        found, starts = grams(" ".join(chunks))
        ends = np.cumsum([len(c) + 1 for c in chunks])
        owner = np.minimum(np.searchsorted(ends, starts, "right"), n - 1)  # grams from an edge belong to the chunk after it
        for b in range(bits):
            self.table[first : first + n, b] = np.bincount(owner, self.coder.weights[found, b], n)
        self.table[first : first + n, -1] = np.bincount(owner, minlength=n)

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean margins and the number of n-grams of each text."""
        if len(self.rows) > TABLE_WORDS:
            self.clear()
        split = [t.lower().split() for t in texts]
        self._learn(sorted(set().union(*split).difference(self.rows)))
        rows = self.rows
        sums = np.array([self.table[[rows[c] for c in chunks]].sum(0, dtype=np.float64) if chunks else np.zeros(self.table.shape[1]) for chunks in split])
        return sums[:, :-1] / np.maximum(1, sums[:, -1:]), sums[:, -1]


def train(docs: DataFrame, per_language: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Coder:
    """Trains on at most about per_language rows of each language, drawn evenly by a hash of id and text.

    Rows that repeat id and text count once, so null and repeated ids don't change the bound. Rows without a label, or whose text is null or
    has no letter, don't count; without any other nothing is learned. Further columns are ignored.
    """
    labelled = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.withColumn("h", F.xxhash64("i", "text", F.lit("langid")))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    quota = {r.lang: min(1.0, per_language / max(1, r.n)) for r in counts.collect()}
    if not quota:
        return Coder.trained([])
    least = min(quota.values())
    # One row a label; the labels are the classes of the model, which the driver holds anyway.
    below = F.coalesce(F.element_at(F.map_from_arrays(F.array(*map(F.lit, quota)), F.array(*map(F.lit, quota.values()))), F.col("lang")), F.lit(least)) * 1_000_000
    drawn = labelled.filter(F.pmod("h", F.lit(1_000_000)) < below).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return Coder.trained((r.text, r.lang) for r in drawn.select("text", "lang").orderBy("h").toLocalIterator())


def identify(docs: DataFrame, coder: Coder, text_column: str = "text", ambiguous_below: float = 0.6) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous added (columns of these names are replaced).

    A null text or one without a letter is `und` with score 1 and not ambiguous. If nothing was learned, other texts have a null
    lang_pred, score 0 and are ambiguous. An empty table gives no rows; rows that repeat are predicted alike. Ambiguous: the
    probability of the nearest codeword is below ambiguous_below, or a quarter of its bits disagree. Whole texts count.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = docs.select(*[f"`{n}`" for n in names]).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    model = docs.sparkSession.sparkContext.broadcast(coder)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model.value)
        coder, at = model.value, names.index(text_column)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                margins, n = scorer.margins(texts)
                lettered = n > 0
                languages = coder.languages or [None]
                best, p, wrong = coder.decode(margins) if coder.languages else (np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)))
                lang = pa.array([languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], pa.string())
                unsure = lettered & ((p < ambiguous_below) | (wrong > coder.code.shape[1] // 4))
                yield pa.RecordBatch.from_arrays([*part.columns, lang, pa.array(np.where(lettered, p, 1.0)), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(predict, schema)
