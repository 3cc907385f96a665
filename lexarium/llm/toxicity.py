"""Toxicity scores from a lexicon trie intersected with Levenshtein automata, and the context of each hit.

The lexicon (words and stems) is learned from labelled documents. Words of a text run through the product of the
lexicon's trie with the automata that allow one edit for terms of 5 to 8 letters and two from 9 on; the product is built
state by state as texts need it, so misspelled terms (letters left out, added, replaced or swapped) cost no more than exact ones. Around each hit a window of words
separates abuse (further hits near by) from quotation (quotation marks around it or close to it); a logistic model over
these context scores gives a document's probability.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled rows of either class train the model (whole texts).
TRAINING_ROWS = 2000
#: Words on either side of a hit that are its context.
WINDOW = 6
#: Shortest stem, and distinct chunks kept in a worker's table.
SHORTEST_STEM, TABLE_CHUNKS = 4, 400_000
QUOTES = frozenset("\"'“”„‟«»‹›‘’`")
_WORDS = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Letters, digits and signs of a chunk that may be one misspelled term.
LONGEST_SPELLING = 32


def edits(term: str) -> int:
    """Edits allowed for a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The product of a lexicon trie and the Levenshtein automata of its terms, determinised as it is used.

    A term ending in * is a stem: whatever follows it is accepted. run(word) gives the terms it hits and the edits of each.
    """

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool]]] = [[]]
        self.room = [0]
        for term in sorted(set(terms)):
            spelled, stem, node = term.rstrip("*"), term.endswith("*"), 0
            allowed = edits(spelled)
            self.room[0] = max(self.room[0], allowed)
            for c in spelled:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], allowed)
            self.ends[node].append((term, stem))
        self.letters = {c for x in self.children for c in x}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, positions: set[tuple[int, int, str]]) -> int:
        """The number of a set of (node, edits, mark), closed under leaving out a letter of a term.

        The mark is the accepted stem where node is -1, and else empty or the letter that completes a swap.
        """
        closed: dict[tuple[int, str], int] = {}
        stack = list(positions)
        while stack:
            node, used, stem = stack.pop()
            if closed.get((node, stem), 99) <= used:
                continue
            closed[node, stem] = used
            if node >= 0 and not stem:
                for term, is_stem in self.ends[node]:
                    if is_stem and used <= edits(term.rstrip("*")):
                        stack.append((-1, used, term))
                if used < self.room[node]:
                    stack += [(child, used + 1, "") for child in self.children[node].values() if used < self.room[child]]
        key = frozenset((n, u, s) for (n, s), u in closed.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        following: set[tuple[int, int, str]] = set()
        for node, used, stem in self.sets[state]:
            if node < 0:
                following.add((node, used, stem))
                continue
            if stem:
                if letter == stem:
                    following.add((node, used, ""))
                continue
            child = self.children[node].get(letter)
            if child is not None:
                following.add((child, used, ""))
            if used < self.room[node]:
                following.add((node, used + 1, ""))
                for first, c in self.children[node].items():  # two neighbouring letters swapped
                    swapped = self.children[c].get(letter)
                    if swapped is not None and first != letter and used < self.room[swapped]:
                        following.add((swapped, used + 1, first))
                following.update((c, used + 1, "") for c in self.children[node].values() if used < self.room[c])
        return self._state(following)

    def run(self, word: str) -> dict[str, int]:
        state, letters = self.start, self.letters
        for c in word:
            if c not in letters:
                c = ""
            steps = self.steps[state]
            following = steps.get(c)
            if following is None:
                if len(self.sets) > 200_000:  # bounds memory: begin anew
                    self.states, self.sets, self.steps = {}, [], []
                    self.start = self._state({(0, 0, "")})
                    return self.run(word)
                following = steps[c] = self._step(state, c)
            state = following
            if not self.sets[state]:
                return {}
        out: dict[str, int] = {}
        for node, used, stem in self.sets[state]:
            for term in [stem] if node < 0 else [] if stem else [t for t, is_stem in self.ends[node] if not is_stem]:
                if used <= edits(term.rstrip("*")):
                    out[term] = min(used, out.get(term, 9))
        return out


def learn_lexicon(examples: list[tuple[str, int]], purity: float = 0.9) -> list[str]:
    """Words and stems (with *) that mark the toxic documents among (text, label).

    A term needs enough distinct neighbourhoods (the words before and after it) in toxic documents, so that copies of one
    document don't make its words look like marks, and a share of `purity` at least of toxic ones if both labels were as frequent.
    """
    toxic, clean, neighbourhoods = Counter(), Counter(), Counter()
    completions: dict[str, set[str]] = defaultdict(set)
    seen: set[int] = set()
    n = [0, 0]

    def stems(word: str) -> list[str]:
        return [word[:i] + "*" for i in range(SHORTEST_STEM, min(len(word), 9) + 1)]

    for text, label in examples:
        n[bool(label)] += 1
        words = _WORDS.findall(text.lower())
        distinct = set(words)
        (toxic if label else clean).update({*distinct, *(s for w in distinct for s in stems(w))})
        if not label:
            continue
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            place = hash((before, word, after))
            if place not in seen:
                seen.add(place)
                neighbourhoods[word] += 1
                for s in stems(word):
                    neighbourhoods[s] += 1
                    if len(completions[s]) < 4:
                        completions[s].add(word)
    if not n[0] or not n[1]:
        return []
    least, ratio = max(3, 0.01 * n[1]), n[1] / n[0]
    good = {t for t, a in toxic.items() if min(a, neighbourhoods[t]) >= least and a / (a + clean[t] * ratio + 0.1) >= purity}
    marks = {t for t in good if t.endswith("*") and len(completions[t]) >= 4 and t[:-2] + "*" not in good}
    words = {t for t in good if not t.endswith("*") and not any(s in marks for s in stems(t))}
    return sorted(marks | words)


class ToxicityModel:
    """Lexicon, weights of its terms and of misspellings that clean documents hold, and a logistic model over context scores."""

    FEATURES = 6
    #: Share of a term's weight that a misspelling of it has with so many edits.
    DISCOUNT = (1.0, 0.95, 0.85)

    def __init__(self, prior: float = 0.0):
        self.lexicon: list[str] = []
        self.weights: dict[str, float] = {}
        self.harmless: dict[str, float] = {}
        #: What a misspelling of a term weighs at most, where training documents hold any.
        self.misspelled: dict[str, float] = {}
        self.beta = np.zeros(self.FEATURES + 1)
        self.beta[0] = np.log((prior + 1e-3) / (1 - prior + 1e-3))

    @classmethod
    def trained(cls, examples: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
        """From (text, 0 or 1); weights: how many documents of the corpus a sampled clean and a sampled toxic one stand for."""
        total = [sum(weights[1] for _, y in examples if y), sum(weights[0] for _, y in examples if not y)]
        model = cls(total[0] / max(1e-9, sum(total)))
        model.lexicon = learn_lexicon(examples)
        if not model.lexicon:
            return model
        finder = Finder(model)
        found, exact, near, forms, labels = [], [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], Counter(int(bool(y)) for _, y in examples)
        for text, y in examples:
            hits = finder.hits(text)
            found.append(hits)
            right = {t for _, terms, *_ in hits[0] for t, e in terms if not e}
            exact[bool(y)].update(right)
            near[bool(y)].update({t for _, terms, *_ in hits[0] for t, e in terms if e} - right)
            forms[bool(y)].update({form for _, terms, _, form in hits[0] if all(e for _, e in terms)})
        odds = lambda counts, key: float(np.clip(np.log((counts[1][key] + 0.5) / (labels[1] + 1)) - np.log((counts[0][key] + 0.5) / (labels[0] + 1)), -3, 6))
        model.weights = {t: odds(exact, t) for t in model.lexicon}
        model.misspelled = {t: odds(near, t) for t in {*near[0], *near[1]}}
        model.harmless = {form: odds(forms, form) for form in forms[0]}
        x = np.array([model.features(h) for h in found])
        y = np.array([int(bool(y)) for _, y in examples], float)
        w = np.where(y > 0, weights[1], weights[0])
        model._fit(x, y, w / w.mean())
        return model

    def weight(self, terms: tuple[tuple[str, int], ...], form: str) -> float:
        best = max(min(self.weights.get(t, 0.0) * self.DISCOUNT[min(e, 2)], self.misspelled.get(t, 99.0) if e else 99.0) for t, e in terms)
        return min(best, self.harmless.get(form, best)) if all(e for _, e in terms) else best

    def _fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> None:
        """Newton steps of ridge-penalised logistic regression."""
        x = np.column_stack([np.ones(len(x)), x])
        penalty = np.diag([1e-6, *[ridge] * self.FEATURES])
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (w * p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (w * (y - p)) - penalty @ beta)
            beta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                break
        self.beta = beta

    def features(self, found: tuple[list, int]) -> list[float]:
        """Context scores of a document's hits: strongest and number, outside and inside quotation, neighbours, density."""
        hits, words = found
        scored = [(place, w, quoted) for place, terms, quoted, form in hits if (w := self.weight(terms, form)) > 0]
        if not scored:
            return [0.0] * self.FEATURES
        said, told = [w for _, w, q in scored if not q], [w for _, w, q in scored if q]
        near = sum(b - a <= WINDOW for (a, *_), (b, *_) in zip(scored, scored[1:], strict=False))
        return [max(said, default=0.0), np.log1p(sum(said)), max(told, default=0.0), np.log1p(sum(told)), np.log1p(near), np.log1p(100 * len(said) / (1 + words))]

    def score(self, features: list[float]) -> float:
        z = float(self.beta[0] + np.dot(self.beta[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Finder:
    """Finds the hits of texts; distinct chunks run through the automaton once."""

    def __init__(self, model: ToxicityModel):
        self.automaton = LexiconAutomaton(model.lexicon)
        self.known: dict[str, tuple] = {}

    def _terms(self, chunk: str) -> tuple[tuple[tuple[str, int], ...], str]:
        """The terms of the chunk's words and the edits of each, and the first word that hits."""
        out: dict[str, int] = {}
        form = ""
        words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
        if len(words) > 1 and len(inside := _EDGES.sub("", chunk)) <= LONGEST_SPELLING:
            words.append(inside)  # digits and signs inside stand for letters
        for word in words:
            for term, used in self.automaton.run(word).items():
                out[term] = min(used, out.get(term, 9))
                form = form or word
        return tuple(sorted(out.items())), form

    def hits(self, text: str) -> tuple[list[tuple[int, tuple, bool]], int]:
        """(place, ((term, edits), ...), quoted, form) of each chunk that hits, and the number of chunks."""
        if len(self.known) > TABLE_CHUNKS:
            self.known.clear()
        chunks, known = text.lower().split(), self.known
        for c in set(chunks).difference(known):
            known[c] = self._terms(c)
        found = [(i, t) for i, c in enumerate(chunks) if (t := known[c])[0]]
        return [(i, terms, self._quoted(chunks, i), form) for i, (terms, form) in found], len(chunks)

    @staticmethod
    def _quoted(chunks: list[str], at: int) -> bool:
        """Whether a quotation opens before the hit and closes after it within the window."""
        if chunks[at][0] in QUOTES and any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in chunks[at : at + WINDOW + 1]):
            return True
        opens = any(c[0] in QUOTES for c in chunks[max(0, at - WINDOW) : at + 1])
        closes = any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in chunks[at : at + WINDOW + 1])
        return opens and closes


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Trains on at most about per_class rows of either label, drawn evenly by a hash of the id.

    Ids without a label or a text don't count; of an id labelled more than once the greatest label holds, and of an id with
    several texts the one of the least hash. Without both labels nothing is learned.
    """
    marks = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("i")).agg(F.max(F.when(F.col(label_column) > 0, 1).otherwise(0)).alias("y"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    below = F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))) * 1_000_000
    drawn = marks.filter(F.pmod(F.xxhash64("i", F.lit("toxicity")), F.lit(1_000_000)) < below)
    texts = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    # At most about twice per_class ids are drawn, whatever the size of the tables: broadcast, and no text is shuffled.
    one = texts.join(F.broadcast(drawn), "i").groupBy("i").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    rows = [(r.text, r.y) for r in one.orderBy("i").toLocalIterator()]
    return ToxicityModel.trained(rows, (1 / share.get(0, 1.0), 1 / share.get(1, 1.0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """docs without the text column, with score (double, 0 to 1), predicted (int: 1 from the threshold on) and n_hits (int).

    Columns of these names are replaced. Null and empty texts have no hits and get the model's score for that; whole
    texts count. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in (text_column, "score", "predicted", "n_hits")]
    schema = docs.select(*[f"`{n}`" for n in names]).schema.add("score", "double").add("predicted", "integer").add("n_hits", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        finder = Finder(model)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(len(names)).to_pylist():
                found = finder.hits(text or "")
                hits.append(len(found[0]))
                scores.append(model.score(model.features(found)))
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(hits, pa.int32())], names=[*names, "score", "predicted", "n_hits"])

    return docs.select(*[f"`{n}`" for n in names], f"`{text_column}`").mapInArrow(score, schema)
