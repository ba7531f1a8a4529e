"""Toxicity scores from a learned lexicon, found despite misspellings, and the context of each hit.

The lexicon (words far more frequent in toxic than in other labelled texts) is a trie. Each distinct word of the
corpus is turned into a Levenshtein automaton, run on the trie: one bit-parallel state per number of errors, stepped
along the trie's edges for many words at once, so only branches within reach of some word are walked. A hit is weighed by its window of words: quotation
marks around it and words of reporting take weight away, address of a reader adds some. A logistic model over the sums
gives the score. Lexicon, variants that turned out harmless, words of context in whatever language, and the model are
learned from labelled rows alone; the words of reporting and address that are given are English, the learned ones add to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import batch_rows, keyed, pieces, written

WORD = re.compile(r"\w+")
# Words of reporting, words of address, and quotation marks.
REPORTING = frozenset("said says say wrote writes called calls calling word words term quote quoted quotes reported told".split())
ADDRESS = frozenset("you your yours youre ur u thou thee".split())
QUOTES = '"“”„«»‘’'
N_FEATURES = 6
#: Letters of the longest term; a word within its reach fits the 64 bits of a state.
LONGEST = 60


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and the words it has been asked about."""

    def __init__(self, terms: list[str], harmless: list[str] = (), lowering: list[str] = (), raising: list[str] = (), cache_size: int = 500_000):
        self.lowering, self.raising = REPORTING | frozenset(lowering), ADDRESS | frozenset(raising)
        self.terms, self.harmless, self.cache_size = sorted(set(terms)), frozenset(harmless), cache_size
        if any(len(t) > LONGEST for t in self.terms):
            raise ValueError(f"a term has more than {LONGEST} letters")
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        # Of the terms below each node: most errors allowed, lengths of the shortest and longest word within reach.
        self.errors, self.low, self.high = [0], [LONGEST], [0]
        for number, term in enumerate(self.terms):
            node, d = 0, errors_allowed(term)
            for c in ["", *term]:
                if c:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.ends.append(None)
                        self.errors.append(0)
                        self.low.append(LONGEST)
                        self.high.append(0)
                    node = self.edges[node][c]
                self.errors[node] = max(self.errors[node], d)
                self.low[node], self.high[node] = min(self.low[node], len(term) - d), max(self.high[node], len(term) + d)
            self.ends[node] = number
        self.letters = sorted({c for e in self.edges for c in e})
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, int]] = {}

    def nearest(self, words: list[str]) -> list[tuple[str, int] | None]:
        """For each word the lexicon's term with fewest errors (first in order of spelling among equals) and their number, within what the term allows.

        The trie is walked once for all words: a node has those whose automata are alive there, a state being one
        number for each count of errors, whose bit i says that the path so far matches the word's first i letters.
        """
        sizes = np.array([len(w) for w in words])
        spelled = np.array(words).view(np.uint32).reshape(len(words), -1) if words else np.zeros((0, 1), np.uint32)
        bits = np.uint64(1) << np.arange(spelled.shape[1], dtype=np.uint64)
        at = {c: ((spelled == ord(c)) * bits).sum(1, dtype=np.uint64) for c in self.letters}
        whole = (np.uint64(2) << sizes.astype(np.uint64)) - np.uint64(1)
        one, none = np.uint64(1), 3 * len(self.terms)
        best = np.full(len(words), none)
        here = np.flatnonzero((sizes >= self.low[0]) & (sizes <= self.high[0]))
        stack = [(0, here, [np.uint64((2 << e) - 1) & whole[here] for e in range(self.errors[0] + 1)])]
        while stack:
            node, here, state = stack.pop()
            number = self.ends[node]
            if number is not None:
                last = sizes[here].astype(np.uint64)
                for e in reversed(range(errors_allowed(self.terms[number]) + 1)):
                    hit = here[(state[e] >> last & one).astype(bool)]
                    best[hit] = np.minimum(best[hit], e * len(self.terms) + number)
            for c, child in self.edges[node].items():
                same, full = at[c][here], whole[here]
                new = [(state[0] & same) << one]
                for e in range(1, self.errors[child] + 1):
                    new.append(((state[e] & same) << one | state[e - 1] | state[e - 1] << one | new[e - 1] << one) & full)
                alive = np.flatnonzero((new[-1] != 0) & (sizes[here] >= self.low[child]) & (sizes[here] <= self.high[child]))
                if len(alive):
                    stack.append((child, here[alive], [x[alive] for x in new]))
        return [(self.terms[b % len(self.terms)], b // len(self.terms)) if b < none else None for b in best.tolist()]

    def look(self, words: set[str], at_once: int = 16_384) -> None:
        """Make ``found`` cover these words."""
        if len(self.seen) > self.cache_size:
            self.seen, self.found = set(), {}
        new = words - self.seen
        self.seen |= new
        if self.terms:
            asked = [w for w in new if self.low[0] <= len(w) <= self.high[0] and w not in self.harmless]
            for start in range(0, len(asked), at_once):
                part = asked[start : start + at_once]
                self.found.update((w, hit) for w, hit in zip(part, self.nearest(part), strict=True) if hit)


_KNOWN: dict[tuple, Lexicon] = {}


def lexicon_of(terms: list[str], harmless: list[str] = (), lowering: list[str] = (), raising: list[str] = ()) -> Lexicon:
    """One lexicon per Python worker, so that what it has looked up serves all tasks of the worker."""
    key = tuple(map(tuple, (terms, harmless, lowering, raising)))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Lexicon(*key)
    return _KNOWN[key]


def quoted(line: str, start: int, end: int) -> bool:
    """Whether quotation marks stand open before and closed after this place of a line."""
    before, after = sum(c in QUOTES for c in line[:start]), sum(c in QUOTES for c in line[end:])
    return before % 2 == 1 and after > 0


def features(text: str, lexicon: Lexicon, window: int = 10) -> np.ndarray:
    """Of one text whose words ``lexicon`` has looked up."""
    out = np.zeros(N_FEATURES)
    lowered = text.lower()
    words = list(WORD.finditer(lowered))
    plain = [m[0] for m in words]
    total = best = 0.0
    exact = fuzzy = cited = 0
    for i, word in enumerate(plain):
        hit = lexicon.found.get(word)
        if hit is None:
            continue
        near = plain[max(0, i - window) : i] + plain[i + 1 : i + 1 + window]
        line_start = lowered.rfind("\n", 0, words[i].start()) + 1
        line_end = lowered.find("\n", words[i].end())
        line = lowered[line_start : line_end if line_end >= 0 else len(lowered)]
        weight = 1.0 if hit[1] == 0 else 0.7
        if quoted(line, words[i].start() - line_start, words[i].end() - line_start):
            weight *= 0.3
            cited += 1
        if not lexicon.lowering.isdisjoint(near):
            weight *= 0.6
        if not lexicon.raising.isdisjoint(near):
            weight *= 1.3
        exact += hit[1] == 0
        fuzzy += hit[1] > 0
        total += weight
        best = max(best, weight)
    if total:
        out[:] = math.log1p(total), best, min(5.0, 100 * total / len(plain)), math.log1p(exact), math.log1p(fuzzy), math.log1p(cited)
    return out


def context_of(text: str, lexicon: Lexicon, close: int = 3) -> dict[str, tuple[int, float]]:
    """Of the words of one text with hits, whose words ``lexicon`` has looked up: how often they stand close to hits, and how often they would if they were spread over the text evenly; hits left out."""
    plain = WORD.findall(text.lower())
    hits = [i for i, w in enumerate(plain) if w in lexicon.found]
    at = {j for i in hits for j in range(max(0, i - close), min(len(plain), i + 1 + close)) if plain[j] not in lexicon.found}
    near = Counter(plain[j] for j in at)
    every = Counter(w for w in plain if w not in lexicon.found and len(w) <= LONGEST) if hits else {}
    return {w: (near[w], n * len(at) / (len(plain) - len(hits))) for w, n in every.items()}


def all_features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    bags = [set(WORD.findall(t.lower())) for t in texts]
    lexicon.look(set().union(*bags))
    none = np.zeros(N_FEATURES)
    return np.array([features(t, lexicon) if not lexicon.found.keys().isdisjoint(b) else none for t, b in zip(texts, bags, strict=True)]).reshape(-1, N_FEATURES)


@dataclass
class Model:
    lexicon: list[str]
    harmless: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    lowering: list[str] = field(default_factory=list)
    raising: list[str] = field(default_factory=list)

    def known(self) -> Lexicon:
        return lexicon_of(self.lexicon, self.harmless, self.lowering, self.raising)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights[1:] + self.weights[0])))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the features of each document of ``keyed`` columns."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            for run in pieces(batch_rows(batch)):
                x = all_features([t.decode() for _, t in run], known)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in run], pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.mapInArrow(measured, "doc_id long, features array<double>")


def training_rows(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, toxic of the labelled rows to learn from: crc32 of the id as text mod 5 is not 0, and of those about ``most``, by a hash of the id. Of several labels of one id the largest counts."""
    rows = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1))))


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000, least_share: float = 0.05, lift: float = 20.0, least_texts: int = 5, level: float = 0.01, most_terms: int = 5_000) -> Model:
    """Learn from a bounded sample of labelled rows, about ``most`` of them (see ``training_rows``).

    A word is a term if it is ``lift`` times as frequent in the toxic texts as in the others, and either at least
    ``least_share`` of the toxic texts have it (3 at least), or ``least_texts`` of them and chance would hardly make it
    so: Chernoff's bound for that many of the word's texts being toxic is at most ``level`` over the number of words in
    as many toxic texts. So the words of a small language need no share of all toxic texts. Of more than
    ``most_terms`` the most frequent in proportion are taken; words of more than ``LONGEST`` letters are none. Equal texts count once. A variant within a
    term's errors is harmless if the labelled texts have it no more often among toxic texts than among others, as far
    as their numbers go. Words of context are learned by the same bound, among the texts with a hit: those near hits of
    texts that are not toxic lower a hit's weight, those near hits of toxic ones raise it (see ``_context_words``).
    """
    rows = F.broadcast(training_rows(labels, most))
    sample = written(keyed(df, id_col, text_col).join(rows, "doc_id").groupBy(F.xxhash64("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        rate = n_toxic / max(1, n_toxic + n_other)
        return Model([], [], np.array([30.0 if rate == 1 else -30.0] + [0.0] * N_FEATURES))
    counts = written(sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") + F.col("good") >= 2))
    lifted = ((F.col("bad") + 0.5) / (n_toxic + 1)) / ((F.col("good") + 0.5) / (n_other + 1))
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    toxic_share = n_toxic / (n_toxic + n_other)
    # Natural logarithm of the bound; a word in no other text has no second part.
    bound = -(bad * F.log(bad / (bad + good) / toxic_share) + F.when(good > 0, good * F.log(good / (bad + good) / (1 - toxic_share))).otherwise(0.0))
    asked = max(1, counts.where(F.col("bad") >= least_texts).count())
    supported = (F.col("bad") >= max(3, least_share * n_toxic)) | ((F.col("bad") >= least_texts) & (bound <= math.log(level / asked)))
    terms = [r["word"] for r in counts.where(supported & (lifted >= lift) & F.length("word").between(4, LONGEST)).orderBy(F.desc(lifted), "word").limit(most_terms).collect()]
    harmless: list[str] = []
    if terms:

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = lexicon_of(terms)
            for batch in batches:
                known.look(set(batch.column(0).to_pylist()))
                yield batch.filter(pa.array([w in known.found and known.found[w][1] > 0 for w in batch.column(0).to_pylist()], pa.bool_()))

        mild = counts.where((F.col("bad") + 0.5) / (n_toxic + 1) <= 3 * (F.col("good") + 0.5) / (n_other + 1)).select("word")
        harmless = [r["word"] for r in mild.mapInArrow(near, "word string").collect()]
    model = Model(terms, harmless)
    if terms:
        model.lowering, model.raising = _context_words(sample, model, level, least_texts)
    measured = with_features(sample.select("doc_id", "text"), model).join(sample.select("doc_id", "toxic"), "doc_id").select("features", "toxic").collect()
    x, y = np.array([r["features"] for r in measured]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in measured], float)
    model.weights = fit_logistic(x, y)
    return model


def _improbable(mine: Column, other: Column, share: float) -> Column:
    """Natural logarithm of Chernoff's bound for so many of the texts that have a word being of a kind that has this share of all; 0 if they are no more than that."""
    part = mine / (mine + other)
    bound = -(mine * F.log(part / share) + F.when(other > 0, other * F.log((1 - part) / (1 - share))).otherwise(0.0))
    return F.when(part > share, bound).otherwise(0.0)


def _context_words(sample: DataFrame, model: Model, level: float, least_texts: int, enriched: float = 2.0, most: int = 2_000) -> tuple[list[str], list[str]]:
    """Words that stand close to hits in texts that are not toxic, and in toxic ones, more often than chance would have it; of more than ``most`` the least probable.

    A word of context is ``enriched`` times as frequent close to hits as elsewhere in the same texts. Else the words of a
    language whose hits are more often toxic than another's would do.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            known.look(set().union(*(WORD.findall(t.lower()) for t in texts)))
            rows = []
            for text, kind in zip(texts, batch.column(1).to_pylist(), strict=True):
                own = context_of(text, known)
                rows += [(w, kind, n, expected) for w, (n, expected) in own.items()] + [("", kind, 0, 0.0)] * bool(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["word", "toxic", "near", "expected"])

    rows = sample.select("text", "toxic").mapInArrow(counted, "word string, toxic int, near long, expected double")
    close = (F.col("near") > 0) | (F.col("word") == "")
    counts = written(rows.groupBy("word").agg(F.sum(F.when(close, F.col("toxic")).otherwise(0)).cast("double").alias("bad"), F.sum(F.when(close, 1 - F.col("toxic")).otherwise(0)).cast("double").alias("good"), F.sum("near").alias("near"), F.sum("expected").alias("expected")))
    whole = counts.where("word = ''").first()  # all texts with a hit
    if whole is None or not whole["bad"] or not whole["good"]:
        return [], []
    share = whole["bad"] / (whole["bad"] + whole["good"])
    asked = counts.where((F.col("word") != "") & (F.col("bad") + F.col("good") >= least_texts) & (F.col("near") >= enriched * F.col("expected")))
    limit = math.log(level / max(1, 2 * asked.count()))
    pick = lambda p: [r["word"] for r in asked.withColumn("p", p).where(F.col("p") <= limit).orderBy("p", "word").limit(most).collect()]
    return pick(_improbable(F.col("good"), F.col("bad"), 1 - share)), pick(_improbable(F.col("bad"), F.col("good"), share))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text mod 5 is 0), score, predicted (score >= 0.5).

    A null or empty text has no hits and gets the model's score for such. Repeated rows each get their row; a null id
    stays null and is not held out; an empty table gives no rows; other columns are ignored.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            for run in pieces(batch_rows(batch)):
                s = model.scores(all_features([t.decode() for _, t in run], known))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in run], pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = keyed(df, id_col, text_col).mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
