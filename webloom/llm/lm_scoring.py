"""Log probabilities of texts by a trigram model in Elias-Fano tries.

Counts of the training texts make a trie of three levels: a word, its successors, and theirs. A level is one rising
sequence (numbers of words, each context's raised by the last of the context before) in Elias-Fano form, with rising
pointers to where each context's successors begin, in the same form, and smoothed probabilities as 16-bit codes. All
levels lie in one flat buffer that is mapped, not decoded; a query finds a context and then its successor inside the
context's range, by the high bits and then a search among the few entries that share them.

The trie is as large as the corpus, so it is cut by a hash of word pairs into shards of bounded size. Blocks of
documents (see ``blocks``) ask each shard once for each of their distinct pairs and triples, with how often these stand
in the block's training texts: the sum over blocks is what the shard's trie is built from, and what it then answers.
So nothing grows with how often a pair occurs, and nothing of the model passes through the driver but its two totals.

Probabilities are Dirichlet-smoothed: with c occurrences of a word after a context seen C times,
``p = (c + m * p') / (C + m)``, p' being that of the shorter context and (c + 1) / (N + V + 1) without any; the two parts
``c / (C + m)`` and ``m / (C + m)`` are what the codes stand for. A word that was never trained on has p' alone.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.blocks import blocks, documents_of, numbered, one_batch, packed, rows_of, unpacked, whole
from webloom.llm.common import keyed, trim

#: Decimal logarithms between which probabilities are coded, and the codes: 0 is probability 0.
LOWEST, CODES = -16.0, 65_535


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, evenly spaced in their logarithm, so within 0.03 percent."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint((np.log10(p) - LOWEST) / -LOWEST * (CODES - 1))
    return np.where(p > 0, np.clip(code, 1, CODES), 0).astype(np.uint16)


def dequantised(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (LOWEST - LOWEST * (codes.astype(np.float64) - 1) / (CODES - 1)), 0.0)


#: Where the one of each rank stands in each byte, at rank * 256 + byte.
IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[rank] for rank in range(8) for byte in range(256)], np.uint64)


class EliasFano:
    """A rising sequence of n numbers up to ``top``: low bits side by side, high bits as gaps between ones. All four arrays are views of a buffer of 64-bit words."""

    @staticmethod
    def words_of(values: np.ndarray) -> np.ndarray:
        """The sequence as 64-bit words: n, bits of a low part, words of high parts, then low parts, high parts, and ones before each word of these."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high_bits = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(high_bits[-1]) + 64) // 64 + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, high_bits >> 6, np.uint64(1) << (high_bits & 63).astype(np.uint64))
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, (at >> 6)[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.cumsum(np.bitwise_count(high)).astype(np.uint64)
        return np.concatenate([np.array([n, width, len(high), len(low)], np.uint64), low, high, np.concatenate([[np.uint64(0)], ones[:-1]]).astype(np.uint64)])

    def __init__(self, words: np.ndarray):
        self.n, self.width, n_high, n_low = (int(x) for x in words[:4])
        self.low, self.high, self.ones = words[4 : 4 + n_low], words[4 + n_low : 4 + n_low + n_high], words[4 + n_low + n_high : 4 + n_low + 2 * n_high]
        self.zeros, self.inverse = np.arange(n_high, dtype=np.uint64) * np.uint64(64) - self.ones, ~self.high
        self.n_zeros = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))
        self.size = 4 + n_low + 2 * n_high

    @staticmethod
    def _place(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where in each word the one of this rank (from 0) stands: first its byte, from the sums of ones of all eight at once, then its bit, from a table."""
        each, top = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
        ones = word - (word >> np.uint64(1) & np.uint64(0x5555555555555555))
        ones = (ones & np.uint64(0x3333333333333333)) + (ones >> np.uint64(2) & np.uint64(0x3333333333333333))
        upto = (ones + (ones >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * each
        place = np.bitwise_count((rank * each | top) - upto & top).astype(np.uint64) << np.uint64(3)
        rest = rank - (upto << np.uint64(8) >> place & np.uint64(0xFF))
        return place + IN_BYTE[rest << np.uint64(8) | word >> place & np.uint64(0xFF)]

    def _select(self, directory: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(directory, rank.astype(np.uint64), side="right") - 1
        return at * 64 + self._place(bits[at], rank.astype(np.uint64) - directory[at]).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        shift = (at & 63).astype(np.uint64)
        word = self.low[at >> 6] >> shift
        over = shift + np.uint64(self.width) > np.uint64(64)
        word[over] |= self.low[(at >> 6)[over] + 1] << (np.uint64(64) - shift[over])
        return word & np.uint64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        high = self._select(self.ones, self.high, i) - i
        return (high.astype(np.uint64) << np.uint64(self.width) | self._low(i)).astype(np.int64)

    def _behind_zero(self, k: np.ndarray) -> np.ndarray:
        """How many numbers have a high part of at most k: the ones before the zero of rank k."""
        out = np.full(len(k), self.n)
        there = (k >= 0) & (k < self.n_zeros)
        out[there] = np.minimum(self.n, self._select(self.zeros, self.inverse, k[there]) - k[there])
        return np.where(k < 0, 0, out)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose number is at least each value, and whether it is that value: numbers with its high bits lie between two zeros, and the low bits are searched among them."""
        high = values >> self.width
        low, end = self._behind_zero(high - 1), self._behind_zero(high)
        last = end.copy()
        wanted = (values & ((1 << self.width) - 1)).astype(np.uint64)
        open_ = np.flatnonzero(low < end)
        while len(open_):
            middle = (low[open_] + end[open_]) // 2
            less = self._low(middle) < wanted[open_]
            low[open_[less]], end[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < end[open_]]
        equal = low < last
        equal[equal] = self._low(low[equal]) == wanted[equal]
        return low, equal


def level(parents: np.ndarray, numbers: np.ndarray, n_parents: int) -> list[np.ndarray]:
    """The words of one level: numbers, sorted inside each parent, raised by the last of the parents before, and pointers to where each parent's begin."""
    pointers = np.searchsorted(parents, np.arange(n_parents + 1))
    last = np.zeros(n_parents, np.int64)
    full = pointers[1:] > pointers[:-1]
    last[full] = numbers[pointers[1:][full] - 1] + 1
    base = np.cumsum(last) - last
    return [EliasFano.words_of(numbers + base[parents]), EliasFano.words_of(pointers)]


class Trie:
    """Three levels in one flat buffer of 64-bit words; nothing of it is copied when it is opened.

    The codes of level two are what a pair leaves to its shorter context, from which its count follows too; those of
    level three are the triples' own parts.
    """

    @staticmethod
    def build(first: np.ndarray, second: np.ndarray, c2: np.ndarray, parent: np.ndarray, third: np.ndarray, c3: np.ndarray, m3: float) -> bytes:
        """From sorted distinct pairs (first, second) with their counts, and sorted triples (place of the pair, third) with theirs."""
        words, of = np.unique(first, return_inverse=True)
        parts = [EliasFano.words_of(words), *level(of, second, len(words)), *level(parent, third, len(first))]
        for codes in (quantised(m3 / (c2 + m3)), quantised(c3 / (c2[parent] + m3))):
            parts.append(np.frombuffer(codes.tobytes() + b"\0" * (-2 * len(codes) % 8), np.uint64))
        return np.concatenate([np.array([len(words), len(first), len(third)], np.uint64), *parts]).tobytes()

    def __init__(self, buffer):
        words = np.frombuffer(buffer, np.uint64)
        self.sizes, at, self.sequences = [int(x) for x in words[:3]], 3, []
        for _ in range(5):
            self.sequences.append(EliasFano(words[at:]))
            at += self.sequences[-1].size
        self.codes = []
        for n in self.sizes[1:]:
            self.codes.append(words[at : at + (2 * n + 7) // 8].view(np.uint16)[:n])
            at += (2 * n + 7) // 8

    def _children(self, node: np.ndarray, which: np.ndarray, number: np.ndarray, entries: EliasFano, pointers: EliasFano) -> np.ndarray:
        """The place of each number among the successors of its node, ``node[which]``, or -1: a node's range and its numbers' raise are looked up once, then each number's successor in the range."""
        out = np.full(len(which), -1)
        there = np.flatnonzero(node >= 0)
        if not len(there) or not entries.n:
            return out
        start, end, raised = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        start[there], end[there] = pointers[node[there]], pointers[node[there] + 1]
        behind = np.flatnonzero(start > 0)
        raised[behind] = entries[start[behind] - 1] + 1
        here = np.flatnonzero(end[which] > 0)
        parent = which[here]
        found, equal = entries.successor(number[here] + raised[parent])
        inside = equal & (found >= start[parent]) & (found < end[parent])
        out[here[inside]] = found[inside]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The node of each pair, -1 if it was never seen."""
        root = self.sequences[0]
        words, which = np.unique(first, return_inverse=True)
        if not root.n:
            return np.full(len(first), -1)
        node, equal = root.successor(words)
        return self._children(np.where(equal, node, -1), which, second, self.sequences[1], self.sequences[2])

    def triples(self, node: np.ndarray, which: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The leaf of each third word behind the pair ``node[which]``, -1 if it was never seen."""
        return self._children(node, which, third, self.sequences[3], self.sequences[4])


def mapped(data: bytes) -> mmap.mmap:
    """The levels in memory mapped outside of any file, since executors have no folder in common with the place they run in; a file with the same bytes can be mapped just so."""
    out = mmap.mmap(-1, max(8, len(data)))
    out.write(data)
    return out


BEGIN, END = 0, 1
#: Numbers of words start behind those two.
WORDS = 2


class Grams:
    """The distinct pairs and triples of a block of documents, in order, and where they stand."""

    def __init__(self, row: dict):
        self.ids, sizes, self.trained = documents_of(row["docs"])
        local, number, count = unpacked(row["tokens"]).astype(np.int64), unpacked(row["numbers"]).astype(np.int64), whole(unpacked(row["counts"]))
        number = np.where(number > 0, number + WORDS - 1, -1)
        # BEGIN, words, END of each document in a row.
        ends = np.cumsum(sizes + 2)
        total = int(ends[-1]) if len(ends) else 0
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
        self.numbers, self.counts = np.full(total, BEGIN), np.zeros(total, np.int64)
        self.is_end, self.is_begin = np.zeros(total, bool), np.zeros(total, bool)
        self.is_end[ends - 1] = self.is_begin[ends - sizes - 2] = True
        self.numbers[self.is_end] = END
        inner = ~(self.is_end | self.is_begin)
        self.numbers[inner], self.counts[inner] = number[local], count[local]
        self.sizes = sizes
        # Pairs and triples of words that were all trained on, by the place of their last word.
        s = self.numbers
        self.at2 = np.flatnonzero(~self.is_begin[1:] & (s[1:] >= 0) & (s[:-1] >= 0)) + 1
        self.keys2, self.which2 = np.unique(s[self.at2 - 1] << 32 | s[self.at2], return_inverse=True)
        pair_at = np.full(total, -1)
        pair_at[self.at2] = self.which2
        self.at3 = np.flatnonzero((pair_at[1:] >= 0) & (pair_at[:-1] >= 0)) + 1
        self.keys3, self.which3 = np.unique(pair_at[self.at3 - 1] << 32 | s[self.at3], return_inverse=True)
        self.pair_of3 = self.keys3 >> 32

    def trained_counts(self) -> tuple[np.ndarray, np.ndarray]:
        train = self.trained[self.doc]
        return (np.bincount(w[train[at]], minlength=len(k)) for w, at, k in ((self.which2, self.at2, self.keys2), (self.which3, self.at3, self.keys3)))

    def context_counts(self, n_texts: int) -> np.ndarray:
        """Of each distinct pair, how often its first word was trained on."""
        out = np.zeros(len(self.keys2), np.int64)
        before = self.at2 - 1
        out[self.which2] = np.where(self.is_begin[before], n_texts, self.counts[before])
        return out

    def dealt(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard the places of its pairs and of its triples, which go with the pair they begin with."""
        mixed = self.keys2.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shard2 = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % shards
        shard2 = shard2.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
        shard3 = shard2[self.pair_of3]
        order2, order3 = np.argsort(shard2, kind="stable"), np.argsort(shard3, kind="stable")
        cuts2, cuts3 = (np.searchsorted(x[o], np.arange(shards + 1)) for x, o in ((shard2, order2), (shard3, order3)))
        for k in np.flatnonzero(np.diff(cuts2)):
            yield int(k), order2[cuts2[k] : cuts2[k + 1]], order3[cuts3[k] : cuts3[k + 1]]


PAYLOAD = "shard int, block long, pairs binary, triples binary"


def _asked(rows: DataFrame, shards: int) -> DataFrame:
    """What each block asks of each shard, with its own training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Grams(row)
            c2, c3 = g.trained_counts()
            out = []
            for shard, at2, at3 in g.dealt(shards):
                k2, k3 = g.keys2[at2], g.keys3[at3]
                own = np.searchsorted(at2, g.pair_of3[at3])
                each = np.bincount(own, minlength=len(k2))
                out.append((shard, row["block"], packed(np.concatenate([k2 >> 32, k2 & 0xFFFFFFFF, c2[at2], each])), packed(np.concatenate([k3 & 0xFFFFFFFF, c3[at3]]))))
            yield one_batch(out, PAYLOAD)

    return rows.mapInArrow(ask, PAYLOAD)


def answered(asked: list[tuple[bytes, bytes]], m3: float) -> list[bytes]:
    """The codes for each block's pairs and triples, from the trie of what all blocks together have trained on. What several blocks ask is looked up once."""
    pairs, triples = [unpacked(p).reshape(4, -1) for p, _ in asked], [unpacked(t).reshape(2, -1) for _, t in asked]
    cuts2, cuts3 = (np.cumsum([0, *(x.shape[1] for x in parts)]) for parts in (pairs, triples))
    (first, second, own2, each), (third, own3) = np.concatenate(pairs, axis=1), np.concatenate(triples, axis=1)
    del pairs, triples
    keys, which = np.unique(first.astype(np.int64) << 32 | second, return_inverse=True)
    c2 = np.bincount(which, own2, len(keys)).astype(np.int64)
    keys3, which3 = np.unique(np.repeat(which, each) << 32 | third, return_inverse=True)
    c3 = np.bincount(which3, own3, len(keys3)).astype(np.int64)
    del first, second, own2, each, third, own3
    seen, seen3 = c2 > 0, c3 > 0
    place = np.cumsum(seen) - 1
    trie = Trie(mapped(Trie.build(keys[seen] >> 32, keys[seen] & 0xFFFFFFFF, c2[seen], place[keys3[seen3] >> 32], keys3[seen3] & 0xFFFFFFFF, c3[seen3], m3)))
    node = trie.pairs(keys >> 32, keys & 0xFFFFFFFF)
    leaf = trie.triples(node, keys3 >> 32, keys3 & 0xFFFFFFFF)
    codes2, codes3 = np.full(len(keys), CODES), np.zeros(len(keys3), np.int64)
    codes2[node >= 0], codes3[leaf >= 0] = trie.codes[0][node[node >= 0]], trie.codes[1][leaf[leaf >= 0]]
    return [packed(np.concatenate([codes2[which[a:b]], codes3[which3[c:d]]])) for a, b, c, d in zip(cuts2[:-1], cuts2[1:], cuts3[:-1], cuts3[1:], strict=True)]


def _scored(rows: DataFrame, shards: int, n_texts: int, total: int, distinct: int, m2: float, m3: float) -> DataFrame:
    """Each document of blocks with their shards' answers."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Grams(row)
            left, own3 = np.ones(len(g.keys2)), np.zeros(len(g.keys3))
            codes = {a["shard"]: a["codes"] for a in row["answers"] or ()}
            for shard, at2, at3 in g.dealt(shards):
                found = unpacked(codes[shard])
                n = len(at2)
                left[at2], own3[at3] = dequantised(found[:n]), dequantised(found[n:])
            # The pairs' counts, exact up to a thousand and within 0.03 percent beyond.
            c2 = m3 / left - m3
            own2 = np.where(c2 < 1_000, np.rint(c2), c2) / (g.context_counts(n_texts) + m2)
            known = np.where(g.is_end, n_texts, g.counts)
            alone = (known + 1) / (total + distinct + 1)
            before = np.concatenate([[0], np.where(g.is_begin, n_texts, g.counts)[:-1]])
            p = m2 / (before + m2) * alone
            p[g.at2] += own2[g.which2]
            # The pair that ends just before a token is its longer context.
            context = np.full(len(p) + 1, -1)
            context[g.at2 + 1] = g.which2
            longer = np.flatnonzero(context[:-1] >= 0)
            p[longer] *= left[context[longer]]
            p[g.at3] += own3[g.which3]
            real = ~g.is_begin
            tally = lambda x: np.bincount(g.doc[real], x[real], len(g.ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.ids, pa.int64()), pa.array(g.sizes + 1, pa.int64()), pa.array(tally(known > 0).astype(np.int64), pa.int64()), pa.array(tally(np.log10(alone)), pa.float64()), pa.array(tally(np.log10(p)), pa.float64())],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return rows.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", training=None, m2: float = 20.0, m3: float = 20.0, shard_tokens: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``training``, a condition on doc_id, holds (the remainder of crc32 of the id as text by 7
    is not 2); the others are ``held_out``. Words are what ASCII white space delimits, A-Z in lower case; a text's end
    is a token too. ``m2`` and ``m3`` weigh the shorter contexts. Null and empty texts are one end; repeated rows each
    get their row and count each; a null id is trained on; without training texts every probability is that of an
    unseen word; an empty table gives no rows; other columns are ignored. Every pair and triple counts, once seen is
    enough. ``shard_tokens`` bounds what a shard of the trie is built from, not the result.
    """
    training = ~held_out() if training is None else training
    docs = keyed(df, id_col, text_col).select("doc_id", "text", F.lit("").alias("label"), F.coalesce(training, F.lit(False)).alias("counted"))
    trained = docs.where("counted").count()
    corpus = numbered(blocks(docs))
    total, distinct = sum(corpus.sums.values()) + trained, corpus.n_words + (trained > 0)
    coded = corpus.coded
    shards = max(1, -(-total // shard_tokens))

    def answer(table: pa.Table) -> pa.Table:
        codes = answered(list(zip(table["pairs"].to_pylist(), table["triples"].to_pylist(), strict=True)), m3)
        out = pa.table({"block": table["block"], "shard": table["shard"], "codes": pa.array(codes, pa.binary())})
        trim()
        return out

    answers = _asked(coded, shards).groupBy("shard").applyInArrow(answer, "block long, shard int, codes binary")
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "codes")).alias("answers"))
    out = _scored(coded.join(by_block.hint("merge"), "block", "left"), shards, trained, total, distinct, m2, m3)
    held = ~F.coalesce(training, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
