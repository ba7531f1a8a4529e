"""Byte-level BPE encoding and decoding by traversal of a prefix trie.

The distinct words of a batch are inserted into a trie of bytes. A depth-first walk gives every node the last
token of the encoding of the prefix that ends there; this needs only the last tokens on the path above, because
an encoding is a chain of tokens whose neighbours are all compatible, and each prefix has just one. A prefix that
many words share is therefore worked out once; a word's ids are read off by walking back from its own node.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webloom.llm.common import batch_rows, byte_letters, keyed, pieces, tokenizer

# Fixed value: the word pattern of the published 50k byte-level vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters alone are cut by WORDS here; for others, on whose classes engines may differ, the library cuts.
PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-ȳΑ-ΡΣ-ώА-я‐-‧‰-⁞₠-₵ぁ-ゔァ-ヶ一-龥가-힣]*")


class TrieBpe:
    """A byte-level BPE vocabulary and its words' encodings."""

    def __init__(self, path: str, cache_size: int = 500_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate((as_bytes(x), as_bytes(y)) for x, y in merges)}
        self.rank = {a << 20 | b: rank for (a, b), (rank, _) in self.merge.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.vocab = {t: i for t, i in vocab.items() if self.merged(t) == [i]}
        self.extended = {self.vocab[t[:-1]] << 8 | t[-1]: i for t, i in self.vocab.items() if t[:-1] in self.vocab}
        self.longest_token = max(map(len, self.vocab))
        self.fits: dict[int, bool] = {}
        self.right, self.left = self.edges()
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tok = tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.cache_size, self.longest = cache_size, longest

    def merged(self, word: bytes) -> list[int]:
        """The vocabulary's merges applied to a short word, lowest rank first."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, -1)) + (i,) for i, p in enumerate(zip(ids, ids[1:], strict=False))), default=None)
            if best is None or best[1] < 0:
                break
            rank, new, i = best
            ids[i : i + 2] = [new]
        return ids

    def edges(self) -> tuple[list, list]:
        """For each token the tokens that stand at its right and left end while it is built up, each with the ranks of the merges that make it and that take it up."""
        made = {new: (rank, a, b) for (a, b), (rank, new) in self.merge.items()}
        chains = ([None] * len(self.bytes_of), [None] * len(self.bytes_of))
        for side, chain in zip((2, 1), chains, strict=True):
            for token in self.vocab.values():
                out, now, gone = [], token, 1 << 60
                while now in made:
                    out.append((now, made[now][0], gone))
                    gone, now = made[now][0], made[now][side]
                out.append((now, -1, gone))
                chain[token] = out
        return chains

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text ending in token ``a`` may go on with token ``b``: the two are the encoding of their bytes.

        They are unless a merge across their border comes first. Merges go by rank, those of one rank from left to
        right; so a border pair merges if both ends exist at once and its rank is lower than that of the left end's
        own next merge and no higher than that of the right end's.
        """
        ranks = self.rank
        good = True
        for x, made_x, gone_x in self.right[a]:
            for y, made_y, gone_y in self.left[b]:
                rank = ranks.get(x << 20 | y)
                if rank is not None and rank < gone_x and rank <= gone_y and made_x <= gone_y and made_y < gone_x:
                    good = False
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a << 20 | b] = good
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all found in one traversal of the words' trie."""
        child: dict[int, int] = {}  # node * 256 + byte: node
        first, sibling, byte_of, depth_of, word_at = [0], [0], [0], [0], [-1]  # by node; 0, the root, also means none
        for number, word in enumerate(words):
            node = 0
            for depth, byte in enumerate(word, 1):
                key = node << 8 | byte
                found = child.get(key)
                if found is None:
                    found = child[key] = len(first)
                    first.append(0)
                    sibling.append(first[node])
                    first[node] = found
                    byte_of.append(byte)
                    depth_of.append(depth)
                    word_at.append(-1)
                node = found
            word_at[node] = number
        del child
        out: list[list[int]] = [[] for _ in words]
        deepest = max(depth_of)
        path = bytearray(deepest)
        last = [-1] * (deepest + 1)  # by depth: the last token of the encoding of the path's first bytes
        stack = [first[0]] if first[0] else []
        vocab, longest, bytes_of, fits, compatible = self.vocab, self.longest_token, self.bytes_of, self.fits, self.compatible
        single, extended = self.single, self.extended
        while stack:
            node = stack.pop()
            if sibling[node]:
                stack.append(sibling[node])
            if first[node]:
                stack.append(first[node])
            depth, byte = depth_of[node], byte_of[node]
            path[depth - 1] = byte
            # The encoding is unique, so the order of trial only matters for speed: the last token one byte longer, then short tokens first.
            token = None
            if depth == 1:
                token = single[byte]
            else:
                before = last[depth - 1]
                longer = extended.get(before << 8 | byte)
                if longer is not None:
                    at = depth - 1 - len(bytes_of[before])
                    before = last[at]
                    good = at == 0 or fits.get(before << 20 | longer)
                    if good is None:
                        good = compatible(before, longer)
                    if good:
                        token = longer
                if token is None:
                    for length in range(1, min(depth, longest) + 1):
                        trial = vocab.get(bytes(path[depth - length : depth]))
                        if trial is None or trial == longer:
                            continue
                        if length == depth:
                            token = trial
                            break
                        before = last[depth - length]
                        good = fits.get(before << 20 | trial)
                        if good is None:
                            good = compatible(before, trial)
                        if good:
                            token = trial
                            break
                    else:
                        raise ValueError("the vocabulary cannot spell a byte")
            last[depth] = token
            number = word_at[node]
            if number >= 0:
                ids, d = [], depth
                while d:
                    ids.append(last[d])
                    d -= len(bytes_of[last[d]])
                out[number] = ids[::-1]
        return out

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the little-endian unsigned 32-bit ids; the strings of special tokens become those tokens."""
        cut = self.cut_special
        split = []
        for text in texts:
            if cut is not None and any(s in text for s in self.special):
                split.append([w for i, part in enumerate(cut.split(text)) for w in ([part] if i % 2 else self.words(part) if part else ())])
            else:
                split.append(self.words(text))
        new = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(new) > self.cache_size:
            self.known = {}
            new = list(set().union(*split))
        ordinary = [w for w in new if w not in self.special]
        for word in set(new) & self.special.keys():
            self.known[word] = np.asarray([self.special[word]], dtype="<u4").tobytes()
        for word, ids in zip(ordinary, self.encode_words([w.encode() for w in ordinary]), strict=True):
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for word in ordinary:
            if len(word) > self.longest:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_CODECS: dict[str, TrieBpe] = {}


def codec(path: str) -> TrieBpe:
    """One codec per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = TrieBpe(path)
        gc.freeze()  # the tables stay for good; the collector need not look at them again
    return _CODECS[path]


def _batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        for run in pieces(batch_rows(batch)):
            encoded = bpe.encode([t.decode() for _, t in run])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in run], pa.int64()), pa.array(encoded, pa.binary()), pa.array([bpe.decode(x) for x in encoded], pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32 bits), decoded (the ids' text).

    A null text counts as empty: no ids, an empty decoded text. Repeated rows each get their row, a null id stays
    null, an empty table gives no rows, other columns are ignored. Special tokens written out in a text become
    those tokens, as the tokenizers library has it by default.
    """
    return keyed(df, id_col, text_col).mapInArrow(partial(_batches, path=tokenizer_file), "doc_id long, ids binary, decoded string")


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in _batches(batches, path):
        ids = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(x.encode()) for x in batch.column(2).to_pylist()), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode_digests(df: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode``'s rows as doc_id, n_tokens, ids_sha256, decoded_sha256, so that no id leaves the worker."""
    return keyed(df, id_col, text_col).mapInArrow(partial(_digests, path=tokenizer_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
