"""Token counts by a published BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a batch are worked off in pieces of about this many bytes.
PIECE_BYTES = 8 << 20
#: A worker remembers the counts of this many chunks; longer ones than so many bytes are never kept.
MOST, LONGEST = 1_000_000, 64

_CODERS: dict[str, object] = {}
_KNOWN: dict[str, dict[bytes, int]] = {}


def coder(tokenizer_file: str):
    """The library's tokenizer without truncation and padding, one per worker; single-threaded, as a Spark task should be."""
    if tokenizer_file not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_file)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        _CODERS[tokenizer_file] = made
    return _CODERS[tokenizer_file]


# Kinds of bytes: white space, letters, digits, marks, and all those that are not looked into.
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \t\n\f\r")] = _WHITE
for _b in range(0x21, 0x7F):
    _KIND[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _MARK
#: Last bytes but one of all white space beyond ASCII (and of other characters).
_BEFORE_LAST = np.isin(np.arange(256), [0x80, 0x81, 0x9A, 0xA0, 0xC2])


def cuttable(tok) -> bool:
    """Whether the tokenizer cuts texts into words by the byte-level pattern alone, so that ``cuts`` keep its tokens."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    words = tok.pre_tokenizer
    return tok.normalizer is None and isinstance(tok.model, BPE) and not tok.model.dropout and isinstance(words, ByteLevel) and words.use_regex and not words.add_prefix_space and all(t.special for t in tok.get_added_tokens_decoder().values())


def cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 begin a chunk: places where words of the byte-level pattern end whatever stands around them.

    Words end between letters, digits and marks, but for an apostrophe with letters, and before white space; white space
    stays with what follows it. Where the pattern's classes aren't plain from the bytes there is no cut: chunks may
    hold several words, never a part of one.
    """
    kind, cut = _KIND[data], np.zeros(len(data), bool)
    latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    before, here = kind[:-1], kind[1:]
    cut[1:] = (before != here) & (before != _WHITE) & (before != _OTHER) & (here != _OTHER) & ~((data[:-1] == ord("'")) & (here == _LETTER))
    spaces = 1 + np.flatnonzero((here == _WHITE) & (before == _OTHER))
    cut[spaces] = (data[spaces - 1] >= 0x80) & ~_BEFORE_LAST[data[spaces - 2]]
    return cut


def _chunk_counts(chunks: list[bytes], tokenizer_file: str, at_once: int) -> list[int]:
    """How many tokens each of some distinct chunks has; the library sees those that this worker doesn't remember."""
    known, tok = _KNOWN.setdefault(tokenizer_file, {}), coder(tokenizer_file)
    new = [c for c in chunks if c not in known]
    if len(known) + len(new) > MOST:
        known.clear()
        new = chunks
    for start in range(0, len(new), at_once):
        part = new[start : start + at_once]
        known.update(zip(part, map(len, tok.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)), strict=True))
    found = [known[c] for c in chunks]
    for c in new:
        if len(c) > LONGEST:
            del known[c]
    return found


def _whole_counts(texts: pa.Array, tokenizer_file: str, at_once: int) -> np.ndarray:
    """Counts of texts that the library encodes whole."""
    out = []
    for start in range(0, len(texts), at_once):
        out += map(len, coder(tokenizer_file).encode_batch_fast([t.decode() for t in texts.slice(start, at_once).to_pylist()], add_special_tokens=False))
    return np.asarray(out, np.int64)


def _piece_counts(data: np.ndarray, offsets: np.ndarray, tokenizer_file: str, at_once: int) -> np.ndarray:
    """Counts of the texts that lie between offsets of some UTF-8: their distinct chunks are looked up and added up."""
    begins = cuts(data)
    begins[offsets[offsets < len(data)]] = True
    starts = np.append(np.flatnonzero(begins), len(data))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    each = np.asarray(_chunk_counts(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), tokenizer_file, at_once), np.int64)
    so_far = np.concatenate([[0], np.cumsum(each[chunks.indices.to_numpy()])])
    return np.diff(so_far[np.searchsorted(starts, offsets)])


def token_counts(texts: pa.Array, tokenizer_file: str, at_once: int = 256) -> pa.Array:
    """How many tokens each text has, without special ones; null for null."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if cuttable(coder(tokenizer_file)):
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
        data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
        parts, at = [np.zeros(0, np.int64)], 0
        while at < len(filled):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
            parts.append(_piece_counts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], tokenizer_file, at_once))
            at = end
        counts = np.concatenate(parts)
    else:
        counts = _whole_counts(filled, tokenizer_file, at_once)
    return pa.array(counts, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def bpe_tokens(text: Column, tokenizer_file: str, at_once: int = 256) -> Column:
    """How many tokens the text has, without special ones; null for null.

    Texts are cut into chunks that no word of the vocabulary's pattern crosses, and the library encodes a chunk once
    in a while for each worker; ``at_once`` strings are given to it at a time. Vocabularies with other patterns
    encode whole texts.
    """

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return token_counts(texts, tokenizer_file, at_once)

    return counted(text)
