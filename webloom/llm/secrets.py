"""Secret scans: fixed patterns, and a battery of randomness tests over candidate strings.

A candidate is a long run of the characters that encodings use, with ``=`` only as padding at its end; a run that mixes
the characters of two alphabets is cut at those that are foreign to one, for each in turn. Its encoding (hex, base32,
base64) is inferred from its alphabet and its symbols go through three tests:

* chi-squared uniformity of the alphabet,
* runs: how often neighbouring symbols change between character classes (for hex: between letters and digits),
* serial correlation of the symbols' values.

Each test is read both ways. A candidate must be compatible with a random string (no test rejects that at
``random_level``), and it must be incompatible with written text: the same statistics have a null distribution for
text-like strings of the same length, whose p-values are combined by Fisher's method. Short strings cannot reach a
small p-value there, which is what makes the rule length-aware. The false discovery rate is held per document by
the Benjamini-Hochberg rule with weights in proportion to length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import keyed
from webloom.session import ship

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PADDED = re.compile(r"[^=]+=*")
# Parts of a run in one of the two largest alphabets, which hold all others.
PARTS = (re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))
SHORTEST = 20
# The encodings' alphabets in the order of their symbols' values.
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE64_URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
ENCODINGS = tuple((name, {c: i for i, c in enumerate(letters)}) for name, letters in (("hex", HEX_LOWER), ("hex", HEX_UPPER), ("base32", BASE32), ("base64", BASE64), ("base64url", BASE64_URL)))

#: Model of text: probability that two symbols drawn from it agree, and that neighbours are of different classes.
TEXT_MATCH, TEXT_CHANGE = 0.066, 0.12
# How many of 10,000 letters of English are each, in order of the alphabet.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (817, 129, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7), strict=True))
#: Share of written letters that are hex digits.
HEX_LETTERS = sum(LETTERS[c] for c in "abcdef") / sum(LETTERS.values())
#: A letter's logarithmic probability in text, made less sure by a tenth of even chance, since other languages differ.
LETTER_LOG = {c: math.log(0.9 * n / sum(LETTERS.values()) + 0.1 / 26) for c, n in LETTERS.items()}
LETTER_MEAN = sum(n * LETTER_LOG[c] for c, n in LETTERS.items()) / sum(LETTERS.values())
#: Its spread between letters, with half as much again for what neighbouring letters have in common.
LETTER_SPREAD = 1.5 * math.sqrt(sum(n * (LETTER_LOG[c] - LETTER_MEAN) ** 2 for c, n in LETTERS.items()) / sum(LETTERS.values()))


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees of freedom > x), by the cube-root normal approximation; exact for k of 2, 4, 6."""
    if k in (2, 4, 6):
        half, term, total = x / 2, 1.0, 0.0
        for i in range(int(k) // 2):
            total += term
            term *= half / (i + 1)
        return math.exp(-half) * total
    return normal_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= x)."""
    if x <= 0:
        return 1.0
    if n > 400:
        return normal_tail((x - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x, n + 1)))


def classes(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(text: str) -> dict | None:
    """The tests' p-values for one candidate: ``random`` (smallest for "it is random") and ``written`` ("it is written text"); None if no encoding fits."""
    body = text.rstrip("=")
    n = len(body)
    for name, values in ENCODINGS:
        if n >= 2 and all(c in values for c in body):
            break
    else:
        return None
    m = len(values)
    symbols = [values[c] for c in body]
    counts = [0] * m
    for v in symbols:
        counts[v] += 1
    chi = sum((c - n / m) ** 2 for c in counts) * m / n
    # With few symbols per cell the statistic is not chi-squared; its exact mean and variance for multinomial counts are.
    mean, var = m - 1.0, 2.0 * (m - 1) * (n - 1) / n
    scale = var / (2 * mean)  # a chi-squared variable of that mean and variance, since the statistic is skewed
    p_chi = chi2_tail(chi / scale, mean / scale)
    kinds = [classes(c) for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    share = [sum(classes(c) == k for c in values) / m for k in range(4)]
    q = 1 - sum(x * x for x in share)
    # Neighbouring changes share a symbol, so their number spreads otherwise than of independent ones.
    shared = sum(x * (1 - x) ** 2 for x in share) - q * q
    sigma = math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * shared)
    p_few, p_many = normal_tail(((n - 1) * q - changes - 0.5) / sigma), normal_tail((changes - (n - 1) * q - 0.5) / sigma)
    centre = (m - 1) / 2
    spread = (m * m - 1) / 12
    serial = sum((a - centre) * (b - centre) for a, b in zip(symbols, symbols[1:], strict=False)) / (spread * math.sqrt(n - 1))
    p_serial = 2 * normal_tail(abs(serial))
    random = min(1.0, 3 * min(p_chi, 2 * min(p_few, p_many), p_serial))
    # Written text: more agreement among symbols than 1/m, so a larger statistic; a small one speaks against text.
    shift = n * (m * TEXT_MATCH - 1) if m * TEXT_MATCH > 1 else 0.0
    p_even = 1 - normal_tail((chi - mean - shift) / math.sqrt(var + 4 * shift))
    p_change = binomial_tail(changes, n - 1, TEXT_CHANGE)
    letters = [c for c in body.lower() if c in LETTERS]
    if name == "hex":  # sixteen symbols are too few for evenness to tell; that all letters are hex digits tells more
        parts = (p_change, HEX_LETTERS ** len(letters))
    elif name == "base32" and letters:  # letters of one case: text has the common ones
        deviation = (sum(LETTER_LOG[c] for c in letters) - LETTER_MEAN * len(letters)) / (LETTER_SPREAD * math.sqrt(len(letters)))
        parts = (p_even, p_change, normal_tail(-deviation))
    else:
        parts = (p_even, p_change)
    written = chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in parts), 2 * len(parts))
    return {"encoding": name, "n": n, "random": random, "written": written}


def discoveries(tested: list[tuple[int, float]], rate: float) -> list[bool]:
    """Benjamini-Hochberg with weights in proportion to length: which of (length, p-value) are found at this false discovery rate."""
    if not tested:
        return []
    mean = sum(n for n, _ in tested) / len(tested)
    weighted = [p * mean / n for n, p in tested]
    bound = 0.0
    for rank, q in enumerate(sorted(weighted), 1):
        if q <= rate * rank / len(tested):
            bound = q
    return [q <= bound and bound > 0 or q == 0 for q in weighted]


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of all strings of 20 or more characters to test, in order; those of different alphabets may overlap."""
    found = set()
    for run in CANDIDATE.finditer(text):
        for m in PADDED.finditer(text, run.start(), run.end()):
            if m.end() - m.start() >= SHORTEST:
                for part in PARTS:
                    found.update((p.start(), p.end()) for p in part.finditer(text, m.start(), m.end()) if p.end() - p.start() >= SHORTEST)
    return sorted(found)


def scan(text: str, rate: float = 1e-4, random_level: float = 1e-3) -> list[tuple[int, int, int]]:
    """Spans (start, end, index in KINDS) by start, then kind; positions in code points, end exclusive."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = list(found)
    tested = []
    for start, end in candidates(text):
        result = battery(text[start:end])
        if result is not None:
            tested.append((start, end, result))
    good = [t for t, found_random in zip(tested, discoveries([(r["n"], r["written"]) for _, _, r in tested], rate), strict=True) if found_random and t[2]["random"] >= random_level]
    for start, end, _ in good:
        inside = any(a <= start and end <= b and (a, b) != (start, end) for a, b, _ in good)
        if not inside and not any(a <= start and end <= b for a, b, _ in base):
            found.append((start, end, 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan_rows(batches: Iterator[pa.RecordBatch], rate: float, random_level: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            spans = [scan(t or "", rate, random_level) for t in part.column(1).to_pylist()]
            base = [[s for s in x if s[2] < 3] for x in spans]
            count = lambda k: pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(spell(x).encode()).hexdigest() for x in base], pa.string()), pa.array([spell(x) for x in spans], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def secret_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 1e-4, random_level: float = 1e-3) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of all findings by start, then kind; ``base_sha256`` is of the same list of the
    three base kinds alone. A null or empty text has no spans. Repeated rows each get their row, a null id stays
    null, an empty table gives no rows, other columns are ignored.
    """
    return keyed(df, id_col, text_col).mapInArrow(partial(_scan_rows, rate=rate, random_level=random_level), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]], placeholder: str = "<SECRET>") -> str:
    """The text with each span, overlapping ones joined, replaced by the placeholder."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], placeholder]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", placeholder: str = "<SECRET>", rate: float = 1e-4, random_level: float = 1e-3) -> DataFrame:
    """``df`` with the secrets in its texts replaced; ``count_col``, if it is there, gets the new number of code points.

    All rows and columns stay, repeated rows and null ids too; rows without findings and null or empty texts are
    unchanged; an empty table stays empty.
    """
    at = df.columns.index(text_col)
    count = df.columns.index(count_col) if count_col in df.columns else None

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = list(part.columns)
                texts = part.column(at).to_pylist()
                spans = [scan(t, rate, random_level) if t else [] for t in texts]
                if any(spans):
                    columns[at] = pa.array([mask(t, s, placeholder) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
                    if count is not None:
                        old = part.column(count).to_pylist()
                        columns[count] = pa.array([len(t) if s else n for t, s, n in zip(columns[at].to_pylist(), spans, old, strict=True)], part.column(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    ship(df.sparkSession)
    named = df.select(*[F.col(f"`{c}`") for c in df.columns])
    return named.mapInArrow(cleaned, df.schema)
