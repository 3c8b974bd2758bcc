"""Secrets in texts: three fixed patterns, and a battery of randomness tests for tokens of no known form.

Battery: for each run of 20 or more token characters the narrowest alphabet
that holds it is taken as its encoding. The token must pass as uniform over
that alphabet in a chi-squared test of symbol counts, a runs test about the
alphabet's middle and a lag-1 serial-correlation test. Three statistics give
p-values against ordinary text (letter frequencies, few changes of character
class where the alphabet has several, alternation of vowels and consonants);
they are combined by Stouffer's rule, and a Benjamini-Hochberg procedure over the text's tokens, with p-values
weighted by token length, controls false discoveries.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so that shorter ones needn't be matched and dropped
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")  # = only as padding, so that the value of name=value is tested by itself

#: False discovery rate against ordinary text, and the level under which uniformity counts as rejected.
FDR, UNIFORM_LEVEL = 1e-3, 1e-3
MASK = "[SECRET]"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From narrow to wide; the first that holds all symbols is inferred.
ALPHABETS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("hex", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"),
    ("lower36", _DIGITS + _LOWER), ("upper36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Letter frequencies of ordinary text, per mille.
_FREQUENCY = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
_SURPRISE = {c: -math.log(f / sum(_FREQUENCY.values())) for c, f in _FREQUENCY.items()}
_MEAN, _SQUARE = (sum(f * _SURPRISE[c] ** n for c, f in _FREQUENCY.items()) / sum(_FREQUENCY.values()) for n in (1, 2))


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _z_of(p: float) -> float:
    """The normal quantile, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _phi(mid) < p else (lo, mid)
    return lo


def _at_least(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))) if n <= 400 else 1 - _phi((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))


def inferred_alphabet(token: str) -> tuple[str, str] | None:
    have = set(token)
    return next(((name, a) for name, a in ALPHABETS if have <= set(a)), None)


def uniformity(token: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of uniform randomness: symbol counts (upper tail), runs and serial correlation (both tails)."""
    n, k = len(token), len(alphabet)
    counts = [token.count(c) for c in set(token)]
    x = sum(c * c for c in counts) * k / n - n
    p_chi = 1 - _phi((x - (k - 1)) / math.sqrt(max(2 * (k - 1) * (1 - 1 / n), 1e-9)))
    at = [alphabet.index(c) for c in token]
    high = [2 * i >= k for i in at]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    p_runs = 2 * _phi(-abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    middle = sum(at) / n
    square = sum((i - middle) ** 2 for i in at)
    r = sum((i - middle) * (j - middle) for i, j in zip(at, at[1:], strict=False)) / square if square else 1.0
    p_serial = 2 * _phi(-abs(r + 1 / n) * math.sqrt(n))
    return p_chi, p_runs, p_serial


def text_p(token: str, alphabet: str) -> float:
    """Combined p-value of the battery's statistics under ordinary text: small for what text hardly makes."""
    n = len(token)
    folded = token.lower()
    letters = [c for c in folded if c.isalpha()]
    m = len(letters)
    if m >= 8:
        z_letters = -(sum(_SURPRISE[c] for c in letters) - m * _MEAN) / math.sqrt(m * (_SQUARE - _MEAN**2))
    else:
        z_letters = -26 / 8 if m < n / 2 else 0.0
    kind = [1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 4 for c in token]
    changes = sum(x != y for x, y in zip(kind, kind[1:], strict=False))
    vowel = [c in "aeiouy" for c in folded]
    share = sum(vowel) / n
    if 0 < share < 1:
        r = sum((x - share) * (y - share) for x, y in zip(vowel, vowel[1:], strict=False)) / (n * share * (1 - share))
        z_serial = -(r + 0.35) * math.sqrt(n)
    else:
        z_serial = -2.0
    if len({c.isdigit() + 2 * c.islower() + 3 * c.isupper() for c in alphabet}) == 1:  # one class has no changes, whether random or not
        return _phi((z_letters + z_serial) / math.sqrt(2))
    z_runs = _z_of(max(_at_least(changes, n - 1, 0.06), 1e-300))
    return _phi((z_letters + z_runs + z_serial) / math.sqrt(3))


def random_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of tokens that the battery takes for random."""
    tested = []
    for m in TOKEN.finditer(text):
        body = m[0].rstrip("=")
        found = inferred_alphabet(body)
        if len(body) >= 20 and found and min(uniformity(body, found[1])) >= UNIFORM_LEVEL:
            tested.append((text_p(body, found[1]), len(body), m.start(), m.end()))
        else:
            tested.append((1.0, max(len(body), 1), m.start(), m.end()))
    if not tested:
        return []
    mean = sum(t[1] for t in tested) / len(tested)
    ranked = sorted((p * mean / n, start, end) for p, n, start, end in tested)
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= FDR * i / len(ranked)), default=0)
    return [(start, end) for _, start, end in ranked[:last]]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Base spans, and random tokens that overlap none of them."""
    base = base_spans(text)
    more, i, reach = [], 0, -1
    for start, end in sorted(random_tokens(text)):
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= start:
            more.append((start, 3, end, start))
    return sorted(base + more)


def redacted(text: str) -> str:
    """The text with every secret, merged where they overlap, in place of it MASK; names such as ``password=`` stay."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in all_spans(text)):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for text in b.column("text").to_pylist():
            spans = all_spans(text)
            base = [s for s in spans if s[1] < 3]
            for column, value in zip(rows, (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in rows[:3]), *(pa.array(x, pa.string()) for x in rows[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs(doc_id, text, ...).

    Null texts count as empty ones and have no spans; doc_id may be null or
    repeated; columns besides the two are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: Column) -> Column:
    """The text with its secrets masked; null stays null."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redacted(t) for t in texts.to_pylist()], pa.string())

    return of(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, secrets in text masked, n_chars (if there is one) in step with it."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", redact(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
