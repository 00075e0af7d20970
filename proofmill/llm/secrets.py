"""Secret scan: fixed patterns, and a guess-cost dynamic programme over credential values.

Fixed patterns find assignments, access keys and long hex runs. In wider credential contexts
(``pwd is ...``, ``passphrase: ...``) a value counts as a secret if guessing it is dear: the
cheapest segmentation into known words, dates, repeats, sequences, keyboard walks and brute
force spans needs at least ``10 ** min_log10_guesses`` guesses. A brute force character costs the
alphabet of the classes that the value mixes, so random values are found from 6 characters if they
mix two classes, with letters or digits alone from 9; letters that can be spoken like a word count as
one, so such values are found from 13. Known words are a short fixed
list and the words of the document itself, so ordinary prose after "password is" stays cheap.
Words inside a credential value, or inside a copy of one elsewhere in the text, are not known by
that: no value makes itself or another one cheap.

Defined cases: null and empty texts hold no secret; texts are scanned whole, however long;
offsets are code points, end exclusive; a guess span inside one base span is left out, one that reaches beyond is kept whole;
equal spans cannot occur twice; the guesses told of a value longer than ``LONG_VALUE`` are a lower
bound; repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import python_ready, text_of

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 9.0
#: Values longer than this are measured only until they are proven dear enough.
LONG_VALUE = 256
SPANS = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:(?<![a-z])|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))"""  # DB_PASS and dbPass, not compass
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:secret[\s_-]?)?(?:api|access|private|auth)"""
    r"""[\s_-]?key|secret[\s_-]?key|login|auth)["']?\s{0,3}(?::=|=>|->|[:=]|\bis\b)\s{0,3}["']?"""
    r"""([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "login", "auth")
_WORD = re.compile(r"[^\W\d_]{3,24}")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_SIGNS = re.compile(r"(?:^|(?<=[\W_]))[\W_]|[\W_](?=[\W_]|$)|[^\w\-./:'’|&+=@]")  # but single joining ones

#: Frequent passwords and words, by rank.
COMMON = (
    "password qwerty abc admin letmein welcome monkey dragon master login princess football "
    "baseball sunshine iloveyou trustno shadow superman michael ninja mustang jordan harley hunter "
    "ranger buster soccer batman test pass killer hockey george charlie andrew love secret "
    "root user guest default changeme example summer winter spring autumn hello freedom whatever "
    "computer internet server service system database token access public private my the and for "
    "you not this that with from your have are was but all can one new key value none null true "
    "false string text file name data").split()
#: Rows of a keyboard and its two slants.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./",
            "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/",
            "2q", "3wa", "4esz", "5rdx", "6tfc", "7ygv", "8uhb", "9ijn", "0okm", "-pl,")

_LOG10 = math.log10
#: A word of Latin letters with at most three consonants or vowels in a row, accents apart.
_SPOKEN = re.compile(r"(?:(?!q[^u])[bcdfghj-np-tvwxzß]\u0327?){0,3}(?:[aeiouy][\u0300-\u036f]*){1,3}"
                     r"(?:(?:(?!q[^u])[bcdfghj-np-tvwxzß][\u0300-\u036f]*){1,3}(?:[aeiouy][\u0300-\u036f]*){1,3})*"
                     r"(?:[bcdfghj-np-tvwxzß][\u0300-\u036f]*){0,3}")
_SPEECH = 0.7           # five guesses a character of a word that can be spoken
_BRUTE = 1.0            # ten guesses a character of a plain word or number
_SEGMENT = _LOG10(3)    # the order and number of the segments has to be guessed too
_YEARS = 120
_LEET = str.maketrans("013457@$!", "oieastasi")
_NEXT = {}
for _row in KEYBOARD:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT[_a, _b] = _NEXT[_b, _a] = True
_MAX_WORD = 24


def _date_cost(piece: str) -> float | None:
    """Year, or day-month-year in any order with or without separators."""
    digits = re.sub(r"[-/._]", "", piece)
    if not digits.isascii() or not digits.isdigit() or not piece[0].isdigit() or not piece[-1].isdigit():
        return None
    if len(piece) == 4 and 1900 <= int(digits) <= 2050:
        return _LOG10(_YEARS)
    if len(digits) in (6, 8):
        for day, month, year in ((0, 2, 4), (2, 0, 4), (-2, -4, 0), (-4, -2, 0)):
            two = lambda at: int(digits[at:][:2]) if at >= 0 else int(digits[len(digits) + at:][:2])
            years = digits[4:] if year == 4 else digits[:-4]
            if 1 <= two(day) <= 31 and 1 <= two(month) <= 12 and (
                    len(years) == 2 or 1900 <= int(years) <= 2050):
                return _LOG10(365 * _YEARS) + (_LOG10(4) if len(digits) != len(piece) else 0)
    return None


def _case_cost(piece: str) -> float:
    upper = sum(c.isupper() for c in piece)
    if not upper:
        return 0.0
    if upper == len(piece) or (upper == 1 and (piece[0].isupper() or piece[-1].isupper())):
        return _LOG10(2)
    return _LOG10(sum(math.comb(len(piece), k) for k in range(1, min(upper, len(piece) - upper) + 1)))


def brute_cost(value: str) -> float:
    """log10 of the guesses a character of ``value``, by the classes of characters it mixes.

    Plain words, in one case or with a capital, and numbers count ten guesses a character, also
    several of one kind joined by single signs such as ``e-mail`` or ``12:30``. A single word that
    can be spoken, vowels and consonants taking turns, counts five.
    """
    words = _LETTERS.findall(value)
    if words == [value] and value[1:] in (value[1:].lower(), value[1:].upper()) and _SPOKEN.fullmatch(
            unicodedata.normalize("NFD", value.lower())):
        return _SPEECH
    size = 26 if words else 0
    size += 26 if any(w != w.upper() and w[1:] != w[1:].lower() for w in words) else 0
    size += 10 if _DIGITS.search(value) else 0
    size += 33 if _SIGNS.search(value) else 0
    return _BRUTE if size in (0, 10, 26, 33) else _LOG10(size)


def guess_cost(value: str, ranks: dict[str, int], brute: float = _BRUTE, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    ``ranks`` has the rank, from 1, of each known word in lower case; ``brute`` is the cost of a
    character that no other kind covers. Once no segmentation of the whole can need less than
    ``enough``, the bound that proves it is returned instead.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    step_run = walk_run = same_run = 1
    for end in range(1, n + 1):
        i = end - 1
        # brute force, one character at a time; a new span pays for being one
        offer(end, best[i] + brute)
        if i:
            delta = ord(low[i]) - ord(low[i - 1])
            step_run = step_run + 1 if abs(delta) == 1 and (step_run == 1 or delta == last) else 2 if abs(delta) == 1 else 1
            last = delta
            walk_run = walk_run + 1 if (low[i - 1], low[i]) in _NEXT else 1
            same_run = same_run + 1 if delta == 0 else 1
        for run, base in ((step_run, _LOG10(26) + 0.3), (walk_run, _LOG10(47 * 4)), (same_run, 1.0)):
            if run >= 3:
                # the run may also be shorter than it could be
                for length in range(3, min(run, _MAX_WORD) + 1):
                    offer(end, best[end - length] + base + _LOG10(length) + _SEGMENT)
                if run > _MAX_WORD:
                    offer(end, best[end - run] + base + _LOG10(run) + _SEGMENT)
        for length in range(2, min(end, _MAX_WORD) + 1):
            start = end - length
            piece = low[start:end]
            rank = ranks.get(piece)
            if rank is None and plain != low:
                rank = ranks.get(plain[start:end])
                rank = rank and 4 * rank
            if rank and length >= 3:
                offer(end, best[start] + _LOG10(rank + 1) + _case_cost(value[start:end]) + _SEGMENT)
            if 4 <= length <= 10 and (cost := _date_cost(piece)) is not None:
                offer(end, best[start] + cost + _SEGMENT)
            if length % 2 == 0 and length >= 4 and low[start:start + length // 2] == low[start + length // 2:end]:
                half = start + length // 2  # a block written twice costs about as much as once
                offer(end, best[half] + _LOG10(2) + _SEGMENT)
        if best[end] >= enough and end >= _MAX_WORD and max(step_run, walk_run, same_run) <= _MAX_WORD:
            # but for a run still going on, every longer segmentation has a cut among these
            least = min(best[end - _MAX_WORD + 1:end + 1])
            if least >= enough:
                return least
    return best[n]


def without_values(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans and without the strings equal to one, in any case, elsewhere."""
    # by a value's longest word: where it may stand around that word, as (place of the word, length)
    shapes: dict[str, set[tuple[int, int]]] = {}
    values = {text[a:b].lower() for a, b in spans}
    for value in values:
        word = max(_WORD.finditer(value), key=lambda m: len(m[0]), default=None)
        if word:
            shapes.setdefault(word[0], set()).add((word.start(), len(value)))
    cut = list(spans)
    for m in _WORD.finditer(text):
        for at, length in shapes.get(m[0].lower(), ()):
            start = m.start() - at
            if start >= 0 and text[start:start + length].lower() in values:
                cut.append((start, start + length))
    return redact(text, sorted(cut), " ")


def document_ranks(text: str) -> dict[str, int]:
    """Known words for a text: the fixed list, then the text's own words, frequent ones first."""
    ranks = {w: k for k, w in enumerate(COMMON, 1)}
    counts: dict[str, int] = {}
    for word in _WORD.findall(text.lower()):
        counts[word] = counts.get(word, 0) + 1
    for word in sorted((w for w, c in counts.items() if w not in ranks), key=lambda w: (-counts[w], w)):
        ranks[word] = len(ranks) + 1
    return ranks


def scan(text: str, min_log10_guesses: float = MIN_LOG10_GUESSES) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) of one text, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        base = sorted((s, e) for _, s, e, _ in found)
        values = [(m.start(1), m.start(1) + len(m[1].rstrip(".!?)]}"))) for m in _CONTEXT.finditer(text)]
        asked = [(a, b) for a, b in values if b - a >= 6 and not any(s <= a and b <= e for s, e in base)]
        if asked:
            assigned = [m.span(2) for m in _ASSIGN.finditer(text)]
            ranks = document_ranks(without_values(text, values + assigned + base))
            for start, end in asked:
                value = text[start:end]
                cost = guess_cost(value, ranks, brute_cost(value), min_log10_guesses if len(value) > LONG_VALUE else math.inf)
                if cost >= min_log10_guesses:
                    found.append(("guess", start, end, cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def with_spans(docs: DataFrame, spans: str = "spans", min_log10_guesses: float = MIN_LOG10_GUESSES) -> DataFrame:
    """Documents with their secrets as an array of (kind, start, end, log10_guesses)."""
    python_ready(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "log10_guesses"), s))
                              for s in scan(t, min_log10_guesses)] for t in texts], dtype=object)

    return docs.withColumn(spans, find(text_of()))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, min_log10_guesses: float = MIN_LOG10_GUESSES) -> DataFrame:
    """Documents of the same columns with secrets replaced in ``text`` and ``n_chars`` to match.

    Texts without a secret, null ones too, stay exactly as they are.
    """
    python_ready(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if not isinstance(t, str) or not (s := scan(t, min_log10_guesses))
                             else redact(t, [(a, b) for _, a, b, _ in s]) for t in texts], dtype=object)

    out = docs.withColumn("__clean", clean("text"))
    changed = ~F.col("__clean").eqNullSafe(F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("__clean").cast(docs.schema[c].dataType))
                           .otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def digest_rows(docs: DataFrame, min_log10_guesses: float = MIN_LOG10_GUESSES) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    rows = with_spans(docs.select("doc_id", "text"), "found", min_log10_guesses)
    shown = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(shown(F.filter("found", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"), of("guess").alias("n_guess"))


