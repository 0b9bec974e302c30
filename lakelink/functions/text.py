"""String similarity for pair features: exact definitions, batched over Arrow, equal pairs computed once."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; beyond 0.7 a tenth of the rest for each of up to four equal first letters. Empty texts: 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Most cells of the distance tables that are held at once (4 bytes each), unless one pair alone needs more.
TABLE_CELLS = 8_000_000


def damerau(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of many pairs at once (the recurrence of Lowrance and Wagner)."""
    n = len(pairs)
    if not n:
        return np.zeros(0, np.int64)
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    wide, high = int(lb.max()), int(la.max())
    letters = {c: i for i, c in enumerate(sorted({c for a, b in pairs for c in a + b}))}
    x, y = np.full((n, high), -1), np.full((n, wide), -2)
    for i, (a, b) in enumerate(pairs):
        x[i, : len(a)] = [letters[c] for c in a]
        y[i, : len(b)] = [letters[c] for c in b]
    top = (la + lb).astype(np.int32)
    d = np.zeros((high + 2, wide + 2, n), np.int32)
    d[0, :, :] = top
    d[:, 0, :] = top
    d[1:, 1, :] = np.arange(high + 1)[:, None]
    d[1, 1:, :] = np.arange(wide + 1)[:, None]
    last_row = np.zeros((max(1, len(letters)), n), np.int32)
    each = np.arange(n)
    for i in range(1, high + 1):
        last_col = np.zeros(n, np.int32)
        for j in range(1, wide + 1):
            yj = np.maximum(y[:, j - 1], 0)
            k, m = last_row[yj, each], last_col
            same = x[:, i - 1] == y[:, j - 1]
            cost = d[i, j] + (~same)
            swap = d[k, m, each] + (i - k - 1) + 1 + (j - m - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(cost, swap), np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            last_col = np.where(same, j, last_col)
        last_row[np.maximum(x[:, i - 1], 0), each] = np.where(x[:, i - 1] >= 0, i, last_row[np.maximum(x[:, i - 1], 0), each])
    return d[la + 1, lb + 1, each].astype(np.int64)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u) | (s - u)
    return len(a) - (s & (1 << len(a)) - 1).bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|); both empty: 100."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common tokens and the common ones with either side's rest; an empty side: 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not only_a or not only_b):
        return 100.0
    both_a, both_b = f"{common} {only_a}".strip(), f"{common} {only_b}".strip()
    best = ratio(both_a, both_b)
    return max(best, ratio(common, both_a), ratio(common, both_b)) if common else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one (also windows that stick out at the ends)."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if s in t:
        return 100.0
    n = len(s)
    windows = {t[max(0, i) : i + n] for i in range(1 - n, len(t))}
    best = max(ratio(s, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(ratio(t, s[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def w_ratio(a: str, b: str) -> float:
    """The greatest of the ratios, token ratios at 0.95; for texts of unlike length partial ones at 0.9 (0.6 beyond 8 times)."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if unlike < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    part = 0.9 if unlike <= 8 else 0.6
    sort = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    sets = 100.0 if set(a.split()) & set(b.split()) else partial_ratio(" ".join(sorted(set(a.split()) - set(b.split()))), " ".join(sorted(set(b.split()) - set(a.split()))))
    return max(best, part * partial_ratio(a, b), 0.95 * part * max(sort, sets))


def soundex(s: str) -> str:
    """American Soundex of a Latin word; '' for digits and other scripts."""
    codes = {c: str(d) for d, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
    s = "".join(c for c in s.lower() if "a" <= c <= "z")
    if not s:
        return ""
    out, last = s[0].upper(), codes.get(s[0], "")
    for c in s[1:]:
        d = codes.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


def strip_accents(s: str | None) -> str | None:
    """Compatibility decomposition without combining marks."""
    return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


SCORERS: dict[str, Callable[[str, str], float]] = {"jaro_winkler": jaro_winkler, "ratio": ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "w_ratio": w_ratio}


def similarities(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct with one score for each name: (scorer, a, b). One Arrow pass serves all; equal pairs of a batch are scored
    once; null counts as empty."""

    plan = [(name, scorer) for name, (scorer, _, _) in wanted.items()]

    @F.pandas_udf(", ".join(f"{n} double" for n in wanted))
    def run(*texts: pd.Series) -> pd.DataFrame:
        out, known = {}, {}
        for i, (name, scorer) in enumerate(plan):
            f, values = SCORERS[scorer], []
            for p in zip(texts[2 * i], texts[2 * i + 1], strict=True):
                if (scorer, p) not in known:
                    known[scorer, p] = f(p[0] or "", p[1] or "")
                values.append(known[scorer, p])
            out[name] = pd.Series(values, dtype="float64")
        return pd.DataFrame(out)

    return run(*(c for _, a, b in wanted.values() for c in (a, b)))


def similarity(name: str, a: Column, b: Column) -> Column:
    """One of the scorers above as a column (null counts as empty)."""
    return similarities({"score": (name, a, b)})["score"]


def damerau_similarity(a: Column, b: Column) -> Column:
    """1 - distance / the longer length, 0 if either is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        due = sorted({p for p in pairs if p[0] and p[1]}, key=lambda p: max(len(p[0]), len(p[1])))
        known: dict = {}
        i = 0
        while i < len(due):  # sorted by length, so the next pair's length bounds most of a block
            high = max(map(len, due[min(i + 511, len(due) - 1)])) + 2
            part = due[i : i + max(1, min(512, TABLE_CELLS // (high * high)))]
            i += len(part)
            for p, x in zip(part, damerau(part), strict=True):
                known[p] = 1 - min(1.0, x / max(len(p[0]), len(p[1])))
        return pd.Series([known.get(p, 0.0) for p in pairs], dtype="float64")

    return run(a, b)


def soundex_column(c: Column) -> Column:
    """Soundex of Latin words, '' otherwise (Spark's own passes other texts through)."""
    return F.when(F.coalesce(c, F.lit("")).rlike("^[A-Za-z]+$"), F.soundex(c)).otherwise(F.lit(""))


def strip_accents_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(strip_accents)

    return run(c)
