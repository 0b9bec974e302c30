"""Personal data replaced by keyed surrogates.

Found entities (mail and IP addresses, phone, card, account and social security numbers, access
keys, passwords and tokens, titled names) are replaced by values of the same type: a number keeps
its length, marks and check digits, an address its form, a name its gender, script and capitals.

Everything but names goes through a keyed permutation of all strings of the same format (a Feistel
network over the mixed-radix number that the string spells lays all numbers on a circle, and the next one on it that
is of the type again is taken, so no value stays as it is where there is another; secrets of more than BLOCK characters in blocks, each by a permutation of its place). Letters and
digits of other scripts change within their Unicode block and category, marks only where a secret has
nothing else. A permutation maps different originals to different surrogates and the same original to the
same surrogate in every document, on every worker, with no state to share. Names are spelled from a
keyed digest of the name, so they agree across documents but for collisions: within a document the
second of two colliding names takes the next digest, across documents different names may share a surrogate. Later bare mentions of a titled name are replaced as well.

Defined results: a null text stays null with 0 entities; empty texts and texts without entities
stay as they are. Whole texts are scanned. Repeated rows get equal results.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

KEY = b"lakelink surrogate key"  # give your own to surrogates()
ROUNDS = 8
#: Characters of a secret that one permutation takes.
BLOCK = 256
_MARKS = "!#$%&()*+-./:=?@[\\]^_`{|}~"  # ASCII marks that a secret may hold

_SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)"
_NAME = r"[^\W\d_]{2,30}"
_MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "господин", "κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Signora", "госпожа", "κυρία")
_TITLES = "|".join(sorted({f(t) for t in (*_MALE, *_FEMALE, "Dr", "Prof", "Mx") for f in (str, str.upper)}, key=len, reverse=True))

#: (kind, what a text must hold, pattern), first come first served where matches overlap.
PATTERNS: list[tuple[str, re.Pattern | str, re.Pattern]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)passw|pwd|secret|token|key"), re.compile(_SECRET + r"([^\s\"',;<>]{6,})")),
    ("secret", re.compile(r"(?i)passw|pwd"), re.compile(r"(?i:\b(?:password|passwd|pwd)\b\s*[=:]\s*[\"']?)([^\s\"',;<>]{4,5})(?![^\s\"',;<>])")),
    ("access_key", re.compile("A(?:KIA|SIA|IDA|ROA)"), re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA|IDA|ROA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")),
    ("ipv6", re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*[\w:])")),
    ("phone", re.compile(r"\d[ ().-]{1,2}\d"), re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+-])(?<!\d )\d{3} \d{3} \d{4}(?![\w-]| \d)|(?<![\w.+-])(?<!\d )0\d{2,4}[ /-]\d{6,8}(?![\w-]| \d)")),
    ("ssn", re.compile(r"\d-\d\d-\d"), re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"\d{4}[ -]?\d{4}"), re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")),
    ("name", re.compile(_TITLES), re.compile(rf"(?<!\w)(?:{_TITLES})\b\.?[ ]({_NAME}(?:[ -]{_NAME}){{0,2}})")),
]


@functools.cache
def _alphabet(block: int, category: str) -> str:
    """The characters beyond ASCII of a Unicode block (of 256) and category."""
    return "".join(c for c in map(chr, range(max(128, block << 8), block + 1 << 8)) if unicodedata.category(c) == category)


def _hexa(s: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))


class Permutation:
    """Keyed permutations of the strings of one format."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: str, r: int, b: int, nbytes: int) -> int:
        out, n = b"", 0
        while len(out) < nbytes:
            out += hashlib.blake2b(f"{tweak}|{r}|{n}|{b}".encode(), key=self.key).digest()
            n += 1
        return int.from_bytes(out[:nbytes], "big")

    def _shuffled(self, tweak: str, x: int, size: int, back: bool = False) -> int:
        """A keyed permutation of 0..size-1, or its inverse."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, nbytes = (1 << half) - 1, (half + 7) // 8
        while True:
            a, b = x >> half, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ (self._round(tweak, r, a, nbytes) & mask), a
                else:
                    a, b = b, a ^ (self._round(tweak, r, b, nbytes) & mask)
            x = a << half | b
            if x < size:
                return x

    def number(self, tweak: str, x: int, size: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        """x in 0..size-1 -> the next number that fits (x fits itself) on a keyed circle of them all: one to one, and
        never x itself unless nothing else fits."""
        if size < 2:
            return x
        place = self._shuffled(tweak, x, size)
        while True:
            place = (place + 1) % size
            y = self._shuffled(tweak, place, size, back=True)
            if y == x or fits(y):
                return y

    def spell(self, kind: str, s: str, free: str, fits: Callable[[str], bool] = lambda _: True) -> str:
        """s with the letters and digits marked '1' in free replaced; cases and all else stay."""
        secret = kind.startswith("secret")
        hexa = secret and _hexa(s)
        marks = secret and not any(c.isalnum() for c in s)
        sets, shape, x = [], [], 0
        for c, f in zip(s, free, strict=True):
            letters = ""
            if f == "1":
                if hexa:
                    letters = "0123456789abcdef" if s == s.lower() else "0123456789ABCDEF"
                elif c in "0123456789":
                    letters = "0123456789"
                elif "a" <= c <= "z":
                    letters = "abcdefghijklmnopqrstuvwxyz"
                elif "A" <= c <= "Z":
                    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                elif secret and c > "\x7f" and (marks or unicodedata.category(c)[0] in "LMN"):
                    letters = _alphabet(ord(c) >> 8, unicodedata.category(c))
                elif marks and c in _MARKS:
                    letters = _MARKS
            sets.append(letters)
            # Letters of other alphabets are told by their first.
            shape.append("h" if letters and hexa else "9" if letters[:1] == "0" else "a" if letters[:1] in ("a", "A") else f"<{letters[0]}>" if letters else c)
            if letters:
                x = x * len(letters) + letters.index(c)
        size = 1
        for letters in sets:
            size *= len(letters) or 1

        def back(y: int) -> str:
            out = []
            for c, letters in zip(reversed(s), reversed(sets), strict=True):
                if letters:
                    y, k = divmod(y, len(letters))
                    c = letters[k]
                out.append(c)
            return "".join(reversed(out))

        return back(self.number(f"{kind}|{''.join(shape)}", x, size, lambda y: fits(back(y))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Addresses of these networks get others of the same network.
_NETS = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]


def _ip_class(s: str) -> str | None:
    try:
        a = ipaddress.IPv4Address(s)
    except ValueError:
        return None
    for net in _NETS:
        if a in net:
            return str(net)
    return "special" if a.is_private or a.is_multicast or a.is_reserved else "public"


_NETS6 = [ipaddress.ip_network(n) for n in ("::1/128", "fe80::/10", "fc00::/7", "2001:db8::/32", "2000::/3", "::/0")]


def _net6(s: str) -> ipaddress.IPv6Network | None:
    """The first of _NETS6 that holds an IPv6 address; None if s is none, or may be a qualified name or a time."""
    try:
        a = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    sure = s.count(":") > 2 or s.lower().startswith(("fe80:", "fc", "fd", "2001:"))
    return next(n for n in _NETS6 if a in n) if sure and sum(c.isalnum() for c in s) >= 4 else None


_VOWELS = {"LATIN": "aeiou", "CYRILLIC": "аеиоу", "GREEK": "αεηιο"}
_CONSONANTS = {"LATIN": "bdfgklmnprstv", "CYRILLIC": "бвгдклмнпрст", "GREEK": "βγδκλμνπρστ"}
_ENDS = {"LATIN": ("n", "a"), "CYRILLIC": ("н", "а"), "GREEK": ("ς", "α")}


def _script(s: str) -> str:
    for c in s:
        name = unicodedata.name(c, "")
        for script in _VOWELS:
            if name.startswith(script):
                return script
    return "LATIN"


class Surrogates:
    def __init__(self, key: bytes = KEY):
        self.perm = Permutation(key)

    def name_part(self, part: str, gender: str, given: bool, attempt: int = 0) -> str:
        """A pronounceable name in the script and capitals of part; the gender decides the ending of a given name only."""
        script = _script(part)
        h = int.from_bytes(hashlib.blake2b(f"{part.casefold()}|{attempt}".encode(), key=self.perm.key).digest(), "big")
        out = ""
        for _ in range(4):
            h, c = divmod(h, len(_CONSONANTS[script]))
            h, v = divmod(h, len(_VOWELS[script]))
            out += _CONSONANTS[script][c] + _VOWELS[script][v]
        if given and gender in "mf":
            out = out[:-1] + _ENDS[script][gender == "f"] if gender == "f" else out + _ENDS[script][0]
        return out.upper() if part.isupper() else out.capitalize() if part[:1].isupper() else out

    def of(self, kind: str, s: str) -> str:
        p = self.perm
        if kind == "email":
            local, _, domain = s.rpartition("@")
            labels = domain.split(".")
            kept = 2 if len(labels) > 2 and labels[-2].lower() == "example" else 1
            head = ".".join(labels[:-kept])
            free = "1" * len(local) + "0" + "1" * len(head) + "0" * (len(domain) - len(head))
            return p.spell(kind, s, free)
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=\D)", s)
            n = code.end() if code else int(s[0] == "0")  # a trunk prefix stays
            return p.spell(kind, s, "0" * n + "1" * (len(s) - n))
        if kind == "card":
            return p.spell(kind, s, "0" + "1" * (len(s) - 1), lambda y: luhn(re.sub(r"\D", "", y)))
        if kind == "iban":
            valid = _iban(s)
            return p.spell(kind + str(valid), s, "00" + "1" * (len(s) - 2), lambda y: _iban(y) == valid)
        if kind == "ip":
            group, as_text = _ip_class(s), lambda y: str(ipaddress.IPv4Address(y))
            net = next((n for n in _NETS if str(n) == group), ipaddress.ip_network("0.0.0.0/0"))
            first = int(net.network_address)
            return as_text(first + p.number("ip|" + str(group), int(ipaddress.IPv4Address(s)) - first, net.num_addresses, lambda y: _ip_class(as_text(first + y)) == group))
        if kind == "ipv6":
            net = _net6(s)
            first = int(net.network_address)
            inner = lambda y: _net6(str(ipaddress.IPv6Address(first + y))) == net
            made = ipaddress.IPv6Address(first + p.number(f"ipv6|{net}", int(ipaddress.IPv6Address(s)) - first, net.num_addresses, inner))
            return str(made).upper() if s.upper() == s and s.lower() != s else str(made)
        if kind == "access_key":
            return p.spell(kind, s, "0000" + "1" * (len(s) - 4))
        if kind == "secret":
            return self.secret(s)
        return p.spell(kind, s, "1" * len(s))

    def secret(self, s: str) -> str:
        """Hexadecimal secrets stay so, and others never become so: they would meet the surrogates of the former."""
        parts = [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
        return "".join(self.perm.spell(f"secret{i or ''}", part, "1" * len(part), lambda y, h=_hexa(part): _hexa(y) == h) for i, part in enumerate(parts))


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    spans: list[tuple[int, int, str]] = []
    taken: set[int] = set()
    for kind, gate, pattern in PATTERNS:
        if not (gate in text if isinstance(gate, str) else gate.search(text)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if pattern.groups else m.span()
            s = text[a:b]
            if kind == "ip" and _ip_class(s) is None or kind == "iban" and not _iban(s) or kind == "card" and not luhn(re.sub(r"\D", "", s)) or kind == "ipv6" and _net6(s) is None:
                continue
            if kind == "name" and not s[:1].isupper():
                continue
            if not taken.isdisjoint(range(a, b)):
                continue
            taken.update(range(a, b))
            spans.append((a, b, kind))
    return sorted(spans)


def replaced(text: str, maker: Surrogates) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of the entities in order."""
    spans = found(text)
    if not spans:
        return text, []
    names: dict[str, str] = {}
    for a, b, kind in spans:
        if kind != "name":
            continue
        title = re.search(rf"({_TITLES})\b\.?[ ]$", text[max(0, a - 20) : a])
        said = title[1].casefold() if title else ""
        gender = "m" if said in {t.casefold() for t in _MALE} else "f" if said in {t.casefold() for t in _FEMALE} else "-"
        parts = [x for x in re.split(r"[ -]", text[a:b]) if x[:1].isupper()]
        for i, part in enumerate(parts):
            attempt = 0
            while (known := part.casefold()) not in names:
                made = maker.name_part(known.capitalize(), gender, given=i < len(parts) - 1, attempt=attempt)
                if made not in names.values() and made.casefold() != known:
                    names[known] = made
                attempt += 1
    bare = re.compile(r"(?i)(?<!\w)(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)") if names else None

    def again(m: re.Match) -> str:
        made = names.get(m[1].casefold())
        # Lower-case words of the same letters are no names.
        return m[1] if made is None or not m[1][:1].isupper() else made.upper() if m[1].isupper() and len(m[1]) > 1 else made

    def plain(part: str) -> str:
        return bare.sub(again, part) if bare else part

    out, at, kinds = [], 0, []
    for a, b, kind in spans:
        out.append(plain(text[at:a]))
        out.append(plain(text[a:b]) if kind == "name" else maker.of(kind, text[a:b]))
        kinds.append(kind)
        at = b
    out.append(plain(text[at:]))
    return "".join(out), kinds


def surrogates(df: DataFrame, text: str = "text", key: bytes = KEY, n_entities: str | None = "n_entities", kinds: str | None = "entity_kinds", keep: list[str] | None = None) -> DataFrame:
    """df with the text replaced, and the number and the sorted distinct kinds (comma-joined) of its entities."""
    common.python_ready(df.sparkSession)
    new = [(n_entities, T.LongType()), (kinds, T.StringType())]
    keep = common.kept(df.columns if keep is None else keep, [n for n, _ in new if n])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new if n])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Surrogates(key)
        for frame in frames:
            pairs = [replaced(t, maker) if t else (t, []) for t in frame[text]]
            out = frame[keep].copy()
            out[text] = pd.Series([p[0] for p in pairs], index=frame.index, dtype=object)
            if n_entities:
                out[n_entities] = [len(p[1]) for p in pairs]
            if kinds:
                out[kinds] = [",".join(sorted(set(p[1]))) for p in pairs]
            yield out

    return df.mapInPandas(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
