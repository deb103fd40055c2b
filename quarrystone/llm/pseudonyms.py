"""Format-preserving pseudonyms of personal data.

Values are found by pattern and validated (Luhn, IBAN check digits, calendar
dates, number plans). Each is written as a number in the domain of all valid
values of its format and permuted there by a keyed Feistel network, walking the
cycle until the result is valid again. Equal values get equal pseudonyms in all
documents, without any table of them; who has the key can turn them back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.words import text_array
from quarrystone.sources.tables import table

ROUNDS = 8


class Feistel:
    """Keyed permutations of 0 .. size - 1, one for each name."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse

    def _half(self, name: bytes, turn: int, value: int, bits: int) -> int:
        data = b"%d|%s|%d|%x" % (bits, name, turn, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, (bits + 15) // 8)).digest(), "big") & ((1 << bits) - 1)

    def once(self, name: bytes, value: int, size: int) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        left, right = value >> bits, value & ((1 << bits) - 1)
        if self.inverse:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ self._half(name, turn, left, bits), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ self._half(name, turn, right, bits)
        return left << bits | right

    def permute(self, name: str, value: int, size: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """``value`` must be valid itself: then the walk comes to a valid number at last."""
        while True:
            value = self.once(name.encode(), value, size)
            if value < size and valid(value):
                return value

    def text(self, name: str, value: str, hexadecimal: bool = False) -> str:
        """Digits to digits and letters to letters of the same case; the rest stays. Unlike only in case: alike."""
        plain = value.lower()
        alphabets = ["0123456789abcdef" if hexadecimal else "0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "" for c in plain]
        out = list(value)
        places = [i for i, a in enumerate(alphabets) if a]
        for k in range(0, len(places), 48):  # longer ones in blocks
            block = places[k : k + 48]
            number, size = 0, 1
            for i in block:
                number = number * len(alphabets[i]) + alphabets[i].index(plain[i])
                size *= len(alphabets[i])
            kinds = "".join("x" if hexadecimal else "9" if plain[i].isdigit() else "a" for i in block)
            number = self.permute(f"{name}|{k}|{kinds}", number, size)
            for i in reversed(block):
                number, digit = divmod(number, len(alphabets[i]))
                out[i] = alphabets[i][digit].upper() if value[i].isupper() else alphabets[i][digit]
        return "".join(out)


def filled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order."""
    new = iter(digits)
    return re.sub("[0-9]", lambda _: next(new), shape)


def only_digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def luhn(digits: str) -> int:
    """The check digit of ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


# First digits of card networks, from and to, and the lengths of their numbers.
NETWORKS = (
    ("2221", "2720", (16,)),
    ("300", "305", (14,)),
    ("34", "34", (15,)),
    ("3528", "3589", (16, 17, 18, 19)),
    ("36", "36", (14,)),
    ("37", "37", (15,)),
    ("38", "39", (14,)),
    ("4", "4", (13, 16, 19)),
    ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)),
    ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)),
    ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)),
    ("51", "55", (16,)),
    ("5893", "5893", (13, 14, 15, 16, 17, 18, 19)),
    ("6011", "6011", (16, 17, 18, 19)),
    ("62", "62", (16, 17, 18, 19)),
    ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)),
    ("644", "659", (16, 17, 18, 19)),
    ("6759", "6763", (13, 14, 15, 16, 17, 18, 19)),
)


def card(m: re.Match, f: Feistel) -> str | None:
    """Numbers of a card network, in its length, with a right check digit; they stay in the network."""
    d = only_digits(m[0])
    if luhn(d[:-1]) != int(d[-1]):
        return None
    for low, high, lengths in NETWORKS:
        if len(d) in lengths and low <= d[: len(low)] <= high:
            scale = 10 ** (len(d) - 1 - len(low))
            first = int(low) * scale
            body = str(first + f.permute(f"card{low}|{len(d)}", int(d[:-1]) - first, (int(high) - int(low) + 1) * scale))
            return filled(m[0], body + str(luhn(body)))
    return None


def american(m: re.Match, f: Feistel) -> str | None:
    """Ten digits in the North American form; whatever the area, as people also write numbers no plan has."""
    d = only_digits(m[0])
    return filled(m[0], d[:-10] + str(f.permute("phone", int(d[-10:]), 10**10)).zfill(10))


def foreign(m: re.Match, f: Feistel) -> str | None:
    d = only_digits(m[0])
    if not 8 <= len(d) <= 15:
        return None
    return filled(m[0], d[:2] + str(f.permute(f"phone{d[:2]}", int(d[2:]), 10 ** (len(d) - 2))).zfill(len(d) - 2))


def security(m: re.Match, f: Feistel) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(only_digits(m[0]))
    return filled(m[0], str(f.permute("security", x, 10**9, valid)).zfill(9)) if valid(x) else None


def address(m: re.Match, f: Feistel) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts) or parts[0] == "0":
        return None
    x = f.permute("address", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, lambda x: x >> 24 > 0)
    return ".".join(map(str, x.to_bytes(4, "big")))


FIRST, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def day(year: str, month: str, number: str) -> int | None:
    try:
        n = date(int(year), int(month), int(number)).toordinal() - FIRST
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


def iso_date(m: re.Match, f: Feistel) -> str | None:
    n = day(m[1], m[2], m[3])
    return None if n is None else date.fromordinal(FIRST + f.permute("date", n, DAYS)).isoformat()


def other_date(m: re.Match, f: Feistel) -> str | None:
    """Month first where that can be, else day first; with or without leading zeros."""
    a, mark, b, year = m.groups()
    month_first = mark == "/" and day(year, a, b) is not None
    n = day(year, a, b) if month_first else day(year, b, a)
    padded = len(a) == len(b) == 2
    if n is None or not padded and "0" in (a[0], b[0]):
        return None

    def shown(n: int) -> str:
        d = date.fromordinal(FIRST + n)
        pair = (d.month, d.day) if month_first else (d.day, d.month)
        return mark.join([*(str(x).zfill(2) if padded else str(x) for x in pair), str(d.year)])

    def valid(n: int) -> bool:
        d = date.fromordinal(FIRST + n)
        return (month_first or mark == "." or d.day > 12) and (padded or d.day < 10 or d.month < 10)

    return shown(f.permute(f"date{mark}{month_first}{padded}", n, DAYS, valid))


def account(m: re.Match, f: Feistel) -> str | None:
    """IBAN."""
    plain = m[0].replace(" ", "")

    def check(body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body)) % 97

    if not 15 <= len(plain) <= 34 or check(plain[4:] + plain[:4]) != 1:
        return None
    body = f.text(f"account{plain[:2]}", plain[4:])
    new = iter(f"{plain[:2]}{98 - check(body + plain[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in m[0])


def mail(m: re.Match, f: Feistel) -> str | None:
    name, _, host = m[0].rpartition("@")
    front, _, top = host.rpartition(".")
    return f"{f.text('mail', f'{name}@{front}')}.{top}"


def key(m: re.Match, f: Feistel) -> str | None:
    hexadecimal = bool(HEXADECIMAL.fullmatch(m[2]))
    new = f.text("key", m[2], hexadecimal)
    while bool(HEXADECIMAL.fullmatch(new)) != hexadecimal:
        new = f.text("key", new, hexadecimal)
    return m[1] + new


HEXADECIMAL = re.compile("(?i)[0-9a-f]+")

#: The lengths of countries' IBANs.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def account_pattern() -> re.Pattern:
    """IBANs of their country's length, whatever stands behind; else as many characters as there are.

    Which it is follows from the country and the places of spaces alone, which pseudonyms keep.
    """
    forms = []
    for n, countries in ACCOUNTS.items():
        fours, rest = divmod(n - 4, 4)
        forms.append(rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "") + r"(?!\w)")
    return re.compile(rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join(forms)}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w))", re.ASCII)


#: Kind, a character class that any value has, pattern, and the function that validates and permutes. Earlier kinds win.
KINDS: list[tuple[str, str, re.Pattern, Callable[[re.Match, Feistel], str | None]]] = [
    ("mail", "@", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), mail),
    ("access_key", "AKIA", re.compile(r"(?<!\w)((?:AKIA|ASIA))([0-9A-Z]{16})(?!\w)"), key),
    ("password", "=", re.compile(r"(?i)(?<!\w)((?:password|passwd|pwd|token|secret|api_?key) ?= ?\"?)([0-9a-z]{6,})(?!\w)"), key),
    ("iban", "0", account_pattern(), account),
    ("date", "0", re.compile(r"(?<![\w/.-])(\d{4})-(\d{2})-(\d{2})(?!\w|-\d)", re.ASCII), iso_date),
    ("date", "0", re.compile(r"(?<![\w/.-])(\d{1,2})([/.])(\d{1,2})\2(\d{4})(?!\w|[/.]\d)", re.ASCII), other_date),
    ("address", "0", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", re.ASCII), address),
    ("security", "0", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)", re.ASCII), security),
    ("phone", "0", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", re.ASCII), american),
    ("phone", "+", re.compile(r"(?<![\w+])\+(?!1[ .(-])[1-9]\d(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)", re.ASCII), foreign),
    ("card", "0", re.compile(r"(?<![\w+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)", re.ASCII), card),
]
DIGIT = re.compile("[0-9]")


def rewritten(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end (code points of ``text``) of what they replace."""
    found: list[tuple[int, int, str, str]] = []
    digits = bool(DIGIT.search(text))
    for kind, mark, pattern, change in KINDS:
        if digits if mark == "0" else mark in text or (kind == "access_key" and "ASIA" in text):
            for m in pattern.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b, _, _ in found) and (new := change(m, f)) is not None:
                    found.append((m.start(), m.end(), kind, new))
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in sorted(found):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in sorted(found)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pseudonymise(docs: DataFrame, secret: bytes, inverse: bool = False, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, their texts with pseudonyms, and ``private``: what was replaced.

    private: kind, start and end (in code points of the text as it was), by
    place. ``inverse`` turns pseudonyms made with the same secret back. Null
    texts stay null, with nothing replaced; texts without personal data pass
    unchanged. An own column ``private`` gives way. An empty table gives no
    rows. Each text is rewritten alone, whatever its id, length or copies.
    """
    docs = docs.drop("private")
    at_text = docs.columns.index(text_col)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret, inverse)
        for batch in batches:
            texts, spans = [], []
            valid = batch.column(at_text).is_valid().to_pylist()
            for text, own in zip(text_array(batch.column(at_text)).to_pylist(), valid, strict=True):
                new, found = rewritten(text, f)
                texts.append(new if own else None)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPANS)], names=[*batch.schema.names, "private"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(change, f"{kinds}, private array<struct<kind:string,start:long,end:long>>")


#: For the query and tests only; a real run brings its own.
DEMONSTRATION_SECRET = b"demonstration"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_SECRET)
    return done.select("doc_id", "text", F.size("private").cast("long").alias("n_private"), "private")
