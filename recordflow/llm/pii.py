"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's validation, addresses and access tokens are
replaced by a keyed permutation of their own format: a card number becomes another number
with a check digit as right or wrong as before, a date another date, an IP address another
IP address. The permutation is a Feistel network on the format's index range (cycle walking
keeps it in range), so it is one to one: equal values get equal pseudonyms in every
document, different values different ones, and whoever holds the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
DEMO_KEY = b"replace this key by a secret one"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX = "0123456789abcdef"
# Dates from the first day of FIRST_YEAR to the last of LAST_YEAR are permuted among each other.
FIRST_YEAR, LAST_YEAR = 1900, 2099
DAY0 = datetime.date(FIRST_YEAR, 1, 1).toordinal()
DAYS = datetime.date(LAST_YEAR, 12, 31).toordinal() - DAY0 + 1

# Lengths of account numbers in each country's IBAN (fixed values of the public registry).
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})
    |(?P<secret>(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])
        |(?<![0-9A-Za-z])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY|[Tt]oken|TOKEN)["']?[ ]?[=:][ ]?["']?(?=[0-9A-Za-z]*[0-9])[0-9A-Za-z]{8,}(?![0-9A-Za-z]))
    |(?P<token>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))
    |(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))
    |(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])
        |(?<![\w+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9]|[.-][0-9]))
    |(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}(?P<sep1>[-/.])[0-9]{1,2}(?P=sep1)[0-9]{1,2}|[0-9]{1,2}(?P<sep2>[-/.])[0-9]{1,2}(?P=sep2)[0-9]{4})(?![\w/-]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<number>(?<![\w.])[0-9]{4}(?:[ -][0-9]{4}){3}(?![\w])|(?<![\w.])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?!\w)|(?<![0-9A-Za-z_])[0-9]{13,19}(?![0-9A-Za-z_]))
    """, re.X | re.A)
KINDS = ["email", "secret", "token", "iban", "phone", "ip", "date", "ssn", "number"]
PLAIN = re.compile(rb"[0-9@]")
# Most bits of one digest.
SHORT = 512


class Permuter:
    """Keyed permutations of index ranges."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple, int] = {}

    def _round(self, value: int, number: int, kind: str, size: int, bits: int) -> int:
        data, n = f"{kind}|{size:x}|{number}|{value:x}" if bits > SHORT else f"{kind}|{size}|{number}|{value}", (bits + 7) // 8
        # Halves of long values take more bits than one digest has: an output of any length, keyed by its input's beginning.
        digest = hashlib.shake_256(self.key + data.encode()).digest(n) if bits > SHORT else hashlib.blake2b(data.encode(), key=self.key, digest_size=n).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _walk(self, x: int, size: int, kind: str, order: range) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        forward = order.step > 0
        while True:
            left, right = x >> half, x & mask
            for r in order:
                if forward:
                    left, right = right, left ^ self._round(right, r, kind, size, half)
                else:
                    left, right = right ^ self._round(left, r, kind, size, half), left
            x = left << half | right
            if x < size:
                return x

    def permute(self, x: int, size: int, kind: str) -> int:
        """Image of x in [0, size)."""
        at = (x, size, kind)
        if (y := self.known.get(at)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            y = self.known[at] = self._walk(x, size, kind, range(ROUNDS))
        return y

    def inverse(self, y: int, size: int, kind: str) -> int:
        return self._walk(y, size, kind, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> int:
    """Check digit that ``digits`` need behind them."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def _in_places(pattern: str, new: str, holds) -> str:
    """``pattern`` with the characters that ``holds`` accepts replaced in order by those of ``new``."""
    take = iter(new)
    return "".join(next(take) if holds(c) else c for c in pattern)


def _iban_valid(text: str) -> bool:
    bare = text.replace(" ", "")
    return len(bare) == IBAN_LENGTH.get(bare[:2]) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _iban_at(text: str) -> str | None:
    """The account number of its country's length at the start of a longer match."""
    places = [i for i, c in enumerate(text) if c != " "]
    size = IBAN_LENGTH.get(text[:2], len(places))
    if size >= len(places) or places[size] == places[size - 1] + 1:  # shorter, or cut inside a word
        return None
    return text[: places[size - 1] + 1]


def _fits(day: datetime.date, month_digits: int, day_digits: int, day_first: bool) -> bool:
    """Whether a date can be written with so many digits. With slashes a day first needs to be above 12 to be read so."""
    return (month_digits == 2 or day.month < 10) and (day_digits == 2 or day.day < 10) and (not day_first or day.day > 12)


class Pseudonyms:
    """Rewrites one text after the other with one key. ``back`` undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        p = Permuter(key)
        self.step = p.inverse if back else p.permute
        self.back = back

    def _symbols(self, text: str, alphabet: str, kind: str) -> str:
        size, x = len(alphabet), 0
        for c in text:
            x = x * size + alphabet.index(c)
        x = self.step(x, size ** len(text), kind)
        out = []
        for _ in text:
            x, r = divmod(x, size)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def email(self, s: str) -> str | None:
        """Letters move among letters and digits among digits, case by place; the top domain stays."""
        body, dot, top = s.rpartition(".")
        small = body.lower()
        letters, digits = "".join(c for c in small if c in LETTERS), "".join(c for c in small if c in DIGITS)
        shape = re.sub("[0-9]", "0", re.sub("[a-z]", "a", small)) + dot + top.lower()
        # The shape is part of the permutation's name, so that different addresses stay different.
        new = _in_places(small, self._symbols(letters, LETTERS, f"email letters {shape}") if letters else "", LETTERS.__contains__)
        new = _in_places(new, self._symbols(digits, DIGITS, f"email digits {shape}") if digits else "", DIGITS.__contains__)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(body, new)) + dot + top

    def token(self, s: str) -> str | None:
        """Hexadecimal secrets; runs of digits alone are numbers, not tokens."""
        if s.isdigit():
            return None
        small = s.lower()
        new = self._symbols(small, HEX, "token")
        return new.upper() if s != small else new

    def secret(self, s: str) -> str | None:
        """Named secrets and access key ids: the name or prefix stays; hexadecimal values stay so, others move class by class."""
        value = re.search(r"[0-9A-Za-z]+\Z", s).group()
        head = s[: len(s) - len(value)] if len(value) < len(s) else ""
        if not head:
            head, value = s[:4], s[4:]
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
            small = value.lower()
            new = self._symbols(small, HEX, "token")
            return head + (new.upper() if small != value else new)
        shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", value)))
        out = value
        for alphabet in (DIGITS, LETTERS, LETTERS.upper()):
            if own := "".join(c for c in out if c in alphabet):
                out = _in_places(out, self._symbols(own, alphabet, f"secret {shape}"), alphabet.__contains__)
        return head + out

    def iban(self, s: str) -> str | None:
        if not _iban_valid(s):
            return None
        bare = s.replace(" ", "")
        account = bare[4:]
        new = _in_places(account, self._symbols(d, DIGITS, f"iban digits {bare[:2]}") if (d := re.sub(r"[^0-9]", "", account)) else "", str.isdigit)
        new = _in_places(new, self._symbols(a.lower(), LETTERS, f"iban letters {bare[:2]}").upper() if (a := re.sub(r"[^A-Z]", "", account)) else "", str.isupper)
        check = 98 - int("".join(str(int(c, 36)) for c in new + bare[:2] + "00")) % 97
        return _in_places(s, f"{bare[:2]}{check:02d}{new}", str.isalnum)

    def phone(self, s: str) -> str | None:
        """The country code stays."""
        digits = re.sub(r"[^0-9]", "", s)
        if not 8 <= len(digits) <= 15:
            return None
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|", s).group()
        kept = len(code) - 1 if code else 0
        return code + _in_places(s[len(code):], self._symbols(digits[kept:], DIGITS, f"phone {digits[:kept]}"), str.isdigit)

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts) or parts[0] in ("0", "127") or s == "255.255.255.255":
            return None
        # Index among the addresses that do not start with 0 or 127.
        first, rest = int(parts[0]), int(parts[1]) << 16 | int(parts[2]) << 8 | int(parts[3])
        x = (first - 1 - (first > 127)) << 24 | rest
        size = (254 << 24) - 1
        x = self.step(x, size, "ip")
        first = (x >> 24) + 1
        first += first > 126
        return f"{first}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"

    def date(self, s: str) -> str | None:
        """Order and separators stay; 13 to 31 in first or second place tells day from month."""
        sep = re.search(r"[^0-9]", s).group()
        a, b, c = s.split(sep)
        year_first = len(a) == 4
        y, m, d = (a, b, c) if year_first else (c, b, a)
        month_first = not year_first and sep == "/" and int(a) <= 12
        if month_first:
            m, d = a, b
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal() - DAY0
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        # Among the dates that this way of writing can hold and that read back in the same order.
        kind = f"date {sep}{int(year_first)}{int(month_first)}"
        day = self.step(day, DAYS, kind)
        while not _fits(new := datetime.date.fromordinal(DAY0 + day), len(m), len(d), day_first=not year_first and sep == "/" and not month_first):
            day = self.step(day, DAYS, kind)
        mm, dd = f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"
        return sep.join((f"{new.year}", mm, dd) if year_first else (mm, dd, f"{new.year}") if month_first else (dd, mm, f"{new.year}"))

    def ssn(self, s: str) -> str | None:
        a, g, n = map(int, s.split("-"))
        if a in (0, 666) or a > 899 or not g or not n:
            return None
        x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
        x = self.step(x, 898 * 99 * 9999, "ssn")
        x, n = divmod(x, 9999)
        a, g = divmod(x, 99)
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"

    def number(self, s: str) -> str | None:
        """Card and account numbers: the last digit is as far from the right check digit as before."""
        digits = re.sub(r"[^0-9]", "", s)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        new = self._symbols(digits[:-1], DIGITS, f"number {off}")
        return _in_places(s, new + str((luhn(new) + off) % 10), str.isdigit)

    def _value(self, m: re.Match) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the value at the start of a match; none if the match fails validation."""
        kind, text = next(k for k in KINDS if m.group(k) is not None), m.group()
        new = getattr(self, kind)(text)
        if new is None and re.fullmatch(r"[0-9]{13,19}", text):
            kind, new = "number", self.number(text)  # what fails one format may hold an account number
        if new is None and kind == "iban":
            text = _iban_at(text)  # the pattern runs on into the next group
            new = text and self.iban(text)
        return (kind, m.start() + len(text), new) if new else None

    def _values(self, text: str, pos: int) -> tuple[list[tuple[str, int, int, str]], int | None]:
        """(kind, start, end, pseudonym) of the values from ``pos`` on, and the start of the first
        failed match that holds the start of a value. Behind a failed match's first character all is searched again."""
        out, failed, inside = [], [], None
        while m := PATTERN.search(text, pos):
            if got := self._value(m):
                failed = [f for f in failed if f[1] > m.start()]
                if failed and inside is None:
                    inside = failed[0][0]
                out.append((got[0], m.start(), got[1], got[2]))
                pos = got[1]
            else:
                failed.append(m.span())
                pos = m.start() + 1
        return out, inside

    def _shape(self, text: str, pos: int) -> tuple:
        """What stays of a line whose values are replaced: kinds and the text around them."""
        found, inside = self._values(text, pos)
        return inside, [v[0] for v in found], [text[a:b] for a, b in zip([0, *(v[2] for v in found)], [*(v[1] for v in found), len(text)])]

    def _line(self, text: str, pos: int) -> tuple[str, int]:
        """Rewrites a piece of a line with values inside failed matches. A pseudonym there may
        make the failed match valid or move its end; it is then permuted on until the piece
        reads as before, which keeps the whole one to one. The way back goes from right to left."""
        shape, found = self._shape(text, pos), 0
        count = len(shape[1])
        for i in range(count)[::-1 if self.back else 1]:
            kind, start, end, new = self._values(text, pos)[0][i]
            old = text[start:end]
            while self._shape(trial := text[:start] + new + text[end:], pos) != shape:
                if (new := getattr(self, kind)(new)) in (None, old):
                    new = old
                    break
            found += new != old
            text = trial
        return text, found

    def rewrite(self, text: bytes) -> tuple[bytes, int]:
        """The text with pseudonyms, and how many values were replaced."""
        if not PLAIN.search(text):
            return text, 0
        whole = text.decode("utf-8", "replace")
        out, found, done, pos, failed = [], 0, 0, 0, []
        while m := PATTERN.search(whole, pos):
            got = self._value(m)
            if not got:
                failed.append(m.span())
                pos = m.start() + 1
                continue
            start, (_, end, new) = m.start(), got
            failed = [f for f in failed if f[1] > start]
            if failed:
                # From the failed match to the end of the line; no pattern reaches over lines.
                start = max(failed[0][0] - 1, done)
                end = whole.find("\n", m.end())
                end = len(whole) if end < 0 else end
                new, n = self._line(whole[start:end], failed[0][0] - start)
                failed = []
            else:
                n = new != whole[start:end]
            out += whole[done:start], new
            found += n
            done = pos = end
        out.append(whole[done:])
        return ("".join(out).encode(), found) if found else (text, 0)


def pseudonymise(text: Column, key: bytes = DEMO_KEY, back: bool = False) -> Column:
    """Struct (text, n_values) for a text column; a null text stays null with 0 values."""

    @F.arrow_udf("struct<text: string, n_values: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        work = Pseudonyms(key, back)
        rows = [(None, 0) if t is None else work.rewrite(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["text", "n_values"])

    return run.asNondeterministic()(text.cast("binary"))


def pseudonymised(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_values) of every document, one row per row.

    Empty texts stay empty and null ones null. Repeated rows give repeated rows, long texts
    are searched whole, an empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), pseudonymise(F.col(text_col), key).alias("p"))
    return rows.select(F.col("id").alias(id_col), F.col("p.text").alias("text"), F.col("p.n_values").alias("n_values"))


def with_pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows with all their columns, the text rewritten and its length, if there is such a column, made anew."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), pseudonymise(F.col(text_col), key).alias("p"))
    new = {text_col: F.col("p.text")}
    if chars_col in names:
        new[chars_col] = F.char_length("p.text").cast(docs.schema[chars_col].dataType)
    return row.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
