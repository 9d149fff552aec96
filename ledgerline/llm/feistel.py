"""Format-preserving Feistel pseudonyms for personal data.

Values are found by shape and accepted only if they validate (Luhn digit of a
card number, calendar date, octets of an address, mod-97 of an IBAN, ...). An
accepted value is numbered within the finite set of all values of its format,
that number goes through a keyed permutation of the set, and the result is
written back in the same format. A permutation maps equal values to equal
pseudonyms in every document and different values to different ones, and a
pseudonym validates like the value it stands for.

The permutation is a conjugated shift, ``F^-1(F(x) + s)`` for a keyed Feistel
network ``F`` and a keyed non-zero ``s``, so no value is ever its own pseudonym.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.llm.common import add_columns, unclash
from ledgerline.llm.textvec import per_text, utf8

#: Session setting that holds the secret key of the registered query and the pipeline.
KEY_SETTING = "ledgerline.pseudonyms.key"
#: Stands in for it in demonstrations only: whoever knows a key can undo its pseudonyms.
DEMONSTRATION_KEY = b"ledgerline demonstration key"
ROUNDS = 8


def session_key(spark: SparkSession) -> bytes:
    """The key set in the session, else the demonstration key with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms use the published demonstration key", stacklevel=2)
    return DEMONSTRATION_KEY


class Permutation:
    """A keyed, fixed-point-free permutation of range(size)."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.a = math.isqrt(size - 1) + 1  # a * b >= size, cycle-walked back into range
        self.b = -(-size // self.a)
        self._key = hashlib.blake2b(key, person=b"feistel", digest_size=32).digest()
        self._tweak = f"{kind}/{size}/".encode()
        self.shift = 1 + self._random(b"shift", 0) % (size - 1) if size > 1 else 0

    def _random(self, label: bytes, value: int) -> int:
        text = self._tweak + label + b"/" + str(value).encode()
        return int.from_bytes(hashlib.blake2b(text, key=self._key, digest_size=64).digest(), "big")

    def _forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for r in range(ROUNDS):
                if r % 2 == 0:
                    left = (left + self._random(b"%d" % r, right)) % self.a
                else:
                    right = (right + self._random(b"%d" % r, left)) % self.b
            x = left * self.b + right
            if x < self.size:
                return x

    def _backward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for r in reversed(range(ROUNDS)):
                if r % 2 == 0:
                    left = (left - self._random(b"%d" % r, right)) % self.a
                else:
                    right = (right - self._random(b"%d" % r, left)) % self.b
            x = left * self.b + right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return self._backward((self._forward(x) + self.shift) % self.size) if self.size > 1 else x

    def inverse(self, y: int) -> int:
        return self._backward((self._forward(y) - self.shift) % self.size) if self.size > 1 else y


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return -total % 10


#: Spans of years whose days are permuted among themselves; two-digit years are read as 2000 to 2099.
SPANS = [("date", 1900, 2099), ("early date", 1, 1899), ("late date", 2100, 9999)]
SHORT_SPAN = ("short date", 2000, 2099)

#: Month names by language and length; a name is replaced by one of the first list that has it.
MONTHS = [
    names.split()
    for names in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "jan feb mär apr mai jun jul aug sep okt nov dez",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "janv févr mars avr mai juin juil août sept oct nov déc",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "ene feb mar abr may jun jul ago sept oct nov dic",
    )
]
_MONTH = "|".join(sorted({n for names in MONTHS for n in names}, key=lambda n: (-len(n), n)))

#: Character classes permuted within themselves; everything else stays in place.
CLASSES = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
]
_CLASS = {c: k for k in CLASSES for c in k}

#: How the keys of some services begin, in this case.
KEY_HEADS = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "sk_live_")

# Every alternative is one kind of value; neighbours that are ASCII letters or
# digits make it part of something longer.
FINDER = re.compile(
    rf"""
    (?P<email>(?<![\w.+%-])[\w.+%-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,}})
  | (?P<secret>\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s{{0,3}}[=:]\s{{0,3}}["']?
      (?P<secret_value>[a-z0-9_/+-]{{12,}}))
  | (?P<bare_key>(?<![0-9a-z])(?:(?:AKIA|ASIA)[0-9a-z]{{16}}|gh[opsur]_[0-9a-z]{{36}}|sk_live_[0-9a-z]{{24}})(?![0-9a-z]))
  | (?P<iban>(?<![0-9a-z])[a-z]{{2}}[0-9]{{2}}(?:[ ]?[a-z0-9]{{4}}){{2,7}}(?:[ ]?[a-z0-9]{{1,3}})?(?![0-9a-z]))
  | (?P<ip>(?<![0-9a-z.])(?<!version\ )(?<!release\ )(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9a-z]|\.[0-9]))
  | (?P<date>(?<![0-9a-z.-])(?:[0-9]{{4}}(?P<s1>[-/.])[0-9]{{1,2}}(?P=s1)[0-9]{{1,2}}
      |[0-9]{{1,2}}(?P<s2>[-/.])[0-9]{{1,2}}(?P=s2)(?:[0-9]{{4}}|[0-9]{{2}})
      |[0-9]{{8}}(?=t[0-9]{{4}}))
      (?!(?!t[0-9])[0-9a-z]|[-/.][0-9]))
  | (?P<named_date>(?:
      (?<![0-9a-z.-])[0-9]{{1,2}}(?:st|nd|rd|th|er|[.º])?(?:\s{{0,3}}(?:\b(?:of|de)\s{{1,3}})?|[-/.])(?:{_MONTH})\b\.?
        (?:,?\s{{1,3}}(?:del?\s{{1,3}})?|[-/.,])(?:[0-9]{{4}}|['’]?[0-9]{{2}}(?!:))
      |(?<!\w)(?:{_MONTH})\b\.?(?:\s{{1,3}}|[-/.])[0-9]{{1,2}}(?:st|nd|rd|th)?(?:,?\s{{1,3}}|[-/.,])(?:[0-9]{{4}}|['’]?[0-9]{{2}}(?!:))
      |(?<![0-9a-z.-])[0-9]{{4}}(?:,?\s{{1,3}}|[-/.])(?:{_MONTH})\b\.?(?:\s{{1,3}}|[-/.])[0-9]{{1,2}}(?:st|nd|rd|th)?)
      (?!(?!t[0-9])[0-9a-z]|[-/.][0-9]))
  | (?P<ssn>(?<![0-9a-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9a-z]|-[0-9]))
  | (?P<card>(?<![0-9a-z])(?:[0-9][ -]?){{12,18}}[0-9](?![0-9a-z]))
  | (?P<phone>(?<![0-9a-z])(?:(?:\+?1[ .-]?)?(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[.-])[0-9]{{3}}[ .-][0-9]{{4}}
      |\+[0-9]{{1,3}}(?P<s3>[ .-]?)\(?[0-9]{{1,4}}\)?(?:(?P=s3)[0-9]{{2,4}}){{0,3}}(?P=s3)[0-9]{{2,8}}
      |0[0-9]{{2,4}}[ /-][0-9]{{5,8}})(?![0-9a-z]|[.-][0-9]))
    """,
    re.VERBOSE | re.IGNORECASE,
)


#: What may begin where no valid date does, or one with a two-digit year.
NUMBER = re.compile(FINDER.pattern[FINDER.pattern.index("(?P<card>") :], FINDER.flags)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


class Pseudonyms:
    """Replaces validated values in a text; one instance per key."""

    def __init__(self, key: bytes):
        self.key = key
        self._permutations: dict[tuple[str, int], Permutation] = {}

    def _permute(self, kind: str, size: int, x: int) -> int:
        p = self._permutations.get((kind, size))
        if p is None:
            if len(self._permutations) > 4096:
                self._permutations.clear()
            p = self._permutations[(kind, size)] = Permutation(self.key, kind, size)
        return p(x)

    def characters(self, kind: str, value: str) -> str | None:
        """Letters and digits permuted within their classes, letter case kept."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in value]
        groups = [_CLASS.get(c) for c in low]
        size, x = 1, 0
        for c, g in zip(low, groups):
            if g:
                x = x * len(g) + g.index(c)
                size *= len(g)
        if size == 1:
            return None
        y = self._permute(kind, size, x)
        out = []
        for c, original, g in zip(reversed(low), reversed(value), reversed(groups)):
            if g:
                y, i = divmod(y, len(g))
                n = g[i]
                out.append(n.upper() if original != c and len(n.upper()) == 1 else n)
            else:
                out.append(original)
        return "".join(reversed(out))

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        made = self.characters("email@" + domain.lower(), local)
        return None if made is None else f"{made}@{domain}"

    def secret(self, value: str) -> str | None:
        if not any(c.isdigit() for c in value):
            return None
        if re.fullmatch(r"[0-9a-fA-F]+", value):
            made = f"{self._permute('hex', 16 ** len(value), int(value, 16)):0{len(value)}x}"
            return made.upper() if value.upper() == value else made
        return self.characters("secret", value)

    def bare_key(self, value: str) -> str | None:
        """A service's key that stands alone: its known beginning stays."""
        head = next((h for h in KEY_HEADS if value.startswith(h)), None)
        made = None if head is None else self.characters("key" + head, value[len(head) :])
        return None if made is None else head + made

    def card(self, value: str) -> str | None:
        """The longest run of digit groups in ``value`` that is a card number."""
        groups = list(re.finditer(r"[0-9]+", value))
        tried = [(i, j) for i in range(len(groups)) for j in range(i, len(groups))]
        tried.sort(key=lambda t: groups[t[0]].start() - groups[t[1]].end())
        for i, j in tried:
            start, end = groups[i].start(), groups[j].end()
            digits = _only_digits(value[start:end])
            body = digits[:-1]
            if not 13 <= len(digits) <= 19 or luhn(body) != int(digits[-1]) or not body.strip("0"):
                continue
            made = f"{self._permute('card', 10 ** len(body), int(body)):0{len(body)}d}"
            return value[:start] + _refill(value[start:end], made + str(luhn(made))) + value[end:]
        return None

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "").upper()
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.characters("iban" + plain[:2], plain[4:])
        if body is None:
            return None
        check = 98 - number(body + plain[:2] + "00") % 97
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)

    def ip(self, value: str) -> str | None:
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = 0
        for o in octets:
            x = x * 256 + int(o)
        y = self._permute("ip", 1 << 32, x)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def _day(self, year: str, month: int, day: int) -> dt.date | None:
        """The day that stands for a calendar day, or None if there is no such day."""
        if len(year) not in (2, 4):
            return None
        number = int(year) + (2000 if len(year) == 2 else 0)
        try:
            old = dt.date(number, month, day)
        except ValueError:
            return None
        spans = [SHORT_SPAN] if len(year) == 2 else SPANS
        kind, first, last = next(s for s in spans if s[1] <= number <= s[2])
        start, end = dt.date(first, 1, 1).toordinal(), dt.date(last, 12, 31).toordinal()
        return dt.date.fromordinal(self._permute(kind, end - start + 1, old.toordinal() - start) + start)

    def date(self, value: str) -> str | None:
        sep = next((c for c in value if not c.isdigit()), "")
        a, b, c = value.split(sep) if sep else (value[:4], value[4:6], value[6:])
        for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy") if len(c) == 4 else ("dmy", "mdy", "ymd"):
            parts = dict(zip(order, (a, b, c)))
            new = self._day(parts["y"], int(parts["m"]), int(parts["d"]))
            if new is None:
                continue
            width = 2 if len(parts["d"]) == 2 or len(parts["m"]) == 2 else 1
            year = f"{new.year:04d}"[-len(parts["y"]) :]
            text = {"y": year, "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
            return sep.join(text[k] for k in order)
        return None

    def named_date(self, value: str) -> str | None:
        """A date whose month is a name: day, month and year change, language, order and signs stay."""
        parts = re.split(r"([0-9]+|[^\W\d_]+)", value)
        numbers = [i for i, p in enumerate(parts) if p[:1].isdigit()]
        at_day, at_year = reversed(numbers) if len(parts[numbers[0]]) == 4 else numbers
        at_month, names = next((i, n) for i, p in enumerate(parts) for n in MONTHS if p.lower() in n)
        day, year, name = parts[at_day], parts[at_year], parts[at_month]
        new = self._day(year, 1 + names.index(name.lower()), int(day))
        if new is None:
            return None
        made = names[new.month - 1]
        parts[at_month] = made.upper() if name.isupper() else made.capitalize() if name[0].isupper() else made
        parts[at_day] = f"{new.day:0{len(day)}d}"
        parts[at_year] = f"{new.year:04d}"[-len(year) :]
        ending = parts[at_day + 2] if at_day + 2 < len(parts) and not parts[at_day + 1] else ""
        if ending.lower() in ("st", "nd", "rd", "th"):
            right = "th" if 11 <= new.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
            parts[at_day + 2] = right.upper() if ending.isupper() else right
        elif ending.lower() == "er" and new.day != 1:
            parts[at_day + 2] = ""
        return "".join(parts)

    def ssn(self, value: str) -> str | None:
        area, group, serial = (int(p) for p in value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        y = self._permute("ssn", 898 * 99 * 9999, x)
        y, serial = divmod(y, 9999)
        area, group = divmod(y, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, value: str) -> str | None:
        digits = _only_digits(value)
        if not 8 <= len(digits) <= 15:
            return None
        head = re.match(r"\+[0-9]{1,3}", value)  # the country code stays
        code = head.group(0) if head else ""
        body = _only_digits(value[len(code) :])
        made = f"{self._permute('phone', 10 ** len(body), int(body)):0{len(body)}d}"
        return code + _refill(value[len(code) :], made)

    def replace(self, text: str) -> tuple[str, Counter]:
        """The text with every validated value replaced, and how many of each kind."""
        found: Counter = Counter()
        out, done, at = [], 0, 0
        while (m := FINDER.search(text, at)) is not None:
            kind, whole = m.lastgroup, m.group(0)
            if kind == "secret":
                value = m.group("secret_value")
                made = self.secret(value)
                made = None if made is None else whole[: -len(value)] + made
            else:
                made = getattr(self, kind)(whole)
                if kind == "date" and (made is None or not re.search("[0-9]{4}", whole)):
                    number = NUMBER.match(text, m.start())
                    other = getattr(self, number.lastgroup)(number.group(0)) if number else None
                    if other is not None and (made is None or not other.startswith(whole)):
                        m, kind, made = number, number.lastgroup, other
            if made is None:  # go on behind its first run: the rest may hold a value
                at = m.start() + len(re.match(r"\W*\w+", whole).group(0))
                continue
            found[{"named_date": "date", "bare_key": "secret"}.get(kind, kind)] += 1
            out += [text[done : m.start()], made]
            done = at = m.end()
        return "".join(out) + text[done:], found


_MAY_HOLD = np.isin(np.arange(256), list(b"0123456789@"))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with personal values of ``text`` replaced, and their number in ``n_pseudonyms``.

    Runs inside the partitions, without a shuffle: equal values get equal
    pseudonyms because the permutation depends on the key alone.

    Defined cases: a null text stays null and an empty one empty, both with
    count 0; a value that does not validate stays as it is; repeated rows give
    equal rows; an empty table gives an empty result; an input column named
    ``n_pseudonyms`` is replaced, others pass through.
    """
    docs = unclash(docs, ("doc_id", "text"), ("n_pseudonyms", "ll_text"))

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        made, counts = texts.to_pylist(), np.zeros(len(texts), np.int64)
        swap = Pseudonyms(key)
        data, offsets = utf8(texts)
        for i in np.flatnonzero(per_text(_MAY_HOLD[data], offsets)):
            made[i], found = swap.replace(made[i])
            counts[i] = sum(found.values())
        return {"ll_text": pa.array(made, pa.string()), "n_pseudonyms": pa.array(counts)}

    schema = T.StructType([T.StructField("ll_text", T.StringType()), T.StructField("n_pseudonyms", T.LongType(), False)])
    names = docs.columns
    out = add_columns(docs, "text", schema, run)
    columns = [out["ll_text"].alias("text") if n == "text" else out[n] for n in names]
    return out.select(*columns, "n_pseudonyms")
