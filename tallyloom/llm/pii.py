"""Personal data and secrets replaced by surrogates of the same type and form.

Types: names of known given names (and their later or earlier mentions by one of the two names), mail
and IP addresses, telephone, card, account and social security numbers, dates of birth, and secrets.
A surrogate is a keyed permutation of the entity within its shape: the places of digits, letters
and fixed characters stay, as do the script of digits, vowels and consonants of names, the alphabet of a hexadecimal
secret, a card number's first digit and check digit, a telephone's country code and
fictitious exchange, and the network of an address that is in one with a use of its own. Given names are exchanged for others of
the same gender and script. A permutation without fixed points gives every entity another value,
gives distinct entities distinct ones (no collision can arise within a shape, and what two
shapes could share is walked past, so they don't meet), and gives the same entity the same
surrogate in every document, so that mentions still corefer. with_surrogates() checks over
all documents that distinct entities have distinct surrogates, and makes new ones where not.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Given names by script and gender.
GIVEN = {
    ("latin", "female"): ["Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Elizabeth", "Emma", "Hannah", "Isabella", "Julia", "Laura", "Linda", "Maria", "Mary", "Olivia", "Patricia", "Sophie", "Susan", "Aisha", "Fatima", "Ingrid", "Lakshmi", "Priya", "Yuki"],
    ("latin", "male"): ["Andrew", "Carlos", "Daniel", "David", "Edward", "Hans", "James", "Jean", "John", "Joseph", "Michael", "Paul", "Pedro", "Peter", "Richard", "Robert", "Thomas", "William", "Ahmed", "Hiroshi", "Mohammed", "Omar", "Ravi", "Wei"],
    ("cyrillic", "female"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "male"): ["Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
    ("greek", "female"): ["Αικατερίνη", "Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "male"): ["Γεώργιος", "Δημήτρης", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος"],
}
PLACE = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}

# Alphabets whose characters are exchanged among themselves in surnames and other words.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ", "áàâäãåéèêëíìîïóòôöõúùûüýÿ", "ñçšžćčđłśźżńßþð", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝ", "ÑÇŠŽĆČĐŁŚŹŻŃÞÐ", "ёйъьіїєґ", "0123456789"]
_WORD = {c: a for a in ALPHABETS for c in a}
_PLAIN = {c: a for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for c in a}
_HEX = {c: a for a in ("abcdef", "ABCDEF", "0123456789") for c in a}
_MAIL = {c: a for a in ALPHABETS if not a.isascii() for c in a} | _PLAIN
_HEX_LETTERS = frozenset("0123456789abcdefABCDEF")

# A run of characters that mailboxes have is tried once, at its beginning, so the time is in proportion to the text.
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_LOGIN = re.compile(r"(?<=://)([^\s/@:?#]++):([^\s/@]++)@")
# Patterns with digits are searched in the text with all scripts' decimal digits as ASCII ones.
_IP = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_BORN = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|d\.?o\.?b\.?))\s*(?:[:=]\s*)?([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9])")
_CARD = re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?!\w)")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SERVICE_KEY = re.compile(r"(?<![A-Za-z0-9_-])(sk-|pk-|sk_live_|sk_test_|ghp_|gho_|xoxb-|xoxp-)([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
_SERVICES = ("sk-", "pk-", "sk_", "gh", "xox")
_CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])(AKIA|ASIA)([A-Z0-9]{16})(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*([\"']?)([^\s\"'<>]{6,})")
_SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey")
_NAME = re.compile(rf"(?<!\w)({'|'.join(PLACE)})(\s+)([^\W\d_][\w'’-]+)(?!\w)")
# Names that no list has are told by what stands before them, or by a name that they are joined to.
_CAPITAL = r"[^\W\d_a-zа-яα-ω][\w'’-]+"
_TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Signor|Signora)\.?[ \t]+(?:({_CAPITAL})[ \t]+)?({_CAPITAL})(?!\w)")
_LABELLED = re.compile(rf"(?<!\w)(?i:name|author|contact|patient|customer|employee|signed by|written by|my name is|sincerely|best regards|kind regards)[:,]?\s+({_CAPITAL})[ \t]+({_CAPITAL})(?!\w)")
_JOINED = re.compile(rf"[ \t]*(?:,|,?[ \t](?:and|und|et|y|e|&))[ \t]+({_CAPITAL})[ \t]+({_CAPITAL})(?!\w)")
_BEFORE_NAME = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mon", "Mad", "Señ", "Sig", "ame", "uthor", "ontact", "atient", "ustomer", "mployee", "igned", "itten", "incerely", "egards", "AME", "UTHOR")
_EXAMPLE = re.compile(r"(?:^|\.)example$")
_DIGIT = re.compile(r"[0-9][ .-]?[0-9]")  # in all that the patterns with digits find, but for those of hexadecimal ones
_OTHER_DIGIT = re.compile(r"(?![0-9])\d")
_ASCII = {c: ord("0") + unicodedata.decimal(chr(c)) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
# Networks with a use of their own; an address in one of them stays in it.
NETWORKS = [ipaddress.IPv4Network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")]
_ROUNDS = 8
#: Characters that move together.
PART = 128


@lru_cache(maxsize=10_000)
def _block(c: str) -> str | None:
    """For a letter beyond the alphabets: the letters of its kind among the 64 code points that it is in; None for all other characters."""
    if c.isascii() or not c.isalpha():
        return None
    kind, first = unicodedata.category(c), ord(c) & ~63
    same = "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and unicodedata.category(x) == kind and len(x.lower()) == len(x.upper()) == 1 and x not in _WORD)
    return same if c in same and len(same) > 1 else None


def _hash(data: bytes, key: bytes, size: int) -> int:
    """A keyed hash of so many bytes, as a number."""
    if size <= 64:
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=size).digest(), "big")
    return int.from_bytes(hashlib.shake_256(key + data).digest(size), "big")  # keys have one length


def _feistel(x: int, n: int, key: bytes, back: bool) -> int:
    """A keyed permutation of 0 .. n-1: a Feistel network on a * b >= n numbers, walked until it is inside."""
    a = int(n**0.5) if n < 1 << 50 else 1 << n.bit_length() // 2
    a = max(a, 1)
    b = -(-n // a)
    size = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(x, b)
        for r in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
            if r % 2:
                h = _hash(left.to_bytes(size, "big") + bytes([r]), key, size)
                right = (right - h if back else right + h) % b
            else:
                h = _hash(right.to_bytes(size, "big") + bytes([r]), key, size)
                left = (left - h if back else left + h) % a
        x = left * b + right
        if x < n:
            return x


def moved(x: int, n: int, key: bytes) -> int:
    """Another number of 0 .. n-1, distinct for distinct x; x itself if n is 1. A cycle of all n numbers, hidden by a keyed permutation."""
    return _feistel((_feistel(x, n, key, False) + 1) % n, n, key, True)


class Surrogates:
    """Surrogates under a secret key. again: how many times entities (type, value) are to be made anew, each time under another key."""

    def __init__(self, key: bytes, again: dict[tuple[str, str], int] | None = None):
        self.key, self.again = key, again or {}
        self.of: Callable[[str, str], str] = lru_cache(maxsize=100_000)(self._of)

    def _key(self, *what: str) -> bytes:
        return hmac.new(self.key, "\x00".join(what).encode(), hashlib.sha256).digest()

    def shaped(self, kind: str, value: str, alphabets: dict[str, str], taken: Callable[[str], bool] | None = None) -> str:
        """value with its characters moved within their alphabets; others stay. Values that are taken, as value itself must not be, are walked past: a cycle without them stays one."""
        made = self._moved(kind, value, alphabets)
        while taken and taken(made):
            made = self._moved(kind, made, alphabets)
        return made

    def _moved(self, kind: str, value: str, alphabets: dict[str, str]) -> str:
        """Values of over PART characters move part by part, each under a key of the parts before it: still a permutation, without long arithmetic."""
        of = [alphabets.get(c) or _block(c) for c in value]
        key = self._key(kind, "".join(a[0] if a else c for a, c in zip(of, value, strict=True)))
        out = []
        for at in range(0, len(value), PART):
            some, part = of[at : at + PART], value[at : at + PART]
            n, x = 1, 0
            for a, c in zip(some, part, strict=True):
                if a:
                    n *= len(a)
                    x = x * len(a) + a.index(c)
            x = moved(x, n, key)
            made = []
            for a, c in zip(reversed(some), reversed(part), strict=True):
                if a:
                    x, i = divmod(x, len(a))
                    c = a[i]
                made.append(c)
            out += reversed(made)
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        return "".join(out)

    def _of(self, kind: str, value: str) -> str:
        times = self.again.get((kind, plain(kind, value)), 0) if self.again else 0
        maker = type(self)(self._key("again", str(times))) if times else self
        as_ascii = value.translate(_ASCII)
        made = getattr(maker, "_" + kind)(as_ascii)
        if made == as_ascii:  # nothing in it could be moved
            made = maker._unlike(kind, value)
        if as_ascii == value:
            return made
        # digits come back in the script of the digit at their place, or where the length differs in that of the first other one
        at = next(i for i, c in enumerate(value) if ord(c) in _ASCII)
        of = value if len(made) == len(value) else value[at] * len(made)
        return "".join(_digit(m, c) if m in _DIGITS and c.isdecimal() else m for m, c in zip(made, of, strict=True))

    def _unlike(self, kind: str, value: str) -> str:
        """As many letters as value has characters; for values without any character of a known alphabet."""
        made, n = "", 0
        while len(made) < len(value) or made == value:
            made = (made + "".join(chr(97 + b % 26) for b in self._key("unlike", kind, value, str(n))))[: len(value)] if len(made) < len(value) else ""
            n += 1
        return made

    def _email(self, value: str) -> str:
        # letters of either case are one mailbox; the case of each place stays
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        local, _, domain = low.rpartition("@")
        made = self.shaped("local", local, _MAIL)
        host, _, top = domain.rpartition(".")
        if not _EXAMPLE.search(host):
            host = self.shaped("host", host, _MAIL, _EXAMPLE.search)
        made = f"{made}@{host}.{top}"
        return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for m, c in zip(made, value, strict=True))

    def _ip(self, value: str) -> str:
        address = ipaddress.IPv4Address(value)
        for net in NETWORKS:
            if address in net:
                return str(net[moved(int(address) - int(net[0]), net.num_addresses, self._key("ip", str(net)))])
        while True:
            address = ipaddress.IPv4Address(moved(int(address), 1 << 32, self._key("ip")))
            if not any(address in net for net in NETWORKS):
                return str(address)

    def _ip6(self, value: str) -> str:
        return self.shaped("ip6", value, _HEX)

    def _born(self, value: str) -> str:
        # days of 1900 to 2099 in the given form, the 29th of February aside; other dates move digit by digit
        iso = value[4] == "-"
        numbers = [int(x) for x in re.split(r"[-/.]", value)]
        year, month, day = numbers if iso else reversed(numbers)
        months = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        if not (1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= months[month - 1]) or len(value) != 10:
            return self.shaped("date", value, _PLAIN, lambda m: self._is_day(m))
        x = moved((year - 1900) * 365 + sum(months[: month - 1]) + day - 1, 200 * 365, self._key("born", value[4], value[2]) if iso else self._key("born", value[2]))
        year, x = divmod(x, 365)
        month = next(i for i in range(12) if x < sum(months[: i + 1]))
        day = x - sum(months[:month]) + 1
        return f"{1900 + year}-{month + 1:02d}-{day:02d}" if iso else f"{day:02d}{value[2]}{month + 1:02d}{value[5]}{1900 + year}"

    @staticmethod
    def _is_day(value: str) -> bool:
        """Whether a date is one of those that _born() moves among themselves."""
        iso = value[4] == "-"
        numbers = [int(x) for x in re.split(r"[-/.]", value)]
        year, month, day = numbers if iso else reversed(numbers)
        return len(value) == 10 and 1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]

    def _card(self, value: str) -> str:
        digits = [int(c) for c in value if c.isdigit()]
        check = (digits[-1] - luhn(digits[:-1])) % 10
        body = "".join(map(str, digits[1:-1]))
        made = [digits[0], *map(int, self.shaped(f"card{digits[0]}", body, _PLAIN))]
        made.append((luhn(made) + check) % 10)
        return _filled(value, made)

    def _phone(self, value: str) -> str:
        digits = [int(c) for c in value if c.isdigit()]
        keep = len(digits) - 10 if len(digits) > 10 and value[0] == "+" else 2 if value[0] == "+" else 0
        code, rest = digits[:keep], digits[keep:]
        if len(rest) == 10 and rest[3:6] == [5, 5, 5]:  # a fictitious exchange stays one
            high = rest[0] >= 2
            area = int("".join(map(str, rest[:3]))) - (200 if high else 0)
            n = 800 if high else 200
            x = moved(area * 10_000 + int("".join(map(str, rest[6:]))), n * 10_000, self._key("phone", str(code), str(high)))
            area, line = divmod(x, 10_000)
            made = f"{area + (200 if high else 0):03d}555{line:04d}"
        else:
            made = self.shaped("phone" + str(code), "".join(map(str, rest)), _PLAIN, lambda m: len(m) == 10 and m[3:6] == "555")
        return _filled(value, [*code, *map(int, made)])

    def _ssn(self, value: str) -> str:
        return self.shaped("ssn", value, _PLAIN)

    def _iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self.shaped("iban" + plain[:2], plain[4:], _PLAIN)
        rest = (int(plain[2:4]) - _iban_check(plain[:2], plain[4:])) % 97
        made = plain[:2] + f"{(_iban_check(plain[:2], body) + rest - 2) % 97 + 2:02d}" + body if 2 <= int(plain[2:4]) <= 98 else plain[:4] + body
        it = iter(made)
        return "".join(c if c == " " else _digit(next(it), c) for c in value)

    def _cloud_key(self, value: str) -> str:
        return value[:4] + self.shaped("cloud_key" + value[:4], value[4:], _PLAIN)

    def _service_key(self, value: str) -> str:
        prefix = _SERVICE_KEY.match(value)[1]
        return prefix + self.shaped("service" + prefix, value[len(prefix) :], _PLAIN)

    def _secret(self, value: str) -> str:
        if _HEX_LETTERS.issuperset(value):
            return self.shaped("hex", value, _HEX)
        return self.shaped("secret", value, _PLAIN, _HEX_LETTERS.issuperset)

    def _name(self, value: str) -> str:
        # each part as its own mentions are made
        given, space, family = re.split(r"(\s+)", value, maxsplit=1)
        return self.of("given", given) + space + self.of("family", family)

    def _given(self, value: str) -> str:
        if value not in PLACE:
            made = self.shaped("other given", value, _WORD, PLACE.__contains__)
            return made if made != value else self._unlike("given", value)
        group, i = PLACE[value]
        return GIVEN[group][moved(i, len(GIVEN[group]), self._key("given", *group))]

    def _login(self, value: str) -> str:
        return self.shaped("login", value, _MAIL)

    def _family(self, value: str) -> str:
        made = self.shaped("family", value, _WORD)
        return made if made != value else self._unlike("family", value)


_DIGITS = frozenset("0123456789")


def _filled(form: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(_digit(str(next(it)), c) if c.isdigit() else c for c in form)


def _digit(made: str, before: str) -> str:
    """made, in the digits of the script of the digit that it replaces; numbers in two scripts stay two entities."""
    return chr(ord(before) - int(before) + int(made)) if before.isdecimal() and not before.isascii() else made


def plain(kind: str, value: str) -> str:
    """The form that mentions of one entity share: mailboxes have no case."""
    return value.lower() if kind == "email" else re.sub(r"\s+", " ", value) if kind == "name" else value


def luhn(digits: list[int]) -> int:
    """The check digit for these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities in a text, apart from each other, in order. Of two that overlap the one that starts first stays, then the longer, then the one found by the more certain pattern."""
    found: list[tuple[int, int, int, str]] = []

    def add(kind: str, matches, group: int = 0) -> None:
        found.extend((m.start(group), -m.end(group), len(found), kind) for m in matches)

    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _SECRET_WORDS):
            add("secret", (m for m in _SECRET.finditer(text) if any(c in _PLAIN for c in m[2])), 2)
    if "AKIA" in text or "ASIA" in text:
        add("cloud_key", _CLOUD_KEY.finditer(text))
    if "@" in text:
        add("email", _EMAIL.finditer(text))
    if "://" in text and "@" in text:
        logins = list(_LOGIN.finditer(text))
        add("login", logins, 1)
        add("secret", logins, 2)
    if any(w in text for w in _SERVICES):
        add("service_key", _SERVICE_KEY.finditer(text))
    digits = text if text.isascii() or not _OTHER_DIGIT.search(text) else text.translate(_ASCII)
    if _DIGIT.search(digits):
        add("ip", (m for m in _IP.finditer(digits) if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m[0].split("."))))
        add("ssn", _SSN.finditer(digits))
        add("born", _BORN.finditer(digits), 1)
        add("phone", _PHONE.finditer(digits))
        add("card", (m for m in _CARD.finditer(digits) if _is_card(m[0])))
        add("iban", _IBAN.finditer(digits))
    if "::" in digits or digits.count(":") > 6:
        add("ip6", (m for m in _IP6.finditer(digits) if _is_ip6(m[0])))
    names = []
    if any(name in text for name in PLACE):
        names = [(m.start(), m.end(), m[1], m[3]) for m in _NAME.finditer(text) if m[3][0].isupper() and _script(m[3]) == PLACE[m[1]][0][0]]
    if any(w in text for w in _BEFORE_NAME):
        for m in _TITLED.finditer(text):
            if m[1]:
                names.append((m.start(1), m.end(), m[1], m[2]))
            else:
                add("family", [m], 2)
        names += [(m.start(1), m.end(), m[1], m[2]) for m in _LABELLED.finditer(text)]
    for _, end, _, _ in names:  # grows meanwhile: names joined to names
        if m := _JOINED.match(text, end):
            names.append((m.start(1), m.end(), m[1], m[2]))
    found.extend((start, -end, len(found), "name") for start, end, _, _ in names)
    # later or earlier mentions by one of the two names
    for kind, words in (("given", {n[2] for n in names}), ("family", {n[3] for n in names})):
        for word in sorted(words):
            found.extend((at, -at - len(word), len(found), kind) for at in _mentions(text, word))
    if not found:
        return []
    out, end = [], 0
    for start, stop, _, kind in sorted(found):
        if start >= end:
            out.append((start, -stop, kind))
            end = -stop
    return out


def _mentions(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            yield at
        at = text.find(word, end)


def _is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(c in _HEX_LETTERS for c in value) and len(value) > 6


def _is_card(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return 13 <= len(digits) <= 19 and digits[0] in (3, 4, 5, 6)


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return name.split(" ")[0].lower()


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (type, start, end, surrogate) of each entity in the given text."""
    spans = find(text)
    if not spans:
        return text, []
    out, at, told = [], 0, []
    for start, end, kind in spans:
        made = surrogates.of(kind, text[start:end])
        out += [text[at:start], made]
        told.append((kind, start, end, made))
        at = end
    return "".join([*out, text[at:]]), told


#: The session's setting that holds the key of surrogates.
KEY = "spark.tallyloom.pii.key"


def session_key(spark: SparkSession) -> str:
    """The key that the session sets. Where it sets none, a random one that nobody can know, kept for the session: then surrogates are the same within it, and other ones in the next."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())])
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


#: Rounds of new surrogates for colliding entities; more than a few mean that surrogates are no permutations at all.
ROUNDS = 20


def with_surrogates(documents: DataFrame, key: str, text_col: str = "text", to: str = "entities", make: type[Surrogates] = Surrogates) -> DataFrame:
    """documents with surrogates in the text, and their entities (type, start, end in the former text, surrogate).

    A null text stays null and has no entities; a column named as `to` is replaced; further
    columns, missing ids and repeated rows make no difference. Whole texts are searched.
    All documents are read once before, to check that distinct entities have distinct surrogates;
    of those that share one, the smallest keeps it and the others get new ones, the same in every document.
    """
    kept = documents.drop(*[c for c in documents.columns if c == to and c != text_col])
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.ArrayType(ENTITY))])
    secret, again = key.encode(), distinct_again(documents, key, text_col, make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = make(secret, again)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts, told = [], []
                for text in part.column(at).to_pylist():
                    text, entities = (None, []) if text is None else replace(text, surrogates)
                    texts.append(text)
                    told.append([{"type": k, "start": s, "end": e, "surrogate": m} for k, s, e, m in entities])
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(told, _ARROW)], names=schema.names)

    return kept.mapInArrow(run, schema)


def _told(documents: DataFrame, key: str, text_col: str, make: type[Surrogates], again: dict[tuple[str, str], int]) -> DataFrame:
    """type, surrogate and entity of all mentions in plain form; repeated ones may be left out."""
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = make(secret, again)
        for batch in batches:
            seen = {}
            for first in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(first, 64).to_pylist():
                    for start, end, kind in find(text) if text else []:
                        # a name's two parts are made and checked as entities of their own
                        parts = zip(("given", "family"), text[start:end].split(None, 1), strict=True) if kind == "name" else [(kind, text[start:end])]
                        for k, value in parts:
                            seen[k, plain(k, surrogates.of(k, value)), plain(k, value)] = None
            kinds, made, entities = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (kinds, made, entities)], names=["type", "surrogate", "entity"])

    return documents.select(F.col(text_col).cast("string")).mapInArrow(run, "type string, surrogate string, entity string")


def distinct_again(documents: DataFrame, key: str, text_col: str = "text", make: type[Surrogates] = Surrogates) -> dict[tuple[str, str], int]:
    """How many times entities are to be made anew, so that over all documents distinct ones have distinct surrogates; empty if none collide, as is expected."""
    again: dict[tuple[str, str], int] = {}
    for _ in range(ROUNDS):
        told = _told(documents, key, text_col, make, again)
        shared = told.groupBy("type", "surrogate").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).where("low < high").select("type", "surrogate", "low")
        groups = shared.collect()
        if not groups:
            return again
        table = documents.sparkSession.createDataFrame(groups, shared.schema)
        for r in told.join(table, ["type", "surrogate"]).where("entity != low").select("type", "entity").distinct().collect():
            again[r.type, r.entity] = again.get((r.type, r.entity), 0) + 1
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds")


def collisions(documents: DataFrame, key: str, text_col: str = "text", make: type[Surrogates] = Surrogates) -> DataFrame:
    """Surrogates that stand for several distinct entities of a type, over all documents before any is made anew (none are expected): type, surrogate, entities."""
    return _told(documents, key, text_col, make, {}).distinct().groupBy("type", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
