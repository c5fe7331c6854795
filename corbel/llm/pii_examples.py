"""Labelled passages for the PII classifier: personal data and look-alikes whose labels are known because they were written so.

Values are drawn at random, spelt in one of many ways and set into a context.  Nothing here looks at the features or the
base patterns: a label says what was planted, not what a rule thinks of it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Phrases that lead to, or follow, personal data or look-alikes of a kind; ``{}`` is the value.
_LEADS = {
    "email": ("mail {}", "my e-mail is {}", "please write to {} for more", "contact: {}", "send it to {} today", "reach me under {}, thanks", "questions? {}"),
    "phone": ("phone {}", "tel. {}", "call me on {} after six", "fax: {}", "my mobile is {}", "ring {} any time", "whatsapp {}", "text {} to join", "telephone number {}."),
    "ip": ("host {} answered", "the server {} is down", "from ip {}", "connect to {} first", "my address is {} at home", "blocked {} again", "ping {}"),
    "card": ("card {}", "visa {}", "paid with credit card {} yesterday", "charge it to {}, please", "card number: {}", "mastercard {} exp 04/29"),
}
_OTHERS = ("order no {}", "invoice {}", "it costs ${}", "item {} is sold out", "part {}", "version {}", "serial {}", "id={}", "about {} of them", "isbn {}", "#{}", "ref {} closed", "on {} it ran", "\"{}\"", "section {}", "score {}", "build {} failed", "{} %", "between {} and more", "values {} seen")
_NAMES = ("anna", "ben", "carla", "deniz", "emil", "fatou", "goran", "hana", "ivo", "june", "karim", "lena", "milo", "nora", "olga", "pavel")
_HOSTS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "edu", "info", "eu", "ch")
_WORDS = ("the", "a", "this", "noon", "home", "work", "point", "line", "page", "end", "once", "night", "last", "product", "matrix", "here", "first", "top")
_DOTS = (" dot ", " (dot) ", "[dot]", " [dot] ", "(.)", " . ", "[.]", "{dot}")
_ATS = (" at ", " (at) ", "[at]", " [at] ", " @ ", "(at)", " AT ", "{at}", " <at> ")


def _word(rng: random.Random, most: int = 4) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéüo") for _ in range(rng.randint(1, most)))


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _check_digit(body: str) -> int:
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return -total % 10


def card_digits(rng: random.Random, n: int, valid: bool = True) -> str:
    body = _digits(rng, n - 1, "3456")
    return body + str((_check_digit(body) + (0 if valid else rng.randint(1, 9))) % 10)


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(x for x in [*out, digits[at:]] if x)


def respelt(kind: str, rng: random.Random) -> tuple[str, bool]:
    """A value of ``kind`` in a spelling the base patterns mostly miss; and whether it tells itself without a context."""
    if kind == "email":
        local = rng.choice((rng.choice(_NAMES), _word(rng), f"{rng.choice(_NAMES)}.{_word(rng)}", f"{_word(rng)}_{rng.randint(1, 99)}", f"{rng.choice(_NAMES)}{rng.randint(1, 2000)}"))
        host, top = ".".join(_word(rng) for _ in range(rng.choice((1, 1, 2)))), rng.choice(_HOSTS)
        dot, at = rng.choice(_DOTS), rng.choice(_ATS)
        if "." in local and rng.random() < 0.5:
            local = local.replace(".", " dot ") if dot == " dot " else local
        spelt = f"{host}.{top}".replace(".", dot) if at == " at " or rng.random() < 0.7 else f"{host}.{top}"
        return local + at + spelt, True
    if kind == "ip":
        return rng.choice(_DOTS).join(str(rng.randint(0 if k else 1, 255)) for k in range(4)), True
    if kind == "card":
        n = rng.choice((15, 15, 16, 16, 16, 16, 13, 14, 19))
        digits = card_digits(rng, n)
        sizes = {15: (4, 6), 14: (4, 6)}.get(n, (4, 4, 4, 4))
        sep = rng.choice((".", "/", "  ", "_", " - ", " ", "-", ". "))
        return (_grouped(digits, sizes, sep), True) if rng.random() < 0.8 else (digits, False)
    form, n = rng.choice(("paren", "three", "zero", "intl", "slash", "bare", "uk", "pairs")), _digits
    sep = rng.choice((" ", "-", ".", " "))
    if form == "paren":
        return f"({n(rng, rng.choice((3, 3, 4)), '023456789')}){rng.choice((' ', '', '-'))}{n(rng, 3)}{sep}{n(rng, 4)}", True
    if form == "three":
        return f"{rng.choice(('', '', '1' + sep))}{n(rng, 3, '23456789')}{sep}{n(rng, 3)}{sep}{n(rng, 4)}", True
    if form == "zero":
        return f"0{n(rng, rng.choice((2, 3, 4)), '123456789')}{sep}{n(rng, rng.choice((6, 7, 8)))}", True
    if form == "intl":
        return f"00{rng.choice(('', ' '))}{n(rng, 2, '3456789')}{sep}{n(rng, rng.choice((2, 3)), '123456789')}{sep}{n(rng, rng.choice((6, 7, 8)))}", True
    if form == "slash":
        return f"0{n(rng, rng.choice((2, 3, 4)), '123456789')}/{n(rng, rng.choice((6, 7, 8)))}", True
    if form == "uk":
        return f"0{n(rng, 2, '1278')}{sep}{n(rng, 4)}{sep}{n(rng, 4)}", True
    if form == "pairs":
        return sep.join([f"0{rng.randint(1, 9)}", *(n(rng, 2) for _ in range(4))]), True
    return n(rng, rng.choice((9, 10, 11))), False


def look_alike(kind: str, rng: random.Random) -> str:
    """What may be taken for ``kind`` and is not."""
    n = _digits
    if kind == "email":
        return rng.choice((
            f"{rng.choice(_WORDS)} at {_word(rng)}.{rng.choice(_HOSTS)}", f"look at {rng.choice(_WORDS)} dot {rng.choice(_WORDS)}", f"{_word(rng)} at {_word(rng)} dot {_word(rng)}",
            f"{_word(rng)} at {rng.choice(_WORDS)}.{rng.choice(_WORDS)}", f"sold @ {rng.randint(1, 99)}.{rng.randint(10, 99)}", f"{_word(rng)} at www.{_word(rng)}.{rng.choice(_HOSTS)}", f"{_word(rng)} at 10.{rng.randint(10, 59)}",
        ))
    if kind == "ip":
        return rng.choice((
            ", ".join(str(rng.randint(0, 255)) for _ in range(4)), ",".join(str(rng.randint(0, 99)) for _ in range(4)), rng.choice((".", " . ", "[.]")).join([str(rng.randint(256, 999)), *(str(rng.randint(0, 400)) for _ in range(3))]),
            f"{rng.randint(1, 31)}. {rng.randint(1, 12)}. {rng.randint(1, 31)}, {rng.randint(1, 12)}", f"{rng.randint(1, 9)}, {rng.randint(1, 9)}.{rng.randint(0, 9)}, {rng.randint(0, 9)}",
        ))
    date = f"{rng.randint(1990, 2030)}{rng.choice('-./')}{rng.randint(1, 12):02d}{rng.choice('-./')}{rng.randint(1, 28):02d}"
    date = rng.choice((date, "-".join(reversed(date.replace("/", "-").replace(".", "-").split("-")))))
    common = (
        f"{date} {rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}.{rng.randint(0, 59):02d}", f"{date} - {date}", f"{n(rng, 1)}.{n(rng, rng.randint(7, 14))}", f"{n(rng, 2, '123456789')} {n(rng, 3)} {n(rng, 3)} {n(rng, 3)}",
        f"978-{n(rng, 1)}-{n(rng, 2)}-{n(rng, 6)}-{n(rng, 1)}", f"{n(rng, 4)} - {n(rng, 4)} - {n(rng, 4)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{rng.choice('abcdef')}{n(rng, rng.randint(8, 15))}{rng.choice('abcdef')}",
        f"{n(rng, 2)}.{n(rng, 4)} {n(rng, 1)}.{n(rng, 4)}", " ".join(n(rng, rng.randint(1, 3)) for _ in range(rng.randint(4, 6))), n(rng, rng.randint(12, 19)), f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)} {rng.randint(1900, 2030)}",
    )
    if kind == "card" and rng.random() < 0.6:
        digits = card_digits(rng, rng.choice((13, 14, 15, 16, 16, 16, 19)), valid=False)
        return _grouped(digits, (4, 4, 4, 4), rng.choice(("", "", " ", "-", ".", "  ")))
    return rng.choice(common)


def in_context(value: str, lead: str, rng: random.Random) -> tuple[str, int, int]:
    """``value`` in ``lead``, between made-up words: the passage, and where the value stands."""
    left = " ".join(_word(rng) for _ in range(rng.randint(0, 5)))
    right = " ".join(_word(rng) for _ in range(rng.randint(0, 4)))
    before, after = lead.split("{}")
    before = f"{left} {before}" if left else before
    return f"{before}{value}{after} {right}".rstrip() if right else f"{before}{value}{after}", len(before), len(before) + len(value)


def planted(kind: str, rng: random.Random) -> tuple[str, int, int, int]:
    """A passage with one value of ``kind`` or one look-alike: text, start, end, label."""
    if rng.random() < 0.5:
        value, tells = respelt(kind, rng)
        lead = "{}" if tells and rng.random() < 0.5 else rng.choice(_LEADS[kind])
        return *in_context(value, lead, rng), 1
    value = look_alike(kind, rng)
    return *in_context(value, "{}" if rng.random() < 0.5 else rng.choice(_OTHERS), rng), 0


def passages(kinds: tuple[str, ...], each: int, seed: int = 17) -> Iterator[tuple[str, str, int, int, int]]:
    """``each`` passages of every kind: kind, text, start, end, label.  The same seed gives the same passages."""
    rng = random.Random(seed)
    for kind in kinds:
        for _ in range(each):
            yield kind, *planted(kind, rng)
