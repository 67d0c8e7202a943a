"""Small labelled tables for the learned scanners, drawn from lines and value forms listed here.

The lines hold what fixed patterns miss: credentials without a keyword or with
words between, short or grouped hex, numbers that run into other numbers,
addresses that are spelled out; and beside them what only looks like that.
Each row's values are drawn anew, so two rows share no finding.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterator

LOWER, UPPER, DIGITS, HEX = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
BASE64 = UPPER + LOWER + DIGITS + "+/"
PLAIN = UPPER + LOWER + DIGITS


def _run(r: random.Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(r.choices(letters, k=r.randint(low, high or low)))


def _word(r: random.Random, low: int = 2, high: int = 9) -> str:
    first = r.randint(0, 1)
    return "".join(r.choice("aeiou" if (i + first) % 2 else "bcdfghlmnprstvw") for i in range(r.randint(low, high)))


def _mixed(r: random.Random, letters: str, low: int, high: int) -> str:
    """With a small letter, a capital and a digit each."""
    body = list(_run(r, letters, low, high))
    for i, kind in zip(r.sample(range(len(body)), 3), (LOWER, UPPER, DIGITS), strict=True):
        body[i] = r.choice(kind)
    return "".join(body)


def _grouped(text: str, size: int, sign: str) -> str:
    return sign.join(text[i : i + size] for i in range(0, len(text), size))


# Credentials

SECRET_VALUES: list[Callable[[random.Random], str]] = [
    lambda r: _mixed(r, BASE64, 24, 60) + r.choice(["", "=", "=="]),
    lambda r: _mixed(r, PLAIN, 20, 48),
    lambda r: _mixed(r, PLAIN + "_-", 28, 64),
    lambda r: _run(r, HEX[:10], 2) + _run(r, HEX, 14, 21),  # hex too short for its pattern
    lambda r: _grouped(_run(r, HEX, 32), r.choice([4, 8]), r.choice("-:")),
    lambda r: _run(r, "0123456789ABCDEF", 32, 64),
    lambda r: r.choice(["sk_live_", "pk_test_", "ghp_", "xoxb-", "glpat-", "AIza"]) + _mixed(r, PLAIN, 20, 40),
    lambda r: "eyJ" + ".".join(_mixed(r, PLAIN + "_-", 20, 50) for _ in range(3)),
]
PASSWORDS: list[Callable[[random.Random], str]] = [
    lambda r: _mixed(r, PLAIN + "!@$%^&*#~+-", 9, 18),
    lambda r: _word(r, 4, 8).capitalize() + r.choice("!@#$%&*_-") + _run(r, DIGITS, 2, 4),
    lambda r: _word(r, 4, 7) + _run(r, DIGITS, 2, 5) + r.choice("!@#$%&*") + _word(r, 3, 6),
    lambda r: _mixed(r, PLAIN, 10, 20),
]
SECRET_LINES = ["{w} {v} {w}", "{w} key {v} {w} {w}", '{w} = "{v}"', "{w}: {v}", "<{w}>{v}</{w}>", "Authorization: Bearer {v}", "--{w}={v} {w}", "{w} {w} '{v}', {w}", "export {W}={v}", "({v})"]
PASSWORD_LINES = ["the password is {v} {w}", "pwd {v} {w}", "login {w} / {v}", "pass -> {v}", "passphrase: {v}", "{w} with password '{v}' {w}", "https://{w}:{v}@{w}.org/{w}", "user={w}&pw={v}&{w}={w}", "credentials {w} {v}", "secret code {v}"]
HARMLESS: list[Callable[[random.Random], str]] = [
    lambda r: f"https://www.{_word(r)}.org/{_word(r)}/{_word(r)}-{_word(r)}?id={r.randint(1, 10**6)}",
    lambda r: f"/usr/{_word(r)}/{_word(r)}_{r.randint(1, 99)}.txt",
    lambda r: f"{_word(r, 4)}.{r.randint(1, 99)}@{_word(r, 4)}.com",
    lambda r: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00Z",
    lambda r: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 300)}-{_word(r, 3, 5)}",
    lambda r: f"{_word(r, 3)}_{_word(r, 3)}_{_word(r, 3)}",
    lambda r: "".join(_word(r, 3, 6).capitalize() for _ in range(r.randint(2, 4))),
    lambda r: f"{_word(r, 3)}-{_word(r, 3)}-{_word(r, 2)}",
    lambda r: _run(r, DIGITS, 8, 20),
    lambda r: f"{r.randint(100, 999)}-{r.randint(1000, 9999)}-{r.randint(0, 10**8):08d}",
    lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r: _grouped(_run(r, HEX, 8), 8, "") + "-" + "-".join(_run(r, HEX, 4) for _ in range(3)) + "-" + _run(r, HEX, 12),
    lambda r: f"{_word(r, 3)}{r.randint(1, 9999)}",
    lambda r: f"item_{r.randint(0, 10**11):012d}_x",
    lambda r: f"10.{r.randint(1000, 9999)}/{_word(r)}.{r.randint(1, 9999)}",
    lambda r: f"{_word(r, 3)}({_word(r)}={r.randint(0, 99)})",
    lambda r: _word(r, 8, 16),
    lambda r: f"{_run(r, UPPER, 2, 4)}-{_run(r, DIGITS, 3, 5)}{r.choice(['', '-' + _run(r, UPPER, 1, 3)])}",  # a part's number
    lambda r: f"{_run(r, UPPER, 1, 3)}{_run(r, DIGITS, 4, 8)}{_run(r, UPPER, 0, 2)}",
    lambda r: _run(r, HEX, 7, 12),  # a commit's short name
]
#: Encoded files: long runs after what says so.
ENCODED_LINES = ["src='data:image/{w};base64,{v}' {w}", "url(data:image/png;base64,{v})", "Content-Transfer-Encoding: base64 {v}", "<img {w} data:image/jpeg;base64,{v}>", "iVBORw0KGgoAAAANSUhEUg{v}"]
ENCODED: list[Callable[[random.Random], str]] = [lambda r: _run(r, BASE64, 60, 240) + r.choice(["", "=", "=="])]
COMMIT_LINES = ["commit {v} {w} {w}", "fixed in {v}", "{w} since {v} {w}", "git show {v}", "merge {v} into {w}"]
HARMLESS_LINES = ["{w} {v} {w}", "{w}: {v}", '{w} = "{v}"', "see {v}, {w}", "({v})", "{w} key {v} {w}", "the password page {v} {w}", "token {v} {w}", "{v}: {w}", "secret {w} {v}"]


def _filled(r: random.Random, line: str, value: str) -> tuple[str, int, int]:
    """The line with words and the value in place, in longer surroundings; where the value stands."""
    line = f"{' '.join(_word(r) for _ in range(r.randint(0, 5)))} {line} {' '.join(_word(r) for _ in range(r.randint(0, 3)))}".strip()
    before, after = ("".join(_word(r).upper() if p == "W" else _word(r) if p == "w" else p for p in half.replace("{w}", "\0w\0").replace("{W}", "\0W\0").split("\0")) for half in line.split("{v}"))
    return before + value + after, len(before), len(before) + len(value)


def secret_forms(n: int = 1_200, seed: int = 11) -> Iterator[tuple[str, int, int, bool, str]]:
    """(text, start, end, whether that is a credential, the value's form); half of them are not."""
    r = random.Random(seed)

    def drawn(lines, values, good, name):
        at = r.randrange(len(values))
        return *_filled(r, r.choice(lines), values[at](r)), good, f"{name}{at}"

    for i in range(n):
        if i % 16 == 1:
            yield drawn(ENCODED_LINES, ENCODED, False, "encoded")
        elif i % 16 == 9:
            yield drawn(*((COMMIT_LINES, HARMLESS[-1:]) if i % 32 == 9 else (HARMLESS_LINES, HARMLESS[11:12])), False, "id")
        elif i % 2:
            yield drawn(HARMLESS_LINES, HARMLESS, False, "harmless")
        elif i % 4:
            yield drawn(PASSWORD_LINES, PASSWORDS, True, "password")
        else:
            yield drawn(SECRET_LINES, SECRET_VALUES, True, "value")


def secret_rows(n: int = 1_200, seed: int = 11) -> Iterator[tuple[str, int, int, bool]]:
    """secret_forms without the form."""
    return (row[:4] for row in secret_forms(n, seed))


# Personal data


def _card(r: random.Random, good: bool = True) -> str:
    body = [r.randint(1, 9), *(r.randint(0, 9) for _ in range(14))]
    last = -sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(body)) % 10
    digits = "".join(map(str, [*body, last if good else (last + r.randint(1, 9)) % 10]))
    return r.choice([digits, digits, _grouped(digits, 4, " "), _grouped(digits, 4, "-")])


def _phone(r: random.Random) -> str:
    a, b, c = _run(r, DIGITS, 3), _run(r, DIGITS, 3), _run(r, DIGITS, 4)
    return r.choice([f"+{r.randint(1, 9)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 9)}-{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}"])


def _local_phone(r: random.Random) -> str:
    a, b, c = _run(r, DIGITS, 3), _run(r, DIGITS, 3), _run(r, DIGITS, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}"])


def _email(r: random.Random) -> str:
    return f"{_word(r, 3)}{r.choice(['', '.', '_'])}{r.choice(['', str(r.randint(1, 99)), _word(r, 3, 5)])}@{_word(r, 3, 8)}{r.choice(['', str(r.randint(1, 9))])}{r.choice(['.com', '.org', '.example.com', '.de'])}"


def _spelled(r: random.Random) -> str:
    at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT ")])
    name = _word(r, 3) + (dot + _word(r, 3) if r.random() < 0.4 else "")
    return f"{name}{at}{_word(r, 4)}{dot}{r.choice(['com', 'org', 'net', 'de'])}"


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


PERSONAL: list[tuple[str, Callable[[random.Random], str]]] = [("phone", _phone), ("card", _card), ("ip", _ip), ("email", _email)]
MISSED: list[tuple[str, Callable[[random.Random], str]]] = [("phone", _local_phone), ("email", _spelled)]
NOT_PERSONAL: list[Callable[[random.Random], str]] = [
    lambda r: _card(r, False).replace(" ", "").replace("-", ""),
    lambda r: _run(r, DIGITS, 1, 20),
    lambda r: f"{r.randint(1, 20)}.{r.randint(0, 20)}{r.choice(['', f'.{r.randint(0, 300)}', f'.{r.randint(0, 30)}.{r.randint(256, 9999)}'])}",
    lambda r: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    lambda r: f"{r.randint(1900, 1960)}-{r.randint(1961, 2030)}",
    lambda r: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
    lambda r: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
    lambda r: f"{r.randint(1, 999)},{r.randint(0, 999):03d}.{r.randint(0, 99):02d}",
    lambda r: f"+{r.randint(1, 99)}%",
    lambda r: f"978-{r.randint(0, 9)}-{r.randint(100, 999)}-{r.randint(10000, 99999)}-{r.randint(0, 9)}",
    lambda r: f"@{_word(r, 4)}{r.choice(['', str(r.randint(1, 99))])}",
    lambda r: f"{_word(r, 3)} at {_word(r, 3)} the dot {_word(r, 3)}",
    lambda r: f"({r.randint(1, 20)}) {r.randint(1, 400)}-{r.randint(401, 900)}",
    lambda r: f"{_word(r, 2, 5)}{r.randint(1, 999)}",
]


def personal_rows(n: int = 1_500, seed: int = 12) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(text, its spans as (start, end, kind)): values alone, side by side, beside other numbers, and none at all."""
    r = random.Random(seed)
    for i in range(n):
        parts: list[tuple[str, str | None]] = []
        for _ in range(r.randint(1, 3)):
            parts += [(_word(r), None) for _ in range(r.randint(0, 3))]
            if i % 3 == 0:
                kinds = [None]
            elif i % 3 == 1:
                kinds = [r.choice(PERSONAL), r.choice([None, r.choice(PERSONAL), r.choice(PERSONAL)])]  # numbers that run into each other
                r.shuffle(kinds)
            else:
                kinds = [r.choice([r.choice(MISSED), r.choice(MISSED), r.choice(PERSONAL)])]
            parts += [(r.choice(NOT_PERSONAL)(r), None) if k is None else (k[1](r), k[0]) for k in kinds]
        parts += [(_word(r), None) for _ in range(r.randint(0, 3))]
        text, spans = "", []
        for value, kind in parts:
            text += r.choice([" ", " ", " ", ", ", "\n"]) if text else ""
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
            if r.random() < 0.1:
                text += r.choice([".", ",", "!!", "###"])
        yield text, spans
