"""Labelled spans in forms that no rule of ``pii`` covers, and numbers that are no personal data: what the tagger is taught, and tested on."""

from __future__ import annotations

import numpy as np

_NAMES = "anna ben carla david emil farah greta hugo ines jonas karim lena marta nils olga pavel rosa samir tara viktor".split()
_ENDS = "com org net de io fr".split()
_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _some(r: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[k] for k in r.integers(0, len(letters), n))


def _digits(r: np.random.Generator, n: int) -> str:
    return _some(r, "0123456789", n)


def _card(r: np.random.Generator) -> str:
    """Sixteen digits that pass Luhn."""
    d = [int(c) for c in _digits(r, 15)]
    total = sum(2 * x - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def _email(r: np.random.Generator) -> tuple[str, str, str]:
    pick = lambda x: x[int(r.integers(0, len(x)))]
    name = pick(_NAMES) + pick(("", ".", "_", "-")) + pick(_NAMES) + pick(("", "", _digits(r, 2)))
    return name, pick(_NAMES) + pick(("mail", "corp", "net", "", "shop")) + pick(("", _digits(r, 1))), pick(_ENDS)


def _fours(r, by: str) -> str:
    c = _card(r)
    return by.join(c[k : k + 4] for k in (0, 4, 8, 12))


def _phone(r) -> tuple[str, str, str]:
    return _digits(r, 3), _digits(r, 3), _digits(r, 4)


def _ip(r, by: str) -> str:
    return by.join(str(k) for k in r.integers(0, 256, 4))


def _at(r, at: str, dot: str = ".") -> str:
    name, host, end = _email(r)
    return f"{name}{at}{host}{dot}{end}"


#: Forms taught, by kind.
TAUGHT = {
    "email": [lambda r: _at(r, " [at] "), lambda r: _at(r, "(at)"), lambda r: _at(r, " @ "), lambda r: _at(r, " [at] ", " [dot] "), lambda r: _at(r, "@", " . "), lambda r: _at(r, "@", ",")],
    "ip": [lambda r: _ip(r, "[.]"), lambda r: _ip(r, " . "), lambda r: _ip(r, "[dot]"), lambda r: _ip(r, ". ")],
    "card": [lambda r: _fours(r, "."), lambda r: _fours(r, "/"), lambda r: _fours(r, "_"), lambda r: _fours(r, "  "), lambda r: _fours(r, " - ")],
    "phone": [lambda r: "({}) {}-{}".format(*_phone(r)), lambda r: "{}-{}-{}".format(*_phone(r)), lambda r: "{}.{}.{}".format(*_phone(r)), lambda r: "{}/{}/{}".format(*_phone(r)), lambda r: "001 {} {} {}".format(*_phone(r))],
    "secret": [lambda r: _some(r, _HEX, 40), lambda r: _some(r, _HEX, 32), lambda r: _some(r, _HEX.upper(), 40), lambda r: "AKIA" + _some(r, _UPPER, 16), lambda r: "sk-" + _some(r, _MIXED, 32), lambda r: _some(r, _MIXED, 36)],
}
#: Forms of the same kinds that are never taught: the tagger is measured on them.
HELD = {
    "email": [lambda r: _at(r, "[at]"), lambda r: _at(r, " (at) "), lambda r: _at(r, " @", ".")],
    "ip": [lambda r: _ip(r, "(.)"), lambda r: _ip(r, " .")],
    "card": [lambda r: _fours(r, ":"), lambda r: _fours(r, " / "), lambda r: _fours(r, ", ")],
    "phone": [lambda r: "({}) {}.{}".format(*_phone(r)), lambda r: "{} {}-{}".format(*_phone(r)), lambda r: "({})-{}-{}".format(*_phone(r))],
    "secret": [lambda r: "ghp_" + _some(r, _MIXED, 34), lambda r: _some(r, _HEX, 36), lambda r: _some(r, _MIXED, 28)],
}
#: Numbers that are no personal data.
PLAIN = [
    lambda r: f"{r.integers(1900, 2100)}", lambda r: f"{r.integers(1990, 2030)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}", lambda r: f"{r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}",
    lambda r: f"{r.integers(0, 24):02}:{r.integers(0, 60):02}:{r.integers(0, 60):02}", lambda r: f"${r.integers(1, 10)},{r.integers(0, 1000):03}.{r.integers(0, 100):02}", lambda r: f"{r.integers(0, 100)}.{r.integers(0, 1000)} %",
    lambda r: f"Version {r.integers(0, 10)}.{r.integers(0, 20)}.{r.integers(0, 20)}", lambda r: f"{r.integers(1, 30)}.{r.integers(1, 30)}", lambda r: f"{r.integers(1, 100)},{r.integers(0, 1000):03},{r.integers(0, 1000):03}",
    lambda r: f"#{r.integers(1, 100000)}", lambda r: f"{r.integers(1, 500)}-{r.integers(500, 900)}", lambda r: f"@{_NAMES[int(r.integers(0, len(_NAMES)))]}", lambda r: f"{r.integers(2, 999)}x{r.integers(2, 999)}",
    lambda r: f"[{r.integers(1, 99)}]", lambda r: f"({r.integers(1900, 2030)})", lambda r: _digits(r, int(r.integers(5, 10))), lambda r: f"{_some(r, _UPPER[:26], 2)}{_digits(r, 3)}",
]


def planted(carriers: list[str], kinds: dict[str, list], n: int, r: np.random.Generator, size: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of about ``size`` characters, each a piece of a carrier in which one form stands in place of a word, and its span (none for
    ``PLAIN``, given as kind "")."""
    out, names = [], sorted(kinds)
    for k in range(n):
        kind = names[k % len(names)]
        own = kinds[kind]
        span = own[int(r.integers(0, len(own)))](r)
        text = carriers[int(r.integers(0, len(carriers)))]
        at = int(r.integers(0, max(1, len(text) - size)))
        piece = text[at : at + size]
        room = max(0, size - len(span) - 4)
        left = int(r.integers(0, room + 1))
        before = piece[:left].rstrip()
        glue = (" ", " ", " ", ": ", ' "', " (", " = ")[int(r.integers(0, 7))] if before else ""
        close = {' "': '"', " (": ")"}.get(glue, ("", "", ".", ",", "!!", "###")[int(r.integers(0, 6))])
        head = before + glue
        out.append((head + span + close + " " + piece[left : left + room - left].lstrip(), [(kind, len(head), len(head) + len(span))] if kind else []))
    return out
