"""Plain one-text-at-a-time versions of the exact parts, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked),
        n < 10 or 100 * len(marked) > 20 * n,
    )


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    kinds = ("assign", "access", "hex")
    name = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    words = ALNUM.findall(lower(text))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def shingles(text: str | None, width: int) -> set:
    words = SPACED.findall(lower(text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def near_groups(texts: dict[int, str | None], width: int, percent: int = 80) -> dict[int, int]:
    sets = {k: shingles(t, width) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + large - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {k: root(k) for k in ids}
