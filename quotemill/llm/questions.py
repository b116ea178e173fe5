"""What a market's title asks: subject, opponent, measure, direction, threshold and day, read from noisy wording."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that tell what is measured, which way, and words that carry no subject.
MEASURES = {
    "rain": ["rain", "rainfall", "precipitation", "inches"],
    "approval": ["mayor", "approval", "rating"],
    "points": ["points", "pts", "scores", "score"],
    "release": ["ship", "ships", "launch", "launches", "released", "release"],
    "temperature": ["temperature", "temp", "reading", "daily"],
    "price": ["price", "trade", "stock", "shares", "close", "finish"],
    "win": ["beat", "defeat", "win", "vs", "against"],
}
UP = ["above", "over", "exceeding", "more", "least", "reach"]
DOWN = ["below", "under", "less"]
HIGH, LOW = ["high", "highest"], ["low", "lowest"]
BREAKS = ["beat", "defeat", "vs", "against", "over"]
FILLERS = [
    "will", "the", "does", "do", "be", "have", "get", "come", "comes", "in", "on", "of", "at", "or", "than", "to", "by", "before", "end", "total", "degrees", "deg", "f", "usd", "dollars", "pct", "percent",
    "city", "inc", "corp", "market", "reach", "high", "highest", "low", "lowest", "least", "new",
]
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
SHORT_FORMS = {"pt": "port", "st": "saint", "mt": "mount", "ft": "fort"}

_WORD = r"[^\W\d_]+"
_DATES = [
    (re.compile(r"\(?\b(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}|\d{2})\b\)?"), None),
    (re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b"), None),
    (re.compile(rf"\b(?:(?P<w>{_WORD}),\s*)?(?P<n>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(?P<y>\d{{4}}))?(?![\w.]*\d)(?!\s*(?:\+|or\b|point|pts|inch|degree|°|%|pct|percent|usd|dollar|f\b|k\b))"), "n"),
    (re.compile(rf"\b(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<n>{_WORD})\b\.?(?:,?\s+(?P<y>\d{{4}}))?"), "n"),
]
_NUMBER = re.compile(r"(?<![\d.,])\$?\s?(\d[\d,]*(?:\.\d+)?|\.\d+)\s?(k\b)?")


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbours changing places as one edit; most + 1 if it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=500_000)
def _is(word: str, group: tuple[str, ...], loose: bool | str) -> bool:
    """Whether a word is of a group; loosely, also with one edit if it has five letters or more (four, with two letters changing places)."""
    if word in group:
        return True
    if loose == "any":
        return any(min(len(word), len(g)) >= 2 and max(len(word), len(g)) >= 3 and distance(word, g, 1) <= 1 for g in group)
    return loose and any((len(word) >= 5 or len(g) >= 5 or sorted(word) == sorted(g)) and min(len(word), len(g)) >= 4 and distance(word, g, 1) <= 1 for g in group)


def _any(words: list[str], group: list[str], loose: bool | str) -> bool:
    if not loose:
        return not set(words).isdisjoint(group)
    t = tuple(group)
    return any(_is(w, t, loose) for w in words)


def plain(title: str) -> str:
    """Lower case, one kind of space, without tags in front."""
    s = unicodedata.normalize("NFKC", title).lower().strip()
    s = re.sub(r"^(?:\[[^\]]*\]|\([a-z]{1,2}\))\s*", "", s)
    return re.sub(r"\s+", " ", s)


@lru_cache(maxsize=10_000)
def month(word: str) -> int | None:
    if word in MONTHS:
        return MONTHS[word]
    if len(word) < 3 or word in WEEKDAYS:
        return None
    near = {n for w, n in MONTHS.items() if (len(w) >= 5 or len(word) == 3 and sorted(w) == sorted(word) or len(word) == 4 and len(w) == 3 and len(set(word)) < 4) and distance(word, w, 1) <= 1}
    return near.pop() if len(near) == 1 else None


def take_date(s: str, year: int | None) -> tuple[tuple[int | None, int, int] | None, str]:
    """The day named in a text, and the text without it. year holds where none is named; None leaves it open."""
    for pattern, named in _DATES:
        for m in pattern.finditer(s):
            g = m.groupdict()
            mo = month(g["n"]) if named else int(g["m"])
            if not mo or not 1 <= mo <= 12 or not 1 <= int(g["d"]) <= 31:
                continue
            y = int(g["y"]) if g.get("y") else year
            start = m.start()
            if g.get("w") and not _is(g["w"], tuple(WEEKDAYS), False):
                start = m.start("n")
            return (y + 2000 if y is not None and y < 100 else y, mo, int(g["d"])), s[:start] + " ; " + s[m.end() :]
    # A misspelt month before a day and a year: the month stays open (0).
    m = re.search(rf"\b{_WORD}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>20\d\d)\b", s)
    if m and 1 <= int(m["d"]) <= 31:
        return (int(m["y"]), 0, int(m["d"])), s[: m.start()] + " ; " + s[m.end() :]
    return None, s


def read(title: str | None, year: int | None = 2021) -> dict | None:
    """The parts of the question a title asks; None for a null or blank one.

    measure ('' if unknown), direction (1 up, -1 down, 0 none), threshold (None if none), day (y, m, d; y is
    year where the title names none) or None, subject and opponent as cleaned words.
    """
    if not title or not title.strip():
        return None
    s = plain(title)
    day, rest = take_date(s, year)
    # Apostrophes stay in names; all else that is no letter, digit or sign parts words.
    found = [m for m in _NUMBER.finditer(rest)]
    words = re.findall(rf"{_WORD}(?:'{_WORD})?", rest)
    measure = ""
    degrees = re.search(r"°|\bdegrees\b|\d\s?f\b", rest) is not None
    for loose in (False, True, "any"):
        if measure:
            break
        if loose and degrees:
            measure = "temperature"
            break
        if loose == "any" and _any(words, ["over"], False):
            break
        for name, group in MEASURES.items():
            if _any(words, group, loose):
                measure = name
                break
    if not measure and re.search(r"\d\s?\+", rest):
        measure = "points"
    if not measure:
        measure = "price" if found else "win" if _any(words, ["over"], True) else ""
    if measure == "temperature":
        measure = "high" if _any(words, HIGH, False) else "low" if _any(words, LOW, False) else "high" if _any(words, HIGH, "any") else "low" if _any(words, LOW, "any") else measure
    out = {"measure": measure, "direction": 0, "threshold": None, "day": day, "subject": "", "opponent": ""}
    if measure == "win":
        out["subject"], out["opponent"] = _sides(rest)
        return out
    if measure == "release":
        group = (*MEASURES["release"], "will", "the", "before", "end", "of", "by")
        near = (*MEASURES["release"], "before")
        out["subject"] = " ".join(w for w in re.findall(rf"{_WORD}|\d+", rest) if w not in group and not _is(w, near, True))
        return out
    if found:
        m = found[-1]
        number = round(float(m[1].replace(",", "")) * (1000 if m[2] else 1), 6)
        out["threshold"] = number
        rest = rest[: m.start()] + " # " + rest[m.end() :]
    words = re.findall(rf"{_WORD}(?:'{_WORD})?", rest)
    up, down = ">" in rest or "+" in rest or _any(words, UP, False), "<" in rest or _any(words, DOWN, False)
    for loose in (True, "any"):
        if not up and not down:
            up, down = _any(words, UP, loose), _any(words, DOWN, loose)
    out["direction"] = 1 if measure == "points" or up and not down else -1 if down else 0
    strict, loose = _passed_over(measure)
    kept = [w for w in words if w not in strict and not _is(w, loose, True)]
    out["subject"] = " ".join(SHORT_FORMS.get(w, w) for w in kept)
    return out


@lru_cache(maxsize=32)
def _passed_over(measure: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """The words that are no part of a subject, and those of them that may be misspelt."""
    words = MEASURES.get(measure, MEASURES["temperature"]) + UP + DOWN + FILLERS
    return frozenset(words), tuple(w for w in words if len(w) >= 5)


def _sides(rest: str) -> tuple[str, str]:
    """The side that wins, and the other, of a text like 'A beat B', 'A to win vs B' or 'A over B'."""
    words = re.findall(rf"{_WORD}(?:'{_WORD})?", rest)
    drop = {"will", "the", "do", "on", "to", "win"}
    for loose in (False, True, "any"):
        for i, w in enumerate(words):
            if 0 < i < len(words) - 1 and _is(w, tuple(BREAKS), loose):
                left, right = words[:i], words[i + 1 :]
                clean = lambda side: " ".join(SHORT_FORMS.get(x, x) for x in side if x not in drop and not (len(x) <= 4 and sorted(x) in (sorted("will"), sorted("win"))))
                if clean(left) and clean(right):
                    return clean(left), clean(right)
    # No word parts the sides: what follows "win", less a stray letter or two, is the other one.
    at = next((i for i, w in enumerate(words) if w == "win" and 0 < i < len(words) - 1), None)
    if at:
        right = [w for w in words[at + 1 :] if len(w) > 2]
        left = [w for w in words[:at] if w not in drop]
        if left and right:
            return " ".join(SHORT_FORMS.get(w, w) for w in left), " ".join(right)
    return " ".join(w for w in words if w not in drop), ""
