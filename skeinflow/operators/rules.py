"""Extraction rules in Python, for steps that search for a cut and for streaming state. The same rules as functions.text."""

from __future__ import annotations

import math
import re

import regex

from ..config import DEFAULT as C
from ..functions import vocab as V

_TOKEN = regex.compile(r"[\p{L}\p{N}_-]+").findall
_NAMED = frozenset(V.DAYS + V.MONTHS + V.NUMBERS)
_STOP, _MARKERS, _CORE, _DROP = frozenset(V.STOP), frozenset(V.MARKERS), frozenset(V.CORE), frozenset(V.FRAME_DROP)
_TOPIC = {w: k for k, ws in reversed(V.TOPICS.items()) for w in ws}
_CLOSER = {'"': '"', "“": "”", "‘": "’"}
_PAYLOAD = [regex.compile(p) for p in (r"[0-9]", r"[\p{L}\p{N}_]-[\p{L}\p{N}_]", r"[a-z,'\"] [A-Z][A-Z]+($|[^\p{L}\p{N}_])", r"[a-z,'\"] [A-Z][a-z]")]
_OPENERS = re.compile("^(?:(?:" + "|".join(o.replace(" ", r"\s+") for o in sorted(V.OPENERS, key=len, reverse=True)) + r")[\s,]+)+", re.I)
_CLAUSE = re.compile(r",\s+|;\s+|\s+(?:and|but|so|then|while|though)\s+")
_SECOND = re.compile(r"\b(you|your|yours)\b", re.I)
_FIRST = re.compile(r"\b(i|my|mine|me|we|our|us)\b", re.I)


def words(text: str) -> list[str]:
    return sorted({V.stem(w) for w in _TOKEN(text.lower()) if w not in _STOP})


def inside(text: str) -> list[bool]:
    """Whether each character is within quotation marks (marks included)."""
    flags, waiting = [], ""
    for c in text:
        was = bool(waiting)
        if was and c == waiting:
            waiting = ""
        elif not was and c in _CLOSER:
            waiting = _CLOSER[c]
        flags.append(was or bool(waiting))
    return flags


def cut_outside(text: str, pattern) -> list[str]:
    """Pieces between matches that don't begin within quotation marks; trimmed, none empty."""
    quoted = inside(text)
    edges = [0]
    for m in pattern.finditer(text):
        if not quoted[m.start()]:
            edges += [m.start(), m.end()]
    edges.append(len(text))
    return [p for p in (text[a:b].strip() for a, b in zip(edges[::2], edges[1::2])) if p]


_END = re.compile(r"(?<=[.!?:])\s+|\n+")


def sentences(text: str) -> list[str]:
    return cut_outside(text, _END)


def has_payload(text: str) -> bool:
    return any(w in _NAMED for w in regex.findall(r"[\p{L}\p{N}_'-]+", text.lower())) or any(p.search(text) for p in _PAYLOAD)


def is_fact(text: str, markers: frozenset = _MARKERS) -> bool:
    return has_payload(text) or any(V.stem(w) in markers for w in _TOKEN(text.lower()))


def frame(text: str) -> list[str]:
    out, before = set(), None
    for w in _TOKEN(text):
        low, prev, before = w.lower().strip("-"), before, w.lower()
        if not low or low in _STOP:
            continue
        if re.search("[0-9]", w):
            if prev is None:
                out.add("ID:#" + low)
            elif prev not in _STOP and prev not in _NAMED - set(V.NUMBERS) and not re.search("[0-9]", prev):
                out.add(f"ID:{V.stem(prev)}#{low}")
            continue
        s = V.stem(low)
        if low in _NAMED or (prev is not None and regex.match(r"\p{Lu}", w)) or s in _DROP or ("-" in low and s not in _MARKERS):
            continue
        out.add(_TOPIC.get(s, s))
    return sorted(out)


def trim_tail(text: str) -> str:
    """Without a trailing clause that adds no fact, as long as what stays is one and loses no payload."""
    must = has_payload(text)
    quoted = inside(text)
    for mark in (",", " and ", " while ", " though ", " but "):
        for m in re.finditer(f"(?={re.escape(mark)})", text):
            left, rest = text[: m.start()].strip(), text[m.start() + len(mark) :].strip()
            if not quoted[m.start()] and len(left) >= 12 and has_payload(left) >= must and is_fact(left) and not is_fact(rest, _CORE):
                return left
    return text


def clauses(text: str) -> list[str]:
    return cut_outside(text, _CLAUSE) or [text]


def fit(text: str, limit: int = C.max_chars) -> str:
    """At most limit characters: the longest run of clauses with payload, else the longest clause, else cut at a blank."""
    if len(text) <= limit:
        return text
    parts = clauses(text)
    runs = [", ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
    carrying = [r for r in runs if len(r) <= limit and has_payload(r)]
    short = carrying or [p for p in parts if len(p) <= limit]
    if short:
        return max(short, key=len)
    head = text[:limit]
    return head.rpartition(" ")[0] if " " in head else head


_PERSON = [(r"\bI'm\b", "{s} is"), (r"\bI've\b", "{s} has"), (r"\bI'll\b", "{s} will"), (r"\bI am\b", "{s} is"), (r"\bI have\b", "{s} has"), (r"\bI do\b", "{s} does"), (r"\bI go\b", "{s} goes"), (r"(?i:\bwe are\b)", "the team is"), (r"(?i:\bwe have\b)", "the team has"),
           (r"\bI\b", "{s}"), (r"(?i:\b(?:my|mine)\b)", "{s}'s"), (r"\bme\b", "{s}"), (r"(?i:\bwe're\b)", "the team is"), (r"(?i:\bwe\b)", "the team"), (r"(?i:\bour\b)", "the team's")]


def third_person(text: str, subject: str = "the user") -> str:
    for pattern, by in _PERSON:
        text = re.sub(pattern, lambda m, by=by: by.format(s=subject), text)
    who = "|".join(map(re.escape, {"the user", "the team", subject}))
    text = re.sub(rf"\b({who}) ({'|'.join(V.AGREE)})\b", r"\1 \2s", text)
    return " ".join(text.split())


def extract(text: str | None, subject: str = "the user", address: bool = True) -> list[str]:
    """The facts of a text, in order."""
    out = []
    for s in sentences(text or ""):
        if re.search(r"\?\s*$", s) or (address and _SECOND.search(s) and not _FIRST.search(s)):
            continue
        s = _OPENERS.sub("", s + " ").strip(" .,!?:")
        if len(s) < C.min_chars or not is_fact(s):
            continue
        fact = fit(third_person(trim_tail(s), subject))
        if fact[:1] in ('"', "“"):
            fact = fit(f"{subject} says {fact}")
        if len(fact) >= C.min_chars:
            out.append(fact)
    return out


def said(role: str | None, text: str | None) -> list[str]:
    """The facts of a turn; their subject is the user or the speaker's name."""
    who = (role or "").strip()
    return extract(text, "the user" if who.lower() in ("user", "you", "") else who)


def importance(text: str, hits: int = 0) -> float:
    """1 to 5, as functions.text.importance."""
    stems = {V.stem(w) for w in _TOKEN(text.lower())}
    tier = next((k for k, ws in V.TIERS if stems & set(ws)), 1.0)
    value = tier - (0.0 if has_payload(text) else 0.5) + (1.0 if stems & set(V.FLAGGED) else 0.0) + min(1.0, 0.4 * math.log(1 + hits))
    return max(1.0, min(5.0, value))


_CAPITAL = regex.compile(r"""[^.!?"“\s][,;:]?\s+([A-Z]\p{L}{2,})""")


def capitals(text: str) -> list[str]:
    """Capitalised words of 3 letters or more, neither at the start nor after . ! ? or a quotation mark."""
    return _CAPITAL.findall(text)
