"""Text expressions: each function gives the SQL of an expression over the SQL expression t, in a dialect d.

Everything stays in built-in functions of the engine. Patterns avoid lookaround and \\b, which the two engines treat differently.
"""

from __future__ import annotations

from . import vocab as V
from .dialect import quoted

TOKEN = r"[\p{L}\p{N}_-]+"
WORD_END = r"($|[^\p{L}\p{N}_])"
WORD_START = r"(^|[^\p{L}\p{N}_])"


def tokens(d, t): return d.re_all(f"lower({t})", TOKEN)


def raw_tokens(d, t): return d.re_all(t, TOKEN)


def trim(d, t): return d.re_sub(t, r"^\s+|\s+$", "")


def stem(d, x):
    def undouble(b): return f"CASE WHEN right({b}, 1) = left(right({b}, 2), 1) THEN left({b}, length({b}) - 1) ELSE {b} END"

    return (f"CASE WHEN {x} LIKE '%ing' AND length({x}) >= 7 THEN {undouble(f'left({x}, length({x}) - 3)')} WHEN {x} LIKE '%ed' AND length({x}) >= 6 THEN {undouble(f'left({x}, length({x}) - 2)')} "
            f"WHEN {x} LIKE '%s' AND length({x}) >= 4 AND {x} NOT LIKE '%ss' AND {x} NOT LIKE '%us' THEN left({x}, length({x}) - 1) ELSE {x} END")


def words(d, t): return d.distinct(d.transform(d.filter(tokens(d, t), "x", f"x NOT IN ({quoted(V.STOP)})"), "x", stem(d, "x")))


def all_stems(d, t): return d.distinct(d.transform(tokens(d, t), "x", stem(d, "x")))


QUOTED = '"[^"]*"?|“[^”]*”?|‘[^’]*’?|[^"“‘]+'


def spans(d, t):
    """Runs inside and outside quotation marks. The pattern takes about a microsecond a character, so Spark tries it only on texts that have a mark."""
    found = d.re_all(t, QUOTED)
    if d.name != "spark":
        return found
    marked = " OR ".join(d.has(t, f"'{q}'") for q in '"“‘')
    return f"CASE WHEN {t} IS NULL OR {marked} THEN {found} ELSE filter(array({t}), z -> z <> '') END"


def quote_depth(d, t):
    """One 0 or 1 for each character: inside quotation marks, marks included. By spans; the oracle goes character by character."""
    if d.name == "spark":
        return d.join(d.transform(spans(d, t), "p", """repeat(CASE WHEN left(p, 1) IN ('"', '“', '‘') THEN '1' ELSE '0' END, length(p))"""), "''")
    close = f"""(acc.o = '"' AND c = '"') OR (acc.o = '“' AND c = '”') OR (acc.o = '‘' AND c = '’')"""
    body = f"""CASE WHEN acc.o = '' AND c IN ('"', '“', '‘') THEN {d.struct(o='c', out="acc.out || '1'")} WHEN acc.o <> '' AND ({close}) THEN {d.struct(o="''", out="acc.out || '1'")} ELSE {d.struct(o='acc.o', out="acc.out || CASE WHEN acc.o <> '' THEN '1' ELSE '0' END")} END"""
    return f"({d.fold(d.chars(t), d.struct(o=chr(39) * 2, out=chr(39) * 2), 'acc', 'c', body)}).out"


def sentences(d, t):
    """Cut after . ! ? : before white space, and at line ends, but not inside quotation marks; trimmed, none empty."""
    guard = [d.chr(k) for k in (2, 3, 4, 5)]
    marks, spaces = f"concat({', '.join(guard)})", f"concat(' ', {d.chr(10)}, {d.chr(9)}, {d.chr(13)})"
    parts = spans(d, t)
    cut = d.re_sub("p", r"([.!?:])\s+", f"{d.group(1)}\x01")
    shown = d.transform(parts, "p", f"""CASE WHEN left(p, 1) IN ('"', '“', '‘') THEN {d.translate('p', spaces, marks)} ELSE {cut} END""")
    pieces = d.transform(d.split(d.join(shown, "''"), "\x01|\n+"), "p", d.translate(trim(d, "p"), marks, spaces))
    return d.filter(d.transform(pieces, "p", trim(d, "p")), "p", "p <> ''")


def is_question(d, t): return d.re_test(t, r"\?\s*$")


def addresses_other(d, t):
    second = d.re_test(t, rf"(?i){WORD_START}(you|your|yours){WORD_END}")
    first = d.re_test(t, rf"(?i){WORD_START}(i|my|mine|me|we|our|us){WORD_END}")
    return f"({second} AND NOT {first})"


def strip_openers(d, t):
    openers = "|".join(o.replace(" ", r"\s+") for o in sorted(V.OPENERS, key=len, reverse=True))
    return d.re_sub(d.re_sub(f"concat({trim(d, t)}, ' ')", rf"(?i)^(?:(?:{openers})[\s,]+)+", ""), r"^[ .,!?:]+|[ .,!?:]+$", "")


def has_payload(d, t):
    named = d.any(d.re_all(f"lower({t})", r"[\p{L}\p{N}_\x27-]+"), "x", f"x IN ({quoted(V.DAYS + V.MONTHS + V.NUMBERS)})")
    tests = [d.re_test(t, p) for p in (r"[0-9]", r"[\p{L}\p{N}_]-[\p{L}\p{N}_]", rf'[a-z,\x27"] [A-Z][A-Z]+{WORD_END}', r'[a-z,\x27"] [A-Z][a-z]')]
    return f"({named} OR {' OR '.join(tests)})"


def marked(d, t, words): return d.any(tokens(d, t), "x", f"({stem(d, 'x')}) IN ({quoted(words)})")


def is_fact(d, t, words=None): return f"({has_payload(d, t)} OR {marked(d, t, words or V.MARKERS)})"


def frame(d, t):
    """What a fact is about: its stems without what a correction may change, and identifiers as ID:noun#number."""
    low, bound = d.re_sub("lower(x)", "^-+|-+$", ""), d.name == "spark"
    prev = f"lower({d.at('ws', 'i - ' + str(d.first_index))})"
    s = "root" if bound else stem(d, "low")
    topic = " ".join(f"WHEN ({s}) IN ({quoted(g)}) THEN '{k}'" for k, g in V.TOPICS.items())
    first = f"i = {d.first_index}"
    body = (f"CASE WHEN low = '' OR low IN ({quoted(V.STOP)}) THEN NULL "
            f"WHEN {d.re_test('x', '[0-9]')} THEN CASE WHEN {first} THEN concat('ID:#', low) WHEN PREV NOT IN ({quoted(V.STOP + V.DAYS + V.MONTHS)}) AND NOT {d.re_test('PREV', '[0-9]')} THEN concat('ID:', {stem(d, 'PREV')}, '#', low) END "
            f"WHEN low IN ({quoted(V.DAYS + V.MONTHS + V.NUMBERS)}) THEN NULL WHEN NOT ({first}) AND {d.re_test('x', r'^\p{Lu}')} THEN NULL "
            f"WHEN ({s}) IN ({quoted(V.FRAME_DROP)}) THEN NULL WHEN {d.has('low', chr(39) + '-' + chr(39))} AND ({s}) NOT IN ({quoted(V.MARKERS)}) THEN NULL {topic} ELSE {s} END")
    if bound:  # worked out once for each word, not wherever it is named
        body = f"transform(array({low}), low -> transform(array({stem(d, 'low')}), root -> {body})[0])[0]".replace("PREV", f"({prev})").replace("ws", raw_tokens(d, t))
        return d.distinct(d.filter(d.transform_i(raw_tokens(d, t), "x", "i", body), "f", "f IS NOT NULL"))
    body = body.replace("PREV", f"({prev})").replace("low ", f"({low}) ").replace("low,", f"({low}),").replace("low)", f"({low}))").replace("ws", raw_tokens(d, t))
    return d.distinct(d.filter(d.transform_i(raw_tokens(d, t), "x", "i", body), "f", "f IS NOT NULL"))


def identifiers(d, f): return d.filter(f, "x", d.starts("x", "'ID:'"))


def importance(d, t, hits="0"):
    tiers = " ".join(f"WHEN {d.overlap('st', d.array(*(chr(39) + w + chr(39) for w in ws)))} THEN {k}" for k, ws in V.TIERS)
    flagged = d.overlap("st", d.array(*("'" + w + "'" for w in V.FLAGGED)))
    body = f"(CASE {tiers} ELSE 1.0 END) - (CASE WHEN {has_payload(d, t)} THEN 0.0 ELSE 0.5 END) + (CASE WHEN {flagged} THEN 1.0 ELSE 0.0 END) + least(1.0, 0.4 * ln(1 + {hits}))"
    return f"greatest(1.0, least(5.0, {body}))".replace("st,", f"{all_stems(d, t)},")


def word_sub(d, s, p, r, flags=""):
    """Replaces p where it stands as a whole word. Twice, since neighbours share the character between them."""
    for _ in range(2):
        s = d.re_sub(s, rf"{flags}{WORD_START}{p}{WORD_END}", f"{d.group(1)}{r}{d.group(2)}")
    return s


def third_person(d, t, subject="the user"):
    s = f"concat(' ', {t}, ' ')"
    mark = "''" if d.name == "duckdb" else "\\'"
    own, team = f"{subject}{mark}s", f"the team{mark}s"
    for p, r, flags in ((r"I\x27m", f"{subject} is", ""), (r"I\x27ve", f"{subject} has", ""), (r"I\x27ll", f"{subject} will", ""), ("I am", f"{subject} is", ""), ("I have", f"{subject} has", ""), ("I do", f"{subject} does", ""),
                        ("I go", f"{subject} goes", ""), ("we are", "the team is", "(?i)"), ("we have", "the team has", "(?i)"), ("I", subject, ""), ("my", own, "(?i)"), ("mine", own, "(?i)"), ("me", subject, ""),
                        (r"we\x27re", "the team is", "(?i)"), ("we", "the team", "(?i)"), ("our", team, "(?i)")):
        s = word_sub(d, s, p, r, flags)
    who = "the user|the team" + ("" if subject == "the user" else f"|{subject}")
    for _ in range(2):
        s = d.re_sub(s, rf"{WORD_START}({who}) ({'|'.join(V.AGREE)}){WORD_END}", f"{d.group(1)}{d.group(2)} {d.group(3)}s{d.group(4)}")
    return trim(d, d.re_sub(s, r"\s+", " "))


def needs_wide(d, t):
    raw = d.re_all(t, r"[\p{L}\p{N}_]+")
    low = d.re_all(f"lower({t})", r"[\p{L}\p{N}_]+")
    entity = d.any(d.after_first(raw), "x", rf"{d.re_test('x', r'^[A-Z]')} AND lower(x) NOT IN ('i')")
    direct = f"(coalesce({d.at(low, 1)}, '') IN ({quoted(V.WH)}) AND ({entity} OR {d.has(t, possessive(d))}))"
    script = " OR ".join(d.starts("x", f"'{v}'") for v in V.SCRIPT_VERBS)
    return f"(NOT {direct} AND {d.any(low, 'x', f'x IN ({quoted(V.PRONOUNS + V.CONSEQUENCE + V.HYPERNYMS)}) OR {script}')})"


def possessive(d): return f"concat({d.chr(39)}, 's')"


def weave_tokens(d, t): return d.filter(d.transform(d.re_all(f"lower({t})", r"[\p{L}][\p{L}\x27-]+"), "x", d.re_sub("x", r"^[\x27-]+|[\x27-]+$", "")), "x", f"length(x) >= 4 AND x NOT IN ({quoted(V.NOISE)})")


def clip_words(d, t, n=25): return d.join(d.slice(d.filter(d.split(trim(d, t), r"\s+"), "x", "x <> ''"), 1, n), "' '")


def clean_markup(d, t):
    for p, r in ((r"(?s)<!--.*?-->", " "), (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<[^>]*>", " "), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", d.group(1)), (r"https?://[^\s]+", " "), (r"&[a-z]+;|&#[0-9]+;", " "), (r"\s+", " ")):
        t = d.re_sub(t, p, r)
    return trim(d, t)
