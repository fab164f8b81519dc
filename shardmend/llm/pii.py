"""Personal data: rule spans, and a semi-Markov conditional random field over whole-span features.

Rules give the base spans of four kinds. The field is trained here, on zones (runs of tokens with a digit or an
at sign, also one written out, and their neighbours) of a bounded sample of documents. Its labels are the
base spans, and spans that are written into the sampled texts in forms that no rule reads (separators
that rules don't know, at and dot spelled out, numbers that run into each other), with numbers of other
meaning beside them. Its features describe whole candidate segments (groups of digits, checksum,
separators, words before and after). Viterbi with bounded entity length chooses boundaries and kinds
together; spans that the field finds with enough margin, and that overlap no base span, are added. The
margin is chosen on a part of the sample that the field did not learn from.

Null and empty texts have no spans. Texts of any length are read whole; the work grows with the number
of tokens. Offsets count code points, ends exclusive. Rows are independent, so ties, repeated rows and
extra columns need no care; a column of the result's name makes it take leading underscores.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fit_in_one_task, small_batches, spare_name

KINDS = ("email", "ip", "card", "phone")
#: Documents, with digits or an at sign, and zones of them that the field is trained on at most; spans written into each of them.
TRAIN_DOCS, TRAIN_ZONES, WRITTEN = 1500, 12000, 8
#: Tokens of a segment at most, passes over the sample, and size of a step.
MAX_SEGMENT, PASSES, STEP = 8, 4, 0.3
#: Margin of an added span where none has been learned; margins tried; share of the plain numbers that may be taken for a span.
MARGIN, MARGINS, FALSE_SHARE = 4.0, (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), 0.002

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind only spares attempts within a run of digits, where no match can start anew.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the part before an at sign is the run that touches it, from the last match's end on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Rule spans by kind, then start."""
    if not text or not _TELLING.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the field -------------------------------------------------------------------------------------


# At signs and dots that are spelled out, and the shapes of candidates by kind: a segment of another shape is never of the kind.
_HINT = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]|\bdot\b", re.I)
_SPELLED = ("dot", "(at", "[at", "{at", "( at", "[ at", "{ at")
_BRACKETED = re.compile(r"[(\[{](?:at|dot|[.@])[)\]}]", re.I)
_AT = re.compile(r"\s*[(\[{]\s*(?:at|@)\s*[)\]}]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+(?:dot|\.)\s+", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_CARDISH = re.compile(r"[0-9]+(?:[ ._/\u2010-\u2013\xa0-]{1,3}[0-9]+)*")
_PHONEISH = re.compile(r"[+(]?[0-9]+(?:[ ()./\u2010-\u2013\xa0-]{1,3}[0-9]+)*")
_GROUPS = re.compile(r"[0-9]+")
#: Neighbouring tokens are this many characters apart at most.
NEAR = 3


def hinted(text: str) -> bool:
    """Whether a text can hold any span at all."""
    if _TELLING.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _SPELLED)


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that tell of a span (those beside an at sign or a spelled-out dot, too), trimmed of edge signs."""
    telling: dict[int, int] = {}

    def token(at: int) -> tuple[int, int]:
        a = b = at
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        return a, b

    at = 0
    # only the neighbourhood of digits and at signs is split into tokens
    for m in _HINT.finditer(text):
        digit = "0" <= m[0] <= "9"
        if m.start() < at and digit:
            continue
        a, b = token(m.start()) if m.start() >= at else (last, at)
        last, at = a, max(at, b)
        telling[a] = b
        if not digit:
            if m.end() > b:  # a bracketed word with spaces inside
                for x in (a2 for a2 in range(b, m.end()) if not text[a2].isspace()):
                    c, d = token(x)
                    telling[c] = d
                    b = d
            before, after = a - 1, b
            while before >= 0 and a - before <= NEAR and text[before].isspace():
                before -= 1
            if before >= 0 and not text[before].isspace() and a - before <= NEAR:
                c, d = token(before)
                telling.setdefault(c, d)
            while after < len(text) and after - b < NEAR and text[after].isspace():
                after += 1
            if after < len(text) and not text[after].isspace():
                c, d = token(after)
                telling.setdefault(c, d)
    group: list[tuple[int, int]] = []
    for s in sorted(telling.items()):
        if group and s[0] - group[-1][1] > NEAR:
            if tokens := _edges(text, group):
                yield tokens
            group = []
        group.append(s)
    if group and (tokens := _edges(text, group)):
        yield tokens


def _edges(text: str, group: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in group:
        if not _BRACKETED.fullmatch(text, a, b):
            while a < b and text[a] in "\"'([{<,;:!?.":
                if text[a] == "(" and any("0" <= c <= "9" for c in text[a:b]):
                    break
                a += 1
            while b > a and not text[b - 1].isalnum() and text[b - 1] not in "_-+":
                if text[b - 1] == ")" and "(" in text[a:b]:
                    break
                b -= 1
        if a < b:
            out.append((a, b))
    return out


def word_before(text: str, start: int) -> str:
    m = re.search(r"(\w+)\W*$", text[max(0, start - 24) : start])
    return m[1].lower() if m else ""


def word_after(text: str, end: int) -> str:
    m = re.match(r"\W*(\w+)", text[end : end + 24])
    return m[1].lower() if m else ""


def kinds_of(s: str) -> tuple[str, ...]:
    """Kinds whose shape a segment has; the field chooses among them."""
    n = len(_digits(s))
    out = []
    if len(s) <= 320 and _AT.search(s) and _MAIL.fullmatch(_DOT.sub(".", _AT.sub("@", s))):
        out.append("email")
    if 4 <= n <= 12 and _QUAD.fullmatch(_DOT.sub(".", s)):
        out.append("ip")
    if 13 <= n <= 19 and _CARDISH.fullmatch(s):
        out.append("card")
    if 9 <= n <= 15 and _PHONEISH.fullmatch(s):
        out.append("phone")
    return tuple(out)


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole candidate segment, before they are joined with its kind."""
    s = text[a:b]
    d = _digits(s)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    groups = "-".join(str(len(g)) for g in _GROUPS.findall(s)[:9])
    between = "".join(sorted(set(re.sub(r"[0-9]+", "", s)))) if len(d) > 6 else ""
    out = ["bias", f"n={min(len(d), 20)}", f"shape={shape[:16]}", f"groups={groups}", f"form={shape[:16]}|{groups}", f"plus={s[:1] == '+'}", f"at={min(s.count('@'), 2)}", f"gaps={min(s.count(' '), 4)}", f"dots={min(s.count('.'), 5)}", f"between={between[:8]}", f"zero={s[:2] == '00'},{s[:1] == '0'},{s[:1] == '('}"]
    if 13 <= len(d) <= 19:
        out.append(f"card={luhn(d)},{len(re.sub('[0-9 -]', '', s)) == 0}")
        out.append(f"luhn={luhn(d)}")
    if 4 <= len(d) <= 12 and _QUAD.fullmatch(q := _DOT.sub(".", s)):
        out.append(f"quad={all(int(x) < 256 for x in q.split('.'))}")
    if _AT.search(s):
        out.append(f"mail={bool(_MAIL.fullmatch(_DOT.sub('.', _AT.sub('@', s))))}")
    if 9 <= len(d) <= 15:
        out.append(f"tel={s[0] == '+'},{len(re.sub('[0-9 ().+-]', '', s)) == 0}")
    # the neighbourhood says less than the segment, and its words are many
    out.append(f"before={word_before(text, a)[:6]}")
    out.append(f"next={_kind_of_word(word_after(text, b))},{_kind_of_word(word_before(text, a))}")
    return out


def _kind_of_word(w: str) -> str:
    return "" if not w else "9" if w.isdigit() else "a" if w.isalpha() else "x"


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[tuple[str, ...], list[str]]]:
    """(kinds, features) of each segment i..j of at most MAX_SEGMENT tokens that has the shape of a kind, and of each single token."""
    out = {}
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + MAX_SEGMENT) + 1):
            kinds = kinds_of(text[tokens[i][0] : tokens[j - 1][1]])
            if kinds or j == i + 1:
                out[i, j] = kinds, segment_features(text, tokens[i][0], tokens[j - 1][1])
    return out


def potentials(w: dict, cands: dict) -> dict[tuple[int, int, str], float]:
    out = {}
    for (i, j), (kinds, feats) in cands.items():
        for kind in kinds:
            out[i, j, kind] = sum(w.get(f"{kind}|{f}", 0.0) for f in feats)
        if j == i + 1:
            out[i, j, "O"] = sum(w.get(f"O|{f}", 0.0) for f in feats)
    return out


def _lse(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def fit_field(examples: list[tuple[dict, list[tuple[int, int, str]], int]]) -> dict[str, float]:
    """Stochastic gradient ascent on the conditional log-likelihood; forward and backward sums run over segmentations."""
    w: dict[str, float] = defaultdict(float)
    for step in range(PASSES):
        rate = STEP / (1 + step)
        for cands, gold, n in examples:
            pot = potentials(w, cands)
            ends, starts = defaultdict(list), defaultdict(list)
            for (i, j, k), v in pot.items():
                ends[j].append((i, k, v))
                starts[i].append((j, k, v))
            fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                fwd[j] = _lse([fwd[i] + v for i, _, v in ends[j]])
            for i in range(n - 1, -1, -1):
                bwd[i] = _lse([bwd[j] + v for j, _, v in starts[i]])
            for i, j, k in gold:
                for f in cands[i, j][1]:
                    w[f"{k}|{f}"] += rate
            for (i, j, k), v in pot.items():
                p = math.exp(min(0.0, fwd[i] + v + bwd[j] - fwd[n]))
                if p > 1e-4:
                    for f in cands[i, j][1]:
                        w[f"{k}|{f}"] -= rate * p
    return {k: v for k, v in w.items() if abs(v) > 1e-3}


def gold_segments(text: str, tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]] | None:
    """Spans as segments of tokens; None where one doesn't start and end with tokens, or has not its kind's shape."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    out, taken = [], set()
    for kind, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):  # longer ones first
        if b <= tokens[0][0] or a >= tokens[-1][1]:
            continue
        if a not in starts or b not in ends or not 0 < ends[b] - starts[a] <= MAX_SEGMENT or kind not in kinds_of(text[a:b]):
            return None
        seg = range(starts[a], ends[b])
        if not taken & {*seg}:
            taken |= {*seg}
            out.append((seg[0], seg[-1] + 1, kind))
    return out + [(i, i + 1, "O") for i in range(len(tokens)) if i not in taken]


def scored_segments(text: str, tokens: list[tuple[int, int]], w: dict) -> list[tuple[str, int, int, float]]:
    """Entities of the best segmentation, each with its margin over reading its tokens as plain ones.

    Only stretches of tokens that some candidate covers are walked: all others are plain. Segments have
    MAX_SEGMENT tokens at most, so the work grows with the run, however long.
    """
    pot: dict[tuple[int, int], list[tuple[str, float]]] = {}
    ends = [0] * (len(tokens) + 1)  # of the tokens that a candidate which starts here or before covers
    digits = [0]
    for a, b in tokens:
        digits.append(digits[-1] + sum("0" <= c <= "9" for c in text[a:b]))
    spelled = [bool(_AT.search(text, a, tokens[t + 1][0] if t + 1 < len(tokens) else b)) for t, (a, b) in enumerate(tokens)]
    for i in range(len(tokens)):
        mail = False
        for j in range(i + 1, min(len(tokens), i + MAX_SEGMENT) + 1):
            mail = mail or spelled[j - 1]
            n = digits[j] - digits[i]
            if not mail and not 4 <= n <= 19:
                if n > 19:
                    break
                continue
            a, b = tokens[i][0], tokens[j - 1][1]
            if kinds := kinds_of(text[a:b]):
                feats = segment_features(text, a, b)
                pot[i, j] = [(k, sum(w.get(f"{k}|{f}", 0.0) for f in feats)) for k in kinds]
                ends[i] = max(ends[i], j)
    out, i = [], 0
    while i < len(tokens):
        stop = ends[i]
        if not stop:
            i += 1
            continue
        k = i
        while k < stop:
            stop = max(stop, ends[k])
            k += 1
        plain = [sum(w.get(f"O|{f}", 0.0) for f in segment_features(text, *tokens[t])) for t in range(i, stop)]
        best: list[tuple[float, int, str, float]] = [(0.0, i, "O", 0.0)]
        for j in range(i + 1, stop + 1):
            top = (best[-1][0] + plain[j - 1 - i], j - 1, "O", plain[j - 1 - i])
            for h in range(max(i, j - MAX_SEGMENT), j):
                for kind, v in pot.get((h, j), ()):
                    if best[h - i][0] + v > top[0]:
                        top = (best[h - i][0] + v, h, kind, v)
            best.append(top)
        j, found = stop, []
        while j > i:
            _, h, kind, v = best[j - i]
            if kind != "O":
                found.append((kind, tokens[h][0], tokens[j - 1][1], v - sum(plain[h - i : j - i])))
            j = h
        out += found[::-1]
        i = stop
    return out


def decode(text: str, tokens: list[tuple[int, int]], w: dict) -> list[tuple[str, int, int]]:
    """Best segmentation's entities that have the margin learned, or MARGIN."""
    least = w.get("margin", MARGIN)
    return [(k, a, b) for k, a, b, m in scored_segments(text, tokens, w) if m >= least]


def all_spans(text: str | None, w: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, base and added), each by kind as listed, then start."""
    base = base_spans(text)
    if not text or not hinted(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for tokens in zones(text):
        if free := _free(tokens, taken):
            # a segment may not run over a base span, so each run of free tokens is decoded alone
            run = [free[0]]
            for s in free[1:]:
                k = bisect_left(taken, (run[-1][1], -1))
                if s[0] - run[-1][1] > NEAR + 2 or k < len(taken) and taken[k][0] < s[0]:
                    added += decode(text, run, w)
                    run = []
                run.append(s)
            added += decode(text, run, w)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def _free(tokens: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens that overlap no taken span; both lists are sorted."""
    starts, tops, top = [x for x, _ in taken], [], 0
    for _, y in taken:
        top = max(top, y)
        tops.append(top)
    return [(a, b) for a, b in tokens if not (k := bisect_left(starts, b)) or tops[k - 1] <= a]


# --- what the field learns from -------------------------------------------------------------------


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _card(rng: random.Random) -> str:
    d = _number(rng, rng.choice((15, 16, 16, 16, 16)) - 1)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _in_groups(digits: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return by.join(out)


def written_span(rng: random.Random) -> tuple[str, str]:
    """(kind, text) of a made-up span in a form that the rules don't read, or read only where it stands alone."""
    kind = rng.choice(KINDS)
    if kind == "email":
        letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        name, host, top = letters(rng.randint(2, 9)) + rng.choice(("", ".", "_")) + _number(rng, 2) * rng.randint(0, 1) + letters(2), letters(rng.randint(3, 8)), rng.choice(("com", "org", "net", "example.com", "de", "fr"))
        at = rng.choice((" (at) ", "(at)", " [at] ", "[at]", " @ ", "@ ", " @", " {at} ", " at "))
        spell = at == " at " or rng.random() < 0.6  # a bare word says too little without the dot's
        dot = rng.choice((" dot ", " (dot) ", "(dot)", " [dot] ", "[dot]", "[.]")[0 if at == " at " else 1 :]) if spell else "."
        return kind, (name.replace(".", "") if spell else name) + at + (host + "." + top).replace(".", dot)
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return kind, rng.choice(("[.]", "(.)", " . ", "[dot]", " dot ", "(dot)")).join(parts)
    if kind == "card":
        d = _card(rng)
        sizes = (4, 4, 4, 4) if len(d) == 16 else (4, 6, 5)
        return kind, rng.choice((_in_groups(d, sizes, rng.choice((".", "/", "_", " - ", "  ", "\u2013", "\xa0", " / "))), d, _in_groups(d, sizes, rng.choice(" -"))))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    form = rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "1-{a}-{b}-{c}", "00{x} {a} {b}{c}", "001 {a} {b} {c}", "+{x} {a}/{b}{c}", "({a}) {b} {c}", "0{y}/{b}{c}", "+{x} ({a}) {b}/{c}", "+{x} ({a}) {b}-{c}"))
    return kind, form.format(a=a, b=b, c=c, x=_number(rng, rng.randint(1, 2)), y=_number(rng, 3))


def written_number(rng: random.Random) -> str:
    """A number that is none of the kinds."""
    n = lambda k: _number(rng, k)
    year, month, day = rng.randint(1900, 2040), rng.randint(1, 12), rng.randint(1, 28)
    d = n(16)
    odd = d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)
    forms = (
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d} {day:02d}:{month:02d}:00", f"{n(1)} {n(3)} {n(3)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}",
        n(rng.randint(9, 12)), odd, odd[: rng.randint(13, 15)] if not luhn(odd[:13]) and not luhn(odd[:14]) and not luhn(odd[:15]) else n(7), _in_groups(odd, (4, 4, 4, 4), rng.choice(" -./")), f"{year} {year + 1} {year + 2}", " ".join(n(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))), f"{year}-{year + 9}",
        f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(3)}.{n(3)}.{n(3)}", f"@{''.join(rng.choice('abcdef') for _ in range(5))}", f"v{n(1)}.{n(1)}", f"{n(2)} @ {n(2)}", "at 5 dot 30", f"{n(3)}.{n(1)} {n(3)}.{n(1)} {n(3)}.{n(1)}",
    )
    return rng.choice(forms)


def written_text(text: str, rng: random.Random, n: int = WRITTEN) -> tuple[str, list[tuple[str, int, int]]]:
    """(text, spans): a text with made-up spans and numbers put at some of its spaces, and all its spans, its own base spans included."""
    own = base_spans(text)
    gaps = [m.start() for m in re.finditer(" ", text)]
    free = [g for g in gaps if not any(a - 3 <= g <= b + 2 for _, a, b in own)]
    out, spans, at, size = [], [], 0, 0
    for g in [*sorted(rng.sample(free, min(n, len(free)))), len(text)]:
        spans += [(kind, a - at + size, b - at + size) for kind, a, b in own if at <= a < g]
        out.append(text[at:g])
        size += g - at
        at = g
        if g == len(text):
            break
        for _ in range(rng.choice((1, 1, 1, 2))):  # of two that stand side by side greedy rules make one
            if rng.random() < 0.55:
                kind, piece = written_span(rng)
                spans.append((kind, size + 1, size + 1 + len(piece)))
            else:
                piece = written_number(rng)
            out.append(" " + piece)
            size += 1 + len(piece)
    return "".join(out), spans


def examples_of(text: str, seed: int) -> Iterator[tuple[str, list[tuple[int, int]], list[tuple[int, int, str]]]]:
    """(text, tokens, gold segments) of zones: of the text as it is, and with spans written into it."""
    for t, spans in ((text, base_spans(text)), written_text(text, random.Random(seed))):
        for tokens in zones(t):
            for k in range(0, len(tokens), 16):
                part = tokens[k : k + 16]
                if (gold := gold_segments(t, part, spans)) is not None:
                    yield t, part, gold


def learned(texts: list[str], most: int = TRAIN_ZONES) -> dict[str, float]:
    """Weights and margin from texts; their order does not matter."""
    found, rng = [], random.Random(3)
    for text in sorted(texts):
        found += examples_of(text, xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")))
    rng.shuffle(found)
    found = found[:most]
    if not found:
        return {}
    apart, taught = found[: len(found) // 5], found[len(found) // 5 :]
    w = fit_field([(candidates(t, tokens), gold, len(tokens)) for t, tokens, gold in taught])
    # the least margin at which hardly any plain token is taken for a span
    false, plain = [], 0
    for t, tokens, gold in apart:
        true = {(k, tokens[i][0], tokens[j - 1][1]) for i, j, k in gold}
        plain += sum(k == "O" for *_, k in gold)
        false += [m for k, a, b, m in scored_segments(t, tokens, w) if (k, a, b) not in true]
    w["margin"] = next((m for m in MARGINS if sum(x >= m for x in false) <= FALSE_SHARE * plain), MARGINS[-1])
    return w


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> dict[str, float]:
    """Weights from at most about `rows` documents that hold a digit or an at sign."""
    small_batches(docs.sparkSession)
    sample = bounded_sample(docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")), rows)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = learned([text for pdf in batches for text in pdf.text])
        yield pd.DataFrame({"feature": [*w], "weight": [*w.values()]}).astype({"feature": object, "weight": float})

    return dict(map(tuple, fit_in_one_task(sample, fit, "feature string, weight double")))


def find_spans(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """docs with a struct column `pii`: base and spans (arrays of kind, start, end) and their digests."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, spans {span}, base_sha256 string, joined string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                base, spans = all_spans(t, w)
                say = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
                as_rows = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
                rows.append((as_rows(base), as_rows(spans), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            yield pd.DataFrame(rows, columns=["base", "spans", "base_sha256", "joined"])

    return docs.withColumn(spare_name(docs, "pii"), found(F.col(text)))


def mask_text(text: str | None, spans: list) -> str | None:
    """Each span replaced by its kind in brackets; overlapping spans are joined under the first one's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """docs, its text with all spans masked and n_chars (where it has it) set to the new length."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask_text(t, all_spans(t, shared.value)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def count_kind(pii, kind: str):
    return F.size(F.filter(pii["base"], lambda s: s["kind"] == kind)).cast("long")
