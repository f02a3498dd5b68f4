"""Personal data by rules and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.
A semi-Markov model adds spans that the patterns miss, of the same kinds and of
two more (secret, iban): spelled-out addresses, numbers without a country code,
numbers run together, IPv6 whole or compressed, keys and account numbers.  Near
a trigger (a digit, an at sign or the word "at", two colons) every run of
tokens of at most `MAX_SPAN` code points that has the letters, digits and
separators of a kind is a candidate segment, so neighbouring boundaries compete.
Segments are scored as whole spans (shape, length, checksums, separators, what
they cut off, the words around them) for each kind, text outside a segment
scores 0, and dynamic programming picks the best set of boundaries and kinds.
As everything outside candidates scores 0 whatever its division, the programme
needs to visit the candidates' ends only, and the result is that of the
programme over all positions.

The potentials are fitted by conditional likelihood on the corpus itself.  No
table marks spans, so examples are made from base spans of a bounded sample of
documents (`sample_rows`): each is rewritten in its own surroundings to a form
that the patterns miss (the segment to find) or to one that only looks like it
(a wrong check digit, a number without any cue: nothing to find).  At most
about `sample_examples` different lattices, chosen by a hash, are fitted to.  A
Gaussian prior around stated potentials keeps what such examples cannot tell.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize, sampled

KINDS = ("email", "ip", "card", "phone")
#: The kinds that the model knows; spans are ordered by start, then kind as listed.
ALL_KINDS = (*KINDS, "secret", "iban")
MAX_SPAN = 80

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from within: the look-behind only saves the retries
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        elif start < at:
            end = max(end, at)  # what was walked over isn't walked over again: an @ ends every local part
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by kind, each leftmost and non-overlapping within its kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        octet = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m.groups()))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


_TRIGGER = re.compile(r"[0-9]|@|::|\bat\b", re.I)
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_HEX = re.compile(r"[0-9A-Fa-f]{1,4}")
_AT_WORDS, _DOT_WORDS = {"at", "@"}, {"dot", "."}
_OPEN, _CLOSE = set("[({<"), set("])}>")
#: Marks that may stand between the digits of one number.
_JOINS = set("-./()_\u2013")
_CUES = {
    "email": {"mail", "email", "e-mail", "contact", "courriel", "correo", "write", "reach"},
    "ip": {"ip", "address", "server", "host", "ipv6", "ipv4", "adresse", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "cc", "amex"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone", "whatsapp", "sms", "ring"},
    "secret": {"token", "key", "secret", "password", "passwort", "apikey", "api_key", "bearer", "credential"},
    "iban": {"iban", "account", "konto", "compte", "cuenta"},
}
_DATES = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}")
FEATURES = [
    "bias", "cue", "other cue", "separators agree", "brackets", "spelled", "checksum", "length", "area in brackets", "prefix", "leading zero", "touches symbols",
    "all one digit", "cuts digits off", "cuts words off", "date", "even groups", "letters and digits", "only hex", "plain run",
]
_AT = {f: i for i, f in enumerate(FEATURES)}

#: Means of the prior.
PRIOR: dict[str, dict[str, float]] = {
    "email": {"bias": -2.5, "brackets": 4.0, "cue": 3.0, "other cue": -1.0, "length": 1.0, "cuts words off": -4.0, "spelled": -1.0, "even groups": 1.5},
    "ip": {"bias": -3.0, "cue": 2.5, "all one digit": -2.0, "length": 4.0, "brackets": 1.0, "cuts digits off": -6.0, "cuts words off": -5.0, "only hex": 1.0},
    "card": {"bias": -6.5, "checksum": 4.5, "length": 1.5, "cue": 2.0, "separators agree": 1.0, "even groups": 1.0, "plain run": 1.0, "other cue": -2.0, "all one digit": -6.0, "cuts digits off": -2.5, "date": -3.0, "touches symbols": -2.0},
    "phone": {
        "bias": -5.0, "length": 1.5, "cue": 3.5, "area in brackets": 2.5, "separators agree": 0.75, "prefix": 1.5, "leading zero": 0.5, "even groups": 1.0, "other cue": -2.5, "touches symbols": -3.0,
        "checksum": -0.5, "all one digit": -4.0, "cuts digits off": -4.0, "date": -4.0,
    },
    "secret": {"bias": -4.0, "cue": 3.5, "letters and digits": 1.0, "length": 1.5, "only hex": 0.0, "other cue": -1.0, "cuts words off": -3.0},
    "iban": {"bias": -4.0, "checksum": 6.0, "cue": 1.0, "length": 1.0, "cuts digits off": -2.0, "cuts words off": -2.0, "even groups": 0.5},
}
SAMPLE_ROWS, SAMPLE_EXAMPLES = 5000, 500
#: Precision of the prior, and steps of the fit.
PRECISION, FIT_STEPS = 4.0, 80
#: Code points kept on either side of a rewritten span.
AROUND = 50

Token = tuple[int, int, str]
Segment = tuple[int, int, int, tuple[int, ...]]


def _weights(potentials: dict[str, dict[str, float]]) -> np.ndarray:
    return np.array([[potentials[k].get(f, 0.0) for f in FEATURES] for k in ALL_KINDS])


def _number(token: str) -> bool:
    return token.isascii() and token.isdigit()


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every segment with a trigger in it, widened to white space where that is near."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        if m.start() - MAX_SPAN > hi:
            if hi >= 0:
                yield lo, hi
            lo = max(0, m.start() - MAX_SPAN)
            lo = text.rfind(" ", max(0, lo - MAX_SPAN), lo) + 1 or lo
        hi = min(len(text), m.end() + MAX_SPAN)
    if hi >= 0:
        yield lo, hi


def _numbers(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, int, str]]:
    """Phone and card segments that begin with token i."""
    lo, _, first = tokens[i]
    if not (_number(first) or first in ("+", "(") and i + 1 < len(tokens) and _number(tokens[i + 1][2])):
        return
    digits = marks = groups = 0
    for j in range(i, len(tokens)):
        start, end, t = tokens[j]
        if j > i and (gap := text[tokens[j - 1][1] : start]) and gap not in (" ", "\u00a0"):
            return
        if _number(t):
            digits, marks, groups = digits + len(t), 0, groups + 1
            if digits > 19 or groups > 7 or end - lo > MAX_SPAN:
                return
            if digits >= 12:
                yield lo, end, "card"
            if 7 <= digits <= 15:
                yield lo, end, "phone"
        elif j > i and t not in _JOINS or (marks := marks + 1) > 2:
            return


def _addresses(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, int, str]]:
    """IP segments that begin with token i: IPv6 groups, or four small numbers with more than a dot between them."""
    lo, end, first = tokens[i]
    if _HEX.fullmatch(first) or first == ":" and i + 1 < len(tokens) and tokens[i + 1][:1] == (end,) and tokens[i + 1][2] == ":":
        groups, colons, double = 0, 0, 0
        for j in range(i, len(tokens)):
            start, stop, t = tokens[j]
            if j > i and start != tokens[j - 1][1]:
                break
            if t == ":":
                colons += 1
                double += colons == 2
                if colons > 2 or double > 1:
                    break
            elif _HEX.fullmatch(t) and (j == i or colons):
                groups, colons = groups + 1, 0
            else:
                break
            if groups > 8:
                break
            if groups == 8 and not double and not colons or double and colons != 1 and 1 <= groups <= 7:
                yield lo, stop, "ip"
    if _number(first) and len(first) <= 3 and int(first) <= 255:
        parts, marked, j = 1, False, i + 1
        while parts < 4:
            between, wide = [], j
            while j < len(tokens) and j - wide < 3 and not _number(tokens[j][2]):
                between.append(tokens[j][2].lower())
                j += 1
            core = [t for t in between if t not in _OPEN and t not in _CLOSE]
            if len(core) != 1 or core[0] not in _DOT_WORDS or j >= len(tokens) or len(tokens[j][2]) > 3 or not _number(tokens[j][2]) or int(tokens[j][2]) > 255:
                return
            marked |= len(between) > 1 or core[0] == "dot" or text[tokens[wide - 1][1] : tokens[j][0]] != "."
            parts, j = parts + 1, j + 1
        if marked and tokens[j - 1][1] - lo <= MAX_SPAN and "\n" not in text[lo : tokens[j - 1][1]]:
            yield lo, tokens[j - 1][1], "ip"


def _mails(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, int, str]]:
    """Address segments around an at sign or the word, token i, bare or in brackets."""
    if tokens[i][2].lower() not in _AT_WORDS:
        return
    left, right = i - 1, i + 1
    if left >= 0 and right < len(tokens) and tokens[left][2] in _OPEN and tokens[right][2] in _CLOSE:
        left, right = left - 1, right + 1
    starts, near = [], left
    while near >= 0 and len(starts) < 6 and tokens[near][2].isalnum():
        starts.append(tokens[near][0])
        joined = near >= 2 and tokens[near - 1][2] in "._%+-" and tokens[near - 1][1] == tokens[near][0] and tokens[near - 2][1] == tokens[near - 1][0]
        said = near >= 2 and tokens[near - 1][2].lower() == "dot"
        if not joined and not said:
            break
        near -= 2
    ends, j = [], right
    while starts and j < len(tokens) and len(ends) < 5 and tokens[j][2].isalnum():
        while j + 2 < len(tokens) and tokens[j + 1][2] == "-" and tokens[j + 2][2].isalnum():
            j += 2
        if j > right and tokens[j][2].isalpha() and 2 <= len(tokens[j][2]) <= 24:
            ends.append(tokens[j][1])
        k = j + 1
        bracket = k < len(tokens) and tokens[k][2] in _OPEN
        k += bracket
        if k >= len(tokens) or tokens[k][2].lower() not in _DOT_WORDS:
            break
        k += 1
        if bracket:
            if k >= len(tokens) or tokens[k][2] not in _CLOSE:
                break
            k += 1
        j = k
    for lo in starts:
        for hi in ends:
            if hi - lo <= MAX_SPAN and "\n" not in text[lo:hi]:
                yield lo, hi, "email"


def _keys(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, int, str]]:
    """Secret and account-number segments that begin with token i."""
    lo, end, first = tokens[i]
    if first.isascii() and first.isalnum():
        j = i
        while True:  # tokens that marks join without white space
            stop = tokens[j][1]
            run = text[lo:stop]
            if 16 <= len(run) <= MAX_SPAN and re.search("[0-9]", run) and re.search("[A-Za-z]", run):
                yield lo, stop, "secret"
            if len(run) > MAX_SPAN or j + 2 >= len(tokens) or tokens[j + 1][2] not in "_-+/=." or tokens[j + 1][0] != stop or tokens[j + 2][0] != tokens[j + 1][1] or not tokens[j + 2][2].isalnum():
                break
            j += 2
    if re.match(r"[A-Z]{2}[0-9]{2}", first):
        size = 0
        for j in range(i, len(tokens)):
            start, stop, t = tokens[j]
            if not re.fullmatch(r"[A-Z0-9]+", t) or j > i and text[tokens[j - 1][1] : start] not in (" ", "") or size + len(t) > 34:
                return
            size += len(t)
            if size >= 15:
                yield lo, stop, "iban"


def _mod97(account: str) -> bool:
    """The check digits of an account number are right."""
    said = re.sub("[^0-9A-Z]", "", account)
    return said.isascii() and int("".join(str(int(c, 36)) for c in said[4:] + said[:4])) % 97 == 1


def _between_cards(text: str, lo: int, hi: int) -> bool:
    """What stands next to a number, one space off, are numbers as long as a card's, if any."""
    before, after = re.search(r"([0-9]+) ?$", text[max(0, lo - 21) : lo]), re.match(r" ?([0-9]+)", text[hi : hi + 21])
    return text[lo - 1 : lo] in ("", " ") and text[hi : hi + 1] in ("", " ") and all(m is None or 12 <= len(m[1]) <= 19 for m in (before, after))


def _features(kind: str, text: str, lo: int, hi: int) -> tuple[int, ...]:
    """Whole-span features of text[lo:hi] as a segment of the kind that are on."""
    span = text[lo:hi]
    digits = re.sub("[^0-9]", "", span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before = {w for x in text[max(0, lo - 40) : lo].split()[-3:] for w in (x.strip(".:,;()=\"'").lower(), x.strip(".:,;()=\"'").lower().removesuffix("s"), x.split("=")[0].lower())}
    left, right = text[max(0, lo - 3) : lo], text[hi : hi + 3]
    marks = set(re.sub(r"[\w()+]", "", span)) | ({"_"} if "_" in span else set())
    number = kind in ("phone", "card")
    lower = span.lower()
    on = {
        "bias": True,
        "cue": not before.isdisjoint(_CUES[kind]),
        "other cue": before.isdisjoint(_CUES[kind]) and any(not before.isdisjoint(cues) for cues in _CUES.values()),
        "separators agree": len(marks) == 1,
        "brackets": bool(re.search(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]", lower)),
        "spelled": bool(re.search(r"\s(?:at|dot)\s", lower)),
        "checksum": luhn(digits) if number and len(digits) >= 12 else kind == "iban" and _mod97(span),
        "length": {"phone": 9 <= len(digits) <= 13, "card": len(digits) in (13, 14, 15, 16, 19), "secret": hi - lo >= 20, "ip": len(re.sub("[^0-9A-Fa-f]", "", span)) >= 8 or span.count(":") == 7 or ":" not in span, "iban": len(re.sub(r"\W", "", span)) >= 18}.get(kind, True),
        "area in brackets": bool(re.match(r"\([0-9]{2,4}\)", span)),
        "prefix": span.startswith(("00", "+")),
        "leading zero": span.startswith(("0", "(0")),
        "touches symbols": right[:1] in tuple("%$=/€£") or left[-1:] in tuple("%$=/#€£"),
        "all one digit": len(set(digits)) == 1,
        "cuts digits off": bool(re.search(r"[0-9][ .,:/_()+-]{0,2}$", left) or re.match(r"[ .,:/_()+-]{0,2}[0-9]", right)) and not (kind == "card" and not marks and _between_cards(text, lo, hi)),
        "cuts words off": bool(re.search(r"[\w][.:_%+-]?$", left) or re.match(r"[.:_%+-]?\w", right)),
        "date": bool(_DATES.search(span)),
        "even groups": len(groups) > 1 and (set(groups) == {4} if kind == "card" else set(groups) <= {2, 3, 4}) if number else kind == "email" and bool(re.search(r"(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$", lower)) or kind == "iban" and " " in span,
        "letters and digits": bool(digits) and len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", span)) >= 4,
        "only hex": bool(re.fullmatch(r"[0-9A-Fa-f:]+", span)),
        "plain run": not marks,
    }
    return tuple(_AT[f] for f, v in on.items() if v)


def _segments(text: str, base: list[Span]) -> list[Segment]:
    """Candidate segments clear of the base spans: (end, start, kind, features that are on), by end."""
    taken = sorted((lo, hi) for _, lo, hi in base)
    starts = [lo for lo, _ in taken]
    reach, top = [], 0
    for _, hi in taken:
        top = max(top, hi)
        reach.append(top)
    out: dict[tuple[int, int, int], tuple[int, ...]] = {}
    for begin, end in _windows(text):
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, begin, end)]
        for i in range(len(tokens)):
            for make in (_numbers, _addresses, _mails, _keys):
                for lo, hi, kind in make(text, tokens, i):
                    k = bisect.bisect_left(starts, hi)
                    if not (k and reach[k - 1] > lo) and (hi, lo, ALL_KINDS.index(kind)) not in out:
                        out[hi, lo, ALL_KINDS.index(kind)] = _features(kind, text, lo, hi)
    return [(*k, out[k]) for k in sorted(out)]


def decode(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans that the model adds: the set of segments, clear of each other and of the base spans, that scores most."""
    if not _TRIGGER.search(text):
        return []
    potentials = weights.tolist()
    # a segment below 0 is never better than no segment
    segments = [(hi, lo, kind, score) for hi, lo, kind, on in _segments(text, base) if (score := sum(map(potentials[kind].__getitem__, on))) > 0]
    ends = [s[0] for s in segments]
    best, back = [0.0], [None]  # over the first j segments by end
    for j, (_hi, lo, _kind, score) in enumerate(segments):
        i = bisect.bisect_right(ends, lo, 0, j)
        with_it = best[i] + score
        best.append(max(best[j], with_it))
        back.append(i if with_it > best[j] else None)
    out, j = [], len(segments)
    while j:
        if back[j] is None:
            j -= 1
        else:
            hi, lo, kind, _ = segments[j - 1]
            out.append((ALL_KINDS[kind], lo, hi))
            j = back[j]
    return out


def _rewrites(kind: str, span: str) -> list[tuple[str, str, str | None]]:
    """Forms of a base span that the patterns miss: (text before, form, its kind or None if it is nothing to find)."""
    digits = re.sub("[^0-9]", "", span)
    seed = hashlib.sha1(span.encode("utf-8", "surrogatepass")).hexdigest()
    if kind == "email":
        local, domain = span.split("@")
        spelled = domain.replace(".", " dot ")
        return [
            ("", f"{local} [at] {domain}", kind), ("", f"{local} (at) {domain.replace('.', ' (dot) ')}", kind), ("email ", f"{local} at {spelled}", kind), ("mail ", f"{local} @ {domain}", kind),
            ("look at ", "that dot there", None), ("token = ", seed, "secret"), ("commit ", seed, None),
        ]
    if kind == "ip":
        groups = [f"{(int(p) * 257 + 4369 * i) & 0xFFFF or 1:x}" for i, p in enumerate(span.split(".") * 2)]
        return [("", ":".join(groups), kind), ("", f"2001:{groups[0]}::{groups[1]}", kind), ("", span.replace(".", "[.]"), kind), ("at ", "12:34:56", None), ("", f"ab::{groups[2]}:{groups[3]}", kind)]
    if kind == "card":
        if len(digits) != 16:
            return []
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        iban = next(f"DE{c:02d}{digits}00" for c in range(2, 99) if _mod97(f"DE{c:02d}{digits}00"))
        return [
            *(("card ", re.sub("(.{4})(?=.)", rf"\1{mark}", d), kind if d == digits else None) for d in (digits, wrong) for mark in (".", "_")),
            ("", iban, "iban"), ("iban ", re.sub("(.{4})(?=.)", r"\1 ", iban), "iban"), ("", iban[:-1] + "7", None), ("order ", wrong, None),
        ]
    own = digits[-10:]
    if len(own) < 10:
        return []
    spaced = f"{own[:3]} {own[3:6]} {own[6:]}"
    pairs = " ".join(["0" + own[1]] + [own[i : i + 2] for i in range(2, 10, 2)])
    return [
        ("", f"({own[:3]}) {own[3:6]}-{own[6:]}", kind), ("tel ", spaced, kind), ("call ", f"00{digits}", kind), ("tel ", f"0{own[:9]}", kind), ("tel ", pairs, kind), ("phone ", own, kind),
        ("about ", spaced, None), ("", f"{spaced}%", None), ("on ", "2024-01-15", None), ("", own, None), ("sum ", f"{own[:1]},{own[1:4]},{own[4:7]}.{own[7:9]}", None),
    ]


Example = list[tuple[int, int, int, tuple[int, ...], bool]]


def examples(text: str) -> Iterator[Example]:
    """Candidate segments of rewritten surroundings, each with whether it is to be found; placed from the first one on, so that equal lattices are equal."""
    base = base_spans(text)
    for kind, lo, hi in base:
        if any(lo < b and a < hi for k, a, b in base if (k, a, b) != (kind, lo, hi)):
            continue
        for before, form, gold in _rewrites(kind, text[lo:hi]):
            head = f"{text[max(0, lo - AROUND) : lo]} {before}"
            said = f"{head}{form} {text[hi : hi + AROUND]}"
            where = (len(head) + len(form), len(head), ALL_KINDS.index(gold)) if gold else None
            found = _segments(said, base_spans(said))
            if found:  # a form without its segment among the candidates teaches that nothing else is right there
                at = min(s[1] for s in found)
                yield [(hi - at, lo - at, k, on, (hi, lo, k) == where) for hi, lo, k, on in found]


def _gradient(example: Example, weights: np.ndarray, into: np.ndarray) -> None:
    """Adds observed minus expected features of one lattice; expectations by the forward and backward sums over sets of disjoint segments."""
    potentials = weights.tolist()
    score = [sum(map(potentials[k].__getitem__, on)) for _, _, k, on, _ in example]
    ends, n = [s[0] for s in example], len(example)
    begins = sorted(s[1] for s in example)
    before = [bisect.bisect_right(ends, s[1]) for s in example]
    behind = [bisect.bisect_left(begins, e) for e in ends]

    def both(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    ahead = [0.0]
    for j in range(n):
        ahead.append(both(ahead[j], ahead[min(before[j], j)] + score[j]))
    order = sorted(range(n), key=lambda j: example[j][1])
    after = [0.0] * (n + 1)  # over the segments from the i-th by start on
    for i in range(n - 1, -1, -1):
        j = order[i]
        after[i] = both(after[i + 1], score[j] + after[behind[j]])
    for j, (_, _, kind, on, gold) in enumerate(example):
        p = math.exp(min(0.0, ahead[before[j]] + score[j] + after[behind[j]] - ahead[n]))
        into[kind, list(on)] += gold - p


def fit(found: list[tuple[Example, int]], prior: np.ndarray) -> np.ndarray:
    """Weights that are most probable given lattices, each with its number, and prior."""
    weights, total = prior.copy(), sum(n for _, n in found)
    for _ in range(FIT_STEPS if total else 0):
        step = np.zeros_like(weights)
        for example, n in found:
            own = np.zeros_like(weights)
            _gradient(example, weights, own)
            step += n / total * own
        weights += 2 * (step - PRECISION / 100 * (weights - prior))
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_examples: int = SAMPLE_EXAMPLES) -> np.ndarray:
    """Weights fitted on examples from about `sample_rows` documents, chosen by a hash; without examples, the prior."""
    rows = docs.select(F.xxhash64(F.col(id_col), F.lit("pii")).alias("h"), F.col(text_col).cast("string").alias("t"))
    chosen = sampled(rows, F.col("h"), sample_rows).where(F.col("t").rlike("[0-9]")).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                made = [json.dumps(e) for e in examples(t.as_py() or "")]
                for i in range(0, len(made), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(made[i : i + 1000], pa.string())], ["e"])

    lattices = materialize(chosen.mapInArrow(run, "e string").groupBy("e").agg(F.count("*").alias("n")), "pii-examples")
    taken = sampled(lattices, F.xxhash64("e"), sample_examples).orderBy("e").collect()  # about sample_examples rows, whatever the corpus
    return fit([([(*s[:3], tuple(s[3]), s[4]) for s in json.loads(r["e"])], r["n"]) for r in taken], _weights(PRIOR))


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    Null and empty texts have no spans (spans is empty then); null ids and
    repeated rows keep their rows; other columns are ignored; an empty table
    gives no rows.  Without weights the model is trained on the documents first.
    """
    weights = train(docs, id_col, text_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                every = _sorted(base + decode(text, base, weights))
                rows.append([*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(every)])
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, weights: np.ndarray) -> str:
    """The text with each span, overlapping ones merged, replaced by its first kind in square brackets."""
    base = base_spans(text)
    out, end = [], 0
    merged: list[list] = []
    for kind, lo, hi in _sorted(base + decode(text, base, weights)):
        if merged and lo < merged[-1][2]:
            merged[-1][2] = max(hi, merged[-1][2])
        else:
            merged.append([kind, lo, hi])
    for kind, lo, hi in merged:
        out += [text[end:lo], f"[{kind.upper()}]"]
        end = hi
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """docs with personal data in the text replaced; all rows and columns stay, a null text stays null. Trained as in `find_spans`."""
    weights = train(docs, id_col, text_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (x := t.as_py()) is None else redact_text(x, weights) for t in b.column(text_col)]
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
