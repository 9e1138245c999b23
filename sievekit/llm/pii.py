"""Personal data: fixed patterns, and spans that a conditional random field finds beyond them.

The field is trained on a small labelled table of marked sentences. It is decoded only in windows around
tokens that hold a digit or an @ or spell out a dot in one of four languages: no span of these kinds is without one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from sievekit.llm.common import map_texts
from sievekit.llm.crf import Crf, plain

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
#: Tokens to either side of a signal that the field sees.
REACH = 6
#: Tokens of a window at most, and those that two pieces of a longer one share on either side; tokens decoded at once.
LONGEST, OVERLAP = 256, 24
TOGETHER = 20_000

#: The labelled table: spans are marked [kind|text]; {name} stands for made-up values of that sort.
SENTENCES = """
you can reach me on [phone|{phone}] after lunch
please call [phone|{local}] and ask for the manager
phone: [phone|{local}]
tel. [phone|{spaced}] (office hours)
my mobile is [phone|{plain_phone}] , thanks
fax [phone|{local}] or write to [email|{email}]
the and of [phone|{phone}] in the house
contact [email|{email}] for details
write to [email|{at_email}] about the order
email [email|{at_email}] today
or mail [email|{at_email}].
his mail is [email|{at_email}], hers not
send it to [email|{spaced_email}] before noon
e-mail: [email|{email}].
the server at [ip|{ip}] was slow
host [ip|{ip}] refused the connection
of the [ip|{ip}] and to
ip address [ip|{ip}], port {small}
pay with card [card|{card}] please
credit card [card|{card_spaced}] expires {month}
visa [card|{card_dashed}] was declined
the [card|{card}] thing was on
karte [card|{card_spaced}] und
there were {small} people in {year}
version {version} was released in {year}
chapter {small} of {small} , page {small}
the price fell from {price} to {price} in {month}
order {long_number} was shipped on {date}
invoice no. {long_number} , total {price}
call it a day at {time}
the address of the house is {small} Main Street
in {year} the population was {big}
see section {version} and table {small}
he wrote {small} books , {small} of them about the war
meet me at {time} on {date}
serial {hex} was found
token = "{hex}"
room {small} , floor {small}
the ratio was {decimal} at {year}
follow @{handle} for news
card games are fun
they host a party at home
mail order is slow , the phone is dead
reach [email|{at_email}] for the keys
just drop [email|{at_email}] a line
you will find [email|{at_name}] in the list
reach [email|{at_name}] any time
ask [email|{at_name}] or [email|{email}]
my address is [email|{at_email}] ok
adresse : [email|{at_de}] bitte
schreib an [email|{at_de}] wegen der Miete
escribe a [email|{at_es}] hoy
mi correo es [email|{at_es}] , gracias
écris à [email|{at_fr}] demain
mon adresse est [email|{at_fr}] merci
ring me on [phone|{uk}] tonight
ring [phone|{uk}] before six
text me at [phone|{uk}] please
ruf mich unter [phone|{de}] an
Telefon [phone|{de}] oder [phone|{local}]
erreichbar unter [phone|{de}]
llámame al [phone|{es}] mañana
teléfono [phone|{es}]
appelle le [phone|{fr}] ce soir
tél. [phone|{fr}]
whatsapp [phone|{phone}] or [phone|{es}]
invoice number {zero_number} is open
invoice {zero_number} , customer {long_number}
order no {zero_number} from {date}
parcel {zero_number} arrives at {time}
account {long_number} at the bank
Rechnung Nr. {zero_number} vom {date}
factura {zero_number} del {year}
dossier {zero_number} du {date}
the dot at the end of the line
we met at noon and left at dawn
polka dot dress at the shop
a dot com company at the edge of town
the score was {small} {small} {small} at half time
lines {small} {small} {small} {small} of the table
pages {small} {small} {small} {small}
pages {small} {small} {small} of the book
seats {small} {small} and {small} at the back
in {year} {year} and {year} the river rose
"""


def _values(rng: random.Random) -> dict[str, str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8)))
    digits = rng.choice("345") + d(14)
    card = next(digits + str(k) for k in range(10) if luhn(digits + str(k)))
    groups = [card[k : k + 4] for k in range(0, 16, 4)]
    area = d(3)
    return {
        "phone": rng.choice([f"+1 ({area}) 555-{d(4)}", f"+49 {d(3)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]),
        "local": rng.choice([f"({area}) 555-{d(4)}", f"{area}-555-{d(4)}", f"{area}.555.{d(4)}"]),
        "spaced": f"0{d(2)} {d(4)} {d(4)}", "plain_phone": "0" + d(9),
        "email": f"{word()}{d(1)}@{word()}.{rng.choice(['com', 'org', 'de'])}", "at_email": f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}",
        "spaced_email": f"{word()} (at) {word()} (dot) com", "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card, "card_spaced": " ".join(groups), "card_dashed": "-".join(groups),
        "small": d(rng.randint(1, 3)), "year": "1" + d(3), "version": f"{d(1)}.{d(2)}.{d(1)}", "price": f"${d(2)}.{d(2)}", "month": f"0{d(1)}/{d(2)}",
        "long_number": d(rng.randint(6, 12)), "date": f"20{d(2)}-0{d(1)}-1{d(1)}", "time": f"1{d(1)}:{d(2)}", "big": f"{d(1)},{d(3)},{d(3)}",
        "at_name": f"{word()} dot {word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}", "at_de": f"{word()} at {word()} punkt de", "at_es": f"{word()} arroba {word()} punto es", "at_fr": f"{word()} arobase {word()} point fr",
        "uk": rng.choice([f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}"]), "de": rng.choice([f"0{d(3)}/{d(7)}", f"0{d(3)} {d(7)}", f"0{d(2)}-{d(8)}"]),
        "es": rng.choice([f"6{d(2)} {d(3)} {d(3)}", f"9{d(8)}"]), "fr": f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", "zero_number": "0" + d(9),
        "hex": "".join(rng.choice("0123456789abcdef") for _ in range(32)), "decimal": f"0.{d(3)}", "handle": word(),
    }


def labelled(sentences: str = SENTENCES, copies: int = 4, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table as tokens and tags."""
    rng, out = random.Random(seed), []
    for _ in range(copies):
        for line in filter(None, sentences.splitlines()):
            text = re.sub(r"\{(\w+)\}", lambda m: _values(rng)[m[1]], line)
            words, tags = [], []
            for part in re.split(r"(\[\w+\|[^\]]+\])", text):
                if mark := re.fullmatch(r"\[(\w+)\|([^\]]+)\]", part):
                    inner = mark[2].split()
                    words += inner
                    tags += [f"B-{mark[1]}", *[f"I-{mark[1]}"] * (len(inner) - 1)]
                else:
                    words += (more := part.split())
                    tags += ["O"] * len(more)
            out.append((words, tags))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


_LOCAL = r"[A-Za-z0-9._%+-]++"
_DOMAIN = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
_EMAIL_RUN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_DOMAIN}")
_EMAIL_HERE = re.compile(_LOCAL + _DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches begin where a run of local characters begins, or where the match before has ended inside one."""
    at = 0
    while text.find("@", at) >= 0:
        match = (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL_RUN.search(text, at)
        if not match:
            return
        yield match.span()
        at = match.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping by kind, failing ones dropped."""
    found = [(*span, "email") for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_SIGNAL = re.compile(r"[0-9@]|\b(?:dot|punkt|punto|point)\b", re.IGNORECASE)
_TOKEN = re.compile(r"\S+")


def _valid(kind: str, text: str) -> bool:
    """What no context can make up for: a card's checksum, an address's numbers, a telephone's number of digits."""
    digits = "".join(c for c in text if c.isascii() and c.isdigit())
    if kind == "ip":
        return all(p.isdigit() and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 7 <= len(digits) <= 15


class Spans:
    """A text's spans. Whether a new one touches an earlier one takes a binary search: new ones come in the order of their starts."""

    def __init__(self, base: list[tuple[int, int, str]]):
        self.all, self.end = base, 0
        self.starts, self.ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))

    def add(self, begin: int, end: int, kind: str) -> None:
        before = bisect_left(self.starts, end)
        if self.end <= begin and not (before and self.ends[before - 1] > begin):
            self.all.append((begin, end, kind))
            self.end = end


class Finder:
    """Base spans and the field's spans of whole texts."""

    def __init__(self, crf: Crf):
        self.crf = crf

    def _windows(self, text: str) -> Iterable[tuple[list[tuple[int, str]], int, int]]:
        """Tokens with their places around signals, line by line; neighbours' windows are joined.

        A long window comes in pieces that overlap: of each, the spans that begin in the given range of its tokens count.
        """
        at = 0
        while signal := _SIGNAL.search(text, at):
            begin, stop = text.rfind("\n", 0, signal.start()) + 1, text.find("\n", signal.start())
            stop = len(text) if stop < 0 else stop
            at = stop
            held: list[tuple[int, str]] = []
            core, since = 0, -1  # tokens since the last signal; -1: none is held
            for m in _TOKEN.finditer(text, begin, stop):
                held.append((m.start(), m[0]))
                if not plain(m[0]):
                    if since < 0:
                        held = held[-REACH - 1 :]
                    since = 0
                elif since >= 0:
                    since += 1
                    if since > 2 * REACH:
                        yield held[: len(held) - since + REACH], core, len(held)
                        held, core, since = held[-REACH:], 0, -1
                elif len(held) > LONGEST:
                    held = held[-REACH:]
                if since >= 0 and len(held) >= LONGEST:
                    yield held, core, len(held) - OVERLAP
                    held, core = held[-2 * OVERLAP :], OVERLAP
            if since >= 0:
                yield held[: len(held) - max(0, since - REACH)], core, len(held)

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        found = [Spans(base_spans(text)) for text in texts]
        held: list[tuple[int, tuple]] = []
        size = 0
        for n, text in enumerate(texts):
            for window in self._windows(text):
                held.append((n, window))
                size += len(window[0])
                if size >= TOGETHER:
                    self._decode(held, texts, found)
                    held, size = [], 0
        self._decode(held, texts, found)
        return [sorted(set(spans.all), key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for spans in found]

    def _decode(self, held: list[tuple[int, tuple]], texts: list[str], found: list) -> None:
        place = {t: k for k, t in enumerate(dict.fromkeys(t for _, (w, _, _) in held for _, t in w))}
        rows = self.crf.rows(list(place))
        tags = self.crf.decode([rows[[place[t] for _, t in w]] for _, (w, _, _) in held])
        for (n, (window, core, end)), best in zip(held, tags, strict=True):
            if best.any():
                self._add(found[n], texts[n], window, best, core, end)

    @staticmethod
    def _add(spans: Spans, text: str, window: list[tuple[int, str]], best: np.ndarray, core: int, stop: int) -> None:
        """The window's valid spans that touch no span that is there already."""
        k = 0
        while k < len(window):
            tag = TAGS[best[k]]
            if tag[0] != "B":
                k += 1
                continue
            j = k + 1
            while j < len(window) and TAGS[best[j]] == "I" + tag[1:]:
                j += 1
            begin, end = window[k][0], window[j - 1][0] + len(window[j - 1][1])
            while end > begin and text[end - 1] in ".,;:!?\"'":
                end -= 1
            if core <= k < stop and _valid(tag[2:], text[begin:end]):
                spans.add(begin, end, tag[2:])
            k = j


def train(examples: list[tuple[list[str], list[str]]] | None = None) -> Crf:
    return Crf(TAGS).train(examples or labelled())


def find_pii(docs: DataFrame, examples: list[tuple[list[str], list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``found``, an array of (start, end, kind, base) in code points, end exclusive.

    ``base`` tells the fixed patterns' spans from those that the field adds. A null or empty text has none.
    Whole texts are searched, the patterns in time linear in the length; the field sees long lines in overlapping
    pieces of a fixed size. Spans that begin at one place come in the order of KINDS. Repeated rows give repeated rows;
    other columns aren't read, whatever their names; an empty table gives an empty result. ``examples``: the labelled table as
    tokens and tags, by default the one in this module.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(examples))  # a few thousand weights

    def make():
        finder = Finder(sent.value)

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            rows = []
            for text, spans in zip(texts, finder(texts), strict=True):
                base = set(base_spans(text)) if spans else ()
                rows.append([{"start": a, "end": b, "kind": k, "base": (a, b, k) in base} for a, b, k in spans])
            return {"found": rows}

        return apply

    return map_texts(docs, make, "found array<struct<start: int, end: int, kind: string, base: boolean>>", id_col, text_col)
