"""A linear-chain conditional random field over word shapes, trained and decoded with numpy.

Every token has one feature set, a function of its shape alone, so a task meets few distinct sets: each is
given a number and a row of scores, and scoring tokens is a look-up of rows. Viterbi runs over many windows
at once, one array step for each place in the windows.
"""

from __future__ import annotations

import re

import numpy as np

_PART = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zß-öø-ÿ]+|[0-9]+|[^\W\d_]+|.", re.DOTALL)
#: Words that announce personal data. They are features, never matches by themselves.
CUES = {
    "call": "phone", "phone": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone", "fax": "phone", "telefon": "phone",
    "email": "mail", "e-mail": "mail", "mail": "mail", "write": "mail", "contact": "mail", "correo": "mail", "courriel": "mail",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "karte": "card", "carte": "card", "tarjeta": "card",
    "ip": "host", "host": "host", "server": "host", "address": "host", "adresse": "host",
    "ring": "phone", "llama": "phone",  "text": "phone", "whatsapp": "phone", "ruf": "phone", "llámame": "phone", "teléfono": "phone", "appelle": "phone", "tél": "phone", "erreichbar": "phone", "handy": "phone", "portable": "phone", "móvil": "phone",
    "invoice": "number", "number": "number", "nr": "number", "no": "number", "pages": "number", "order": "number", "account": "number", "parcel": "number", "rechnung": "number", "factura": "number", "dossier": "number", "serial": "number", "commande": "number", "pedido": "number", "konto": "number", "lines": "number", "seats": "number",
    "at": "at", "dot": "dot", "(at)": "at", "[at]": "at", "(dot)": "dot", "[dot]": "dot", "arroba": "at", "arobase": "at", "punkt": "dot", "punto": "dot", "point": "dot",
}
_EDGE = ".,;:!?"
#: Parts of a written shape.
PARTS = 16


def shape(token: str) -> str:
    """X, x and d for runs of capitals, small letters and digits (with the number of digits), other characters as they are.

    The whole token counts; a shape of many parts is written as its first and last ones.
    """
    out = []
    for part in _PART.findall(token):
        if part.isdigit():
            out.append("d" + str(min(len(part), 9)))
        elif part[0].isalpha():
            out.append("X" if part.isupper() else "x")
        elif not out or out[-1] != part:
            out.append(part)
    return "".join(out if len(out) <= PARTS else [*out[: PARTS // 2], "~", *out[-PARTS // 2 :]])


def features(token: str) -> tuple[str, ...]:
    """What is known of a token: its shape at three levels of detail and the cue that it is."""
    core = token.strip(_EDGE)
    full = shape(core)
    rough = re.sub(r"d\d", "d", full)
    digits = sum(map(str.isdigit, core))
    cue = CUES.get(core.lower())
    return (
        "s=" + full, "r=" + re.sub(r"(d[. -]?)+", "d", rough), f"n={min(digits, 20)}",
        "@" if "@" in core else "", "+" if core[:1] == "+" else "", f"0{min(digits, 9)}" if core[:1] == "0" else "", "(" if core[:1] in "([" else "",
        f"dots={min(core.count('.'), 4)}" if digits else "", "cue=" + cue if cue else "", "end" if token[-1:] in _EDGE else "",
    )


def plain(token: str) -> bool:
    """No digit, no @ and not a dot spelled out: windows hold some token that isn't plain."""
    return not any(c.isdigit() or c == "@" for c in token) and CUES.get(token.strip(_EDGE).lower()) != "dot"


class Crf:
    """Weights: of features for the token itself, the one before and the one after; of pairs of tags."""

    def __init__(self, tags: list[str]):
        self.tags = tags
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 3, len(tags)))
        self.moves = np.zeros((len(tags), len(tags)))
        self.forbidden = np.array(
            [[b[0] == "I" and a[2:] != b[2:] for b in tags] for a in tags], dtype=bool
        )
        self.begin = np.array([-1e4 if t[0] == "I" else 0.0 for t in tags])

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        """Tokens x tags: own features plus those of the neighbours."""
        own = np.array([self.weights[r].sum(axis=0) for r in rows])
        out = own[:, 0].copy()
        out[1:] += own[:-1, 1]
        out[:-1] += own[1:, 2]
        return out

    def train(self, sentences: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> Crf:
        """Maximum likelihood by AdaGrad over whole sentences; the order of sentences is fixed, so is the result."""
        at = {t: k for k, t in enumerate(self.tags)}
        data = []
        for words, tags in sentences:
            rows = [[self.index.setdefault(f, len(self.index)) for f in features(w) if f] for w in words]
            data.append((rows, np.array([at[t] for t in tags])))
        shape_ = (len(self.index), 3, len(self.tags))
        self.weights = np.zeros(shape_)
        seen_w, seen_m = np.full(shape_, 1e-2), np.full(self.moves.shape, 1e-2)
        block = np.where(self.forbidden, -1e4, 0.0)
        for _ in range(rounds):
            grad_w, grad_m = -ridge * self.weights, -ridge * self.moves
            for rows, gold in data:
                score, moves, n = self._scores(rows), self.moves + block, len(rows)
                score[0] += self.begin
                ahead = np.empty_like(score)
                ahead[0] = score[0]
                for t in range(1, n):
                    ahead[t] = score[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0)
                behind = np.zeros_like(score)
                for t in range(n - 2, -1, -1):
                    behind[t] = np.logaddexp.reduce(moves + (score[t + 1] + behind[t + 1])[None, :], axis=1)
                total = np.logaddexp.reduce(ahead[-1])
                mark = -np.exp(ahead + behind - total)
                mark[np.arange(n), gold] += 1
                for t in range(1, n):
                    grad_m -= np.exp(ahead[t - 1][:, None] + moves + (score[t] + behind[t])[None, :] - total)
                    grad_m[gold[t - 1], gold[t]] += 1
                for t, r in enumerate(rows):
                    grad_w[r, 0] += mark[t]
                    if t + 1 < n:
                        grad_w[r, 1] += mark[t + 1]
                    if t:
                        grad_w[r, 2] += mark[t - 1]
            grad_m[self.forbidden] = 0
            grad_w /= len(data)
            grad_m /= len(data)
            seen_w += grad_w**2
            seen_m += grad_m**2
            self.weights += rate * grad_w / np.sqrt(seen_w)
            self.moves += rate * grad_m / np.sqrt(seen_m)
        return self

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Tokens x (own, to the next one, to the one before) x tags."""
        out = np.zeros((len(tokens), 3, len(self.tags)))
        for k, token in enumerate(tokens):
            known = [self.index[f] for f in features(token) if f in self.index]
            out[k] = self.weights[known].sum(axis=0)
        return out

    def decode(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each window, given its tokens' rows. Windows of like length share the array steps."""
        best: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(windows)
        moves = self.moves + np.where(self.forbidden, -1e4, 0.0)
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
        for at in range(0, len(order), 512):
            group = [k for k in order[at : at + 512] if len(windows[k])]
            if not group:
                continue
            sizes = np.array([len(windows[k]) for k in group])
            longest, tags = sizes.max(), len(self.tags)
            score = np.zeros((len(group), longest, tags))
            for g, k in enumerate(group):
                own = windows[k]
                score[g, : len(own)] = own[:, 0]
                score[g, 1 : len(own)] += own[:-1, 1]
                score[g, : len(own) - 1] += own[1:, 2]
            value = score[:, 0] + self.begin
            back = np.zeros((len(group), longest, tags), dtype=np.int16)
            for t in range(1, longest):
                step = value[:, :, None] + moves[None]
                back[:, t] = step.argmax(axis=1)
                after = step.max(axis=1) + score[:, t]
                value = np.where((t < sizes)[:, None], after, value)
            tag = value.argmax(axis=1)
            out = np.zeros((len(group), longest), dtype=int)
            for t in range(longest - 1, -1, -1):
                inside = t < sizes
                out[inside, t] = tag[inside]
                if t:
                    tag = np.where(inside, back[np.arange(len(group)), t, tag], tag)
            for g, k in enumerate(group):
                best[k] = out[g, : sizes[g]]
        return best
