"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding rests on a property of rank-ordered merging: a sequence of tokens is the encoding of its bytes
exactly when every adjacent pair is the encoding of its own bytes. So each prefix of a piece has one
last token, the vocabulary entry that ends there and forms such a pair with the last token of what
precedes it. Reading left to right, a state holds only what later bytes can still depend on: the longest
suffix that begins some token, and the last tokens at the places where a token may still begin. A token
is emitted once every place where a later token can begin lies behind it, a lookahead bounded by the
vocabulary. States and transitions are made when first met and kept in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from sievekit.llm.common import map_texts, worker_table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of a worker's tables, about 150 MB together: states of the transducer (half a KB each with their steps) and encoded
#: pieces in each of two generations (0.2 KB each, up to MAX_PIECE characters).
MAX_STATES = 80_000
MAX_PIECES = 120_000
MAX_PIECE = 64
#: Bytes that may pass a full table of states before it is begun anew, as a multiple of its size.
PASSED = 100


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeTransducer:
    """Encodes one piece at a time: ``encode(bytes)`` returns ids as packed little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.packed = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.last: list[bytes | None] = []
        self.steps: dict[int, int] = {}  # the next state; its complement where something is emitted
        self.emits: dict[int, bytes] = {}
        self.suffixes: dict[bytes, tuple] = {}
        self.passed = 0
        self._number((b"", None, (), ()))

    def _number(self, state: tuple) -> int | None:
        """The state's number; None for a new one once the table is full."""
        if (k := self.numbers.get(state)) is None and len(self.states) < self.max_states:
            k = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.last.append(None)
        return k

    def merge(self, data: bytes) -> list[bytes]:
        """The definition: join the adjacent pair of lowest rank, the leftmost first, until none is left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, token: bytes) -> bool:
        if (ok := self.whole.get(token)) is None:
            ok = self.whole[token] = self.merge(token) == [token]
        return ok

    def _pair(self, left: bytes, right: bytes) -> bool:
        if (ok := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 2 * self.max_states:
                self.pairs.clear()
            ok = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return ok

    def _known(self, seen: bytes) -> tuple:
        """Of the bytes since a token may have begun: tokens that end here, sizes with which a token may still begin, the longest of these as bytes."""
        if (found := self.suffixes.get(seen)) is None:
            tails = [seen[-k:] for k in range(len(seen), 0, -1)]
            if len(self.suffixes) >= self.max_states:
                self.suffixes.clear()
            found = self.suffixes[seen] = (
                tuple((len(t), t) for t in tails if t in self.ranks and self._stands(t)),
                tuple(len(t) for t in tails if t in self.prefixes),
                next((t for t in tails if t in self.prefixes), b""),
            )
        return found

    def _move(self, state: tuple, byte: int) -> tuple[tuple, bytes]:
        """The next state and what is emitted. A state: bytes since a token may have begun, last emitted token, then for each place after that one
        the token that ends there (None: nothing depends on it) and its token ends so far as bits."""
        suffix, before, pending, ends = state
        tokens, begins, suffix = self._known(suffix + bytes([byte]))
        end, pairs = len(pending) + 1, self.pairs
        for size, token in tokens:
            if (start := end - size) < 0:
                continue
            left = pending[start - 1] if start else before
            if left is None:
                if start:
                    continue
                break
            if (ok := pairs.get((left, token))) is None:
                ok = self._pair(left, token)
            if ok:
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        path = (ends[start - 1] if start else 0) | 1 << end
        common = needed = path
        for size in begins:
            if (at := end - size) > 0:
                if pending[at - 1] is not None:
                    common &= ends[at - 1]
                    needed |= ends[at - 1]
            elif at == 0:
                common = 0
        pending, ends = (*pending, token), (*ends, path)
        emitted = b""
        if common:
            last = at = common.bit_length() - 1
            while at:
                emitted = self.packed[pending[at - 1]] + emitted
                at -= len(pending[at - 1])
            before = pending[last - 1]
            pending, ends, needed = pending[last:], tuple(x >> last for x in ends[last:]), needed >> last
            end -= last
        if end not in begins:
            before = b""  # no later token can begin there
        if needed != (2 << end) - 2:
            pending = tuple([t if needed >> k & 1 else None for k, t in enumerate(pending, 1)])
            ends = tuple([x if needed >> k & 1 else 0 for k, x in enumerate(ends, 1)])
        # The places up to the last emitted token all look alike from here on.
        ends = tuple([x & -2 for x in ends])
        return (suffix, before, pending, ends), emitted

    def _finish(self, state: tuple) -> bytes:
        """What is left to be emitted at the end of a piece."""
        pending, tokens = state[2], []
        at = len(pending)
        while at:
            tokens.append(pending[at - 1])
            at -= len(tokens[-1])
        return b"".join(map(self.packed.__getitem__, reversed(tokens)))

    def encode(self, piece: bytes) -> bytes:
        """States met while the table has room are kept with their steps. Later ones are gone through and forgotten; once that was done
        for as many bytes as would have filled the table many times, it is begun anew, as the texts may have changed."""
        if (whole := self.packed.get(piece)) is not None:
            return whole
        if self.passed > PASSED * self.max_states:
            self._reset()
        number, state, out, steps, emits = 0, None, [], self.steps, self.emits
        for byte in piece:
            if number is not None:
                found = steps.get(number << 8 | byte)
                if found is not None:
                    if found < 0:
                        out.append(emits[number << 8 | byte])
                        number = ~found
                    else:
                        number = found
                    continue
                state = self.states[number]
            state, emitted = self._move(state, byte)
            after = self._number(state)
            if emitted:
                out.append(emitted)
            if after is None:
                self.passed += 1
            elif number is not None:
                steps[number << 8 | byte] = ~after if emitted else after
                if emitted:
                    emits[number << 8 | byte] = emitted
            number = after
        if number is None:
            out.append(self._finish(state))
        else:
            if (rest := self.last[number]) is None:
                rest = self.last[number] = self._finish(self.states[number])
            out.append(rest)
        return b"".join(out)


class Pieces(dict):
    """Encoded pieces, made when missing. When full, they become the old generation and a new one begins."""

    def __init__(self, transducer: MergeTransducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, piece: str) -> bytes:
        if (out := self.old.get(piece)) is None:
            out = self.transducer.encode(piece.encode())
            if len(piece) > MAX_PIECE:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(MergeTransducer(ranks))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed. A text of millions of characters is cut into pieces as it is read."""
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(self.pieces[m[0]] for m in self.pattern.finditer(text))


#: UTF-8 by byte class. State 0 is between characters, 8 is an error; the others wait for continuation bytes.
_WAIT1, _WAIT2, _WAIT3, _E0, _ED, _F0, _F4, ERROR = 1, 2, 3, 4, 5, 6, 7, 8


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return _WAIT1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: _E0, 0xED: _ED}.get(byte, _WAIT2)
        return {0xF0: _F0, 0xF4: _F4}.get(byte, _WAIT3) if 0xF0 <= byte <= 0xF4 else ERROR
    low, high, after = {
        _WAIT1: (0x80, 0xBF, 0), _WAIT2: (0x80, 0xBF, _WAIT1), _WAIT3: (0x80, 0xBF, _WAIT2), _E0: (0xA0, 0xBF, _WAIT1),
        _ED: (0x80, 0x9F, _WAIT1), _F0: (0x90, 0xBF, _WAIT2), _F4: (0x80, 0x8F, _WAIT2),
    }.get(state, (1, 0, ERROR))
    return after if low <= byte <= high else ERROR


class StreamDecoder:
    """Turns ids into bytes and text as they come; a character split over tokens waits for its rest.

    ``feed`` returns the bytes of the ids; ``text`` collects whole characters only. Most tokens end between
    characters; these are found in one array look-up, and only the others go through the state machine.
    """

    def __init__(self, tokens: list[bytes], open_tokens: np.ndarray):
        self.tokens, self.open = tokens, open_tokens
        self.state, self.valid = 0, True

    @staticmethod
    def opens(tokens: list[bytes]) -> np.ndarray:
        """Of each token: does it leave the state between characters, when it starts there?"""
        out = np.zeros(len(tokens), dtype=bool)
        for k, token in enumerate(tokens):
            state = 0
            for byte in token:
                state = utf8_step(state, byte)
            out[k] = state != 0
        return out

    def feed(self, ids: np.ndarray) -> bytes:
        tokens, state, at = self.tokens, self.state, 0
        marks = np.flatnonzero(self.open[ids])
        while state != ERROR:
            if state == 0:
                nxt = np.searchsorted(marks, at)
                if nxt == len(marks):
                    break
                at = int(marks[nxt])
            if at >= len(ids):
                break
            for byte in tokens[ids[at]]:
                state = utf8_step(state, byte)
            at += 1
        self.state, self.valid = state, self.valid and state != ERROR
        return b"".join(map(tokens.__getitem__, ids.tolist()))

    def finish(self) -> bool:
        """Did the bytes so far form whole characters?"""
        return self.valid and self.state == 0

    def text(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Decoded text, chunk by chunk; raises UnicodeDecodeError where the bytes aren't UTF-8."""
        held = b""
        for ids in chunks:
            data = held + self.feed(ids)
            cut = len(data)
            if self.state not in (0, ERROR):
                cut -= 1
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
            held = data[cut:]
            yield data[:cut].decode()
        if held:
            yield held.decode()


def _load(data: bytes) -> tuple[Encoder, list[bytes], np.ndarray]:
    """A worker's tables, kept between its tasks."""

    def make() -> tuple:
        ranks = read_ranks(data)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return Encoder(ranks), tokens, StreamDecoder.opens(tokens)

    return worker_table(hashlib.sha256(data).hexdigest(), make)


#: Ids decoded at once.
CHUNK = 1 << 16


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``is_utf8``; ``ids`` too with ``with_ids``.

    Whole texts are encoded by the ranks at ``path`` and the ids are decoded again in chunks, so nothing
    beyond a text and its ids is held. A null or empty text has no tokens (the hashes are of nothing).
    Equal texts and repeated rows give equal rows; an empty table gives an empty result; other columns and
    null ids pass unread.
    """
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file

    def make():
        encoder, tokens, opens = _load(ranks.value)

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "is_utf8": []}
            if with_ids:
                out["ids"] = []
            for text in texts:
                packed = encoder.encode(text)
                numbers = np.frombuffer(packed, dtype="<u4")
                decoder, digest = StreamDecoder(tokens, opens), hashlib.sha256()
                for at in range(0, len(numbers), CHUNK):
                    digest.update(decoder.feed(numbers[at : at + CHUNK]))
                out["n_tokens"].append(len(numbers))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(digest.hexdigest())
                out["is_utf8"].append(decoder.finish())
                if with_ids:
                    out["ids"].append(numbers.astype(np.int32))
            return out

        return apply

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, is_utf8 boolean" + ", ids array<int>" * with_ids
    return map_texts(docs, make, columns, id_col, text_col)
