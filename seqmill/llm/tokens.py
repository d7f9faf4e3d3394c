"""Token ids of whole texts by the ``tokenizers`` library, with each distinct piece encoded once.

The vocabulary splits texts at white space and drops it, so the ids of a text are
those of its words one after the other.  Words of ASCII and Latin-1 letters are
cut into the vocabulary's pre-tokens with array operations over the bytes of many
texts, numbered by Arrow, and only the merges of each distinct pre-token run in
the library.  Every other word (other alphabets, apostrophes, control characters,
special tokens) is one piece: plain ones are cut by a regular expression, the
rest goes through the library whole.  ``tests/llm`` holds all ways against each other.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: A word for the short way: printable ASCII and precomposed Latin letters.
_PLAIN = re.compile("[\x21-\x7eÀ-įı-ſ]+")
_LETTER = "a-zÀ-ÖØ-öø-ſ"
#: The pre-tokens of the public vocabulary file, for plain words.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


#: Classes of bytes: white space, letter (U+00C0 to U+00FF too), digit, other printable, all that needs the way of whole words.
_SPACE, _ALPHA, _DIGIT, _OTHER, _ODD = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[ord("'"), ord("<")]] = _ODD
    out[ord("0"):ord("9") + 1] = _DIGIT
    out[ord("A"):ord("Z") + 1] = out[ord("a"):ord("z") + 1] = _ALPHA
    out[0x80:0xC0] = out[0xC3] = _ALPHA
    return out


_CLASSES = _byte_classes()
#: What makes a piece a word that was not cut.
_UNCUT = re.compile(rb"[^\x21-\x26\x28-\x3b\x3d-\x7e\x80-\xbf\xc3]|\xc3[\x97\xb7]")


def _cut(data: np.ndarray, bounds: np.ndarray, plain: bool) -> tuple[pa.Array, np.ndarray]:
    """``(pieces, places)`` of texts that lie one after the other: text ``i`` has ``pieces[places[i]:places[i + 1]]``.

    Pieces are lower-case pre-tokens; words with an odd byte (all words unless ``plain``) stay whole, as they are.
    """
    kind = _CLASSES[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    letter = data[second]
    kind[second[(letter == 0x97) | (letter == 0xB7)]] = _ODD  # the signs among the letters
    lower = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    lower[second[(letter >= 0x80) & (letter <= 0x9E)]] += 32
    spaces = np.flatnonzero(kind == _SPACE)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first[spaces + 1] = True
    keep = kind != _SPACE
    kind, lower = kind[keep], lower[keep]
    # a word starts at the first kept byte after a space or a text's start
    ends = bounds - np.searchsorted(spaces, bounds)
    marks = np.flatnonzero(first)
    starts = np.zeros(len(kind) + 1, bool)
    starts[marks - np.searchsorted(spaces, marks)] = True
    starts = starts[:-1]
    breaks = starts | (kind == _DIGIT)
    breaks[1:] |= kind[1:] != kind[:-1]
    odd = kind == _ODD
    if not plain:
        breaks, lower = starts, data[keep]
    elif odd.any():
        at = np.flatnonzero(starts)
        whole = np.repeat(np.logical_or.reduceat(odd, at), np.diff(np.append(at, len(kind))))
        breaks = np.where(whole, starts, breaks)
        lower = np.where(whole, data[keep], lower)
    at = np.flatnonzero(breaks)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [
        None, pa.py_buffer(np.append(at, len(kind)).astype("<i4")), pa.py_buffer(np.ascontiguousarray(lower))])
    return pieces, np.searchsorted(at, ends)


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 on."""
    out, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class WordEncoder:
    """``texts(column)``: the ids of an Arrow column of texts; ``ids(words)``: those of a list of words (bytes), joined.

    Ids of pieces are kept in two generations of at most about ``keep`` each: a
    full one becomes the old one, and what is met again moves back.
    """

    def __init__(self, path: str, keep: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._merge = self._tok.model.tokenize
        self._map = _byte_letters()
        self._keep = keep
        self._words: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._plain = self._short_way_holds()

    def _short_way_holds(self) -> bool:
        """Whether this vocabulary cuts words as the short way does."""
        probe = ["it's", "a1b22", "x--y,z", "Été's", "naïve|", "WORD###", "×÷a"]
        return all(self._short(w) == self._whole([w])[0] for w in probe)

    def _short(self, word: str) -> bytes:
        return b"".join(map(self._merged, _PIECES.findall(word.lower())))

    def _merged(self, piece: str) -> bytes:
        q = piece if piece.isascii() else "".join(map(self._map.__getitem__, piece.encode()))
        return array("I", [t.id for t in self._merge(q)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _turn(self) -> None:
        if len(self._words) >= self._keep:
            self._old, self._words = self._words, {}

    def prepare(self, lists: list[list[bytes]]) -> None:
        """Put every word of the lists into the cache."""
        self._turn()
        rest = []
        for w in set().union(*lists).difference(self._words):
            if w in self._old:
                self._words[w] = self._old[w]
                continue
            s = w.decode()
            if self._plain and _PLAIN.fullmatch(s) and "<|" not in s:
                self._words[w] = self._short(s)
            else:
                rest.append(s)
        for i in range(0, len(rest), 4096):
            part = rest[i:i + 4096]
            self._words.update(zip(map(str.encode, part), self._whole(part)))

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self._words.__getitem__, words))

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        self._turn()
        got = list(map(self._words.get, pieces))
        new = [i for i, ids in enumerate(got) if ids is None]
        uncut = []
        for i in new:
            p = pieces[i]
            ids = self._old.get(p)
            if ids is None and (not self._plain or _UNCUT.search(p)):
                uncut.append(i)
            else:
                got[i] = self._words[p] = self._merged(p.decode()) if ids is None else ids
        if uncut:
            self.prepare([[pieces[i] for i in uncut]])
            for i in uncut:
                got[i] = self._words[pieces[i]]
        return got

    def texts(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of a binary column of UTF-8 texts without nulls, ``end_id`` after every text.

        Text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``.
        """
        ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.empty(0, np.uint8)
        pieces, places = _cut(data, ends - ends[0], self._plain)
        coded = pieces.dictionary_encode()
        table = self._known(coded.dictionary.to_pylist()) + [int(end_id).to_bytes(4, "little")]
        at = np.insert(coded.indices.to_numpy(), places[1:], len(table) - 1)
        got = pa.array(table, pa.large_binary()).take(pa.array(at))
        offsets = np.frombuffer(got.buffers()[1], "<i8")[:len(at) + 1] // 4
        return np.frombuffer(got.buffers()[2], "<u4")[:offsets[-1]], offsets[places + np.arange(len(places))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
