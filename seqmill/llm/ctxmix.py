"""Operator 2: language-model scores by logistic context mixing.

A text is coded word by word: the bytes of a lower-cased word and a space, at the
text's end a line end.  Every bit is predicted in several hashed contexts (the last
0 to 4 bytes of the text, over word ends, and the whole word so far); the predictions' log
odds are summed under weights chosen by a gate, the sum is refined by an adaptive table, and a
word's bits add up to its spelling probability at its place in the text.  Only the bits of its
first three bytes depend on the words before, so they are coded once for each four bytes before and
three bytes of a word that occur, the others once for a word.  Over the spelling stand the counts of whole
words and of words after the hashed word before, which grow with the corpus and stay
in Spark tables.  The share of the word before is chosen by a gate, how often it was
seen, and learnt from all training words; within a document the words seen so far
are a further predictor, whose share is weighed by its success in the document.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, ship, text_bytes, words, written
from seqmill.llm.tokenfile import decode_ranks, encode_ranks

#: Context lengths in bytes (-1: the whole word so far) and the bits of their tables' slot numbers.
ORDERS, TABLE_BITS = (0, 1, 2, 3, 4, -1), (12, 16, 18, 19, 20, 20)
_BASE = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
SLOTS = int(_BASE[-1])
# The gate: how often the word so far was seen, and how often with the rarer next bit.
_SEEN, _RARER = np.array([1, 2, 4, 8, 16, 64, 256, 2048]), np.array([1, 2, 4, 16, 128])
GATES, BINS = (len(_SEEN) + 1) * (len(_RARER) + 1), 33
#: Shares of the words seen so far in the document, each weighed by its success.
SHARES = np.array([0.0, 0.08, 0.4])
#: The gate of the word before: how often it was seen; and the shares that its predictions can have.
_BEFORE = np.array([1, 2, 4, 16, 256])
FOLLOW = np.array([0.0, 0.25, 0.5, 0.75])
_BLOCK = 1 << 16
#: Bytes before a piece that its contexts see; first bytes of a word whose contexts reach over its start.
_LEAD, _HEAD = 4, 3
#: Words whose bits one learner counts; input partitions whose places share a row (2 to the power).
_TASK_WORDS, _SPAN_BITS = 1_000_000, 10
#: Bits of a pair of words' hash, those of them that name its bucket, pairs that a task adds up at a time.
_PAIR_BITS, _BUCKET_BITS, _TASK_PAIRS = 44, 12, 1 << 20
#: Words whose pairs are made at a time; places of words that a task holds before it sends them to their chunks.
_PAIR_WORDS, _HELD_PLACES = 1 << 17, 1 << 18
_LOW = np.uint64((1 << (_PAIR_BITS - _BUCKET_BITS)) - 1)  # a key's place in its bucket: 32 bits


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


class Coded:
    """Bytes to code in a row, with the hash of each byte's contexts: whole words (empty: the end), or pieces of texts.

    A piece begins with ``lead`` bytes that are only seen by the contexts; its word begins at byte ``start``.
    """

    def __init__(self, ws: list[bytes], lead: int = 0, start=0):
        data = ws if lead else [w + b" " if w else b"\n" for w in ws]
        self.byte = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
        size = np.fromiter(map(len, data), np.int64, len(data))
        self.first = np.cumsum(size) - size
        pos = np.arange(len(self.byte)) - np.repeat(self.first, size)
        self.hashes = []
        near = np.zeros(len(self.byte), np.uint32)
        back = 0
        for order in ORDERS[:-1]:
            while back < order:
                back += 1
                last = np.zeros_like(near)
                last[back:] = self.byte[:-back]
                last[pos < back] = 0  # nothing before the piece
                near = near * np.uint32(0x01000193) + last + np.uint32(1)
            self.hashes.append(_mix32(near))
        # the whole word so far: a polynomial whose sums over a word telescope
        pos = pos - np.repeat(np.broadcast_to(start, len(ws)), size)
        power = np.cumprod(np.concatenate([[1], np.full(int(pos.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        term = np.where(pos < 0, np.uint64(0), (self.byte.astype(np.uint64) + np.uint64(1)) * power[np.maximum(pos, 0)])
        run = np.cumsum(term) - term
        whole = run - np.repeat(run[self.first], size)
        whole = whole ^ (whole >> np.uint64(32)) ^ pos.astype(np.uint64)
        self.hashes.append(_mix32(whole.astype(np.uint32)))
        self.owner = np.repeat(np.arange(len(ws)), size)
        if lead:
            coded = np.ones(len(self.byte), bool)
            coded[(self.first[:, None] + np.arange(lead)).ravel()] = False
            self.byte, self.owner, self.hashes = self.byte[coded], self.owner[coded], [h[coded] for h in self.hashes]
            self.first -= lead * np.arange(len(ws))

    def bits(self):
        """For each of the eight bits: ``(bit, slots of every order)``."""
        for j in range(8):
            node = (np.uint32(1 << j) | (self.byte >> np.uint32(8 - j))) * np.uint32(0x9E3779B1)
            bit = (self.byte >> np.uint32(7 - j)) & np.uint32(1)
            yield bit.astype(np.uint8), [
                (((h + node) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - b)).astype(np.int64) + at
                for h, b, at in zip(self.hashes, TABLE_BITS, _BASE)]


def count_bits(coded: Coded, times: np.ndarray, into: np.ndarray) -> None:
    """Add how often each slot saw a 0 and a 1, to ``into[2 * slot + bit]``."""
    weight = times[coded.owner]
    for bit, slots in coded.bits():
        for s in slots:
            np.add.at(into, 2 * s + bit, weight)


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))


def _gate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_SEEN, n0 + n1, "right") * (len(_RARER) + 1)
            + np.searchsorted(_RARER, np.minimum(n0, n1), "right")).astype(np.uint8)


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)


class Mixer:
    """Weights of every gate, learnt online by Newton steps on the coding cost."""

    def __init__(self):
        n = len(ORDERS)
        self.weights = np.full((GATES, n), 0.1)
        self.weights[:, -1] = 0.6
        self.curve = np.tile(np.eye(n), (GATES, 1, 1))
        self.seen = np.zeros((GATES, BINS, 2))
        self.words = 0.0

    def learn(self, counts: np.ndarray, coded: Coded, times: np.ndarray) -> None:
        """One step for a batch of words.  A word is predicted from the counts without one occurrence
        of its own, as a word that was not there."""
        n = len(ORDERS)
        weight = times[coded.owner].astype(np.float32)
        grad, curve = np.zeros_like(self.weights), np.zeros_like(self.curve)
        pairs = counts.view(f"V{2 * counts.itemsize}")
        for bit, slots in coded.bits():
            own1 = bit.astype(np.float32)
            odds = np.empty((n, len(bit)), np.float32)
            for i, s in enumerate(slots):
                both = pairs[s].view(counts.dtype)  # a slot's two counts lie together and are fetched at once
                n0 = np.maximum(both[0::2] - (1 - own1), 0)
                n1 = np.maximum(both[1::2] - own1, 0)
                odds[i] = _log_odds(n0, n1)
            gate = _gate(n0, n1)  # of the last context, the word so far
            order = np.argsort(gate, kind="stable")
            there, first = np.unique(gate[order], return_index=True)
            o, bit, w, gate = odds[:, order], bit[order], weight[order], gate[order]
            mixed = (o * self.weights.T.astype(np.float32)[:, gate]).sum(0)
            p = 1 / (1 + np.exp(-np.clip(mixed, -30, 30)))
            grad[there] += np.add.reduceat(o * (w * (bit - p)), first, axis=1).T
            spread = w * p * (1 - p)
            for i in range(n):
                for j in range(i + 1):
                    curve[there, i, j] += np.add.reduceat(o[i] * o[j] * spread, first)
            at = (gate.astype(np.int64) * BINS + _bin(mixed)) * 2 + bit
            self.seen += np.bincount(at, w, self.seen.size).reshape(self.seen.shape)
        low = np.tril(np.ones((n, n)), -1) * curve
        self.curve = 0.95 * self.curve + curve + low.transpose(0, 2, 1)
        ridge = np.eye(n) * (1e-3 * np.trace(self.curve, axis1=1, axis2=2)[:, None, None] / n + 1e-6)
        step = np.linalg.solve(self.curve + ridge, grad[:, :, None])[:, :, 0]
        self.weights += np.clip(step, -0.2, 0.2)
        self.words += float(times.sum())


@dataclass
class Model:
    odds: np.ndarray  # log odds of every slot
    gate: np.ndarray  # the gate that each slot of the last context opens
    weights: np.ndarray
    refined: np.ndarray  # [gate, bin]

    @classmethod
    def of(cls, counts: np.ndarray, weights: np.ndarray, seen: np.ndarray) -> "Model":
        n0, n1 = counts[0::2], counts[1::2]
        trust = _gate(n0[_BASE[-2]:], n1[_BASE[-2]:])
        center = (np.arange(BINS) - BINS // 2) / 2
        prior = 1 / (1 + np.exp(-center))
        share = (seen[:, :, 1] + 2 * prior) / (seen.sum(2) + 2)
        share = np.clip(share, 1e-7, 1 - 1e-7)
        return cls(_log_odds(n0, n1).astype(np.float32), trust, weights.astype(np.float32), np.log(share / (1 - share)).astype(np.float32))

    def log10(self, coded: Coded) -> np.ndarray:
        """log10 of the probability of each word or piece."""
        bits = np.zeros(len(coded.byte))
        for bit, slots in coded.bits():
            gate = self.gate[slots[-1] - _BASE[-2]]
            mixed = sum(self.odds[s] * self.weights[gate, i] for i, s in enumerate(slots))
            mixed = 0.5 * (mixed + self.refined[gate, _bin(mixed)])
            bits -= np.logaddexp(0, np.where(bit == 1, -mixed, mixed))
        return np.add.reduceat(bits, coded.first) / np.log(10) if len(coded.first) else bits

    def tails(self, ws: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's bytes after its first three, which the words before don't change."""
        out = np.zeros(len(ws))
        at = [i for i, w in enumerate(ws) if len(w) >= _HEAD]
        if at:
            out[at] = self.log10(Coded([b" %b " % ws[i] for i in at], _LEAD, 1))
        return out


def word_ends(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first three bytes, with the space or end behind it, and its last three: numbers, the first byte highest,
    ends on the right (a short word's on the left of the first number)."""
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    front = b"".join([b"\0" + (w + b" " if w else b"\n")[:_HEAD].ljust(_HEAD, b"\0") for w in ws])
    back = b"".join([b"\0" + w[-_HEAD:].rjust(_HEAD, b"\0") for w in ws])
    return tuple(np.frombuffer(x, ">u4").astype(np.uint64) for x in (front, back))


def head_keys(flat: np.ndarray, size: np.ndarray, front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The four bytes before each word and its first three bytes as one number.

    ``flat`` are numbers of words of texts, one after the other, each ended by 0; ``size`` the words' bytes, ``front`` and
    ``back`` their ``word_ends``.  Before a text stands a line end.
    """
    flat = flat.astype(np.int64)
    before = np.concatenate([np.zeros_like(flat[:1]), flat[:-1]])
    first = before == 0
    n, space, line = size[before], np.uint64(0x20), np.uint64(0x0A)
    # the byte before the word before, and the one before that (the last byte of the word there)
    parted = np.where(np.concatenate([[True], first[:-1]]), line, space) if len(flat) else first.astype(np.uint64)
    further = np.concatenate([np.zeros(1, np.uint64), back[before[:-1]] & np.uint64(0xFF)]) if len(flat) else parted
    lead = back[before]
    lead = np.where(n == 2, lead | parted << np.uint64(16), lead)
    lead = np.where(n == 1, lead | parted << np.uint64(8) | further << np.uint64(16), lead)
    lead = np.where(first, line, lead << np.uint64(8) | space)
    return lead << np.uint64(24) | front[flat]


def head_pieces(keys: np.ndarray) -> list[bytes]:
    """Pieces for ``Coded(pieces, 4, 4)``."""
    whole = keys.astype(">u8").tobytes()
    out = []
    for i in range(1, len(whole), 8):
        x = whole[i:i + 7]
        out.append(x[:5] if x[4] == 0x0A else x[:6] if x[5] == 0x20 else x)
    return out


class Heads:
    """log10 of the probability of the first three bytes of words at their places; what was coded is kept."""

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.zeros(0, np.uint64), np.zeros(0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        named, which = np.unique(keys, return_inverse=True)
        new = np.setdiff1d(named, self.keys, assume_unique=True)
        if len(new):
            value = np.concatenate([self.model.log10(Coded(head_pieces(new[i:i + 4096]), _LEAD, _LEAD)) for i in range(0, len(new), 4096)])
            at = np.searchsorted(self.keys, new)
            self.keys, self.values = np.insert(self.keys, at, new), np.insert(self.values, at, value)
        return self.values[np.searchsorted(self.keys, named)][which]


def _packed(ids: np.ndarray) -> bytes:
    """Numbers in one to four bytes each: words that come early, the common ones, have small numbers."""
    control, data = encode_ranks(ids)
    return len(ids).to_bytes(8, "little") + control + data


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    at = 8 + (n + 3) // 4
    return decode_ranks(data[8:at], data[at:], n)


def _word_hashes(ws: list[bytes]) -> np.ndarray:
    """48 bits each."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ws), np.uint64, len(ws)) >> np.uint64(16)


def _pairs(flat: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hash of every word with the word before it; before a text's first word stands an end."""
    h = hashes[flat]
    before = np.concatenate([hashes[:1], h[:-1]])
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (h + np.uint64(0x7F4A7C15))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - _PAIR_BITS)


def _pair_keys(texts, n: int, hashes: np.ndarray) -> np.ndarray:
    """``_pairs`` of texts of ``n`` words in all, one after the other; every text ends with an end.

    Only the keys are held for all words, whatever else is needed for some texts at a time.
    """
    out, at, some, held = np.empty(n, np.uint64), 0, [], 0
    for x in texts:
        some.append(x)
        held += len(x)
        if held >= _PAIR_WORDS:
            out[at:at + held] = _pairs(np.concatenate(some), hashes)
            at, some, held = at + held, [], 0
    if some:
        out[at:] = _pairs(np.concatenate(some), hashes)
    return out


def distinct_pairs(texts: list[np.ndarray], train: list[bool], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct pairs, ascending, and their occurrences in the texts that are learnt from.

    A key carries its text's mark in the lowest bit and is sorted where it stands, so that for each
    word little more than the key is held.
    """
    keys = _pair_keys(texts, sum(map(len, texts)), hashes)
    keys <<= np.uint64(1)
    at = 0
    for x, learnt in zip(texts, train):
        if learnt:
            keys[at:at + len(x)] |= np.uint64(1)
        at += len(x)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] ^ keys[:-1]) > np.uint64(1)]))
    times = np.add.reduceat(keys.astype(np.uint8) & 1, first, dtype=np.int64)
    return keys[first] >> np.uint64(1), times


def _packed_longs(x: np.ndarray) -> bytes:
    """Counts of any size: packed if all have 32 bits."""
    return b"\0" + _packed(x.astype(np.uint32)) if x.max(initial=0) >> 32 == 0 else b"\1" + x.astype("<i8").tobytes()


def _unpacked_longs(data: bytes) -> np.ndarray:
    return _unpacked(data[1:]).astype(np.int64) if data[0] == 0 else np.frombuffer(data, "<i8", offset=1)


#: What a chunk gets back of its words: ``n`` numbers of words, packed, with what each of them needs.
_PLACES = "chunk long, n long, idx binary, total binary, lp binary, hash binary, size binary"


def packed_places(chunk, idx, total, lp, hashes, size):
    """Rows of ``_PLACES``: the places of words dealt to their chunks, ascending."""
    order = np.lexsort((idx, chunk))
    chunk, idx, total, lp, hashes, size = (x[order] for x in (chunk, idx, total, lp, hashes, size))
    cuts = np.flatnonzero(np.diff(chunk, prepend=chunk[:1] - 1))
    parts = [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(chunk)))]
    short = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits
    yield pa.RecordBatch.from_arrays(
        [pa.array(chunk[cuts], pa.int64()), pa.array([p.stop - p.start for p in parts], pa.int64()),
         pa.array([_packed(np.diff(idx[p], prepend=0).astype(np.uint32)) for p in parts], pa.binary()),
         pa.array([_packed_longs(total[p]) for p in parts], pa.binary()),
         pa.array([lp[p].astype("<f4").tobytes() for p in parts], pa.binary()),
         pa.array([short[p].tobytes() for p in parts], pa.binary()),
         pa.array([_packed(size[p].astype(np.uint32)) for p in parts], pa.binary())],
        names=["chunk", "n", "idx", "total", "lp", "hash", "size"])


def unpacked_places(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """A chunk's ``total, lp, hash, size`` of each of its words, by number, of its rows of ``_PLACES``."""
    n = rows.column("n").to_numpy().sum()
    total, lp, hashes, size = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for r in rows.select(["idx", "total", "lp", "hash", "size"]).to_pylist():
        at = np.cumsum(_unpacked(r["idx"]), dtype=np.int64)
        total[at], lp[at], size[at] = _unpacked_longs(r["total"]), np.frombuffer(r["lp"], "<f4"), _unpacked(r["size"])
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, :6] = np.frombuffer(r["hash"], np.uint8).reshape(-1, 6)
        hashes[at] = wide.view("<u8").ravel()
    return total, lp, hashes, size


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys of a bucket as differences."""
    return _packed(np.diff(keys & _LOW, prepend=np.uint64(0)).astype(np.uint32))


def _unpacked_keys(data: bytes) -> np.ndarray:
    """Their places in the bucket."""
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts are mostly 0 or 1: packed, then deflated."""
    return zlib.compress(_packed(counts.astype(np.uint32)), 1)


def _unpacked_counts(data: bytes) -> np.ndarray:
    return _unpacked(zlib.decompress(data))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``chunk, bucket, n, keys, counts`` of each chunk's distinct pairs, ascending -> ``chunk, bucket, totals``.

    ``totals`` are the sums over all chunks, in the order of the row's keys.  Buckets are cut
    into more parts or put together so that a task adds up about ``_TASK_PAIRS`` pairs at a time;
    hashes deal them evenly, however frequent a pair is.
    """
    held = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = max(1, -(-held // _TASK_PAIRS))
    finer = max(0, (groups - 1).bit_length() - _BUCKET_BITS)
    coarser = max(0, _BUCKET_BITS - (groups - 1).bit_length())
    low = _PAIR_BITS - _BUCKET_BITS - finer

    def split(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = _unpacked_keys(r["keys"]), _unpacked_counts(r["counts"])
                names = (r["bucket"] << finer) + (keys >> np.uint64(low)).astype(np.int64)
                first = np.flatnonzero(np.diff(names, prepend=-1))
                for a, b in zip(first, np.append(first[1:], len(names))):
                    yield _pair_row(r["chunk"], int(names[a]), keys[a:b], counts[a:b])

    def add(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        keys = np.concatenate([_unpacked_keys(d.as_py()) for d in rows.column("keys")])
        # the group's buckets apart; a finer bucket's keys have its name in their upper bits already
        keys += np.repeat((rows.column("bucket").to_numpy() >> finer).astype(np.uint64) << np.uint64(32), n)
        counts = np.concatenate([_unpacked_counts(d.as_py()) for d in rows.column("counts")]).astype(np.float64)
        order = np.argsort(keys, kind="stable")
        new = np.diff(keys[order], prepend=keys[order[:1]] - np.uint64(1)) != 0
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        totals = np.empty(len(keys), "<f4")
        totals[order] = sums[np.cumsum(new) - 1]
        cuts = np.cumsum(n)[:-1]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"),
                         "totals": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(totals, cuts)], pa.binary())})

    if finer:
        pairs = pairs.mapInArrow(split, pairs.schema)
    return (pairs.groupBy(F.shiftright("bucket", coarser).alias("group"))
            .applyInArrow(add, "chunk long, bucket long, totals binary"))


def _pair_row(chunk: int, bucket: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int64()), pa.array([len(keys)], pa.int64()),
         pa.array([_packed_keys(keys)], pa.binary()), pa.array([_packed_counts(counts)], pa.binary())],
        names=["chunk", "bucket", "n", "keys", "counts"])


def indexed(docs: DataFrame, mod: int, rest: int, key: str, text: str, chunk_bytes: int) -> DataFrame:
    """Texts as numbers of words, chunk by chunk, and each chunk's list of words.

    kind 0: ``chunk, k, held, ids`` (numbers of the words, 0 the end, packed) of a
    document; kind 1: ``chunk, idx, word, c`` (occurrences in training documents);
    kind 2: ``chunk, bucket, n, keys, counts``, the distinct pairs of a word and the
    word before in the chunk, ascending, with their occurrences in training documents;
    kind 3: ``bucket, c``, the distinct ``head_keys`` of the chunk's training documents and their
    occurrences; kind 4: ``chunk, keys, counts``, the ``word_ends`` of the chunk's words.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    k_type = docs.select(F.col(key).alias("k")).limit(0).toArrow().schema.field("k").type
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("k", k_type), ("held", pa.bool_()),
                        ("ids", pa.binary()), ("idx", pa.int32()), ("word", pa.binary()), ("c", pa.int64()),
                        ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def rows(n, /, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def vocabulary(chunk, number, count):
        ws = list(number)
        for at in range(0, len(ws), 50_000):
            part = ws[at:at + 50_000]
            n = len(part)
            yield rows(n, kind=pa.array(np.ones(n, np.int32)), chunk=pa.array(np.full(n, chunk)),
                       idx=pa.array(np.arange(at, at + n, dtype=np.int32)), word=pa.array(part, pa.binary()),
                       c=pa.array(count[at:at + n].astype(np.int64)))

    def pairs(chunk, hashes, texts):
        keys, times = distinct_pairs([x for x, _ in texts], [not h for _, h in texts], hashes)
        name = (keys >> np.uint64(_PAIR_BITS - _BUCKET_BITS)).astype(np.int64)
        at = np.flatnonzero(np.diff(name, prepend=-1))
        for low in range(0, len(at), 512):
            part = [slice(a, b) for a, b in zip(at[low:low + 512], np.append(at[1:], len(name))[low:low + 512])]
            m = len(part)
            yield rows(m, kind=pa.array(np.full(m, 2, np.int32)), chunk=pa.array(np.full(m, chunk)),
                       bucket=pa.array(name[at[low:low + 512]]), n=pa.array([p.stop - p.start for p in part], pa.int64()),
                       keys=pa.array([_packed_keys(keys[p]) for p in part], pa.binary()),
                       counts=pa.array([_packed_counts(times[p]) for p in part], pa.binary()))

    def heads(texts, size, front, back):
        held, some, n = [], [], 0
        for i, x in enumerate(texts):
            some.append(x)
            n += len(x)
            if n >= _PAIR_WORDS or i == len(texts) - 1:
                held.append(np.unique(head_keys(np.concatenate(some), size, front, back), return_counts=True))
                some, n = [], 0
        if held:
            keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            times = np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield rows(len(part), kind=pa.array(np.full(len(part), 3, np.int32)), bucket=pa.array(part.astype(np.int64)),
                           c=pa.array(times[at:at + 50_000]))

    def finished(chunk, number, count, texts):
        yield from vocabulary(chunk, number, count)
        ws = list(number)
        hashes, (front, back) = _word_hashes(ws), word_ends(ws)
        size = np.fromiter(map(len, ws), np.int64, len(ws))
        del ws
        # its factory refers to it: without this a chunk's words would stay until cycles are collected
        number.default_factory = None
        number.clear()
        yield rows(1, kind=pa.array([4], pa.int32()), chunk=pa.array([chunk]), keys=pa.array([front.astype("<u4").tobytes()], pa.binary()),
                   counts=pa.array([back.astype("<u4").tobytes()], pa.binary()))
        yield from heads([x for x, h in texts if not h], size, front, back)
        yield from pairs(chunk, hashes, texts)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        number, count, held_bytes, texts = None, None, 0, []
        for batch in batches:
            for part in chunks(batch, "t", 1 << 20):
                if number is None:
                    number = defaultdict()
                    number.default_factory = number.__len__
                    number[b""]  # the end has number 0
                    count = np.zeros(1 << 16)
                held = part.column("held").to_numpy(zero_copy_only=False)
                ids = []
                for t in part.column("t"):
                    ws = words(t.as_py().lower())
                    ws.append(b"")
                    ids.append(np.fromiter(map(number.__getitem__, ws), np.uint32, len(ws)))
                    held_bytes += len(t.as_py()) + 1
                if len(count) < len(number):
                    count = np.concatenate([count, np.zeros(len(number))])
                train = [x for x, h in zip(ids, held) if not h]
                if train:
                    count += np.bincount(np.concatenate(train), minlength=len(count))
                texts += zip(ids, held)
                n = part.num_rows
                yield rows(n, kind=pa.array(np.zeros(n, np.int32)), chunk=pa.array(np.full(n, chunk)), k=part.column("k"),
                           held=part.column("held"), ids=pa.array([_packed(x) for x in ids], pa.binary()))
                if held_bytes >= chunk_bytes:
                    yield from finished(chunk, number, count, texts)
                    number, held_bytes, chunk, texts = None, 0, chunk + 1, []
        if number is not None:
            yield from finished(chunk, number, count, texts)

    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest
    return docs.select(F.col(key).alias("k"), held.alias("held"), text_bytes(text).alias("t")).mapInArrow(
        run, f"kind int, chunk long, k {kind}, held boolean, ids binary, idx int, word binary, c long, "
             "bucket long, n long, keys binary, counts binary")


def _batches(batches, most: int = 1 << 15):
    """``(words, times)`` of about ``most`` bytes at a time (a longer word alone)."""
    for b in batches:
        for part in chunks(b, "word", most):
            yield part.column("word").to_pylist(), part.column("c").to_numpy(), part


def coded_pieces(vocabulary: DataFrame, heads: DataFrame) -> DataFrame:
    """``word, start, c``: pieces for ``Coded`` that together have every byte of the training texts once, and their occurrences.

    ``vocabulary(word, c)`` gives the bytes after the words' first three, ``heads(key, c)`` the others.
    """
    ship(vocabulary.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(head_pieces(b.column("key").to_numpy()), pa.binary()),
                                              pa.array(np.full(b.num_rows, _LEAD, np.int32)), b.column("c")], names=["word", "start", "c"])

    space = F.lit(b" ")
    tails = vocabulary.where(F.length("word") >= _HEAD).select(F.concat(space, "word", space).alias("word"), F.lit(1).alias("start"), "c")
    return tails.unionByName(heads.mapInArrow(run, "word binary, start int, c long"))


def bit_counts(pieces: DataFrame) -> np.ndarray:
    """``counts[2 * slot + bit]`` over all training texts; a table of fixed size however large the corpus is.

    Tasks send the counts that aren't zero in blocks; a block's parts are added up
    in a stream.
    """
    def gather(batches):
        total = np.zeros(2 * SLOTS, np.float64)
        for ws, times, part in _batches(batches):
            count_bits(Coded(ws, _LEAD, part.column("start").to_numpy()), times.astype(np.float64), total)
        for b in range(0, len(total), _BLOCK):
            at = np.flatnonzero(total[b:b + _BLOCK])
            if len(at):
                yield _block(b // _BLOCK, at, total[b + at])

    def add(batches):
        total, name = np.zeros(_BLOCK), None
        for batch in batches:
            for r in batch.to_pylist():
                if name is not None and r["block"] != name:
                    yield _block(name, np.arange(_BLOCK), total)
                    total[:] = 0
                name = r["block"]
                total[np.frombuffer(r["at"], "<u2")] += np.frombuffer(r["n"], "<f4")
        if name is not None:
            yield _block(name, np.arange(_BLOCK), total)

    kinds = "block int, at binary, n binary"
    out = np.zeros((2 * SLOTS + _BLOCK - 1) // _BLOCK * _BLOCK, np.float32)
    for r in (pieces.mapInArrow(gather, kinds).repartition("block").sortWithinPartitions("block")
              .mapInArrow(add, kinds).toLocalIterator()):
        at = r["block"] * _BLOCK + np.frombuffer(r["at"], "<u2").astype(np.int64)
        out[at] = np.frombuffer(r["n"], "<f4")
    return out[:2 * SLOTS]


def _block(name: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                                       pa.array([n.astype("<f4").tobytes()], pa.binary())], names=["block", "at", "n"])


def fit_mixer(pieces: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the refining table: ``pieces(word, start, c, share)`` is learnt from online, share by share in
    the pieces' order; weights are averaged by pieces learnt from, tables added up.  Shares are cut by the pieces'
    hashes, so the result doesn't depend on how Spark deals the rows."""
    shared = pieces.sparkSession.sparkContext.broadcast(counts)

    def learn(rows: pa.Table) -> pa.Table:
        m = Mixer()
        rows = rows.sort_by([("word", "ascending"), ("start", "ascending")]).combine_chunks()
        for ws, times, part in _batches(rows.to_batches()):
            m.learn(shared.value, Coded(ws, _LEAD, part.column("start").to_numpy()), times)
        v = np.concatenate([[m.words], m.weights.ravel() * m.words, m.seen.ravel()])
        return pa.table({"share": pa.array(np.full(len(v), rows.column("share")[0].as_py())),
                         "i": pa.array(np.arange(len(v), dtype=np.int32)), "v": pa.array(v)})

    sums = np.zeros(1 + GATES * len(ORDERS) + GATES * BINS * 2)
    for r in (pieces.groupBy("share").applyInArrow(learn, "share long, i int, v double")
              .groupBy("i").agg(F.sum("v").alias("v")).collect()):
        sums[r["i"]] = r["v"]
    shared.unpersist()
    start = Mixer()
    if not sums[0]:
        return start.weights, start.seen
    w = 1 + GATES * len(ORDERS)
    return (sums[1:w] / sums[0]).reshape(start.weights.shape), sums[w:].reshape(start.seen.shape)


def _log_sums(flat: np.ndarray, size: np.ndarray, word: np.ndarray | None, seen: np.ndarray, pair: np.ndarray,
              placed: np.ndarray | None = None) -> np.ndarray:
    """log10 probabilities of documents for every share, split by the gates that their words open.

    ``flat`` are the numbers of all documents' words, ``size`` the documents' words, ``word`` the log10
    probability of each number (or ``placed`` that of every word at its place), ``seen`` its training count, ``pair`` the
    training count of every word with the word before it.  Returns ``sums[document, gate, follow, share]``.
    """
    gates = len(_BEFORE) + 1
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - first[doc]
    name = doc * np.int64(len(seen)) + flat
    order = np.argsort(name, kind="stable")
    name = name[order]
    start = np.flatnonzero(np.diff(name, prepend=-1))
    earlier = np.empty(len(flat))
    earlier[order] = np.arange(len(name)) - np.repeat(start, np.diff(np.append(start, len(name))))
    cache = earlier / np.maximum(place, 1)
    times = _before(flat, seen)
    cell = doc * gates + np.searchsorted(_BEFORE, times, "right")
    follows = np.minimum(pair / np.maximum(times, 1), 1)
    logs = (word[flat] if placed is None else placed) * np.log(10)
    alone = np.exp(logs)
    sums = np.empty((len(size) * gates, len(FOLLOW), len(SHARES)))
    for f, follow in enumerate(FOLLOW):
        after = (1 - follow) * alone + follow * follows if follow else alone
        for i, share in enumerate(SHARES):
            both = (1 - share) * after + share * cache if share else after
            with np.errstate(divide="ignore"):  # a word's own probability may be too small for a double
                both = np.maximum(np.log(both), logs + np.log((1 - share) * (1 - follow)))
            sums[:, f, i] = np.bincount(cell, both, len(sums))
    return sums.reshape(len(size), gates, len(FOLLOW), len(SHARES)) / np.log(10)


def _before(flat: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often training texts have the word before each word; before the first stands an end (number 0)."""
    return seen[np.concatenate([np.zeros_like(flat[:1]), flat[:-1]])]


def follow_gains(alone: np.ndarray, times: np.ndarray, pair: np.ndarray, train: np.ndarray) -> np.ndarray:
    """``gain[gate, follow]``: millionths of log10 that each share of the word before adds over training words.

    A word is predicted from the counts without its own occurrence.  Gains are whole numbers, so that
    their sums are the same in any order.
    """
    left = times[train] - 1
    gate = np.searchsorted(_BEFORE, left, "right")
    follows = np.minimum((pair[train] - 1) / np.maximum(left, 1), 1)
    ratio = follows / np.maximum(alone[train], 1e-300)
    out = np.zeros((len(_BEFORE) + 1, len(FOLLOW)), np.int64)
    for f in np.flatnonzero(FOLLOW):  # a share of 0 adds nothing
        gain = np.rint(1e6 * np.log10(1 - FOLLOW[f] + FOLLOW[f] * ratio))
        out[:, f] = np.bincount(gate, gain, len(out)).astype(np.int64)  # whole numbers, exact in doubles
    return out


def _chosen(sums: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Each document's log10 probability under the gates' shares ``best``: a Bayesian mixture over ``SHARES``."""
    total = sums[:, np.arange(len(best)), best].sum(1)
    top = total.max(1, keepdims=True)
    return top[:, 0] + np.log10((10.0 ** (total - top)).mean(1))


def scores(docs: DataFrame, mod: int = 7, rest: int = 2, key: str = "doc_id", text: str = "text",
           chunk_bytes: int = 32 << 20) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document.

    Rows whose crc32 of the key as text leaves ``rest`` modulo ``mod`` are held out
    (a null key counts as the empty text); all others are learnt from.  ``score``
    is the model's log10 probability of the text's lower-cased words and end,
    ``base_score`` that of single words with one added to every count.

    Every bit of every text is predicted from the four bytes before it, over word ends, and the word so far;
    counts and weights are learnt from every occurrence in the training texts.
    A word's probability joins its training count with its spelling's at its place (as often as there are
    distinct words), then under the gate's share the frequency after the word before, then the
    words seen so far.  All are proper distributions over all words.  Learnt texts are scored
    by the whole model, their own counts included.

    Null, empty and word-less texts are one end.  Repeated rows score alike and are
    learnt from each.  Without training rows only spelling and the document's own words predict, and
    the base score is 0.  A word of any length is scored whole.  An empty table gives no rows; other
    columns are left out.  Results depend neither on the rows' order nor on how they are dealt out
    (but for the last digits of sums).

    Words are counted, and their bytes after the third spelled, once for the whole corpus: texts become numbers of
    words in chunks of about ``chunk_bytes``, where the first bytes are spelled once for each four bytes before them; a word's row holds its places in the chunks'
    lists (at most those of 2^10 input partitions, then it has another row), and its
    score goes back to them.  Pairs of words go as hashes, chunk by chunk, to the task that adds
    them up and their totals come back (``pair_counts``).
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = written(indexed(docs, mod, rest, key, text, chunk_bytes), "word-numbers", "zstd")
    lists = parts.where("kind = 1").select(
        "word", F.shiftright("chunk", 24 + _SPAN_BITS).cast("int").alias("span"), F.struct("chunk", "idx").alias("place"), "c")
    by_word = Window.partitionBy("word")
    vocabulary = written(
        lists.repartition("word").groupBy("word", "span").agg(F.collect_list("place").alias("places"), F.sum("c").alias("own"))
        .withColumn("c", F.sum("own").over(by_word)).withColumn("once", F.col("span") == F.min("span").over(by_word))
        .drop("own", "span"), "vocabulary", "zstd")
    known = vocabulary.where("once and c > 0").select("word", "c")
    total = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    heads = written(parts.where("kind = 3").groupBy(F.col("bucket").alias("key")).agg(F.sum("c").alias("c")), "word-heads", "zstd")
    pieces = coded_pieces(known, heads)
    # a learner's counts are one table: so many pieces that the tables are few
    shares = max(1, -(-(v + heads.count()) // _TASK_WORDS))
    counts = bit_counts(pieces.coalesce(shares))
    learnt = fit_mixer(pieces.withColumn("share", F.pmod(F.xxhash64("word"), F.lit(shares))), counts)
    model = spark.sparkContext.broadcast(Model.of(counts, *learnt))

    def score_words(batches):
        held, places = [], 0
        for ws, times, part in _batches(batches):
            lp = model.value.tails(ws)
            at = part.column("places")
            owner = np.repeat(np.arange(len(ws)), pc.list_value_length(at).to_numpy())
            at = at.flatten()
            size = np.fromiter(map(len, ws), np.int64, len(ws))
            held.append((at.field("chunk").to_numpy(), at.field("idx").to_numpy(), times[owner],
                         lp.astype(np.float32)[owner], _word_hashes(ws)[owner], size[owner]))
            places += len(owner)
            if places >= _HELD_PLACES:
                yield from packed_places(*map(np.concatenate, zip(*held)))
                held, places = [], 0
        if held:
            yield from packed_places(*map(np.concatenate, zip(*held)))

    none = F.lit(None)
    back = vocabulary.select("word", "c", "places").mapInArrow(score_words, _PLACES)
    back = back.withColumns({"bucket": none.cast("long"), "totals": none.cast("binary")})
    pairs = pair_counts(parts.where("kind = 2").select("chunk", "bucket", "n", "keys", "counts"))
    ends = parts.where("kind = 4").select("chunk", F.col("keys").alias("front"), F.col("counts").alias("rear"))
    back = back.unionByName(pairs, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)

    def score_documents(left: pa.Table, right: pa.Table) -> pa.Table:
        is_pair = right.column("totals").is_valid()
        totals = right.filter(is_pair).sort_by("bucket").column("totals")
        totals = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<f4") for x in totals])
        ends = right.filter(right.column("front").is_valid())
        front, rear = (np.frombuffer(ends.column(c)[0].as_py(), "<u4").astype(np.uint64) for c in ("front", "rear"))
        right = right.filter(right.column("n").is_valid())
        known, tail, hashes, width = unpacked_places(right)
        size = width + 1  # the space or the end
        heads = Heads(model.value)

        def placed(flat):
            """log10 of the probability of every word at its place, by its spelling there and its count."""
            spelled = heads.log10(head_keys(flat, width, front, rear)) + tail[flat]
            times = known[flat]
            with np.errstate(divide="ignore", under="ignore"):
                counted = np.log10((times + v * 10.0 ** spelled) / max(n + v, 1))
            return np.where(times > 0, counted, spelled + np.log10(max(v, 1) / (n + max(v, 1))))

        base = np.log10((known + 1) / (n + v + 1))
        gain = np.zeros((len(_BEFORE) + 1, len(FOLLOW)), np.int64)
        out = []
        # the chunk's totals are in its distinct pairs' ascending order
        places = sum(int.from_bytes(x.as_py()[:8], "little") for x in left.column("ids"))
        keys = _pair_keys((_unpacked(x.as_py()) for x in left.column("ids")), places, hashes)
        order = np.argsort(keys)
        keys = keys[order]
        rank = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1], dtype=np.int32)])
        del keys
        pairs = np.empty(places, "<f4")
        pairs[order] = totals[rank]
        del order, rank
        done = 0
        for batch in left.combine_chunks().to_batches():
            for part in chunks(batch, "ids", 1 << 20):
                ids = [_unpacked(x.as_py()) for x in part.column("ids")]
                length = np.array([len(x) for x in ids])
                first = np.cumsum(length) - length
                flat = np.concatenate(ids).astype(np.int64)
                pair, done = pairs[done:done + len(flat)].astype(np.float64), done + len(flat)
                own = placed(flat)
                sums = _log_sums(flat, length, None, known, pair, own)
                train = np.repeat(~part.column("held").to_numpy(zero_copy_only=False), length)
                gain += follow_gains(10.0 ** own - 1 / max(n + v, 1), _before(flat, known), pair, train)
                out.append(pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("held"), pa.array(length, pa.int64()),
                     pa.array(np.add.reduceat((known[flat] > 0).astype(np.int64), first)),
                     pa.array(np.add.reduceat(base[flat], first)), pa.array(np.add.reduceat(size[flat], first)),
                     pa.array([x.astype("<f4").tobytes() for x in sums], pa.binary()), pa.nulls(len(ids), pa.binary())],
                    names=["k", "held_out", "n_tokens", "n_known", "base_score", "bytes", "sums", "gain"]))
        table = pa.Table.from_batches(out)
        last = pa.table({"gain": pa.array([gain.tobytes()], pa.binary())})
        return pa.concat_tables([table, last], promote_options="default").select(table.column_names)

    texts = parts.where("kind = 0").select(F.col("chunk").alias("chunk_"), "k", "held", "ids")
    coded = written(texts.groupBy("chunk_").cogroup(back.groupBy("chunk")).applyInArrow(
        score_documents, f"k {kind}, held_out boolean, n_tokens long, n_known long, base_score double, bytes long, "
                         "sums binary, gain binary"), "document-sums", "zstd")
    model.unpersist()
    gates = (len(_BEFORE) + 1, len(FOLLOW))

    def add_gains(batches):
        total = np.zeros(gates, np.int64)
        for b in batches:
            for x in b.column("gain"):
                total += np.frombuffer(x.as_py(), np.int64).reshape(gates)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "g"])

    gain = np.zeros(gates, np.int64)
    for r in (coded.where("gain is not null").select("gain").mapInArrow(add_gains, "i long, g long")
              .groupBy("i").agg(F.sum("g").alias("g")).collect()):
        gain.ravel()[r["i"]] = r["g"]
    best = gain.argmax(1)
    shape = (-1, *gates, len(SHARES))

    def finish(batches):
        for b in batches:
            sums = np.frombuffer(b"".join(x.as_py() for x in b.column("sums")), "<f4").reshape(shape).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("k", "held_out", "n_tokens", "n_known")), pa.array(np.full(b.num_rows, n)),
                 b.column("base_score"), pa.array(_chosen(sums, best)),
                 pa.array(-_chosen(sums, best) / np.log10(2) / b.column("bytes").to_numpy())],
                names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    out = coded.where("gain is null").drop("gain").mapInArrow(
        finish, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("k", key)
