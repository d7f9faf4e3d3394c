"""Texts are coded whole: contexts reach over word ends, and pieces together have every byte of a text once."""

import numpy as np

from seqmill.llm import ctxmix
from tests.llm import brute
from tests.llm.test_operators import documents


def test_pieces_have_every_byte_of_a_text_in_its_contexts():
    ws = [b"", b"a", b"to", b"the", b"there", b"x", "été".encode()]
    texts = [[1, 2, 3, 4, 0], [5, 1, 5, 6, 0], [0], [2, 1, 4, 0]]
    flat = np.concatenate(texts)
    front, back = ctxmix.word_ends(ws)
    keys = ctxmix.head_keys(flat, np.array([len(w) for w in ws]), front, back)
    heads = ctxmix.Coded(ctxmix.head_pieces(keys), 4, 4)
    got, i = [], 0
    for t in texts:
        for w in t:
            pieces = [(heads, heads.owner == i)]
            if len(ws[w]) > 2:
                tail = ctxmix.Coded([b" " + ws[w] + b" "], 4, 1)
                pieces.append((tail, tail.owner == 0))
            got += [(c.byte[p], [h[p] for h in c.hashes]) for c, p in pieces]
            i += 1
    byte = np.concatenate([b for b, _ in got])
    whole = [b"\0\0\0\n" + b"".join(ws[w] + b" " if w else b"\n" for w in t) for t in texts]
    assert byte.astype(np.uint8).tobytes() == b"".join(x[4:] for x in whole)
    coded = [ctxmix.Coded([x], 4, 4) for x in whole]
    for order in range(5):  # the last 0 to 4 bytes of the text
        want = np.concatenate([c.hashes[order] for c in coded])
        assert np.concatenate([h[order] for _, h in got]).tolist() == want.tolist()
    # the word so far: as the word alone has it
    alone = [ctxmix.Coded([ws[w]]) for w in flat]
    assert np.concatenate([h[5] for _, h in got]).tolist() == np.concatenate([c.hashes[5] for c in alone]).tolist()


def test_words_never_seen_are_spelled_after_the_words_before(spark):
    """Each word begins as the one before ends, and no word occurs twice: only contexts over the word's start know that."""
    r = np.random.default_rng(11)
    letters, seen = list("bcdfgklmnprs"), set()

    def text(n=60):
        out, last = [], str(r.choice(letters))
        while len(out) < n:
            w = last + "".join(r.choice(letters, 5))
            if w not in seen:
                seen.add(w)
                out.append(w)
                last = w[-1]
        return out

    texts = [text() for _ in range(120)]
    shuffled = [list(r.permutation(t)) if brute.held_out(k, 7, 2) else t for k, t in enumerate(texts)]
    real, mixed = ({x.doc_id: x for x in ctxmix.scores(documents(spark, [" ".join(t) for t in ts])).collect()}
                   for ts in (texts, shuffled))
    held = [k for k, x in real.items() if x.held_out]
    assert held and all(real[k].score > mixed[k].score + 10 for k in held)
