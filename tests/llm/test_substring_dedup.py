"""Repeated passages against brute force over windows as word tuples."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from triflux.llm import substring_dedup
from triflux.llm.substring_dedup import Words, _estimates, removal_digest, without_repeats

WORD = re.compile("[^ \t-\r]+")


def slow(rows, size):
    """``(doc_id, n_words, n_removed, kept)`` by a dictionary of all windows."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (k, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            if k is not None:
                least[tuple(w[i : i + size])] = min(k, least.get(tuple(w[i : i + size]), k))
    out = []
    for (k, t), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if k is not None and least[tuple(w[i : i + size])] < k:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), None if t is None else kept))
    return Counter(out)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    passage = [word() + "é" for _ in range(30)]
    rows = []
    for k in range(80):
        body = [word() for _ in range(rng.choice((0, 3, 13, 60)))]
        if rng.random() < 0.5:
            body[rng.randrange(len(body) + 1) :] = passage[rng.randrange(10) :]
        gap = rng.choice((" ", "  ", "\n", "\t \x0b"))
        rows.append((rng.randrange(60) if k % 9 else None, gap + gap.join(body) + gap))
    rows += [(5, None), (None, None), (70, ""), (71, " \r\n"), rows[3], rows[3], (-4, rows[7][1])]
    rows += [(80, "x y " * 40_000), (81, "x y " * 20), (82, "  x " * 20), (83, "a\x00b " * 20)]
    return rows + [(90, "ab" * 9_000 + " b" * 20), (91, "ab" * 9_000 + " b" * 20)]


@pytest.mark.parametrize("size, part_bytes", [(13, 1 << 23), (13, 900), (3, 900), (1, 5_000)])
def test_equals_brute_force(frame, size, part_bytes):
    rows = texts(size)
    got = without_repeats(frame(rows), size, part_bytes).collect()
    assert Counter(map(tuple, got)) == slow(rows, size)


def test_digest_and_clashing_columns(frame):
    body = " ".join(map(str, range(30)))
    rows = [(2, body, 1, "x", "y"), (1, f"q {body}  z", 2, "x", "y"), (3, None, 3, None, None)]
    wide = frame(rows, "doc_id long, text string, part int, kind string, shard string")
    got = {r.doc_id: r for r in removal_digest(wide).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[2].n_words, got[2].n_removed, got[2].kept_sha256) == (30, 30, empty)
    assert (got[1].n_removed, got[3].n_words, got[3].kept_sha256) == (0, 0, empty)
    assert got[1].kept_sha256 == hashlib.sha256(f"q {body} z".encode()).hexdigest()
    assert removal_digest(frame([])).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    values = [np.unique(rng.integers(0, 40_000, 9_000).astype(np.uint32)) for _ in range(3)]
    marks = [rng.random(len(v)) < 0.1 for v in values]
    count = Counter()
    for v, m in zip(values, marks):
        count.update(dict(zip(v.tolist(), (1 + m).tolist())))
    flags = _estimates(values, marks)
    truth = np.array([count[x] >= 2 for x in np.concatenate(values).tolist()])
    assert flags[truth].all() and flags[~truth].mean() < 0.05


def test_words_are_hashed_in_chunks(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    own = [x.encode() for _, x in texts(9)[:40]]
    whole = Words(own)
    first, hashes = whole.windows(4)
    spans = [tuple(bytes(whole.bytes[whole.begins[i] : whole.begins[i + 4]]).split()) for i in first.tolist()]
    assert len(set(hashes.tolist())) == len(set(spans))
    assert len(set(zip(spans, hashes.tolist()))) == len(set(spans))
