"""Divergences of sources against exact arithmetic over dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest

from triflux.llm import divergence
from triflux.llm.divergence import audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n int, p string, gb string"


def slow(rows, least, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [x.translate(FOLD) for x in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = sorted(s for g, s in counts if g == lang)
        whole = sum((counts[lang, s] for s in groups), Counter())

        def shares(own):
            below = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // below for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in groups}, shares(whole)
        for s in groups:
            far = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in groups if x != s]
            far.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, s, "pair", x, v, i + 1) for i, (v, x) in enumerate(far)]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            over.sort(key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(over[:top])]
    return sorted(out)


def some(seed, n=200):
    rng = random.Random(seed)
    words = ["a", "B", "Über", "über", "naïve", "don", "😀", "x1y", "ß", "É", "é", "zz", "q-r", "İ", "ǅ"]
    sources = ["s1", "s2", "S", "é", "z", None, "", "hot", "hot", "hot", "hot"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words[: rng.randint(3, 15)]) for _ in range(rng.randint(0, 12)))
        rows.append((k, text, rng.choice(["en", "de", None, ""]), rng.choice(sources), 1, "x", "y"))
    rows += [(1, None, "en", "only null", 1, None, None), (2, "", "xx", "bare", 1, None, None)]
    rows += [(3, "rare", "xx", None, 1, "", ""), (4, "\x00\x7f{}", None, None, 1, "", ""), rows[5], rows[5]]
    return rows + [(9, "long Long " * 30_000, "en", "s1", 1, "", "")]


@pytest.mark.parametrize("least, top, groups, terms", [(5, 4, 2, 3), (1, 50, 64, 4096), (30, 50, 1, 2)])
def test_equals_exact_arithmetic(frame, least, top, groups, terms):
    rows = some(least)
    got = audit(frame(rows, SCHEMA), least, top, groups, terms).collect()
    assert sorted(map(tuple, got)) == slow(rows, least, top)


def test_partial_counts_and_empty_tables(frame, monkeypatch):
    monkeypatch.setattr(divergence, "KEPT", 5)
    rows = some(8, 60)
    assert sorted(map(tuple, audit(frame(rows, SCHEMA), 2).collect())) == slow(rows, 2, 50)
    assert audit(frame([], SCHEMA)).count() == 0


def test_shares_beyond_long_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9 * 10**12, 10**13, 10**6
    row = spark.sql(f"select {n}L n, {total}L total, {kept}L kept")
    got = row.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
