"""Secrets, personal data, licences and languages against brute force and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from triflux.llm import boosting, langid, licenses, pii, secret_scan


def slow_secrets(text):
    name = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end())
           for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
           if len(m.group(1)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_base_secrets_match_brute_force():
    rng = random.Random(1)
    parts = ["password", "Token", "SECRET", "api_key", "APIkey", ":", "=", " ", '"', "'", "AKIA", "ſ",
             "ABCDEFGH12345", "abcdef0123456789", "x", "\n", "é", "zz.=-_/+", "0123456789ab"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [tuple(x) for x in secret_scan.base_spans(text)] == slow_secrets(text), text


def test_novel_strings_are_found_and_identifiers_are_not():
    text = "private key Zx9Qw3Lm7Rt5Yb1Nc8Vf2Kd6 for getUserAccessTokenFromRequest1 or getUserAccessTokenFromRequest2"
    base, spans = secret_scan.find(text)
    assert base == [] and [text[x.start : x.end] for x in spans] == ["Zx9Qw3Lm7Rt5Yb1Nc8Vf2Kd6"]
    assert secret_scan.find("the value Zx9Qw3Lm7Rt5Yb1Nc8Vf2Kd6 is no key at all")[1] == []
    assert secret_scan.redact(text, spans).startswith("private key [SECRET] for")


def test_secret_scan_of_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (None, "token=abcdefghijklmnop"), (3, "a " * 50_000), (3, "AKIA" * 50_000)]
    got = {(r.doc_id, r.spans, r.n_assign) for r in secret_scan.scan(frame(rows)).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "assign:0:22", 1), (3, "", 0), (3, "access:0:200000", 0)}
    assert secret_scan.scan(frame([])).count() == 0
    wide = frame([(1, "secret: aaaaaaaaaaaaa!", 9, "x")], "doc_id long, text string, n_chars long, spans string")
    row = secret_scan.redacted(wide).first()
    assert row.asDict() == {"doc_id": 1, "text": "[SECRET]!", "n_chars": 9, "spans": "x"}


def luhn(digits):
    numbers = [int(x) for x in reversed(digits)]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(numbers)) % 10 == 0


def slow_private(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(":".join(map(str, x)) for x in out)


def test_base_private_data_match_brute_force(frame):
    rng = random.Random(2)
    parts = ["1", "12", "123", "4111111111111111", "5500 0000 0000 0004", "+1 (938) 555-0822", "+", "(", ")",
             ".", " ", "-", "@", "a.b", "mail.com", "x_y", "é", "\n", "192.168.1.1", "300.1.1.1", "0001.2.3.4",
             "😀", "%", "1234567890123456789"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(800)]
    texts += [None, "", "1 " * 2_000, "1" * 2_000, "a@b" + ".c" * 3_000, "+" + "1-" * 3_000, "￿1.2.3.4"]
    for r in pii.scan(frame(list(enumerate(texts)))).collect():
        want = slow_private(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        own = [x for x in r.spans.split(",") if x]
        base = [x for x in own if x.split(":")[0] in ("email", "ip", "card", "phone")]
        assert ",".join(base) == want
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_private_data_of_an_empty_table(frame):
    assert pii.scan(frame([])).count() == 0


def test_boosting_separates_cells_and_columns_agree(spark):
    cells = np.array([[a, b] for a in range(4) for b in range(3)])
    positive = np.where((cells[:, 0] > 1) & (cells[:, 1] != 1), 50.0, 0.0)
    total = np.full(len(cells), 50.0)
    trees = boosting.boost(cells, total, positive)
    scored = boosting.scores(trees, cells)
    at = boosting.threshold(scored, total, positive, 0.99)
    assert at is not None and ((scored >= at) == (positive > 0)).all()
    df = spark.createDataFrame([(x.tolist(),) for x in cells], "f array<int>")
    column = boosting.score_column(trees, lambda i: df["f"][i])
    assert np.allclose([r[0] for r in df.select(column).collect()], scored)
    assert boosting.boost(np.zeros((0, 2)), np.zeros(0), np.zeros(0)) == []


def test_increasing_runs_are_longest():
    rng = random.Random(3)
    for _ in range(300):
        values = rng.sample(range(40), rng.randint(0, 9))
        kept = [values[i] for i in licenses.increasing(values)]
        longest = max(
            (bin(m).count("1") for m in range(1 << len(values))
             if (s := [x for i, x in enumerate(values) if m >> i & 1]) == sorted(s)), default=0,
        )
        assert kept == sorted(kept) and len(kept) == longest


def test_licences_are_found_in_changed_copies(frame):
    mit = licenses.TEMPLATES["mit"].strip()
    text = f"Prose before. {mit.replace('furnished', 'xx yy')} And after. {mit.upper()} Released under the MIT License."
    found = licenses.Matcher(licenses.TEMPLATES).find(text)
    assert [x.licence for x in found] == ["mit", "mit", "mit-line"]
    assert text[found[0].start : found[0].end].startswith("Permission is hereby")
    assert found[0].coverage > 0.97 and found[1].coverage == 1.0
    rows = [(1, None), (2, ""), (3, "license " * 20_000), (4, "Licensed under the Apache License, Version 2.0.")] * 2
    got = sorted((r.doc_id, r.licence, r.start, r.end) for r in licenses.scan(frame(rows)).collect())
    assert got == [(4, "apache-2.0-line", 0, 46)] * 2
    assert licenses.scan(frame([])).count() == 0


DOCS = "doc_id long, text string, lang string"


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert got.count() > 200 and right >= 0.97 * got.count()


def test_languages_of_odd_rows(frame):
    rows = [(k, t, lang) for k in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 !? 34", "de"), (None, "the dog", None), (103, "thedog", None),
           (104, "katzen " * 30_000, None), (103, "thedog", None)]
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(frame(rows + odd, DOCS)).collect() if r.doc_id not in range(40)]
    assert sorted(got, key=str) == sorted(
        [(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "en"), (104, "de"), (103, "en")], key=str
    )
    assert langid.identify(frame([], DOCS)).count() == 0
    assert [r.lang_pred for r in langid.identify(frame([(1, "a b", None)], DOCS)).collect()] == ["und"]


def by_dictionaries(sample, texts):
    """Languages by plain dictionaries: words, then ever shorter n-grams of unseen ones."""

    def pieces(word, n):
        marked = f"<{word}>" if n > 1 else word
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    langs = sorted({x for _, x in sample})
    words = {x: Counter(w for t, y in sample if x == y for w in langid.WORDS.findall(t.lower())) for x in langs}
    grams = {(x, n): Counter(p for w in words[x] for p in pieces(w, n)) for x in langs for n in langid.NGRAMS}

    def log(tables, key):
        every = len(set().union(*tables))
        return [math.log((t[key] + 0.5) / (t.total() + 0.5 * every)) for t in tables]

    def scores(word):
        if any(word in words[x] for x in langs):
            return log([words[x] for x in langs], word)
        for n in langid.NGRAMS:
            tables = [grams[x, n] for x in langs]
            found = [log(tables, p) for p in pieces(word, n) if any(p in t for t in tables)]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        own = langid.WORDS.findall((text or "").lower())
        total = [sum(x) for x in zip(*map(scores, own))]
        best = max(total, default=0)
        out.append("und" if not own else langs[total.index(best)] if any(total) else None)
    return out


@pytest.mark.parametrize("kept", [30, 100_000])
def test_languages_equal_those_by_dictionaries(frame, monkeypatch, kept):
    monkeypatch.setattr(langid, "KEPT", kept)
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    rng = random.Random(kept)
    letters = {"de": "abcdeäß", "en": "abcdefg", "xx": "efghé"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 6)))
    text = lambda x: " ".join(word(x) for _ in range(rng.randint(1, 8)))
    rows = [(k, text(x), x) for k, x in enumerate(rng.choices(list(letters), k=150))]
    sample = [(t, x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    asked = [text(rng.choice(list(letters))) for _ in range(60)] + ["ж", "½ 2", "", None, "Zz zz" * 50]
    asked = [(1_000 + k, t, None) for k, t in enumerate(asked)]
    got = {r.doc_id: r for r in langid.identify(frame(rows + asked, DOCS)).collect()}
    want = by_dictionaries(sample, [t for _, t, _ in asked])
    common = Counter(x for _, x in sample).most_common(1)[0][0]
    for (k, t, _), lang in zip(asked, want):
        lang = "und" if t == "½ 2" else lang or common
        assert got[k].lang_pred == lang and 0 <= got[k].score <= 1, t


def test_every_language_is_learned_however_many(frame):
    rows = [(k * 10 + i, (chr(97 + k // 15) + chr(97 + k % 15)) * 3 + " wort", f"l{k:03d}") for k in range(230) for i in range(6)]
    got = langid.identify(frame(rows, DOCS).repartition(3)).collect()
    want = {k: x for k, _, x in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) > 0.9 * len(rows)


def test_texts_of_no_learned_language_go(frame):
    rows = [(k, t, lang) for k in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    model = langid.learn(frame(rows, DOCS))
    kept = ["the dog and the cat", "der hund", "the cat and the dog und die katze und der hund", "the dog 12 qzx"]
    gone = ["все люди равны", "人人生而自由", "όλοι οι άνθρωποι", "qzx vbnw kjqp wzzq", "kaikki ihmiset syntyvat vapaina", "12", None]
    texts = frame([(k, t, None) for k, t in enumerate(kept + gone)], DOCS)
    assert {r.text for r in langid.accepted(texts, model).collect()} == set(kept)
    (russian,) = langid.Scorer(model).judge(["все люди равны"])
    assert russian[0] in ("de", "en") and russian[2] == 0.0
    assert langid.accepted(frame([], DOCS), model).count() == 0
    few = langid.learn(frame([(None, "the cat and the dog", "en")] * 3, DOCS))
    assert [r.text for r in langid.accepted(texts, few).collect() if r.text in gone] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD License.", ["bsd-line"]),
        ("Released under the XYZ License.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0-line"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0-line"]),
        ("Licensed under CC BY-SA 4.0.", ["cc-by-sa-4.0-line"]),
        ("Licensed under CC BY 4.0.", ["cc-by-4.0-short-line"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0-line"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        (licenses.TEMPLATES["gpl-3.0"].replace("version 3", "version 2"), ["gpl-2.0"]),
        (licenses.TEMPLATES["gpl-3.0"].replace("General", "Affero General"), ["agpl-3.0"]),
    ],
)
def test_short_notices_need_their_name_and_version(text, want):
    assert [x.licence for x in licenses.Matcher(licenses.TEMPLATES).find(f"Prose. {text} More.")] == want


@pytest.mark.parametrize("licence", sorted(licenses.TEMPLATES))
def test_templates_are_found_whole_and_with_a_tenth_of_the_words_changed(licence):
    matcher, own = licenses.Matcher(licenses.TEMPLATES), licenses.TEMPLATES[licence]
    assert licence in [x.licence for x in matcher.find(own) if x.coverage == 1.0]
    if licence not in licenses.REQUIRED:
        words = own.split()
        # Of all the words that few other templates have.
        spread = {w: sum(w.lower() in x.lower() for x in licenses.TEMPLATES.values()) for w in set(words)}
        for i in sorted(range(len(words)), key=lambda i: (spread[words[i]], i))[: len(words) // 10]:
            words[i] = "changed"
        assert licence in [x.licence for x in matcher.find(" ".join(words))]


def test_obfuscated_private_data_are_added_by_their_context(frame):
    rows = [(k, f"call +1 (938) 555-{k:04d} or mail jane{k}@mail.com now") for k in range(200)]
    rows += [(1000 + k, f"order {k:06d} of 2024-01-{k % 28 + 1:02d}") for k in range(200)]
    odd = {2000: "call (938) 555-0822 now", 2001: "mail jane [at] mail [dot] com now", 2002: "order 123456 7",
           2003: "call 938 555 0822 1.2.3.4 now", 2004: None}
    got = {r.doc_id: r.spans for r in pii.scan(frame(rows + list(odd.items()))).collect()}
    assert got[2000] == "number:5:19" and got[2001] == "address:5:29"
    assert got[2002] == "" and got[2004] == "" and got[1005] == ""
    assert got[2003].startswith("ip:18:25") and got[5].startswith("email:31:45,phone:5:22")
