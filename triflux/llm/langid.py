"""Language identification by words, and by ever shorter character n-grams for unseen ones.

A known word adds its log frequency in each language. An unseen word is looked
up by its n-grams of ``NGRAMS[0]`` characters, with marks for its ends; only if
none of them is known do shorter ones speak for it, down to single characters. The
marks are no characters of their own, so a word of unknown letters says nothing, and
a text of such words alone is given the language with most documents.

Whether a text is of a learned language at all is a question of fit, not of the
score, which only compares the learned languages. A known word fits; an unseen one
by the square of the share of its n-grams of ``NGRAMS[0]`` characters that one
language has, as related languages share many. Each word may fit another language,
so texts in several languages fit. The fit is measured against the median of that
language's held-out documents.

The model has all words and n-grams it learned from, as 64-bit hashes with a log
frequency for each language that has them. ``learn`` fits it on a bounded sample: about
``SAMPLE`` labelled documents of each language, but no more than about ``DOCUMENTS`` in
all, chosen by a hash of id and text. ``learn_all`` fits it on every labelled document,
and measures the usual fit on every held-out one. What tasks then get as sorted arrays
are the most frequent hashes, ``HELD`` entries at most; the others stay a table. Words
that are not among the arrays' words are scored once each, by joins with that table, and
added to their texts' sums by a join. ``accepted`` needs that only for texts that do not
fit well enough by the arrays' words alone. Prediction reads all words of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table
from triflux.llm.tokens import slices

SAMPLE, DOCUMENTS = 4_000, 200_000
NGRAMS = (4, 3, 2, 1)
#: In place of an n-gram's size: whole words.
WORD = 0
SMOOTHING = 0.5
#: Scores are probabilities given as much evidence as so many words, so that long texts differ.
EVIDENCE = 8
UNKNOWN = "und"
#: The share of its language's usual fit below which a document is of no language that
#: was learned; about how many held-out documents of a language tell what is usual, and
#: what is where no language has any.
LEAST, FITTED, USUAL = 0.3, 500, 0.5
#: Letters for which a word counts at most in the fit, so that no run of letters outweighs a text.
LETTERS = 12
#: Partial word counts, and words with their scores, that a task holds; words looked up at once.
KEPT, KEPT_SCORES, AT_ONCE = 100_000, 1_000_000, 20_000

#: Entries of a model, one a language and hash, that the driver gathers and tasks get.
HELD = 500_000

WORDS = re.compile(r"[^\W\d_]+")
_SLOTS = 1 << 20
COUNTS = "lang string, size int, hash long, n long"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id is not."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


_FACTORS = np.random.default_rng(9).integers(0, 1 << 64, 1 << 10, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams, in order, and how many each word has.

    N-grams have marks for a word's ends unless they are single characters. With size
    ``WORD`` each word is one, whole.
    """
    codes = np.frombuffer("".join(f"<{x}>" for x in words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) + 2 for x in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    spread = _mixed(codes.astype(np.uint64) + np.uint64(1))
    if size == WORD:
        place = np.arange(len(codes)) - np.repeat(begins, lengths)
        terms = spread * _FACTORS[place % len(_FACTORS)]
        found = np.add.reduceat(terms, begins) if len(words) else terms
        return _mixed(found), np.ones(len(words), np.int64)
    counts = np.maximum(lengths - 2 if size == 1 else lengths - size + 1, 0)
    first = np.repeat(begins + (size == 1), counts) + _places(counts)
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total += spread[first + k] * _FACTORS[k]
    return _mixed(total + np.uint64(size)), counts


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on for each of the counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


@dataclass
class Table:
    """Hashes in order, and for each the languages that have it with what it adds to the base.

    ``base`` is the log frequency in a language that does not have a hash.
    """

    keys: np.ndarray
    begins: np.ndarray
    langs: np.ndarray
    adds: np.ndarray
    base: np.ndarray

    def look_up(self, hashes: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
        """Per word: its known hashes, the sums of their scores, and how many a language has."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        at, owner = at[hit], owner[hit]
        known = np.bincount(owner, minlength=words)
        counts = self.begins[at + 1] - self.begins[at]
        entry = np.repeat(self.begins[at], counts) + _places(counts)
        width = len(self.base)
        cell = np.repeat(owner, counts) * width + self.langs[entry]
        adds = np.bincount(cell, self.adds[entry], words * width).reshape(words, width)
        having = np.bincount(cell, minlength=words * width).reshape(words, width)
        return known, adds + known[:, None] * self.base, having


@dataclass
class Model:
    """Tables of words and n-grams; ``usual`` says how well texts of a language fit.

    ``prior`` is the share of each language among all labelled documents. ``rest`` has
    the hashes that are not in ``tables``, if there are any: ``size, hash, known, sums,
    having``, as ``Table.look_up`` returns them for a word that has it once.
    """

    languages: list[str]
    prior: np.ndarray
    tables: dict[int, Table]
    usual: np.ndarray
    rest: DataFrame | None = None
    _shared: Broadcast | None = field(default=None, repr=False)

    def shared(self, spark: SparkSession) -> Broadcast:
        """The tables, broadcast once for all that use them."""
        if self._shared is None:
            own = Model(self.languages, self.prior, self.tables, self.usual)
            self._shared = spark.sparkContext.broadcast(own)
        return self._shared

    def scores(self, words: list[str], fit: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per word its scores by language and, if asked for, how well it fits, from 0 to 1."""
        out = np.zeros((len(words), len(self.languages)))
        fits = np.ones(len(words))
        left = np.arange(len(words))
        for size in (WORD, *NGRAMS):
            if not len(left) or size not in self.tables:
                continue
            own = [words[i] for i in left.tolist()]
            hashes, counts = grams(own, size)
            owner = np.repeat(np.arange(len(own)), counts)
            known, sums, _ = self.tables[size].look_up(hashes, owner, len(own))
            hit = known > 0
            out[left[hit]] = sums[hit] / known[hit, None]
            if fit and size == WORD:
                fits[left[~hit]] = self._fits([x for x, y in zip(own, hit, strict=True) if not y])
            left = left[~hit]
        return out, fits

    def words_only(self) -> Model:
        """The model without n-grams: words that it does not hold have no score, and fit 0."""
        tables = {x: t for x, t in self.tables.items() if x == WORD}
        return Model(self.languages, self.prior, tables, self.usual)

    def _fits(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        sizes = np.minimum(NGRAMS[0], [len(x) + 2 for x in words])
        for size in np.unique(sizes).tolist():
            if size not in self.tables:
                continue
            at = np.flatnonzero(sizes == size)
            hashes, counts = grams([words[i] for i in at.tolist()], size)
            owner = np.repeat(np.arange(len(at)), counts)
            _, _, having = self.tables[size].look_up(hashes, owner, len(at))
            out[at] = (having.max(axis=1) / counts) ** 2
        return out


def _verdict(
    model: Model, totals: np.ndarray, letters: np.ndarray, n_words: int
) -> tuple[str, float, float]:
    """A text's language, score and fit from the sums over its words."""
    if not letters[2]:
        return UNKNOWN, 0.0, 0.0
    if not totals.any():  # not one letter is known
        best = int(model.prior.argmax())
        return model.languages[best], float(model.prior[best]), 0.0
    best = int(totals.argmax())
    evidence = (totals - totals[best]) * min(1.0, EVIDENCE / n_words)
    return model.languages[best], float(1 / np.exp(evidence).sum()), float(letters[1] / letters[0])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the letters that count, and whether it has any."""
    real = [x.isalpha() or any(map(str.isalpha, x)) for x in words]
    return np.minimum([len(x) for x in words], LETTERS), np.array(real, bool)


class Scorer:
    """Judges texts in one task; keeps the scores of words it has met."""

    def __init__(self, model: Model, fit: bool = False) -> None:
        self._model, self._fit = model, fit
        self._most = max(1, min(KEPT, KEPT_SCORES // max(1, len(model.languages))))
        self._clear(0)

    def _clear(self, wanted: int) -> None:
        rows = max(self._most, wanted)
        self._rows = np.zeros((rows, len(self._model.languages)), np.float32)
        # Letters, at most LETTERS of a word; those that fit; whether there is one at all.
        self._letters = np.zeros((rows, 3), np.float32)
        self._at: dict[str, int] = {}

    def _learn(self, texts: list[list[str]]) -> None:
        missing = set().union(*texts).difference(self._at)
        if len(self._at) + len(missing) > len(self._rows):
            missing = set().union(*texts)
            self._clear(len(missing))
        words = list(missing)
        first = len(self._at)
        for low in range(0, len(words), AT_ONCE):
            part = words[low : low + AT_ONCE]
            here = slice(first + low, first + low + len(part))
            self._rows[here], fits = self._model.scores(part, self._fit)
            letters, real = _letters(part)
            self._letters[here] = np.column_stack([letters, letters * fits, real])
        self._at.update(zip(words, range(first, first + len(words)), strict=True))

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
        """Of each text the language, its score among the languages, and the fit to any of them."""
        waiting: list[list[str]] = []
        owners: list[int] = []
        width = len(self._model.languages)
        totals = np.zeros((len(texts), width))
        letters = np.zeros((len(texts), 3))
        n_words = np.zeros(len(texts), np.int64)

        def add() -> None:
            self._learn(waiting)
            for at, words in zip(owners, waiting, strict=True):
                rows = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
                totals[at] += self._rows[rows].sum(axis=0, dtype=np.float64)
                letters[at] += self._letters[rows].sum(axis=0, dtype=np.float64)
                n_words[at] += len(words)
            waiting.clear()
            owners.clear()

        if width:
            held = 0
            for at, text in enumerate(texts):
                for part in slices(text or ""):
                    words = WORDS.findall(part.lower())
                    if words:
                        waiting.append(words)
                        owners.append(at)
                        held += len(words)
                    if held >= AT_ONCE:
                        add()
                        held = 0
            add()
        for at in range(len(texts)):
            yield _verdict(self._model, totals[at], letters[at], n_words[at])

    def accept(self, texts: list[str | None], usual: np.ndarray, least: float) -> list[bool]:
        """Whether each text fits the languages at ``least`` times as well as is usual."""
        index = {x: i for i, x in enumerate(self._model.languages)}
        return [
            lang != UNKNOWN and fit > 0 and fit >= least * usual[index[lang]]
            for lang, _, fit in self.judge(texts)
        ]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()

    def rows() -> pa.RecordBatch:
        langs, words = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for part in slices(text.as_py()):
                counts.update((lang.as_py(), w) for w in WORDS.findall(part.lower()))
                if len(counts) > KEPT:
                    yield rows()
                    counts.clear()
    if counts:
        yield rows()


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial ``COUNTS`` of distinct ``lang, word, n``."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        words = batch.column(1).to_pylist()
        times = batch.column(2).to_numpy(zero_copy_only=False)
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            part = [words[i] for i in own.tolist()]
            for size in (WORD, *NGRAMS):
                hashes, counts = grams(part, size)
                # Each word once: n-grams stand for words that are rare.
                weight = times[own] if size == WORD else np.ones(len(hashes), np.int64)
                keys, at = np.unique(hashes, return_inverse=True)
                n = np.bincount(at, weight, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(keys), pa.string()),
                        pa.array(np.full(len(keys), size, np.int32)),
                        pa.array(keys.view(np.int64)),
                        pa.array(n),
                    ],
                    names=[x.split()[0] for x in COUNTS.split(", ")],
                )


def learn(
    docs: DataFrame, sample: int = SAMPLE, documents: int = DOCUMENTS, usual: bool = True
) -> Model:
    """Fits the model to ``docs (doc_id, text, lang)`` that are not held out.

    Null texts and languages teach nothing. A language with up to ``sample``
    documents is learned from all of them while all languages together have no more
    than ``documents``. The usual fit, which only ``accepted`` needs, is measured on
    held-out documents.
    """
    complete = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = complete.where(~held_out()).select("doc_id", "lang", "text")
    sizes = keep_table(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = min(sample, documents / max(1, sizes.count()))
    chosen = _sampled(labelled, sizes, each, "language")
    counted = (
        chosen.mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    hashed = counted.mapInArrow(_hash_counts, COUNTS)
    counts = hashed.groupBy("lang", "size", "hash").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].unique().to_pylist()))
    known = sizes.where(F.col("lang").isin(languages)).collect() if languages else []
    model = _fit(languages, counts, {r["lang"]: r["n"] for r in known})
    del counts
    pa.default_memory_pool().release_unused()
    if usual and languages:
        model.usual = _usual(complete.where(held_out()), model)
    return model


def _sampled(docs: DataFrame, sizes: DataFrame, each: float, seed: str) -> DataFrame:
    """``lang, text`` of about ``each`` documents of each language, by a hash of id and text."""
    slot = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(_SLOTS))
    share = F.ceil(F.lit(float(each)) / F.col("n") * _SLOTS)
    return docs.join(sizes, "lang").where(slot < share).select("lang", "text")


def _usual(docs: DataFrame, model: Model) -> np.ndarray:
    """The median fit of each language's documents; the lowest one where a language has none."""
    docs = docs.where(F.col("lang").isin(model.languages)).select("doc_id", "text", "lang")
    sizes = keep_table(docs.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = min(FITTED, DOCUMENTS / len(model.languages))
    shared = model.shared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, fit=True)
        for batch in batches:
            fits = [x for _, _, x in scorer.judge(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fits, pa.float64())], names=["lang", "fit"]
            )

    fits = _sampled(docs, sizes, each, "usual").mapInArrow(run, "lang string, fit double")
    usual = np.full(len(model.languages), np.nan)
    for r in fits.groupBy("lang").agg(F.percentile_approx("fit", 0.5).alias("fit")).collect():
        usual[model.languages.index(r["lang"])] = r["fit"]
    known = usual[~np.isnan(usual)]
    return np.where(np.isnan(usual), known.min() if len(known) else USUAL, usual)


def _fit(
    languages: list[str],
    counts: pa.Table,
    documents: dict[str, int],
    whole: dict[int, tuple[np.ndarray, int]] | None = None,
) -> Model:
    """The model from ``COUNTS``, each language and hash once.

    ``whole`` says what ``counts`` are a part of: by size the sum of each language, and
    how many hashes there are.
    """
    place = {x: i for i, x in enumerate(languages)}
    coded = counts["lang"].dictionary_encode().combine_chunks()
    places = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)
    lang = places[coded.indices.to_numpy()]
    size, n = counts["size"].to_numpy(), counts["n"].to_numpy()
    hashes = counts["hash"].to_numpy().view(np.uint64)
    tables = {}
    for s in (WORD, *NGRAMS):
        at = np.flatnonzero(size == s)
        at = at[np.lexsort((lang[at], hashes[at]))]
        keys, begins = np.unique(hashes[at], return_index=True)
        sums, n_keys = np.bincount(lang[at], n[at], len(languages)), len(keys)
        if whole is not None:
            sums, n_keys = whole.get(s, (sums, 0))
        sums = sums + SMOOTHING * n_keys
        if n_keys:
            tables[s] = Table(
                keys,
                np.append(begins, len(at)),
                lang[at].astype(np.int32),
                (np.log(n[at] + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32),
                np.log(SMOOTHING) - np.log(sums),
            )
    prior = np.array([documents.get(x, 0) for x in languages], np.float64)
    prior /= max(1.0, prior.sum())
    return Model(languages, prior, tables, np.full(len(languages), USUAL))


def learn_all(docs: DataFrame) -> Model:
    """Fits the model to all ``docs (doc_id, text, lang)`` that are not held out.

    Null texts and languages teach nothing. The usual fit is the median of all held-out
    documents of a language, to one in ten thousand of their ranks.
    """
    complete = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = complete.where(~held_out())
    counted = (
        labelled.select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    hashed = counted.mapInArrow(_hash_counts, COUNTS)
    counts = keep_table(
        hashed.groupBy("lang", "size", "hash").agg(F.sum("n").alias("n")), "counts"
    )
    sums = counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    languages = sorted({r["lang"] for r in sums})
    documents = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if sum(r["rows"] for r in sums) <= HELD:
        model = _fit(languages, counts.toArrow(), documents)
    else:
        model = _fit_split(languages, counts, sums, documents)
    pa.default_memory_pool().release_unused()
    if languages:
        judged = _judged(complete.where(held_out()).select("text", "lang"), model)
        # Each document counts, equal texts as often as they occur.
        one_each = judged.select("lang", "fit", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        fits = one_each.where(F.col("lang").isin(languages)).groupBy("lang")
        found = {r["lang"]: r["fit"] for r in fits.agg(F.percentile_approx("fit", 0.5).alias("fit")).collect()}
        least = min(found.values(), default=USUAL)
        model.usual = np.array([found.get(x, least) for x in languages])
    return model


def _fit_split(
    languages: list[str], counts: DataFrame, sums: list, documents: dict[str, int]
) -> Model:
    """The model of more than ``HELD`` entries: the most frequent hashes as arrays, the rest a table."""
    per_lang = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(languages)]
    level = F.floor(F.log2("total")).cast("int").alias("level")
    grouped = counts.groupBy("size", "hash").agg(
        F.sum("n").alias("total"), F.count("*").alias("entries"), *per_lang
    )
    hashes = keep_table(grouped.select("*", level), "hashes")
    keys = {r["size"]: r["count"] for r in hashes.groupBy("size").count().collect()}
    whole = {}
    for size, n_keys in keys.items():
        own = {r["lang"]: r["n"] for r in sums if r["size"] == size}
        whole[size] = np.array([own.get(x, 0) for x in languages], np.float64), n_keys
    held, from_level = 0, 64
    levels = hashes.groupBy("level").agg(F.sum("entries").alias("n")).collect()
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["n"]
        if held > HELD:
            break
        from_level = r["level"]
    lang_n = [F.struct(F.lit(x).alias("lang"), F.col(f"n{i}").alias("n")) for i, x in enumerate(languages)]
    head = (
        hashes.where(F.col("level") >= from_level)
        .select("size", "hash", F.inline(F.array(*lang_n)))
        .where("n is not null")
        .select("lang", "size", "hash", "n")
    )
    model = _fit(languages, head.toArrow(), documents, whole)
    rest = hashes.where(F.col("level") < from_level)
    base = F.create_map(
        *[x for size, t in model.tables.items() for x in (F.lit(size), F.array(*map(F.lit, t.base.tolist())))]
    )[F.col("size")]
    each = range(len(languages))
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in each]
    model.rest = rest.select(
        "size",
        "hash",
        F.lit(1).cast("long").alias("known"),
        F.array(*[base[i] + F.log(n[i] + SMOOTHING) - float(np.log(SMOOTHING)) for i in each]).alias("sums"),
        F.array(*[(n[i] > 0).cast("long") for i in each]).alias("having"),
    )
    return model


SUMS = "totals array<double>, letters double, fits double, real boolean, words long, copies long"


def _key(text: Column) -> list[Column]:
    """128 bits that equal texts share."""
    return [F.xxhash64(F.lit(x), text).alias(x) for x in ("key_a", "key_b")]


def _judged(docs: DataFrame, model: Model) -> DataFrame:
    """``lang``, if there is one, the ``_key``, ``best``, ``score``, ``fit`` and ``copies`` of ``text``.

    With a model that has a rest there is one row for all ``copies`` of a text with a ``lang``.
    """
    shared = model.shared(docs.sparkSession)
    rows = docs.select(
        "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"),
        *_key(F.col("text")),
        "text",
    )
    judged = "lang string, key_a long, key_b long, copies long, best string, score double, fit double"
    names = [x.split()[0] for x in judged.split(", ")]

    def verdicts(batch: pa.RecordBatch, copies: pa.Array, found: list) -> pa.RecordBatch:
        best, score, fit = list(zip(*found, strict=True)) or [(), (), ()]
        columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], copies, *columns], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, fit=True)
        for batch in batches:
            found = list(scorer.judge(batch.column(3).to_pylist()))
            yield verdicts(batch, pa.array(np.ones(len(found), np.int64)), found)

    if model.rest is None:
        return rows.mapInArrow(whole, judged)
    width = len(model.languages)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other word of a text, and one with the sums over the arrays' words."""
        table = shared.value.tables[WORD]
        fields = ["lang", "key_a", "key_b", "hash", "word", *[x.split()[0] for x in SUMS.split(", ")]]
        types = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            made = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=fields)

        for batch in batches:
            for lang, a, b, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                totals, some, any_real, n_words = np.zeros(width), 0.0, False, 0
                for piece in slices(text or ""):
                    times = Counter(WORDS.findall(piece.lower()))
                    if not times:
                        continue
                    words, n = list(times), np.array(list(times.values()))
                    hashes = grams(words, WORD)[0]
                    known, sums, _ = table.look_up(hashes, np.arange(len(words)), len(words))
                    hit = known > 0
                    letters, real = _letters(words)
                    some += float(letters[hit] @ n[hit])
                    totals += n[hit] @ sums[hit].astype(np.float32).astype(np.float64)
                    any_real |= bool(real[hit].any())
                    n_words += int(n[hit].sum())
                    own = hashes.view(np.int64)
                    for i in np.flatnonzero(~hit).tolist():
                        k = int(n[i])
                        out.append((lang, a, b, int(own[i]), words[i], None, float(letters[i] * k), None, bool(real[i]), k, 0))
                    if len(out) > AT_ONCE:
                        yield block()
                out.append((lang, a, b, None, None, totals.tolist(), some, some, any_real, n_words, 1))
        if out:
            yield block()

    parts = keep_table(
        rows.mapInArrow(part, f"lang string, key_a long, key_b long, hash long, word string, {SUMS}"), "parts"
    )
    asked = parts.where("hash is not null")
    # A word is its hash, as in the model.
    scored = _scored(asked.select("hash", "word").dropDuplicates(["hash"]), model)
    sums = asked.drop("word", "totals", "fits").join(scored, "hash").select(
        "lang",
        "key_a",
        "key_b",
        F.array(*[F.col("words") * F.col("scores")[i] for i in range(width)]).alias("totals"),
        "letters",
        (F.col("letters") * F.col("fit")).alias("fits"),
        "real",
        "words",
        "copies",
    )
    every = parts.where("hash is null").drop("hash", "word").unionByName(sums)
    copies = F.sum("copies")
    summed = every.groupBy("lang", "key_a", "key_b").agg(
        F.array(*[F.sum(F.col("totals")[i]) / copies for i in range(width)]).alias("totals"),
        (F.sum("letters") / copies).alias("letters"),
        (F.sum("fits") / copies).alias("fits"),
        F.max("real").alias("real"),
        (F.sum("words") / copies).alias("words"),
        copies.alias("copies"),
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns[3:8]]
            found = [
                _verdict(shared.value, np.array(totals), np.array([letters, fits, real]), words)
                for totals, letters, fits, real, words in zip(*columns, strict=True)
            ]
            yield verdicts(batch, batch.column("copies"), found)

    return summed.mapInArrow(decide, judged)


def _scored(asked: DataFrame, model: Model) -> DataFrame:
    """``hash, scores, fit`` of distinct ``hash, word`` that the arrays' words do not have.

    Those that are words of the rest have their scores there. Only the others, which are
    unseen, are taken apart.
    """
    shared = model.shared(asked.sparkSession)
    width = len(model.languages)
    own = model.rest.where(F.col("size") == WORD).select("hash", "sums")
    words = keep_table(asked.join(own, "hash", "left"), "words")
    scores = F.col("sums").cast("array<float>").cast("array<double>").alias("scores")
    seen = words.where("sums is not null").select("hash", scores, F.lit(1.0).alias("fit"))
    unseen = words.where("sums is null").select("hash", "word")
    found = "known long, sums array<double>, having array<long>"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per word and size what the arrays say, and the hashes that they do not have.

        Of a word with a longest n-gram in the arrays no shorter ones are asked for.
        """
        for batch in batches:
            every, numbers = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for low in range(0, len(every), AT_ONCE):
                words, own = every[low : low + AT_ONCE], numbers[low : low + AT_ONCE]
                for size in NGRAMS:
                    if size not in shared.value.tables or not words:
                        continue
                    table = shared.value.tables[size]
                    hashes, counts = grams(words, size)
                    owner = np.repeat(np.arange(len(words)), counts)
                    known, sums, having = table.look_up(hashes, owner, len(words))
                    missed = ~np.isin(hashes, table.keys)
                    n, m = len(words), int(missed.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([own, own[owner[missed]]])),
                            pa.array([len(x) for x in words] + [None] * m, pa.int32()),
                            pa.array(np.full(n + m, size, np.int32)),
                            pa.array([None] * n + hashes[missed].view(np.int64).tolist(), pa.int64()),
                            pa.array(known.tolist() + [None] * m, pa.int64()),
                            pa.array(sums.tolist() + [None] * m, pa.list_(pa.float64())),
                            pa.array(having.astype(np.int64).tolist() + [None] * m, pa.list_(pa.int64())),
                        ],
                        names=["own", "length", "size", "hash", "known", "sums", "having"],
                    )
                    if size == NGRAMS[0]:
                        left = np.flatnonzero(known == 0)
                        words, own = [words[i] for i in left.tolist()], own[left]

    rows = keep_table(
        unseen.mapInArrow(pieces, f"own long, length int, size int, hash long, {found}"), "grams"
    )
    held = rows.where("hash is null").drop("hash")
    missed = rows.where("hash is not null").select("own", "length", "size", "hash")
    joined = missed.join(model.rest, ["size", "hash"]).select(held.columns)
    each = range(width)
    # Dealt by word once, for both sums.
    by_size = held.unionByName(joined).repartition("own").groupBy("own", "size").agg(
        F.max("length").alias("length"),
        F.sum("known").alias("known"),
        F.array(*[F.sum(F.col("sums")[i]) for i in each]).alias("sums"),
        F.array(*[F.sum(F.col("having")[i]) for i in each]).alias("having"),
    )
    by_word = by_size.groupBy("own").agg(
        F.max("length").alias("length"),
        F.collect_list(F.struct("size", "known", "sums", "having")).alias("sizes"),
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, every = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores, fits = np.zeros((len(lengths), width), np.float32), np.zeros(len(lengths))
            for at, (length, sizes) in enumerate(zip(lengths, every, strict=True)):
                own = {x["size"]: x for x in sizes}
                for size in NGRAMS:
                    if size in own and own[size]["known"]:
                        scores[at] = np.array(own[size]["sums"]) / own[size]["known"]
                        break
                size = min(NGRAMS[0], length + 2)
                if size in own:
                    fits[at] = (max(own[size]["having"]) / (length + 3 - size)) ** 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores.astype(np.float64).tolist(), pa.list_(pa.float64())),
                    pa.array(fits),
                ],
                names=["hash", "scores", "fit"],
            )

    chosen = by_word.mapInArrow(choose, "hash long, scores array<double>, fit double")
    return chosen.unionByName(seen)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs (doc_id, text)``.

    ``lang_pred`` is ``und``, with score 0, where the text is null or has no letter, or
    no language was learned; a text of letters that no language has is given the most
    common one, with its share as the score. Nothing but the text enters the
    prediction. Repeated rows are predicted each; an empty table gives an empty result.
    """
    if model.rest is not None:
        found = _judged(docs.select("text"), model).select("key_a", "key_b", "best", "score")
        rows = docs.select("doc_id", held_out().alias("held_out"), *_key(F.col("text")))
        both = rows.join(found, ["key_a", "key_b"])
        return both.select("doc_id", "held_out", F.col("best").alias("lang_pred"), "score")
    shared = model.shared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(scorer.judge(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([x for x, _, _ in found], pa.string()),
                    pa.array([x for _, x, _ in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )
        pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with all columns, whose texts fit the learned languages.

    Null texts and texts without letters go. Repeated rows stay or go alike; an empty
    table stays empty. With a model that has a rest, a text goes through joins only if
    it would not fit were all words unknown that the arrays do not have; no word
    lowers the fit by more than that.
    """
    shared, usual = model.shared(docs.sparkSession), model.usual
    text_at = docs.columns.index("text")
    if model.rest is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value, fit=True)
            for batch in batches:
                good = scorer.accept(batch.column(text_at).to_pylist(), usual, least)
                yield batch.filter(pa.array(good, pa.bool_()))
            pa.default_memory_pool().release_unused()

        return docs.mapInArrow(run, docs.schema)
    highest = least * float(usual.max())

    def those(sure: bool) -> DataFrame:
        """The rows that stay whatever the rest says, or those for which it matters."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value.words_only(), fit=True)
            for batch in batches:
                found = scorer.judge(batch.column(text_at).to_pylist())
                good = [x != UNKNOWN and (fit > 0 and fit >= highest) == sure for x, _, fit in found]
                yield batch.filter(pa.array(good, pa.bool_()))
            pa.default_memory_pool().release_unused()

        return docs.mapInArrow(run, docs.schema)

    unsure = keep_table(those(False), "unsure")
    if unsure.isEmpty():
        return those(True)
    lowest = F.coalesce(
        *[F.when(F.col("best") == x, F.lit(least * float(y))) for x, y in zip(model.languages, usual, strict=True)]
    )
    found = _judged(unsure.select("text"), model)
    good = found.where((F.col("fit") > 0) & (F.col("fit") >= lowest)).select("key_a", "key_b")
    a, b = _key(unsure["text"])
    late = unsure.join(good, (a == good["key_a"]) & (b == good["key_b"]), "left_semi")
    return those(True).union(late)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    return predict(docs, learn(docs, usual=False))
