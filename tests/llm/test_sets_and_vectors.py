"""Near-duplicates, fingerprints, top-k, mixing and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from triflux.llm import fingerprints, langid, mixing, near_dup, queries, top_k
from triflux.llm.ball_tree import BallTree
from triflux.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_groups(rows, n):
    """``(doc_id, size, smallest id of the group)`` by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[find(i)].append(k)
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return Counter((k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))


def near_copies(seed, base=12, copies=60):
    """Groups of edited copies, a passage that many texts share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(base):
        text = [word() for _ in range(rng.choice((6, 20, 60, 150)))]
        for _ in range(rng.choice((1, 3, copies))):
            edited = list(text)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            if rng.random() < 0.4:
                edited += passage
            texts.append(" ".join(edited))
    texts += [None, "", " \n", "one", "One", "one two", "a b c d", "A  B c d", "x " * 3000]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(3, "a b c d"), (None, "one"), (None, None), (None, "only here at all")]


@pytest.mark.parametrize("long_list", [4, 32])
def test_near_duplicates_match_brute_force(frame, monkeypatch, long_list):
    monkeypatch.setattr(near_dup, "LONG_LIST", long_list)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 40)
    rows = near_copies(5)
    got = near_dup.near_duplicates(frame(rows), words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_groups(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(frame):
    text = "a b c d e f g h i j"
    rows = [(4, text, 1), (2, text.upper(), 2), (2, text, 3), (7, "other words are here now too", 4),
            (None, None, 5), (1, "", 6), (1, "", 7)]
    wide = frame(rows, "doc_id long, text string, n long")
    kept = near_dup.deduplicated(wide)
    assert kept.columns == wide.columns
    got = [(r.doc_id, r.n) for r in kept.collect()]
    assert Counter(k for k, _ in got) == Counter([2, 7, None, 1, 1]) and {n for _, n in got} >= {4, 5, 6, 7}
    assert near_dup.deduplicated(frame([])).count() == 0


def test_columns_of_any_name_are_kept(frame):
    schema = "doc_id long, text string, source string, _class string, _one int, _one_class int, _size string, _MIX int, _copy int, d int, t int"
    extra = ("c", 1, 2, "s", 3, 4, 5, 6)
    rows = [(1, "a b c d e f g", "x", *extra), (2, "A b c d e f g", "x", *extra), (3, None, None, *extra)]
    docs = frame(rows, schema)
    once = near_dup.deduplicated(docs)
    assert once.columns == docs.columns
    assert sorted(map(tuple, once.collect())) == [rows[0], rows[2]]
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and set(map(tuple, mix.collect())) <= set(rows)
    assert mix.count() > 0


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (160, 101)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 161)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_match_brute_force(frame):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdé😀") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(None, "no id at all, but seven words"), (6, None)]
    got = fingerprints.edited_fingerprints(frame(rows)).collect()
    assert len(got) == len(rows)
    clean = [(k, t or "") for k, t in rows]
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.n_chars), []).append(r)
    order = sorted((x for x in clean if x[0] != 6), key=lambda x: (x[0] is not None, x[0] or 0))
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        if k in (3, 6) or t == "":
            continue  # the next id is repeated, so the order there is by hash
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        (r,) = of[k, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles_of(t), shingles_of(edited)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = shingles_of(after)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    same = {}
    for (k, t) in clean:
        for r in of[k, len(t)]:
            if k != 6:
                assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert fingerprints.edited_fingerprints(frame([])).count() == 0
    (alone,) = fingerprints.edited_fingerprints(frame([(1, "a b c d e f g h")])).collect()
    assert alone.next_id == 1 and alone.near_next == 1.0


def shingles_of(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketches_of_parts_merge(spark):
    rng = random.Random(6)
    words = [str(rng.randrange(10**6)) for _ in range(3_000)]
    rows = [("a", " ".join(words[:2000])), ("a", " ".join(words[1000:])), ("b", " ".join(words))]
    parts = fingerprints.with_sketch(spark.createDataFrame(rows, "k string, text string"), "text", "s", words=1)
    merged = {r.k: r for r in fingerprints.merged_sketches(parts, "s", "k")
              .select("k", "s", fingerprints.distinct_shingles("s").alias("n")).collect()}
    assert merged["a"].s == merged["b"].s and 2_000 < merged["a"].n < 4_500
    both = parts.where("k = 'a'").limit(1).select("s").crossJoin(parts.where("k = 'b'").selectExpr("s as t"))
    row = both.select(fingerprints.containment("s", "t").alias("c"), fingerprints.containment("t", "s").alias("d")).first()
    assert row.c > 0.85 and 0.4 < row.d < 0.95


def test_ball_tree_is_exact_with_ties():
    rng = np.random.default_rng(7)
    vectors = np.vstack([rng.integers(-9, 9, (300, 5)), np.tile([[3, 1, -2, 4, 0]], (300, 1))])
    ids = rng.permutation(600)
    tree = BallTree.from_parts(BallTree.build(vectors, ids, leaf=16).parts(), 5)
    for at in range(0, 600, 37):
        query = vectors[at]
        scores = vectors @ query
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[at])[:10]
        got = tree.search(query, int(ids[at]), tree.bounds(query[None])[0], 10, None)
        assert [(-s, i) for s, i in got] == want
        least = -want[4][0]
        part = tree.search(query, int(ids[at]), tree.bounds(query[None])[0], 10, least)
        assert part == [(-s, i) for s, i in want if -s >= least]


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 16)
    rng = random.Random(8)
    rows = [(k, [rng.choice((-1.0, 0.5, 0.25, 2.0)) for _ in range(3)], "x") for k in range(200)]
    rows += [(7, [1.0, 1.0, 1.0], "x")] * 2 + [(100, rows[100][1], "x"), (201, None, "x"), (300, [float("nan"), 1.0, 1.0], "x"),
             (400, [None, 1.0, 1.0], "x"), (500, [float("inf"), 0.0, 0.0], "x"), (600, [], "x"), (700, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    shards = top_k.build_shards(top_k.integer_vectors(df), 16)
    assert shards.count() > 10
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df, df.where(top_k.is_query())).collect())
    good = [(k, np.floor(1024 * np.array(v))) for k, v, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for k, v in good:
        if k % 100 == 0:
            found = sorted((-int(v @ w), i) for i, w in good if i != k and len(w) == len(v))[:10]
            want |= {(k, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    assert set(got) == want
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        big = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
        top_k.top_k(big, big).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


MIX = "doc_id long, text string, source string, size string"


def test_targets_are_filled_like_water(frame):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["b", "é", "a", "Z", None]), "x") for k in range(300)]
    rows += [(None, None, "a", "x"), (1, "", "empty", "x"), (5, "w w", "b", "x"), (5, "w w", "b", "x")]
    got = mixing.mix_report(frame(rows, MIX)).collect()
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert sorted(r.source_size for r in got) == sorted(sizes[s] for _, _, s, _ in rows)
    assert sorted(r.target for r in got) == pytest.approx(sorted(target[s] for _, _, s, _ in rows))
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    again = mixing.mix_report(frame(rows, MIX, 7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed(frame(rows, MIX))
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_report(frame([], MIX)).count() == 0


def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = dict(corpus_pipeline.STAGES)
    identified = one["language_id"](spark, docs, SF)
    assert identified.columns == docs.columns and identified.count() == docs.count()
    distinct = one["near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in distinct.collect()} == {k for k, _, c in slow_groups(rows, 5) if k == c}
    clean = one["secret_scan"](spark, docs, SF)
    assert clean.count() == docs.count() and clean.where("text like '%AKIA%'").isEmpty()
    assert clean.where("n_chars <> length(text)").isEmpty()
    final = corpus_pipeline.run(spark, SF)
    assert set(final.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    filled = final.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n")
    assert filled.where("n > 4096").isEmpty() and filled.count() > 0
    junk = spark.createDataFrame([(1, "12 34", "en", "s", 5), (2, "the and of", "en", "s", 10)], docs.schema)
    assert [r.doc_id for r in langid.accepted(junk, langid.learn(docs)).collect()] == [2]
