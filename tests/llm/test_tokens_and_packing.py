"""Token files and packing against plain encoding, exact round trips, and odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from triflux.llm import tokens
from triflux.llm.config_lp import fractional, solve, solve_with_bound
from triflux.llm.packing import pack, packed_ids
from triflux.llm.token_files import (
    TokenFileReader,
    TokenFileWriter,
    read_token_files,
    write_token_files,
)
from triflux.llm.tokens import TextEncoder, tokenizer_path

ODD = [
    None, "", " \n\t", "Hello, World! it's 3.5 o'clock", "ÀÉÎ straße İstanbul ΑΣ ǅ", "é ́x",
    "a b c\x1cd", "日本語 テキスト", "😀😀 zero‍width", "x" * 3000, "don't WE'LL 12,5%",
    "ab " * 6000, "<|endoftext|> end",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())

    def encode(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return np.array([*ids, 1], "<u4").tobytes()

    return encode


@pytest.mark.parametrize("kept_bytes", [2_000, 1 << 25])
def test_texts_encode_as_in_the_library(plain, monkeypatch, kept_bytes):
    monkeypatch.setattr(tokens, "CHARACTERS", 500)
    encoder = TextEncoder(tokenizer_path(), kept_bytes)
    rng = random.Random(kept_bytes)
    pool = [" ", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "é", "e", "\u0301", "İ", "ß", "À", "ÿ", "ª",
            "×", "½", "²", "'s", "'LL", "'", "1", "23", "!?", "-", "\xad", "日", "Σ", "ς", "😀", "\u200d", "\0", "가",
            "<|endoftext|>", "<|startoftext|>", "<|", "|>", "word", "Two words"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 15))) for _ in range(4_000)]
    for text in [*ODD, *odd]:
        assert encoder.encode(text) + b"\1\0\0\0" == plain(text), text
    assert encoder.encode("foo <|endoftext|> bar") == np.array([23435, 49407, 2411], "<u4").tobytes()


def test_reader_decompresses_only_the_frames_asked_for(tmp_path):
    path = str(tmp_path / "a" / "x.tok.zst")
    writer = TokenFileWriter(path, frame_ids=100)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 50_000, n).astype("<u4").tobytes())
            for k, n in enumerate((1, 0, 99, 100, 101, 950, 3))]
    for k, ids in docs:
        writer.add(k, ids)
    assert writer.close() == (7, 1254)
    reader = TokenFileReader(path)
    assert reader.read(6) == [docs[6][1]] and reader.frames_read == 1
    assert [reader.read(k) for k, _ in docs] == [[ids] for _, ids in docs]
    assert reader.read(99) == []
    damaged = bytearray(open(path, "rb").read())
    damaged[20] ^= 1
    open(path, "wb").write(damaged)
    with pytest.raises(Exception):
        TokenFileReader(path).read(2)


def test_token_files_round_trip(spark, frame, tmp_path, plain):
    rows = [(k * 7 % 13, t) for k, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again")]
    manifest = write_token_files(frame(rows), str(tmp_path / "t"), frame_ids=64)
    got = read_token_files(manifest).collect()
    want = Counter((i, plain(t)) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)
    some = read_token_files(manifest, doc_ids=[5]).collect()
    assert len(some) == sum(i == 5 for i, _ in rows)
    assert {(r.start, bytes(r.ids)) for r in some} == {(r.start, bytes(r.ids)) for r in got if r.doc_id == 5}


def test_token_files_of_an_empty_table(frame, tmp_path):
    manifest = write_token_files(frame([]), str(tmp_path / "e"))
    assert read_token_files(manifest).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_each_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(64, int(rng.lognormvariate(2.5, 1)) + 1) for _ in range(rng.choice((3, 90, 4000))))
    plan = solve(dict(histogram), 64)
    held = Counter()
    for content, copies in plan:
        assert copies > 0 and sum(k * n for k, n in content.items()) <= 64
        for k, n in content.items():
            held[k] += n * copies
    assert held == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in plan) <= -(-total // 64) * 1.02 + 2


def test_plan_of_pairs_is_optimal():
    assert sum(n for _, n in solve({33: 10, 31: 10}, 64)) == 10
    assert sum(n for _, n in solve({40: 7}, 64)) == 7
    assert solve({}, 64) == []
    with pytest.raises(ValueError):
        solve({65: 1}, 64)


def test_packing_is_gapless_and_whole(frame, plain):
    rows = [(k % 9, t) for k, t in enumerate(ODD)] + [(None, "x y"), (3, "same"), (3, "same")]
    pieces, places = pack(frame(rows), capacity=256, with_ids=True)
    got = places.collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert sum(r.length for r in own) <= 256
    want = Counter()
    for i, t in rows:
        ids = plain(t)
        for p, at in enumerate(range(0, len(ids), 1024)):
            part = ids[at : at + 1024]
            want[i, p, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {r.sequence_id: bytes(r.ids) for r in packed_ids(pieces, places).collect()}
    assert {k: len(v) for k, v in sequences.items()} == {
        k: 4 * sum(r.length for r in v) for k, v in by_sequence.items()
    }
    for k, own in by_sequence.items():
        for r in own:
            part = sequences[k][4 * r.offset : 4 * (r.offset + r.length)]
            assert zlib.crc32(part) == r.ids_crc32


def test_packing_an_empty_table(frame):
    assert pack(frame([]))[1].count() == 0


def least_bins(items, capacity):
    """The fewest bins for a few items, by trying all."""
    best = len(items)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        size, rest = rest[0], rest[1:]
        for room in {r for r in rooms if r >= size}:
            at = rooms.index(room)
            place(rest, [*rooms[:at], room - size, *rooms[at + 1 :]])
        place(rest, [*rooms, capacity - size])

    place(sorted(items, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bound_and_plan_stand_on_either_side_of_the_optimum(seed):
    rng = random.Random(seed)
    items = [rng.choice((3, 4, 5, 6, 7, 9, 11, 13, 20)) for _ in range(11)]
    plan, bound = solve_with_bound(Counter(items), 20)
    used = Counter()
    for content, copies in plan:
        assert sum(k * n for k, n in content.items()) <= 20
        used.update({k: n * copies for k, n in content.items()})
    assert used == Counter(items)
    bins = sum(copies for _, copies in plan)
    assert bound <= least_bins(items, 20) <= bins <= least_bins(items, 20) + 1


def test_the_program_is_solved_and_rounded():
    # Lengths that fill bins only in threes and pairs: the program finds those.
    lengths, demand = np.array([30, 35, 50]), np.array([2_000, 2_000, 1_000])
    contents, amounts, bound = fractional(lengths, demand, 100)
    covered = sum(a * c[0] for a, c in zip(amounts, contents))
    assert covered == pytest.approx(2_000, rel=0.1) and len(contents) >= 3
    assert 1_800 <= bound <= 1_834
    rng = random.Random(3)
    histogram = Counter(rng.randint(1, 999) for _ in range(20_000))
    plan, bound = solve_with_bound(histogram, 1_000)
    tokens = sum(k * n for k, n in histogram.items())
    assert -(-tokens // 1_000) <= bound <= sum(n for _, n in plan) <= 1.01 * bound
    assert solve({}, 10) == [] and solve_with_bound({10: 3}, 10) == ([({10: 1}, 3)], 3)
