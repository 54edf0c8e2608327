"""Splitting, encoding and packing against brute force, exact round trips and bounds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import bpe, pack, split

VOCAB = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(VOCAB)


# -- splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\rx", max_size=400), st.integers(2, 90), st.integers(0, 60), st.lists(st.integers(-1, 30), max_size=4))
def test_pieces_cover_within_the_limit(text, limit, overlap, symbols):
    if overlap >= limit:  # no piece could advance
        with pytest.raises(ValueError, match="overlap"):
            split.split_one(text, symbols, limit, overlap)
        return
    pieces, wide = split.split_one(text, symbols, limit, overlap)
    lap = overlap  # what was asked, up to the limit less one
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (a, b, cut, kind) in enumerate(pieces):
        assert 0 < b - a <= limit
        if i:
            assert cut == pieces[i - 1][1] and a == max(0, cut - lap)
    lines = text.split("\n")
    assert wide.tolist() == [n for n, x in enumerate(lines, 1) if len(x[:-1] if x.endswith("\r") and n < len(lines) else x) > limit]


def test_doubling_takes_the_greedy_path():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(50, 400)
        limit, lap = rnd.randint(20, 60), rnd.randint(0, 9)
        pos = np.array(sorted(set(range(0, n, limit - lap)) | {rnd.randint(1, n - 1) for _ in range(20)} - {0}))
        cuts, _ = split.greedy_cuts(n, [pos[pos > 0]], limit, lap)
        at, want = 0, [0]
        while at < n:  # step by step: the farthest boundary in reach
            reach = max(0, at - lap) + limit
            at = n if reach >= n else max(p for p in pos if at < p <= reach)
            want.append(at)
        assert cuts.tolist() == want


def test_natural_boundaries_come_first():
    text = "".join(f"line {i}\n" for i in range(100))
    pieces, _ = split.split_one(text, [30, 60], 300, 10)
    kinds = [k for *_, k in pieces]
    assert set(kinds[:-1]) <= {"symbol", "line"} and "symbol" in kinds and kinds[-1] == "end"
    long, wide = split.split_one("word " * 100, [], 60, 5)
    assert {k for *_, k in long[:-1]} == {"blank"} and wide.tolist() == [1]


# -- encoding

ALPHABET = "aestmdrlv'  \n\t.,!?12é中٣　½😀\x1c\x85"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=30), max_size=6))
def test_ids_are_those_of_the_library(texts):
    import base64

    import tiktoken

    vocab = bpe.vocabulary(VOCAB)
    enc = _reference(tiktoken, base64, vocab)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = list(bpe.encode_texts([*texts, None, ""], vocab))
    assert [g[0] for g in got] == [enc.encode_ordinary(t) for t in texts] + [[], []]
    for t, (ids, starts, counts) in zip(texts, got):
        assert vocab.decode(ids) == t and counts.sum() == len(ids)
        ends = [*starts[1:].tolist(), len(t)]
        at = 0
        for a, b, n in zip(starts, ends, counts):  # slice by slice
            assert vocab.decode(ids[at : at + n]) == t[a:b]
            at += n


_ENC = []


def _reference(tiktoken, base64, vocab):
    if not _ENC:
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENC.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab.ranks, special_tokens={}))
    return _ENC[0]


def test_long_and_special_texts(vocab):
    import tiktoken

    enc = _reference(tiktoken, None, vocab)
    for t in ["a" * 5000, "ab" * 3000, "!" * 2000, " " * 3000, "'" * 999 + "x", "<|endoftext|>", "x" + "\n" * 300 + "y", "😀" * 400]:
        assert [i for i, _, _ in bpe.encode_texts([t], vocab)][0] == enc.encode_ordinary(t)


def test_blocks_do_not_matter():
    import numpy as np

    rnd = random.Random(2)
    cp = np.array([ord(rnd.choice(ALPHABET)) for _ in range(5000)], np.uint32)
    want = bpe.pretoken_starts(cp, 5000)
    for block in (1, 3, 64, 4999, 9000):
        assert (bpe.pretoken_starts(cp, block) == want).all()


# -- packing


def _best_fill(sizes, room):
    reach = {0}
    for s in sizes:
        reach |= {r + s for r in reach if r + s <= room}
    return max(reach)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=12), st.integers(20, 40))
def test_each_combination_is_the_fullest(sizes, capacity):
    left = list(sizes)
    used = 0
    for first, times, combo in pack.minimum_bin_slack({s: sizes.count(s) for s in sizes}, capacity):
        for _ in range(times):
            seed = max(left)
            left.remove(seed)
            assert sum(s * k for s, k in combo.items()) == seed + _best_fill(left, capacity - seed)
            for s, k in combo.items():
                for _ in range(k - (s == seed)):
                    left.remove(s)
            used += 1
    assert not left and used <= len(sizes)


def test_rounds_do_not_grow_with_the_items():
    rnd = random.Random(3)
    h = {}
    for _ in range(20_000):
        s = rnd.randint(1, 256)
        h[s] = h.get(s, 0) + 1
    a = len(pack.minimum_bin_slack(h, 256))
    b = len(pack.minimum_bin_slack({s: n * 1000 for s, n in h.items()}, 256))
    assert b < 3 * a + 256


def test_packed_table(spark):
    rnd = random.Random(1)
    rows = [(i, None if i % 50 == 0 else 0 if i % 33 == 0 else 7 if i % 3 else rnd.randint(1, 260)) for i in range(900)] + [(5, 7), (5, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").cache()
    got = pack.pack(df, 100, rows_per_bucket=7).collect()
    assert sum(r["size"] for r in got) == sum(n or 0 for _, n in rows)
    fill, pieces = {}, {}
    for r in got:
        if r["size"]:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
        else:
            assert r["container_id"] == 0
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_tok"], r["size"], r["n_pieces"]))
    assert max(fill.values()) <= 100 and 0 not in fill
    for d, n in rows:
        if d != 5 and n:
            p = sorted(pieces[d])
            assert len(p) == -(-n // 100) == p[0][3] and [x[1] for x in p] == [100 * k for k in range(len(p))] and sum(x[2] for x in p) == n
    total = sum(n or 0 for _, n in rows)
    assert len(fill) <= -(-total // 100) + 2
    assert pack.pack(df.limit(0), 100).count() == 0
