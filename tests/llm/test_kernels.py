"""Array kernels and the models' cores against plain Python."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chunks, contain, forest, jaccard, pieces, quality, suffixes, text, tokens

TEXTS = ["", " ", "a", "One two three four", "one TWO three four five six\nseven", "é É ß x　y z", "one two three four five six\nseven", "\t a \x0b b c d e f \r\n"]


def flat(values):
    return text.flat(pa.array(values, pa.string()))


def plain_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]


def plain_set(t):
    w = plain_words(t)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=40), max_size=6))
def test_shingle_sets_agree_with_plain_sets(values):
    hashes, bounds = text.shingle_sets(*flat(values))
    sets = [plain_set(v) for v in values]
    got = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(a & b) == len(got[i] & got[j])


def test_nulls_are_empty():
    data, offsets = flat([None, "ab", None])
    assert bytes(data) == b"ab" and offsets.tolist() == [0, 0, 2, 2]


@given(st.binary(max_size=200), st.integers(1, 40))
def test_rolling_hashes_follow_the_bytes(raw, k):
    h = text.rolling(np.frombuffer(raw, np.uint8), k)
    assert len(h) == max(0, len(raw) - k + 1)
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (raw[i : i + k] == raw[j : j + k])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5))
def test_two_stage_sorting(parts):
    raw = b"\0".join(parts) + b"\0"
    t = np.frombuffer(raw, np.uint8)
    order = suffixes.two_stage(t, text.words_at(t), 8)
    assert sorted(order.tolist()) == list(range(len(raw)))
    keys = [raw[i : raw.index(b"\0", i)][:8] for i in order]
    assert keys == sorted(keys)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(97, 99), min_size=1, max_size=60).map(bytes), min_size=1, max_size=6), st.integers(9, 20))
def test_repeats_are_the_later_strings(parts, length):
    rk, start = np.arange(len(parts)) % 2, np.arange(len(parts)) * 1000
    got = suffixes.repeats(*text.flat(pa.array(parts, pa.binary())), rk, start, length)
    stands: dict = {}
    for p, d, a in zip(parts, rk.tolist(), start.tolist()):
        for i in range(len(p) - length + 1):
            stands.setdefault(p[i : i + length], []).append((d, a + i))
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(x for own in stands.values() for x in sorted(own)[1:])


@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 20))
def test_halves_of_a_segment_hold_all_its_strings(before, after, free):
    gram = 5
    length = gram + free
    body, lo = bytes(range(100, 100 + before + gram + after)), before
    whole = [i for i in range(len(body) - length + 1) if i <= lo and i + length >= lo + gram]
    got = []
    for a, b, low, high in suffixes.halved(body, lo, lo + gram, length):
        own = list(range(a, b - length + 1))
        assert all(i <= low and i + length >= high for i in own) and high - low > gram
        got += own
    assert sorted(got) == (whole if free else [])


def test_tree_bound_keeps_every_pair():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.concatenate([b[: int(len(b) * 0.93)], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for b in base]
    links = jaccard.link_rows(sets, None, 80)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert {(max(x), min(x)) for x in links} == want  # components of two: all links are needed


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    table = tokens.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert tokens.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_words_are_encoded_as_whole_texts_are():
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    values = TEXTS + ["Word, a'sb. It's! O'Re, <|endoftext|>x İx ΟΔΟΣ Straße%%% ÉÉ&&& ab's. 12, a1,", "x\x85y\xa0z é ́b"]
    want = [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(values, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        ids, sizes = e.encode(*flat(values), None)
        assert [ids[b - n : b].tobytes() for b, n in zip(np.cumsum(sizes), sizes)] == want
    ids, sizes = e.encode(*flat(values), 2)
    assert ids[np.cumsum(sizes) - 1].tolist() == [2] * len(values) and sizes.tolist() == [1 + len(w) // e.kind.itemsize for w in want]
    assert e.encode(*flat([]), 2)[0].tolist() == []


def test_memory_begins_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "SPANS", 50)
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(20):
        value = " ".join(f"word{'abcdefgh'[j % 8]}x{i + j}, plain{'qrst'[j % 4]}" for j in range(40))
        assert e.encode(*flat([value]), None)[0].tolist() == e.tokenizer.encode(value, add_special_tokens=False).ids
    assert e.known.count < 200


def encode(m, values, rate, seed=1):
    data, offsets = flat(values)
    full = np.flatnonzero(np.diff(offsets) > 0)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.insert(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64), lead[offsets[full]], 32)
    at = lead[offsets] + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    ids, o = pieces.segment(m, chars, at, text.mix(np.arange(len(values), dtype=np.uint64) + np.uint64(seed)), rate)
    return [ids[o[i] : o[i + 1]] for i in range(len(values))]


def test_merges_without_dropout_are_the_librarys():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    values = TEXTS + ["    code", "日本語\n\ttab", "é" * 300, "ab" * 500, "<0x41> </s>", "😀😀 a", " " * 200 + "x" * 200]
    assert [x.tolist() for x in encode(m, values, 0.0)] == sp.encode(values)


def test_dropout_is_seeded_and_lossless(monkeypatch):
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    values = [t for t in TEXTS if t] + ["the quick brown fox " * 20, "▁ mark ▁▁", "hello" * 60]
    a, b, c = (encode(m, values, 0.2, s) for s in (1, 1, 2))
    assert all((x == y).all() for x, y in zip(a, b)) and any(len(x) != len(y) or (x != y).any() for x, y in zip(a, c))
    assert [pieces.decode_text(m, x) for x in a] == values
    monkeypatch.setattr(pieces, "LONG", 10)
    assert all((x == y).all() for x, y in zip(a, encode(m, values, 0.2, 1)))


def test_chunk_ends_resist_insertions():
    raw = np.random.default_rng(2).integers(97, 123, 4000).astype(np.uint8)
    new = np.concatenate([raw[:1000], np.full(7, 65, np.uint8), raw[1000:]])
    a, b = (set(chunks.chunk_ends(x, np.array([0, len(x)]))[0]) for x in (raw, new))
    assert len({e + 7 for e in a if e > 1300} & b) >= 0.9 * len([e for e in a if e > 1300])


def test_sketch_finds_every_item_at_the_threshold():
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    part = " ".join(f"w{i}" for i in range(20))  # holds 16 of them
    less = " ".join(f"w{i}" for i in range(19))
    index = contain.Sketches([7], [item], 5, 80)
    for value, n in ((f"x y {part} z", 16), (f"x y {less} z", 15)):
        rows, hashes = text.shingle_rows(*flat([value]))
        assert len(set(index.hashes.tolist()) & set(hashes.tolist())) == n
        assert bool(index.candidates(rows, hashes, np.array([len(rows)])).shape[1]) or n < 16


def test_partitions_lose_no_match():
    rng = np.random.default_rng(3)
    items = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, n)) for n in (3, 5, 6, 9, 20, 70, 300)]
    index = contain.Sketches(list(range(len(items))), items, 5, 80)
    assert len(index.partitions) > 3
    for i, item in enumerate(items):
        words = item.split()
        for share in (0.82, 0.9, 1.0):
            part = " ".join(words[: int(np.ceil(share * len(words)))])
            rows, hashes = text.shingle_rows(*flat([f"z z {part} {part} y" if len(words) > 4 else part]))
            held = len(set(hashes.tolist()) & set(index.hashes[index.bounds[i] : index.bounds[i + 1]].tolist()))
            if 100 * held >= 80 * index.n[i]:
                assert i in index.candidates(rows, hashes, np.array([len(rows)]))[1]


def test_classifier_separates_and_survives_one_class():
    good = [f"plain words in a row number {i} and more of them" for i in range(60)]
    bad = [f"x{i} | y{i} | z{i} | %%% ###" for i in range(60)]
    data, offsets = flat(good + bad)
    rows, places = quality.features(data, offsets)
    own = [places[rows == i] for i in range(120)]
    y = np.array([1] * 60 + [-1] * 60)
    m = quality.fit(own, y)
    s = m.scores(m.margins(rows, places, 120))
    assert s[:60].min() > s[60:].max()
    for one in (y[:60], y[60:], y[:0]):
        m = quality.fit(own[: len(one)], one)
        assert np.isfinite(m.scores(m.margins(rows, places, 120))).all()


def test_more_levels_need_more_trees():
    n = [forest.trees_for(k, 0.9, 0.12, 0.002) for k in (0, 3, 7, 20)]
    assert n == sorted(n) and n[0] >= 2


def test_spans_of_words():
    data, offsets = flat(["Word,. a'b", "", "É! İ,"])
    low, letter = tokens.lowered(data)
    starts, ends, plain, first = tokens.spans(data, letter, offsets)
    assert [(low.tobytes()[a:b].decode(), bool(p)) for a, b, p in zip(starts, ends, plain)] == [("word", True), (",.", False), ("a'b", False), ("é", True), ("!", False), ("İ,", False)]
    assert first.tolist() == [0, 3, 3, 6]


def slow_pieces(sp, value, key, rate):
    """Seeded merge-dropout by its definition: merge the best pair that is not skipped, leftmost first, from scratch each time."""
    limit, out = int(rate * 2**32), []
    chars = " " + value
    runs, run = [], []
    for i, c in enumerate(chars):
        piece = "\u2581" if c == " " else c
        known = piece != "\u2581" or c == " "
        known = known and not sp.is_unknown(sp.piece_to_id(piece))
        if run and (not known or (c == " " and chars[i - 1] != " ")):
            runs.append(run)
            run = []
        if known:
            run.append((i, piece))
        else:
            runs.append([(i, None)])
    runs.append(run)
    for run in runs:
        pieces_ = list(run)
        if pieces_ and pieces_[0][1] is None:
            out += [sp.piece_to_id(f"<0x{b:02X}>") for b in chars[pieces_[0][0]].encode()]
            continue
        while True:
            best = None
            for j in range(len(pieces_) - 1):
                (at, a), (_, b) = pieces_[j], pieces_[j + 1]
                i = sp.piece_to_id(a + b)
                if sp.is_unknown(i) or sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i):
                    continue
                h = (key + at) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 32
                h ^= (sp.piece_to_id(a) << 20 | sp.piece_to_id(b)) * 0xC2B2AE3D27D4EB4F % 2**64
                h ^= h >> 29
                h = h * 0xBF58476D1CE4E5B9 % 2**64
                if h >> 32 >= limit and (best is None or sp.get_score(i) > best[0]):
                    best = (sp.get_score(i), j, a + b)
            if best is None:
                break
            pieces_[best[1] : best[1] + 2] = [(pieces_[best[1]][0], best[2])]
        out += [sp.piece_to_id(p) for _, p in pieces_]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_dropout_by_its_definition(rate):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    values = ["the quick brown fox jumps over the lazy dog", "  two  spaces", "é \u2581 x日本 tokenisation unbelievable", "a\nb\tc", "international" * 3]
    keys = text.mix(np.arange(len(values), dtype=np.uint64) + np.uint64(1)).tolist()
    got = [x.tolist() for x in encode(m, values, rate)]
    assert got == [slow_pieces(sp, v, k, rate) for v, k in zip(values, keys)]


def test_forest_recall_on_20000_vectors():
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((14_000, 64)))
    side = rng.standard_normal((6_000, 64))
    side = unit(side - (side * x[:6_000]).sum(1, keepdims=True) * x[:6_000])
    x = np.concatenate([x, 0.905 * x[:6_000] + (1 - 0.905**2) ** 0.5 * side])  # one near copy each, close to the threshold
    f = forest.Forest(x[rng.permutation(len(x))[: forest.SAMPLE // 4]], len(x), 100, 0.9, forest.SPILL, forest.MISS, 3)
    assert f.kept <= f.levels == 8 and sum(c.nbytes for c in f.cuts) < 1 << 20
    held = [set() for _ in x]
    for t in range(len(f.cuts)):
        for row, leaf in zip(*(y.tolist() for y in f.leaves(t, x))):
            held[row].add((t, leaf))
    found = sum(not held[i].isdisjoint(held[14_000 + i]) for i in range(6_000))
    assert found >= 0.99 * 6_000


@pytest.mark.parametrize("dense", [0, 1, 16])
@pytest.mark.parametrize("tiled", [False, True])
def test_groups_of_leaves_count_each_link_once(monkeypatch, dense, tiled):
    monkeypatch.setattr(forest, "DENSE", dense)
    monkeypatch.setattr(forest, "LOOKED_UP", 7)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 8)), 5, axis=0) + 0.2 * rng.standard_normal((300, 8))
    x[:40] = x[0] + 0.1 * rng.standard_normal((40, 8))  # a large group of near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight, side = rng.integers(1, 4, len(x)), rng.integers(0, 2, len(x)) if tiled else None
    # two trees of three levels, some rows on both sides of a cut
    held = [sorted({(t << forest.TREE_BITS) + 8 + int(n) for t in (0, 1) for n in rng.choice(8, rng.integers(1, 4), False)}) for _ in x]
    at, codes = np.concatenate([[0], np.cumsum([len(h) for h in held])]), np.concatenate([np.array(h) for h in held])
    counts, links = np.zeros(len(x), int), set()
    for key in sorted({int(c >> forest.TREE_BITS << forest.TREE_BITS) + k for c in codes for k in (4, 5, 6, 14, 15)}):
        in_it = np.flatnonzero([forest.within(np.array(h), key).any() for h in held])
        own = [[c for c in held[r] if c >> forest.TREE_BITS <= key >> forest.TREE_BITS] for r in in_it]
        n, tree = forest.group_links(key, x[in_it], np.concatenate([[0], np.cumsum([len(h) for h in own])]), np.concatenate([np.array(h) for h in own]), weight[in_it], None if side is None else side[in_it], 0.9)
        counts[in_it] += n
        links |= {(int(in_it[a]), int(in_it[b])) for a, b in tree}
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool) & np.array([[bool(set(a) & set(b)) for b in held] for a in held])
    if tiled:
        near &= side[:, None] != side[None, :]
    assert counts.tolist() == (near @ weight).tolist() and near.sum() > 500
    assert all(near[a, b] for a, b in links)
    parts = lambda pairs: {tuple(sorted(p)) for p in united(len(x), pairs)}
    assert parts(links) == parts(zip(*np.nonzero(near)))


def united(n, pairs):
    part = {i: {i} for i in range(n)}
    for a, b in pairs:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for i in part[b]:
                part[i] = part[a]
    return part.values()


def test_forest_below_its_sample():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(x[:200], len(x), 20, 0.9, forest.SPILL, forest.MISS, 3)
    assert f.kept < f.levels
    row, leaf = f.leaves(0, x)
    assert set(row.tolist()) == set(range(3_000)) and len(np.unique(leaf)) > 1 << f.kept
