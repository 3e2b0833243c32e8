"""Operators on small tables: brute force, nulls, ties, repeats, long texts, empty tables, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, chunks, contain, forest, frames, jaccard, licences, pieces, quality, suffixes, tokens

from .test_kernels import plain_set

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk long, n string"


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(r.randint(30, 120))) for _ in range(12)]
    out = []
    for i, b in enumerate(base):
        out.append((i, b))
        w = b.split()
        for k in range(3):
            v = list(w)
            v[r.randrange(len(v))] = word()
            out.append((100 + 10 * i + k, " ".join(v)))
    shared = " ".join(word() for _ in range(60))
    out += [(300 + i, f"{' '.join(word() for _ in range(20))} {shared} {' '.join(word() for _ in range(20))}") for i in range(5)]
    out += [(400, None), (401, ""), (402, "  \n"), (403, "a b"), (404, "A  b"), (405, "a b"), (None, base[0]), (None, None), (7, base[7]), (7, base[7] + " tail"), (500, "long " * 3000), (501, base[0])]
    return [(d, t, "en", "s", 1, 5, "x") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("few", [0, 16_384])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(frames, "FEW_EDGES", few)
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(1000 + i, 1001 + i) for i in range(20)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_hold_every_pair_once(spark):
    out = frames.tiles(spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99)], "k int, i long"), "k", "i", 7).collect()
    by: dict = {}
    for x in out:
        by.setdefault((x.k, x.tile_i, x.tile_j), []).append((x.i, x.side))
    seen: dict = {}
    for (_, a, b), own in by.items():
        assert len(own) <= 30
        for i, s in own:
            for j, t in own:
                if i < j and (a == b or s != t):
                    seen[i, j] = seen.get((i, j), 0) + 1
    assert seen == {(i, j): 1 for i in range(40) for j in range(i + 1, 40)}


def test_tokens(docs, empty):
    from tokenizers import Tokenizer
    import zlib

    got = tokens.token_files(docs, WORD, 2).orderBy("start").collect()
    texts = sorted(((d, t) for d, t, *_ in corpus()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    e = Tokenizer.from_file(WORD)
    at = 0
    for row, (d, t) in zip(got, texts, strict=True):
        ids = e.encode(t or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.token_files(empty, WORD, 2).count() == 0


def test_one_key_over_many_shards(spark):
    import zlib

    from tokenizers import Tokenizer

    e = Tokenizer.from_file(WORD)
    rows = [(None, f"{i:03d} text") for i in range(60)] + [(7, f"{i} other") for i in range(30)] + [(9, "last")]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = tokens.token_files(own, WORD, 2).orderBy("start").collect()
    at = 0
    for row, (d, t) in zip(got, order(rows), strict=True):
        ids = e.encode(t, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len({r.shard for r in got if r.doc_id is None}) > 1
    keys = tokens.write_tokens(own, WORD, 2, frames.scratch_root(spark) + "/t")
    assert keys.groupBy("doc_id", "nth").count().where("count > 1").count() == 0


def test_unknown_keys_are_refused(spark, docs):
    folder = frames.scratch_root(spark) + "/t"
    keys = tokens.write_tokens(docs.where("doc_id is not null"), WORD, 2, folder)
    assert tokens.read_tokens(keys.withColumn("doc_id", F.col("doc_id") + 100_000), folder).count() == 0


def brute_chunks(rows):
    """Chunks by their definition: at each place the hash of the 16 bytes before it, from scratch."""
    gear, out, seen = [int(x) for x in chunks.GEAR], {}, set()
    for d, t in rows:
        b = (t or "").encode()
        ends, last = [], 0
        for p in range(1, len(b) + 1):
            h = sum(gear[b[p - 1 - k]] << k for k in range(min(16, p))) & 0xFFFF
            if p - last == chunks.MOST or (p - last >= chunks.LEAST and h >> (16 - chunks.BITS) == 0):
                ends.append(p)
                last = p
        if last < len(b):
            if ends and len(b) - last < chunks.LEAST:
                ends.pop()
            ends.append(len(b))
        runs = []
        for a, e in zip([0, *ends], ends):
            if b[a:e] in seen:
                runs = [*runs[:-1], [runs[-1][0], e]] if runs and runs[-1][1] == a else [*runs, [a, e]]
            seen.add(b[a:e])
        runs = [(a, e) for a, e in runs if e - a >= min(chunks.MIN_RUN, len(b))]
        kept, at = b"", 0
        for a, e in runs:
            while a < e and b[a] >> 6 == 2:  # a cut takes whole characters only
                a += 1
            while a < e < len(b) and b[e] >> 6 == 2:
                e -= 1
            kept, at = kept + b[at:a], max(at, e)
        out.setdefault(d, []).append(None if t is None else (kept + b[at:]).decode())
    return {d: sorted(v, key=str) for d, v in out.items()}


def order(rows):
    return sorted(((d, t) for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


def test_chunk_dedup(docs, empty):
    got: dict = {}
    for x in chunks.dedup_chunks(docs).collect():
        got.setdefault(x.doc_id, []).append(x.text)
        assert len((x.text or "").encode()) == x.n_bytes - x.n_removed
    assert {d: sorted(v, key=str) for d, v in got.items()} == brute_chunks(order(corpus()))
    whole = {d: t for d, t, *_ in corpus()}
    assert sum(len(whole[300 + i]) - len(got[300 + i][0]) > 200 for i in range(5)) == 4
    assert chunks.dedup_chunks(empty, "rk", "n").count() == 0


def test_a_chunk_of_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT_ROWS", 8)
    r = random.Random(2)
    line = "this very passage stands at the start of one text in three and is cut from all but one. " * 2
    rows = [(i, (line if i % 3 == 0 else "") + " ".join(f"{r.randrange(10**6)}" for _ in range(30))) for i in range(150)]
    got = {x.doc_id: [x.text] for x in chunks.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_chunks(rows)


def test_joins_spread_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 50), (None, 60)], "k long, i long")
    sums = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = frames.spread_join(rows, sums, ["k"], ["i"])
    assert sorted(map(tuple, out.select("k", "i", "n").collect())) == [(1, i, 40) for i in range(40)] + [(2, 50, 1)]
    assert "_salt" in out._jdf.queryExecution().toString()


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT_ROWS", 4)
    monkeypatch.setattr(frames, "FEW_EDGES", 0)
    star = [(0, i) for i in range(1, 200)] + [(500, 501), (501, 502)]
    got = {x.node: x.root for x in frames.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500, 502: 500}


def test_scratch_folders_go(spark):
    import os

    step = frames.cut(spark.range(3), "x")
    path = step.scratch.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    frames.discard(step)
    assert not os.path.exists(path)


def test_encoding(docs, empty):
    out = pieces.encode_docs(docs, PIECE).collect()
    assert len(out) == len(corpus()) and all(x.lossless and x.n_pieces == len(x.ids) for x in out)
    m = pieces.model(PIECE)
    by = {x.doc_id: x for x in out}
    assert pieces.decode_text(m, np.array(by[500].ids)) == "long " * 3000 and by[401].ids == []
    assert pieces.encode_docs(empty, PIECE).count() == 0


def test_preferences(spark):
    turns = [(1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", "a<|im_end|>"), (1, 1, 0, "user", "hi"), (1, 1, 1, "assistant", "b"), (1, 1, 2, "user", None), (2, 0, 0, None, "x"), (3, 0, 0, "user", "q"), (3, 1, 0, "user", "q"), (None, 0, 0, "assistant", "z")]
    out = {x.pair_id: x for x in chat.preference_pairs(spark.createDataFrame(turns, "pair_id long, side int, turn long, role string, text string")).collect()}
    a = out[1]
    assert a.n_prefix == 1 and a.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert a.chosen == "<|im_start|>assistant\na< |im_end|><|im_end|>\n" and a.rejected.startswith("<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\n")
    s = a.chosen_spans[0]
    assert a.chosen[s.start : s.end] == "a< |im_end|><|im_end|>" and len(a.rejected_spans) == 1
    assert out[2].rejected is None and out[2].n_prefix == 0 and out[2].rejected_spans == []
    assert out[3].n_prefix == 1 and out[3].chosen == "" and out[3].rejected == ""
    assert out[None].chosen_spans[0].end > 0
    loose = spark.createDataFrame([(None, None, 0, "assistant", "lost", 1, "x")], "pair_id long, side int, turn long, role string, text string, nth int, line string")
    row = chat.preference_pairs(loose).first()
    assert row.chosen.endswith("lost<|im_end|>\n") and row.rejected is None and len(row.chosen_spans) == 1
    long = spark.createDataFrame([(1, s, t, "user" if t % 2 else "assistant", "word " * 20_000) for s in (0, 1) for t in range(4)], "pair_id long, side int, turn long, role string, text string")
    assert chat.preference_pairs(long).first().n_prefix == 4
    assert chat.preference_pairs(spark.createDataFrame([], "pair_id long, side int, turn long, role string, text string")).count() == 0


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"word{j} of the text" for j in range(i % 7 + 3))) for i in range(200)]
    bad = [(1000 + i, " | ".join(f"x{j}%%%" for j in range(i % 5 + 4))) for i in range(80)]
    own = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "word of the text")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in good + bad] + [(1, None), (None, 1)], "doc_id long, quality int")
    out = {x.doc_id: x.score for x in quality.score(own, quality.train(own, labels)).collect()}
    assert min(out[d] for d, _ in good) > max(out[d] for d, _ in bad) and all(0 <= s <= 1 for s in out.values())
    none = quality.score(empty, quality.train(empty, labels.limit(0)), "rk")
    assert none.count() == 0 and "rk" in none.columns


def test_quality_by_hand(spark):
    """Scores against the definition, computed document by document with dictionaries."""
    rows = [(i, f"good words {i} of a row " * (i % 3 + 1)) for i in range(40)] + [(100 + i, f"bad | {i} | cells ### " * (i % 2 + 1)) for i in range(30)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id long, quality int")
    model = quality.train(own, labels)
    import zlib

    learned = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 5]

    def places(t):
        return set(quality.features(*text_of([t]))[1].tolist())

    sums = {1: {}, 0: {}}
    for d, t in learned:
        for p in places(t):
            sums[int(d < 100)][p] = sums[int(d < 100)].get(p, 0) + 1
    total = {k: sum(v.values()) + quality.DIM for k, v in sums.items()}
    ratio = lambda p: np.log((sums[1].get(p, 0) + 1) / total[1]) - np.log((sums[0].get(p, 0) + 1) / total[0])
    got = {x.doc_id: x.score for x in quality.score(own, model).collect()}
    for d, t in rows:
        r = {p: ratio(p) for p in places(t)}
        norm = np.sqrt(sum(v * v for v in r.values()))
        weight = {p: model.weights[p] / ratio(p) if ratio(p) else 0.0 for p in r}
        margin = sum(weight[p] * r[p] for p in r) / norm + model.bias
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30))), abs=1e-9)
    # a minimum of the hinge loss: no learned text's dual step could move far
    for d, t in learned:
        r = {p: ratio(p) for p in places(t)}
        norm = np.sqrt(sum(v * v for v in r.values()))
        y = 1 if d < 100 else -1
        assert y * (sum(model.weights[p] for p in r) / norm + model.bias) > 0


def test_quality_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).where(quality.held_out()).join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert len(good) and len(bad) and auc >= 0.97


def text_of(values):
    import pyarrow as pa

    from tessera.llm import text

    return text.flat(pa.array(values, pa.string()))


def test_suffix_dedup(spark, empty):
    r = random.Random(9)
    rows = [(i, "".join(r.choice(["ab", "a", "b", "é"]) for _ in range(r.randint(0, 500)))) for i in range(40)]
    rows += [(100, "x" * 2000), (101, "x" * 900 + "y" * 300), (102, None), (103, "\0" * 300), (104, rows[0][1] + rows[1][1])]
    want = suffixes.brute_force(rows)
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for cap in (1500, 2):
        got = suffixes.remove_repeats(own, cap=cap).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("doc_id").collect()
        assert [tuple(x) for x in got] == want
    assert suffixes.remove_repeats(empty, "n").count() == 0
    twice = suffixes.remove_repeats(spark.createDataFrame([(1, "q" * 99 + "r" * 60)] * 2 + [(None, None)], "doc_id long, text string")).orderBy("n_removed").collect()
    assert [x.n_removed for x in twice] == [0, 0, 159]


def brute_jaccard(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), d if not sets[i] else low.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("cap", [1500, 3])
def test_jaccard(docs, cap):
    got = jaccard.jaccard_components(docs, cap=cap).collect()
    assert sorted(((str(x.doc_id), x.n_shingles, x.component_id) for x in got), key=str) == sorted(brute_jaccard([(d, t) for d, t, *_ in corpus()]), key=str)


def test_jaccard_links_rows_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    line = lambda *changed: " ".join(f"x{i}" if i in changed else w for i, w in enumerate(words))
    other = " ".join(f"o{i}" for i in range(40))
    # the null row of 5 is a near copy; 8 and 9 are linked by a null row only; the last two have no id at all
    rows = [(5, other), (None, other + " tail"), (9, line(0)), (None, line(0, 58)), (8, line(0, 58, 30)), (None, "q " * 30 + other[:9]), (None, "q " * 30 + other[:9] + " z")]
    want = brute_jaccard(rows)
    assert ("None", 37, 5) in want and all(c == 8 for d, _, c in want if d in ("8", "9"))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(x.doc_id), x.n_shingles, x.component_id) for x in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cap", [1500, 3])
def test_jaccard_counts_links(docs, cap):
    rows = [(d, t) for d, t, *_ in corpus()]
    sets = [plain_set(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(str(d), len(s), sum(near(s, x) for x in sets) - bool(s)) for (d, _), s in zip(rows, sets)]
    got = jaccard.jaccard_components(docs, cap=cap, count=True).collect()
    assert sorted((str(x.doc_id), x.n_shingles, x.n_links) for x in got) == sorted(want)
    assert sorted(((str(x.doc_id), x.n_shingles, x.component_id) for x in got), key=str) == sorted(brute_jaccard(rows), key=str)


def test_prefix_rows_of_copies_and_of_single_classes_end_early(spark):
    """Copies within a task give their rows once, shares of the shingles make up all, and only shared ones are kept."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words)] * 50 + [" ".join([*words[:-1], "other"]), " ".join(f"x{i}" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    levels = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    whole = sorted(map(tuple, jaccard.prefixes(docs, levels, 5, 80).collect()))
    assert len(whole) == len(set(whole)) == 24  # 36 - 29 + 1 of each of three classes
    parts = [r for k in range(3) for r in map(tuple, jaccard.prefixes(docs, levels, 5, 80, k, 3).collect())]
    assert sorted(parts) == whole
    classes = {}
    for token, sid, _ in whole:
        classes.setdefault(token, set()).add(sid)
    held = jaccard.shared_rows(docs, levels, 5, 80).collect()
    assert sorted((r.token, r.sid, r.place) for r in held) == [r for r in whole if len(classes[r[0]]) > 1]
    assert all(r.few and r.hub == min(classes[r.token]) for r in held)


def test_jaccard_of_nothing(empty):
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("cap", [3000, 20])
def test_forest(spark, cap):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:40] + 0.1 * rng.standard_normal((40, 16)), base[:5], base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 0.0]), (905, [2.0, 0.0]), (906, [])]
    got = {r.vec_id: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=40, cap=cap).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(got[i].n_links for i in range(len(x))) >= 0.9 * near.sum()
    assert all(got[i].n_links <= near[i] for i in range(len(x)))
    assert all(got[i].component_id == i and got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 906))
    assert got[905].component_id == 904 and got[905].n_links == 1
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_forest_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(5, base.tolist()), (5, base.tolist()), (5, (base + 0.01).tolist()), (None, (2 * base).tolist()), (None, None), (9, (-base).tolist())]
    own = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, embedding array<double>, unit int, weight double, leaf string")
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in forest.near_vectors(own).collect()), key=str)
    assert got == sorted([(5, 3, 5, True)] * 3 + [(None, 3, 5, False), (None, 0, None, False), (9, 0, 9, True)], key=str)


def test_forest_sends_a_vector_once_for_leaves_of_a_group(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 16))
    x[:1000] = x[1000:2000] + 0.1 * rng.standard_normal((1000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4000 + i, v[:3].tolist()) for i, v in enumerate(x[:50])], "vec_id long, embedding array<double>")
    kept, cut = {}, frames.cut
    monkeypatch.setattr(frames, "cut", lambda df, name="step": kept.setdefault(name, cut(df, name)) if name == "routed" else cut(df, name))
    monkeypatch.setattr(forest, "FIRST_LEVELS", 2)
    want = sorted(map(tuple, forest.near_vectors(rows, leaf=20).collect()))
    sent = kept["routed"].selectExpr("sum(size(leaves)) as leaves", "sum(size(groups)) as groups").first()
    assert 2 * sent.groups < sent.leaves
    # groups of one leaf each, and groups too large to be sent whole, give the same rows
    monkeypatch.setattr(forest, "FIRST_LEVELS", 30)
    assert sorted(map(tuple, forest.near_vectors(rows, leaf=20).collect())) == want
    monkeypatch.setattr(forest, "FIRST_LEVELS", 1)
    assert sorted(map(tuple, forest.near_vectors(rows, leaf=20, cap=20).collect())) == want


def test_forest_keeps_links_of_a_hot_group(spark):
    rng = np.random.default_rng(6)
    n, hot = 3000, 1000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = x[:hot] - np.outer(x[:hot] @ x[-1], x[-1])
    share = rng.uniform(0.9, 0.95, (hot, 1)) ** 0.5  # distinct vectors, cosine about 0.9 to 0.95
    x[:hot] = share * x[-1] + (1 - share**2) ** 0.5 * own / np.linalg.norm(own, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_vectors(rows, leaf=50).collect()}  # six levels
    near = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i].n_links <= near[i] for i in range(n))
    assert sum(got[i].n_links for i in range(n)) >= 0.998 * near.sum() > 500_000
    assert all(got[i].component_id == 0 for i in range(hot))


def test_containment(spark, docs, empty):
    items = spark.createDataFrame([(1, corpus()[0][1]), (2, None), (3, ""), (4, "a b"), (5, corpus()[0][1]), (6, "never seen words in any of them")], "item_id long, text string")
    got = sorted((str(x.doc_id), x.item_id) for x in contain.contained(docs, items).collect())
    want = []
    for d, t, *_ in corpus():
        for i, s in ((1, corpus()[0][1]), (4, "a b"), (5, corpus()[0][1])):
            q = plain_set(s)
            if q and 100 * len(q & plain_set(t)) >= 80 * len(q):
                want.append((str(d), i))
    assert got == sorted(want) and want
    assert contain.contained(empty, items).count() == 0 and contain.contained(docs, items.limit(0)).count() == 0


def test_containment_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, corpus()[4 * i][1]) for i in range(6)], "item_id long, text string")
    one = sorted(map(tuple, contain.contained(docs, items).collect()), key=str)
    monkeypatch.setattr(contain, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, contain.contained(docs, items).collect()), key=str) == one


FILES = "path string, is_licence_file boolean, text string"
MIT = next(t for k, t in licences.TEMPLATES if k == "MIT" and len(t) > 500)


def test_licences(spark):
    files = [("a/LICENSE", True, "MIT\nReleased under the MIT License."), ("a/b/c/x.py", False, "code"), ("a/b/y.py", False, "Licensed under CC BY-NC 4.0.\ncode"), ("z/q.py", False, None), ("q.py", False, ""), (None, False, "code"), ("a/b/LICENSE", True, "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", False, "code")]
    got = {(x.path, x.how): x for x in licences.scan(spark.createDataFrame(files, FILES)).collect()}
    assert got["a/b/c/x.py", "inherited"].licence == "Apache-2.0" and got["a/b/c/x.py", "inherited"].licence_path == "a/b/LICENSE"
    assert got["a/LICENSE", "own"].licence == "MIT" and got["a/b/y.py", "own"].licence == "CC-BY-NC-4.0" and got["a/b/y.py", "own"].score == 1.0
    assert ("z/q.py", "none") in got and ("q.py", "none") in got and (None, "none") in got
    assert licences.scan(spark.createDataFrame(files, FILES)).count() == len(files)
    assert licences.scan(spark.createDataFrame([], FILES)).count() == 0


def wrapped(text: str, mark: str = "# ", width: int = 70) -> str:
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_notices_over_many_lines(spark):
    notice = {k: max((t for i, t in licences.TEMPLATES if i == k), key=len) for k in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "MPL-2.0", "AGPL-3.0")}
    files = [(f"{k}.py", False, f"#!/usr/bin/env python\n# Copyright 2020 Some One\n#\n{wrapped(t)}\n\nimport os\n" + "print(1)\n" * 300) for k, t in notice.items()]
    files += [(f"spdx-{k}.c", False, f"// SPDX-License-Identifier: {k}\n" + "int x;\n" * 200) for k in ("MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0")]
    files += [("GPL-3.0-spdx.c", False, "// SPDX-License-Identifier: GPL-3.0-only\n"), ("lib/LICENSE", True, "Copyright (c) 2021 The Authors of a long list\n\n" + wrapped(MIT, "")), ("lib/deep/er/x.js", False, "code"), ("words.txt", False, "a licence to speak is not a thing " * 4000)]
    got = {x.path: x for x in licences.scan(spark.createDataFrame(files, FILES)).collect()}
    for p, x in got.items():
        if p.startswith("spdx-") or p.removesuffix(".py") in notice:
            assert x.licence == p.removeprefix("spdx-").removesuffix(".c").removesuffix(".py") and x.how == "own", p
    assert got["GPL-3.0-spdx.c"].licence == "GPL-3.0" and got["lib/LICENSE"].licence == "MIT"
    assert got["lib/deep/er/x.js"].licence_path == "lib/LICENSE" and got["words.txt"].how == "none"


def test_licences_with_clashing_columns(spark):
    own = spark.createDataFrame([("a/LICENSE", True, "Released under the MIT License.", "s", "d", 1, 2, "u", "z"), ("a/x", False, None, "t", None, 3, 4, "v", "y")], FILES + ", source string, dir string, own int, id int, key string, how string")
    got = {x.path: x for x in licences.scan(own).collect()}
    assert (got["a/x"].source, got["a/x"].dir, got["a/x"].own, got["a/x"].id, got["a/x"].key, got["a/x"].how) == ("t", None, 3, 4, "v", "inherited")
