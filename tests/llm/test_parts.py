"""The parts under the operators: containers, codes, linear programs, recursions, hashes."""

import itertools
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenlit.llm import binary_search, cutting_stock, hmm, media, mixing, near_copies, packing, quality, shuffling, simhash, substrings, templates, words
from lumenlit.operators import graph

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_container_round_trip():
    for blocks in (1, 255, 256, 257, 1000):
        payload = random.Random(blocks).randbytes(64 * blocks)
        made = media.container(payload)
        told = media.description(made)
        assert told["valid"] and told["codec"] == "raw " and told["duration"] == len(payload) and told["samples"] == blocks
        assert b"".join(made[r["offset"] : r["offset"] + r["length"]] for r in told["media_ranges"]) == payload
        assert told["keyframes"] == -(-blocks // 256)
        assert made == media.container(payload)
    assert media.description(None) is None
    for broken in (b"", b"junk", made[:100], made[:-64], made[:200] + bytes(50) + made[250:]):
        assert media.description(broken)["valid"] in (False, True)
    assert not media.description(made[:-64])["valid"]


def test_media_udfs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, b"x" * 64), (2, None)], "media int, payload binary")
    out = df.select("media", media.describe(media.store(F.col("payload"))).alias("d"))
    got = {r.media: r.d for r in out.collect()}
    assert got[1].valid and got[1].samples == 1


def fragmented():
    """A file as a streaming encoder writes it: two tracks without samples of their own, then two fragments."""
    box, full = media._box, media._full
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)

    def trak(number, handler, codec, scale):
        stbl = box(b"stbl", full(b"stsd", u32(1), box(codec, bytes(78))), full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0)))
        mdia = box(b"mdia", full(b"mdhd", u32(0, 0, scale, 0, 0)), full(b"hdlr", u32(0), handler, bytes(13)), box(b"minf", stbl))
        return box(b"trak", full(b"tkhd", u32(0, 0, number, 0, 0), bytes(60)), mdia)

    mvex = box(b"mvex", full(b"trex", u32(1, 1, 512, 7, 0x10000)), full(b"trex", u32(2, 1, 100, 5, 0)))
    out = box(b"ftyp", b"isom", u32(1)) + box(b"moov", full(b"mvhd", bytes(96)), trak(1, b"vide", b"avc1", 12800), trak(2, b"soun", b"mp4a", 1000), mvex)
    want = {1: [], 2: []}
    for k in range(2):
        video, sound = [40 + k, 7, 9], [5, 5]

        def moof(first):
            one = box(b"traf", full(b"tfhd", u32(1), flags=0x20000), full(b"trun", u32(3, first, 0), u32(*video), flags=0x205))
            two = box(b"traf", full(b"tfhd", u32(2), flags=0x20000), full(b"trun", u32(2, first + sum(video)), flags=0x001))
            return box(b"moof", full(b"mfhd", u32(k + 1)), one, two)

        size = len(moof(0))
        at = len(out) + size + 8
        out += moof(size + 8) + box(b"mdat", bytes(range(sum(video) + sum(sound))))
        want[1].append((at, sum(video), video[0]))
        want[2].append((at + sum(video), sum(sound), sum(sound)))
    return out, want


def test_tracks_and_fragments(spark):
    made, want = fragmented()
    video, sound = media.all_tracks(made)
    assert (video["track"], video["handler"], video["codec"], video["duration"], video["samples"], video["fragments"], video["keyframes"]) == (1, "vide", "avc1", 6 * 512, 6, 2, 2)
    assert (sound["track"], sound["handler"], sound["codec"], sound["duration"], sound["samples"], sound["keyframes"]) == (2, "soun", "mp4a", 400, 4, 4)
    for track, told in ((1, video), (2, sound)):
        assert [(r["offset"], r["length"]) for r in told["media_ranges"]] == [w[:2] for w in want[track]]
    assert [(k["offset"], k["length"], k["first_sample"]) for k in video["keyframe_ranges"]] == [(want[1][0][0], 40, 1), (want[1][1][0], 41, 4)]
    assert media.all_tracks(made[:-3]) is None and media.all_tracks(None) is None
    df = spark.createDataFrame([(made,), (None,), (b"no media",)], "m binary").select(media.describe_tracks(F.col("m")).alias("t"), media.describe(F.col("m")).alias("d"))
    got = df.collect()
    assert [len(r.t) if r.t else 0 for r in got] == [2, 0, 0] and got[0].d.samples == 6 and got[2].d.valid is False


def test_every_close_pair_shares_a_home_anchor():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(0, 2**63)
        b = a
        for bit in r.choice(63, 4, replace=False):
            b ^= 1 << int(bit)
        row, key, home = simhash.anchors(np.array([a, b], np.int64))
        of = lambda i, h: set(key[(row == i) & (home if h else True)].tolist())
        assert of(0, True) & of(1, False)
    row, key, home = simhash.anchors(np.array([5], np.int64))
    assert home.sum() == 3 and len(set(key.tolist())) == len(key)


def test_bits_of_long_texts_are_counted_in_steps(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = simhash.simhashes(text, 4, 2)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert (simhash.simhashes(text, 4, 2) == whole).all() and whole[0] == np.uint64(simhash.simhash(text) % 2**64)
    assert (simhash.simhashes(None, 4, 3) == 0).all()


def test_crowded_anchors_lose_nothing(spark):
    centre = 0x0F0F33335555AAAA
    codes = sorted({centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 60, 3), 2)} | {random.Random(1).getrandbits(63) for _ in range(50)})
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    want = simhash.links(df).collect()
    split = simhash.links(df, chunk=7).collect()

    def groups(edges):
        name = {c: c for c in codes}

        def root(x):
            while name[x] != x:
                x = name[x]
            return x

        for e in edges:
            assert (e.a ^ e.b).bit_count() < 64
            name[root(max(e.a, e.b))] = root(min(e.a, e.b))
        return {c: root(c) for c in codes}

    own = groups(want)
    assert own == groups(split)
    for a, b in itertools.combinations(codes, 2):
        if (a ^ b).bit_count() <= 4:
            assert own[a] == own[b]


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 180)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*chain, *hub, (7, 7), (3, 2)], "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 180)}


def test_column_generation_meets_the_demand():
    r = random.Random(4)
    for capacity, most in ((16, 5), (64, 40), (64, 0)):
        demand = np.array([0] + [r.randint(0, most) for _ in range(capacity)])
        plan = cutting_stock.plan(demand, capacity)
        made = np.zeros(capacity + 1, int)
        for pattern, times in plan:
            assert sum(s * n for s, n in pattern.items()) <= capacity and times > 0
            for s, n in pattern.items():
                made[s] += n * times
        assert (made == demand).all()
        total = int((demand * np.arange(capacity + 1)).sum())
        assert sum(t for _, t in plan) <= max(-(-total // capacity) * 1.05 + 2, 0)


def test_knapsack():
    prices = np.array([0.0, 0.1, 0.0, 0.5, 0.0, 0.7])
    value, pattern = cutting_stock.best_pattern(prices, 5)
    assert abs(value - 0.7) < 1e-12 and (pattern * np.arange(6)).sum() <= 5


def test_forward_is_the_sum_over_paths():
    r = np.random.default_rng(0)
    model = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    symbol, bounds = np.array([0, 3, 2, 1, 4, 4, 0]), np.array([0, 4, 5, 7])
    got = hmm.forward(model, symbol, bounds)
    for d in range(3):
        s = symbol[bounds[d] : bounds[d + 1]]
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.step[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert np.isclose(10 ** got[d], total)
    starts, steps, emits = hmm.expected(model, symbol, bounds)
    assert np.isclose(starts.sum(), 3) and np.isclose(steps.sum(), 4) and np.allclose(emits.sum(axis=1), np.bincount(symbol, minlength=5))


def test_baum_welch_never_lowers_the_likelihood():
    r = np.random.default_rng(1)
    symbol, bounds = r.integers(0, 6, 400), np.arange(0, 401, 40)
    unigram, before = np.full(6, 1 / 6), -np.inf
    model = hmm.Model(r.dirichlet(np.ones(2)), r.dirichlet(np.ones(2), 2), r.dirichlet(np.ones(6), 2).T)
    for _ in range(8):
        starts, steps, emits = hmm.expected(model, symbol, bounds)
        model = hmm.Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
        now = hmm.forward(model, symbol, bounds).sum()
        assert now >= before - 1e-9
        before = now
    assert np.isclose(hmm.estimated(unigram, starts, steps, emits).emit.sum(axis=0), 1).all()


def test_marginals_of_lines_are_exact():
    r = np.random.default_rng(3)
    emit, steps, bounds = r.normal(size=6), r.normal(size=(2, 2)), np.array([0, 4, 5, 6])
    good, moves, log_z = quality.marginals(emit, bounds, steps)
    for d in range(3):
        n = bounds[d + 1] - bounds[d]
        z, m = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(emit[bounds[d] + t] * y[t] for t in range(n)) + sum(steps[y[t - 1], y[t]] for t in range(1, n)))
            z += p
            m += p * np.array(y)
        assert np.isclose(log_z[d], np.log(z)) and np.allclose(good[bounds[d] : bounds[d + 1]], m / z)
    assert np.isclose(moves.sum(), 3)


def test_quality_without_labels():
    field = quality.fit(np.empty((0, quality.WIDTH)), np.empty(0), np.zeros(1, int), np.empty(0, int))
    assert quality.score([b"some text", None, b""], field).tolist() == [0.5] * 3


def test_word_spans_and_hashes():
    texts = ["a b", "", "\x1c x  y\n", "ab" * 5000 + " tail"]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        a, b = words.spans(data)
        assert [bytes(data[x:y]) for x, y in zip(a, b, strict=True)] == t.encode().split()
    data, _ = words.buffer([b"same other same"])
    h = words.hashes(data, *words.spans(data))
    assert h[0] == h[2] != h[1]
    many = np.frombuffer(b" ".join(b"w%d" % i for i in range(200_000)), np.uint8)
    assert len(np.unique(words.hashes(many, *words.spans(many)))) == 200_000


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10, 20])
def test_rolled_windows(width):
    key = np.random.default_rng(width).integers(0, 2**63, 90).astype(np.uint64)
    key[50:75] = key[10:35]
    h = substrings.rolled(key, width)
    assert len(h) == 91 - width and h[10] == h[50] and len(np.unique(h)) == 91 - width - (26 - width)
    assert len(substrings.rolled(key[: width - 1], width)) == 0


@pytest.mark.parametrize("width", [12, 28, 57, 60, 64])
def test_packed_hashes(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 7, 300, 5000):
        values = np.sort(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - width))
        assert (substrings.unpacked(substrings.packed(values, width), width) == values).all()
    many = np.zeros(1000, np.uint64)
    assert (substrings.unpacked(substrings.packed(many, width), width) == many).all()


def test_small_portions_and_groups_find_the_same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, print string, portion long")
    whole = Counter(map(tuple, substrings.substring_dedup(df).collect()))
    assert Counter(map(tuple, substrings.substring_dedup(df, portion=3000, group=60).collect())) == whole
    assert len(rows) == sum(whole.values())


def test_nearest_codes_are_exact():
    r = np.random.default_rng(5)
    codes = r.integers(0, 2**63, 3000).astype(np.uint64)
    codes[:40] = codes[40]
    index = binary_search.Index(codes, np.arange(3000))
    for q in (0, 41, 2999):
        far = np.bitwise_count(codes ^ codes[q]).astype(int)
        want = sorted((int(far[i]), i) for i in range(3000) if i != q)[:10]
        assert index.nearest(codes[q], q, 10) == want
    assert len(binary_search.Index(codes[:3], np.arange(3)).nearest(codes[0], 0, 10)) == 2


def test_search_in_several_blocks(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, r.getrandbits(63)) for i in range(400)], "id long, code long")
    one = {tuple(x) for x in binary_search.top_k(df.where("id % 100 = 0"), df).collect()}
    many = {tuple(x) for x in binary_search.top_k(df.where("id % 100 = 0"), df, block=70).collect()}
    assert one == many and len(one) == 40


def test_shuffle_spreads_a_crowded_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 0 + 100).alias("size"), F.col("id").alias("position"))
    out = shuffling.external_shuffle(df, "k", "size", bucket_bytes=60_000)
    counts = [r["count"] for r in out.groupBy("bucket").count().collect()]
    assert sum(counts) == 6000 and len(counts) == 10 and max(counts) < 900
    places = sorted(r.position for r in out.select("position").collect())
    assert places == list(range(6000))


def test_operators_take_clashing_columns(spark, rows):
    names = ["id", "print", "key", "_key", "_source", "_own", "_salt", "named", "places", "_places", "_id", "_print", "h", "bucket_", "crowded", "row", "root", "best", "name", "first", "group", "size_"]
    df = spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.length("text").cast("long"))
    clashing = df.withColumns({n: F.lit(n) for n in names})
    for run in (
        lambda x: shuffling.external_shuffle(x, "doc_id", "size"),
        lambda x: mixing.mix(x),
        lambda x: templates.drop_recurring_lines(x),
        lambda x: near_copies.keep_one(x),
        lambda x: substrings.substring_dedup(x),
        lambda x: simhash.near_duplicates(x),
        lambda x: packing.pieces(x, PATH),
        lambda x: quality.scored(x, quality.Field(np.zeros(quality.WIDTH), np.zeros((2, 2)), (1.0, 0.0))),
    ):
        plain, other = run(df), run(clashing)
        some = [c for c in plain.columns if c in other.columns]
        assert some == plain.columns
        assert Counter(map(tuple, other.select(some).collect())) == Counter(map(tuple, plain.collect()))
        kept = [n for n in names if n in other.columns and n not in plain.columns]
        if kept:
            assert {tuple(r) for r in other.select(kept).distinct().collect()} == {tuple(kept)}


def test_mixing_keeps_clashing_columns_out(spark):
    df = spark.createDataFrame([(1, "a", 10, 5.0), (2, None, 0, 5.0), (3, "b", 30, 5.0), (3, "b", 30, 5.0)], "doc_id long, source string, size long, target double")
    out = mixing.mix(df)
    assert out.columns.count("target") == 1 and out.count() == 4
    assert all(0 <= r.copies <= 3 for r in out.collect())
    assert mixing.emit(out).count() == sum(r.copies for r in out.collect())


def test_line_dedup_keeps_extra_columns(spark):
    line = "this line is everywhere number"
    df = spark.createDataFrame([(i, f"own words of text {'abcdefghij'[i]}\n{line} {i}\nafter that {'qrstuvwxyz'[i]}", "keep", 9) for i in range(8)], "doc_id long, text string, note string, n_lines int")
    out = {r.doc_id: r for r in templates.drop_recurring_lines(df).collect()}
    assert line in out[0].text and all(line not in out[i].text for i in range(1, 8)) and out[3].note == "keep" and out[3].n_lines == 3
    copies = spark.createDataFrame([(i, f"first things first here\n{line} 5\nand last") for i in range(8)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in templates.drop_recurring_lines(copies).collect())


def test_lines_of_shared_blocks_and_short_lines_recur(spark):
    block = ["all of this may be copied", "by whom it may concern here", "and nobody is liable for it", "The End"]
    df = spark.createDataFrame([(i, "\n".join([f"some words of {w}", *block, f"more of {w} alone"])) for i, w in enumerate("abcdefg")], "doc_id long, text string")
    out = {r.doc_id: r for r in templates.drop_recurring_lines(df).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped == 4 and out[i].text == f"some words of {w}\nmore of {w} alone" for i, w in enumerate("abcdefg") if i)
    few = templates.drop_recurring_lines(df.where("doc_id < 4").unionByName(df.where("doc_id < 4").withColumn("doc_id", F.col("doc_id") + 10)))
    assert all(r.n_dropped == 0 for r in few.collect())  # eight documents, but four texts


def test_other_lines_never_hide_a_template(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(8))
    lines = [f"A B C d {word()} e f g {word()} k" for _ in range(30)] + [" ".join(["A B C d", *(word() for _ in range(6))]) for _ in range(300)]
    lines += [" ".join(["A B C", *(word() for _ in range(4)), "x", *(word() for _ in range(2)), "y z" + " u" * 13]) for _ in range(30)]  # 25 tokens, too far apart
    lines += [" ".join("P Q R a b c d e f g h i j k l m n o p q s t u v w".split()[:i] + [word()] + "P Q R a b c d e f g h i j k l m n o p q s t u v w".split()[i + 1 :]) for i in range(3, 25)]
    r.shuffle(lines)
    df = spark.createDataFrame([(i, f"{x}\n{word()}") for i, x in enumerate(lines)], "doc_id long, text string")
    tokens = [x.split() for x in lines]
    name = list(range(len(lines)))
    for _ in range(len(lines)):
        before = list(name)
        for x, a in enumerate(tokens):
            name[x] = min(name[y] for y, b in enumerate(tokens) if len(a) == len(b) and a[:3] == b[:3] and 5 * sum(u == v for u, v in zip(a, b, strict=True)) >= 4 * len(a))
        if name == before:
            break
    want = {i for i, n in enumerate(name) if n != i and name.count(n) >= 5}
    assert {x.doc_id for x in templates.drop_recurring_lines(df).where("n_dropped > 0").collect()} == want and len(want) == 50
    found = templates.line_tokens(df, templates.lines(df).select("leaf").distinct(), "doc_id", "text")
    whole = {tuple(x) for x in templates.generalised(found).collect()}
    assert whole == {tuple(x) for x in templates.generalised(found, chunk=7).collect()} and len(whole) == 50


def test_mixing_with_many_sources_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7}" if i % 5 else None, i % 50) for i in range(400)], "doc_id long, source string, size long")
    few = sorted(map(repr, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(df).collect())) == few and len(few) == 400
