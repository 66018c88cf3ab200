"""Every registered query against a plain Python version, on one awkward corpus, and on empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlit.llm import hmm, near_copies, quality, queries, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
RUN = queries.QUERIES


def of(rows):
    return [(i, t or "") for i, t, *_ in rows]


def folds(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


@pytest.mark.parametrize("name", [*RUN, "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    run = corpus_pipeline.run if name == "pipeline" else RUN[name]
    assert run(spark, empty_dir).count() == 0


def test_media(spark, sf_dir, rows):
    want = Counter()
    for i, t in of(rows):
        p = t.encode()
        q = p + bytes(max(64, -(-len(p) // 64) * 64) - len(p))
        want[i, len(p), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-64:])] += 1
    got = RUN["op1_media_columns"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes > r.payload_bytes and r.feature for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_hidden_markov_scores(spark, sf_dir, rows):
    words = [(i, WORD.findall(t.translate(LOWER)) + ["\0"]) for i, t in of(rows)]
    c = Counter(w for i, ws in words if folds(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, ws in words:
        want[i, folds(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)] += 1
    got = RUN["op2_hidden_markov_scores"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_are_the_forward_recursion_over_words(spark, rows, monkeypatch):
    """The score of each text by a recursion over its words in plain Python, with few symbols and most words in classes."""
    monkeypatch.setattr(hmm, "SYMBOLS", 64)
    monkeypatch.setattr(hmm, "KNOWN", 400)
    df = spark.createDataFrame([(k, t, folds(i) != 1) for k, (i, t, *_) in enumerate(rows) if k != 64], "doc_id long, text string, training boolean")
    scores, lex, model = hmm.language_scores(df)
    counts = Counter(w for k, (i, t, *_) in enumerate(rows) if folds(i) != 1 and k != 64 for w in WORD.findall((t or "").translate(LOWER)))
    assert 5 < lex.symbols < len(counts) / 4 and np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1)
    key = {w: hmm.tokens([w.encode()])[0][0] for _, t, *_ in rows for w in WORD.findall((t or "").translate(LOWER))}
    symbol_of = {k: s for k, s in zip(lex.keys.tolist(), lex.symbol.tolist(), strict=True) if s > 0}
    own = {w: symbol_of.get(int(k)) for w, k in key.items()}
    group = {w: int(k) % hmm.CLASSES for w, k in key.items()}
    mass = Counter()
    for w, n in counts.items():
        if own[w] is None:
            mass[group[w]] += n + 0.5
    for r in scores.collect():
        text = rows[r.doc_id][1] or ""
        state, total = None, 0.0
        for w in [*WORD.findall(text.translate(LOWER)), None]:
            symbol = 0 if w is None else own[w] or 1 + lex.symbols + group[w]
            share = 1.0 if w is None or own[w] else (counts[w] + 0.5) / (mass[group[w]] + 0.5)
            state = model.emit[symbol] * (model.start if state is None else state @ model.step)
            total += math.log10(state.sum() * share)
            state = state / state.sum()
        assert math.isclose(r.score, total, rel_tol=1e-9, abs_tol=1e-6)


def test_shuffle(spark, sf_dir, rows):
    got = RUN["op3_external_shuffle"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in of(rows))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = RUN["op3_external_shuffle"](spark, sf_dir).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_packing(spark, sf_dir, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = RUN["op4_column_generation_packing"](spark, sf_dir).collect()
    want = Counter()
    for i, t in of(rows):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 4096):
            want[i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 2


def fingerprint(t, k=4):
    w = WORD.findall(t.translate(LOWER))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, sf_dir, rows):
    fps = [(i, fingerprint(t)) for i, t in of(rows)]
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(group)
        for x, (_, f) in enumerate(fps):
            group[x] = min(group[y] for y, (_, g) in enumerate(fps) if (f ^ g).bit_count() <= 4)
        if group == before:
            break
    smallest = {g: min((i for (i, _), h in zip(fps, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = Counter((i, f"{f:016x}", smallest[g]) for (i, f), g in zip(fps, group, strict=True))
    got = RUN["op5_simhash_components"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_quality(spark, sf_dir, rows):
    got = RUN["op6_crf_quality"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in of(rows))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (folds(r.doc_id) == 0) for r in got)
    low = [r.score for r in got if r.doc_id is not None and r.doc_id % 10 == 8 and r.doc_id < 60]
    high = [r.score for r in got if r.doc_id is not None and r.doc_id % 10 == 3 and r.doc_id < 60]
    assert max(low) < min(high)


def test_quality_is_the_sum_over_all_labellings(spark):
    """Scores of short texts by summing over every labelling of their lines, and a floor of accuracy on held-out rows."""
    r = random.Random(5)
    good = lambda: "\n".join(" ".join(r.choice(("river", "stone", "of", "the", "and", "valley", "light", "were")) for _ in range(r.randint(6, 12))) + "." for _ in range(r.randint(1, 6)))
    bad = lambda: "\n".join("BUY!! " * r.randint(2, 6) + "$$$ ||| ***" for _ in range(r.randint(1, 6)))
    made = [(i, bad() if i % 3 == 0 else good(), int(i % 3 != 0)) for i in range(240)]
    made[7] = (7, "\n".join(bad() for _ in range(900)), 0)  # one very long text doesn't decide the fit
    df = spark.createDataFrame(made, "doc_id long, text string, label int")
    field = quality.train(df.where("doc_id < 160"), df.where("doc_id < 160").select("doc_id", "label"))
    got = {x.doc_id: x.score for x in quality.scored(df, field).where("doc_id >= 160").collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in made[160:]]) >= 0.98
    for i, text, _ in made[160:180]:
        features, size, bounds = quality.line_features([text.encode()])
        emit = features.astype(np.float64) @ field.weights
        weight = {}
        for labels in itertools.product((0, 1), repeat=len(emit)):
            weight[labels] = math.exp(sum(e * y for e, y in zip(emit, labels, strict=True)) + sum(field.steps[a, b] for a, b in itertools.pairwise(labels)))
        total = sum(weight.values())
        mean = sum(s * sum(w for y, w in weight.items() if y[k]) / total for k, s in enumerate(size)) / size.sum()
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        assert math.isclose(got[i], 1 / (1 + math.exp(-(field.curve[0] * math.log(mean / (1 - mean)) + field.curve[1]))), rel_tol=1e-6)


def test_quality_sample_keeps_to_its_bounds(spark):
    df = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10), i % 2) for i in range(50)], "doc_id long, text string, label int")
    labels = df.select("doc_id", "label")
    take = lambda n, size: [r.text for r in quality.sampled(df, labels, "text", "label", "doc_id", n, size).collect()]
    assert len(take(20, 10**6)) == 20 and len(take(100, 10**6)) == 50
    assert len(take(100, 200)) == 20 and len(take(100, 999)) == 49 and max(map(len, take(100, 999))) == 10


def test_substrings(spark, sf_dir, rows):
    order = sorted({(math.inf if i is None else i, t) for i, t in of(rows)})
    first: dict[tuple, tuple] = {}
    for i, t in order:
        w = WORD.findall(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    want = Counter()
    for i, t in of(rows):
        w, key = WORD.findall(t), math.inf if i is None else i
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (key, s):
                gone[s : s + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    got = RUN["op7_fixed_block_anchors"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.n_removed for r in got) > 100


def test_mixing(spark, sf_dir, rows):
    got = RUN["op8_source_mix"](spark, sf_dir).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, target, capped = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[u] for u in names if u not in capped) for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    source = {(i, len(WORD.findall(t or ""))): s for i, t, _, s, _ in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        if r.doc_id != 7:  # which is there twice, from two sources
            assert r.source_size == size[s] and math.isclose(r.target, target[s], abs_tol=1e-3)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert Counter(map(tuple, RUN["op8_source_mix"](spark, sf_dir).collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    df = RUN[name](spark, sf_dir)
    told = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(repr([r[names.index(c)] for c in df.columns]) for r in told.fetchall()) == Counter(repr(list(r)) for r in df.collect())


def brute_lines(docs):
    """What line dedup keeps of each (id, text): templates count distinct texts."""
    template = lambda x: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x))
    found = [(i, t, p, template(x)) for i, t in sorted(set(docs)) for p, x in enumerate(t.split("\n")) if template(x)]
    names = {x: x for _, _, _, x in found}

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    leaves = defaultdict(list)
    for x in sorted(names):
        leaves[len(x), x[:3]].append(x)
    for leaf in leaves.values():
        for a, b in itertools.combinations(leaf, 2):
            if sum(u == v for u, v in zip(a, b, strict=True)) >= math.ceil(0.8 * len(a) - 1e-9):
                names[root(b)] = root(a)
    texts, first = defaultdict(set), {}
    for i, t, _, x in found:
        texts[root(x)].add(t)
        first[root(x)] = min(first.get(root(x), math.inf), i)
    gone = defaultdict(set)
    for i, t, p, x in found:
        if len(texts[root(x)]) >= 5 and first[root(x)] != i:
            gone[i, t].add(p)
    return {(i, t): "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]) for i, t in docs}


def test_blocks_of_lines_recur_line_by_line(spark):
    """A notice of four lines in twenty documents stays in the first alone."""
    notice = "this page is made by one\nand only one of us\nwho asks you to keep\nwhat is written down here"
    df = spark.createDataFrame([(i, f"own words number {chr(97 + i)} {chr(98 + i)} of document {chr(99 + i)}\n{notice}") for i in range(20)], "doc_id long, text string")
    out = {r.doc_id: r for r in templates.drop_recurring_lines(df).collect()}
    assert out[0].n_dropped == 0 and all(out[i].n_dropped >= 4 and notice.split("\n")[1] not in out[i].text for i in range(1, 20))


def test_templates(spark, sf_dir, rows):
    docs = [(math.inf if i is None else i, t) for i, t in of(rows)]
    kept = brute_lines(docs)
    got = RUN["op9_log_template_lines"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.kept_sha256) for r in got) == Counter((i, hashlib.sha256(kept[d].encode()).hexdigest()) for (i, _), d in zip(of(rows), docs, strict=True))
    assert sum(r.n_dropped for r in got) >= 5


@pytest.mark.parametrize(("cell", "spread", "chunk"), [(1, 64, 4096), (1, 1, 5), (2, 9, 4)])
def test_crowded_keys_are_split_and_lose_no_link(spark, monkeypatch, cell, spread, chunk):
    """Lines of few words, so that keys are crowded at every step, against all pairs."""
    monkeypatch.setattr(templates, "CELL", cell)
    monkeypatch.setattr(templates, "SPREAD", spread)
    r = random.Random(cell)
    rows, seen = [], set()
    for size, n in ((5, 40), (6, 60), (10, 80), (14, 60), (25, 40)):
        base = [[r.randrange(3) for _ in range(size - 3)] for _ in range(4)]
        for _ in range(n):
            rest = [r.randrange(4) if r.random() < 0.3 else x for x in r.choice(base)]
            line = (1, 2, 3, *rest)
            if line not in seen:
                seen.add(line)
                rows.append((size, len(rows), list(line)))
    df = spark.createDataFrame(rows, "leaf long, h long, t array<long>")
    group = {h: h for _, h, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (_, a, u), (_, b, v) in itertools.combinations(rows, 2):
        if len(u) == len(v) and sum(x == y for x, y in zip(u, v, strict=True)) >= math.ceil(0.8 * len(u) - 1e-9) and root(a) != root(b):
            group[max(root(a), root(b))] = min(root(a), root(b))
    want = {h: root(h) for _, h, _ in rows if root(h) != h}
    assert {x.h: x.cluster for x in templates.generalised(df, chunk=chunk).collect()} == want and len(want) > 100


def test_a_crowded_key_costs_its_lines_and_not_its_pairs(spark, monkeypatch):
    """Thousands of lines that have all but two tokens in common and don't agree: no two are compared."""
    compared = []
    monkeypatch.setattr(templates, "_compared", lambda cells, lined, similarity, chunk: compared.append(cells.agg({"n": "max"}).first()[0]) or cells.select(F.col("h").alias("a"), F.col("h").alias("b")).limit(0))
    df = spark.createDataFrame([(1, k, [7, 8, 9, 10, 1000 + k, 900_000 + k]) for k in range(8000)], "leaf long, h long, t array<long>")
    assert templates.generalised(df).count() == 0
    assert compared and all(n is None or n <= 2 * templates.CELL for n in compared)


def brute_copies(docs):
    """How often mixing takes each id."""
    size = Counter()
    for _, source, n in docs:
        size[source] += n
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, capped = {s: 1 + k % 3 for k, s in enumerate(names)}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[u] for u in names if u not in capped) for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = Counter()
    for i, source, _ in docs:
        rate = min(3.0, target[source] / size[source]) if size[source] else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] += math.floor(rate) + (u < rate - math.floor(rate))
    return +out


def test_pipeline_against_plain_python(spark, sf_dir):
    """The stages after the classifier, each recomputed from what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir).collect()
    scores = Counter(r.doc_id for r in RUN["op6_crf_quality"](spark, sf_dir).collect() if r.predicted)
    assert Counter(r.doc_id for r in good) == scores
    frame = spark.createDataFrame(good, docs.schema)
    lined = corpus_pipeline.drop_lines(spark, frame, sf_dir).collect()
    keys = [(math.inf if r.doc_id is None else r.doc_id, r.text or "") for r in good]
    kept = brute_lines(keys)
    assert Counter((r.doc_id, r.text or "") for r in lined) == Counter((r.doc_id, kept[k]) for r, k in zip(good, keys, strict=True))
    frame = spark.createDataFrame(lined, docs.schema)
    single = corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()
    plain = lambda t: near_copies.normal((t or "").encode())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (plain(r.text).split() for r in lined)]
    group = list(range(len(lined)))
    for _ in range(len(lined)):
        before = list(group)
        for x, y in itertools.combinations(range(len(lined)), 2):
            if plain(lined[x].text) == plain(lined[y].text) or (all(sets[x]) and all(sets[y]) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])):
                group[x] = group[y] = min(group[x], group[y])
        if group == before:
            break
    last = lambda i: math.inf if i is None else i
    assert Counter(last(r.doc_id) for r in single) == Counter(min(last(lined[k].doc_id) for k in range(len(lined)) if group[k] == g) for g in set(group))
    frame = spark.createDataFrame(single, docs.schema)
    mixed = corpus_pipeline.mix_sources(spark, frame, sf_dir).collect()
    want = brute_copies([(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in single])
    times = Counter(r.doc_id for r in mixed)
    assert times == want
    packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(mixed, docs.schema), sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == times
    assert docs.columns == frame.columns == corpus_pipeline.COLUMNS
