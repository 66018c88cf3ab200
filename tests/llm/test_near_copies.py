"""Near copies against all pairs of shingle sets."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lumenlit.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return bool(a | b) and len(a & b) / len(a | b) >= 0.8


def edited(words, changes, r):
    out = list(words)
    for at in r.sample(range(len(out)), changes):
        out[at] = f"other{r.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(11)
    texts = []
    for k in range(30):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice((60, 150, 400)))]
        texts.append(" ".join(base))
        # From hardly changed to well below the similarity, so that groups have links on either side of it.
        texts += [edited(base, n, r) for n in range(0, len(base) // 12, max(1, len(base) // 80))]
        if k % 5 == 0:
            texts.append("  ".join(base).upper())
    crowd = [f"v{r.randrange(900)}" for _ in range(200)]
    texts += [edited(crowd, r.randint(1, 12), r) for _ in range(40)]
    texts += [None, "", " \n", "short one", "Short  ONE", "another short one"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "again"), (None, texts[0], "s"), (None, "words of no id at all", "s"), (900, None, "s"), (3, texts[90], "same id")]


def groups_of(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if near_copies.normal((rows[a][1] or "").encode()) == near_copies.normal((rows[b][1] or "").encode()) or similar(rows[a][1], rows[b][1])]
    for a, b in pairs:
        parent[find(b)] = find(a)
    return [find(x) for x in range(len(rows))], pairs


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 9])
def test_every_pair_above_the_similarity_and_none_below(spark, near_rows, chunk):
    named, groups = near_copies.near_groups(spark.createDataFrame(near_rows, SCHEMA), chunk=chunk)
    root = {r.name: r.root for r in groups.collect()}
    name_of = {}
    for r in named.collect():
        name_of[r.id, r.print] = r.name
    by_text = {}
    for (i, t, _), name in zip(near_rows, _names(spark, near_rows), strict=True):
        by_text[i, t] = root.get(name, name)
    own = [by_text[i, t] for i, t, _ in near_rows]
    want, pairs = groups_of(near_rows)
    found = sum(own[a] == own[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs) and len(pairs) > 200
    # Nobody is in a group without a chain of similar texts.
    assert all(want[a] == want[b] for a, b in itertools.combinations(range(len(own)), 2) if own[a] == own[b])
    assert len(name_of) <= len(near_rows)


def _names(spark, rows):
    import xxhash

    return [near_copies._signed(xxhash.xxh3_64_intdigest(near_copies.normal((t or "").encode()))) for _, t, _ in rows]


def test_one_of_each_group_stays(spark, near_rows):
    df = spark.createDataFrame(near_rows, SCHEMA)
    kept = [tuple(r) for r in near_copies.keep_one(df).collect()]
    groups, _ = groups_of(near_rows)
    order = {g: min((float("inf") if near_rows[k][0] is None else near_rows[k][0]) for k in range(len(near_rows)) if groups[k] == g) for g in set(groups)}
    assert not Counter(kept) - Counter(near_rows)
    ids = Counter(float("inf") if i is None else i for i, _, _ in kept)
    assert not Counter(order.values()) - ids
    assert sum(ids.values()) <= len(order) + 2  # as many groups, but for a pair that met at no anchor
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_fingerprints_are_counted_in_steps(monkeypatch):
    own = near_copies.shingles(" ".join(map(str, range(900))).encode())
    whole = near_copies.fingerprint(own)
    monkeypatch.setattr(near_copies, "STEP", 7)
    assert (near_copies.fingerprint(own) == whole).all() and len(whole) == near_copies.WIDE


def test_shortest_forest():
    r = np.random.default_rng(4)
    for n in (2, 9, 60):
        a, b, far = r.integers(0, n, 200), r.integers(0, n, 200), r.integers(0, 9, 200)
        a, b, far = a[a != b], b[a != b], far[a != b]
        chosen = near_copies._shortest_forest(a, b, far, n)
        label = list(range(n))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        cost = 0
        for k in np.argsort(far, kind="stable"):
            if find(a[k]) != find(b[k]):
                label[find(a[k])] = find(b[k])
                cost += far[k]
        assert far[chosen].sum() == cost and len(chosen) == n - len({find(x) for x in range(n)})


def test_pairs_at_the_threshold_meet_at_anchors():
    """Of random pairs of sets at a similarity of 0.8 to 0.85 hardly any is lost by anchors and bounds."""
    r, found, n = np.random.default_rng(3), 0, 0
    for similarity in (0.8, 0.825, 0.85):
        for size in (60, 300):
            common = round(2 * similarity / (1 + similarity) * size)
            sets = [[r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (common, size - common, size - common)] for _ in range(300)]
            a, b = (np.stack([near_copies.fingerprint(np.concatenate((x[0], x[side]))) for x in sets]).view(np.uint64) for side in (1, 2))
            (row_a, key_a, home_a), (row_b, key_b, home_b) = simhash.anchors(a), simhash.anchors(b)
            for i in range(len(sets)):
                at = dict(zip(key_a[row_a == i].tolist(), home_a[row_a == i].tolist(), strict=True))
                met = [k for k, home in zip(key_b[row_b == i].tolist(), home_b[row_b == i].tolist(), strict=True) if k in at and (home or at[k])]
                far = np.bitwise_count(a[i] ^ b[i])
                n += 1
                found += any(far[((k >> 24) + 1) % near_copies.WIDE] <= near_copies.LOOSE for k in met) and far.sum() <= near_copies.CLOSE
    assert found >= 0.99 * n
