"""Merkle manifests, token counts and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlit.llm import dialogue, merkle, ordered, queries, token_counts, words

RUN = queries.QUERIES
TOKENIZER = "byte_bpe_50k.json"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_manifest(rows):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    leaf = lambda r, text: sha("".join(map(told, (r[0], r[3], r[2], r[4], text))))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
    trees = {s: tree([x[2] for x in by[s]]) for s in sources}
    over = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(by[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf(r, r[1].translate(lower) if tampered and r[1] is not None else r[1]), ""
            for levels, j in ((trees[s], i), (over, k)):
                for level in levels[:-1]:
                    run, place = level[j // 16 * 16 : j // 16 * 16 + 16], j % 16
                    proof += "".join(run[:place] + run[place + 1 :])
                    node, j = sha("".join([*run[:place], node, *run[place + 1 :]])), j // 16
            out.append((r[0], own, trees[s][-1][0], over[-1][0], sha(proof), node, node == over[-1][0]))
    return out


def test_manifest(spark, sf_dir, rows):
    got = RUN["op11_merkle_manifest"](spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, got.collect()))
    assert found == Counter(brute_manifest(rows))
    assert {v for *_, v in found} == {True, False}


def test_manifest_of_many_blocks_and_sources(spark):
    """One hot source of several rounds of small blocks, a lone row, and more sources than one run holds."""
    r = random.Random(4)
    rows = [(i, r.choice(("Abc", "dé", None)), "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(900)] + [(1, "x", None, "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fields = [df.doc_id, df.source, df.lang, df.n_chars]
    leaves = df.select(df.source.alias("tree"), df.doc_id.alias("id"), merkle.leaf(*fields, df.text).alias("digest"), merkle.leaf(*fields, df.text).alias("claim"))
    got = merkle.manifest(leaves, paths=True, height=1).collect()
    want = Counter((i, leaf, sub, root, proof) for i, leaf, sub, root, proof, _, _ in brute_manifest(rows))
    assert Counter((x.id, x.leaf, x.subroot, x.root, x.proof_sha256) for x in got) == want
    for x in got:  # the siblings themselves lead to the root
        assert x.folded_root == x.root and sha(x.siblings) == x.proof_sha256
        assert merkle.folded(x.leaf.encode(), merkle.opened_path(x.siblings.encode(), bytes(x.shape))).decode() == x.root
    assert {x.position for x in got if x.tree == "hot"} == set(range(600))


def test_positions_of_a_hot_group_are_gapless(spark):
    rows = [("a" if i % 3 else None if i % 2 else "b", i % 50, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, _seq long")
    found = defaultdict(list)
    for r in ordered.positions(df, "g", ["o"]).collect():
        found[r.g].append((r.position, r.o, r.members))
    for some in found.values():
        some.sort()
        assert [p for p, _, _ in some] == list(range(len(some))) and [o for _, o, _ in some] == sorted(o for _, o, _ in some)
        assert all(m == len(some) for _, _, m in some)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(TOKENIZER), Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_token_counts(spark, sf_dir, rows):
    _, tokenizer = library()
    texts = [t or "" for _, t, *_ in rows]
    want = Counter((i, len(t.encode()), n, n > 1024) for (i, *_), t, n in zip(rows, texts, (len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)), strict=True))
    got = RUN["op12_token_counts"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


#: Pieces that make pre-tokens meet: blanks of all kinds, endings, marks, special strings whole and cut, new characters.
PIECES = ["a", "B", "é", "中", "1", "٣", "½", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", "'", "'s", "'re", "'ll", "'LL", "don't", "!", "...", "<|endoftext|>", "<|endof", "\x00", "😀", "́", "\U000105c0", "Ᲊ", "’", "-" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=30))
def test_every_text_counts_as_the_library_counts_it(text):
    path, tokenizer = library()
    nothing = token_counts.Table(np.empty(0, np.uint64), np.empty(0, np.uint32))
    data = text.encode("utf-8", "ignore")
    got = token_counts.counter(path).counts([b"", data, data], nothing).tolist()
    assert got == [0] + [len(tokenizer.encode(data.decode(), add_special_tokens=False))] * 2


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    path, tokenizer = library()
    monkeypatch.setattr(token_counts, "STEP", 50)
    r = random.Random(2)
    text = "".join(r.choice(["word", " ", "  ", "\n", "é", "　", "'s", "x" * 80, ".", " <|endoftext|> "]) for _ in range(4000))
    counter = token_counts.Counter(path)
    assert len(list(counter.parts(text.encode()))) > 100
    nothing = token_counts.Table(np.empty(0, np.uint64), np.empty(0, np.uint32))
    assert counter.counts([text.encode()], nothing).tolist() == [len(tokenizer.encode(text, add_special_tokens=False))]


def test_tiers_change_nothing_and_small_caches_forget(spark, rows, monkeypatch):
    path, tokenizer = library()
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows if i != 104], "doc_id long, text string, n_tokens string")
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in rows if i != 104)
    for most in (1, 7, 100_000):
        assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, path, most=most).collect()) == want
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter, nothing = token_counts.Counter(path), token_counts.Table(np.empty(0, np.uint64), np.empty(0, np.uint32))
    many = [f"w{i:x}z{i * i:x}".encode() for i in range(9000)] * 2
    assert counter.counts(many, nothing).tolist() == [len(e) for e in tokenizer.encode_batch([t.decode() for t in many], add_special_tokens=False)]


def test_frequent_pre_tokens_are_found_and_bounded(spark):
    path, _ = library()
    r = random.Random(8)
    texts = [" the" * 30 + "".join(f" rare{r.random()}" for _ in range(40)) + " of" * 20 for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(150)  # so that summaries are merged in rounds
    found = token_counts.frequent(df, path, most=8)
    assert len(found) <= 8 and {b" the", b" of"} <= set(found)


def test_table_finds_what_it_holds():
    keys = np.unique(words.mix(np.arange(5000, dtype=np.uint64)) & np.uint64(0xFFFFFFFFFFFF0000))  # all begin at few slots
    table = token_counts.Table(keys, np.arange(1, len(keys) + 1, dtype=np.uint32))
    assert (table.find(keys) == np.arange(1, len(keys) + 1)).all() and not table.find(keys + np.uint64(1)).any()


WORDS = re.compile(r"[^\x20\x09-\x0D]")


def brute_dialogues(turns):
    """Every conversation by a table over (turns done, state) that keeps the least (cost, audit)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        by[conv] += [(turn, "user" if key == 4 else role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        numbers, seen, kinds = [r[0] for r in rows if r[0] is not None], set(), []
        for _, role, text in rows:
            marks = WORDS.findall(text)
            kinds.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        best = {0: (0, "", ())}
        for i in range(len(rows) + 1):
            for _ in range(8):  # insertions before the next turn
                for s, (cost, audit, said) in list(best.items()):
                    for x in ("u", "a"):
                        if x in step[s]:
                            new = (cost + 3, audit + "I", (*said, ({"u": "user", "a": "assistant"}[x], "")))
                            if step[s][x] not in best or new < best[step[s][x]]:
                                best[step[s][x]] = new
            if i == len(rows):
                break
            after = {}
            for s, (cost, audit, said) in best.items():
                _, role, text = rows[i]
                moves = [(cost + 4, audit + "D", said, s)]
                if kinds[i] not in ("blank", "duplicate"):
                    extra = 3 * (kinds[i] == "truncated")
                    if letters[i] in step[s]:
                        moves.append((cost + extra, audit + "K", (*said, (role, text)), step[s][letters[i]]))
                    moves += [(cost + 3 + extra, audit + "R", (*said, ({"u": "user", "a": "assistant"}[x], text)), step[s][x]) for x in ("u", "a") if x in step[s]]
                for *new, to in moves:
                    if to not in after or tuple(new) < after[to]:
                        after[to] = tuple(new)
            best = after
        cost, audit, said = min(best[s] for s in (0, 3) if s in best)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in said))))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_conversation_repair(spark, sf_dir, turns, monkeypatch, chunk):
    monkeypatch.setattr(dialogue, "CHUNK", chunk)
    got = RUN["op13_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = Counter(brute_dialogues(turns))
    assert {c for c, *_ in want} == {t[0] for t in turns} and any(not w[7] for w in want) and {x for w in want for x in w[7]} == set("KRDI")
    assert Counter(map(tuple, got.collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.integers(0, 3)), max_size=14), st.integers(1, 5))
def test_chunks_join_to_the_best_of_the_whole(rows, size):
    initials, kinds = [a for a, _ in rows], [k for _, k in rows]
    whole = next(iter(dialogue.repairs(initials, kinds, 0, True).values()))
    joined = dialogue.Joined()
    cuts = list(range(0, len(rows), size)) or [0]
    for a in cuts:
        joined.add({e: dialogue.repairs(initials[a : a + size], kinds[a : a + size], e, a == cuts[-1]) for e in range(4)})
    assert joined.result() == whole


def test_the_search_opens_little_of_a_sound_conversation():
    """The bound leads straight on: a sound conversation of thousands of turns is walked at once."""
    n = 4000
    assert dialogue.repairs(["u", "a"] * (n // 2), [dialogue.FINE] * n, 0, True) == {3: (0, "K" * n)}
