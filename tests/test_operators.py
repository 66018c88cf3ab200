import json
import math
import os
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumenlit import queries
from lumenlit.functions import scoring
from lumenlit.operators import linkage, merging, nearest, packed_nearest, packed_terms, packed_weights, ranking, reporting, state, tfidf
from lumenlit.plans import profile, recommend, search
from lumenlit.sources import feeds, files

PAPER = "id long, arxiv_id string, doi string, norm_title string"


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPER)


def test_linkage_cascade(spark):
    library = papers(spark, [(0, "2401.00001", "", "a study of frustrated magnets in two dimensions part i"), (1, "", "10.1/x", "quantum monte carlo for bosons"), (2, "", "", "tensor networks for strongly correlated electrons and beyond"), (3, "2401.00009", "10.1/x", "quantum monte carlo for bosons")])
    rows = [
        (10, "2401.00001", "", "something else"), (11, "", "10.1/X", "other words"), (12, "", "", "quantum monte carlo for bosons"), (13, "", "", "tensor networks for strongly correlated electrons"),
        (14, "", "", "tensor networks for strongly correlated electrons and beyond it"), (15, "", "", "nothing shared"), (16, "", "", ""), (17, "2401.77777", "", "a study of frustrated magnets in two dimensions part i"),
        (18, "2401.55555", "", "a study of frustrated magnets in two dimensions part ii"), (19, "", "", "tensor network for strongly correlated electrons and beyond"),
    ]
    found = {r.id: (r.library_id, r.rule) for r in linkage.match_library(papers(spark, rows), library).collect()}
    assert found[10] == (0, 1) and found[11] == (1, 2) and found[12] == (1, 3) and found[13] == (2, 4)
    assert found[15] == (None, None) and found[16] == (None, None) and found[18] == (None, None)
    assert found[17] == (0, 3) and found[19] == (2, 5)
    left = linkage.not_in_library(papers(spark, rows), library)
    assert {r.id for r in left.collect()} == {15, 16, 18}
    shuffled = papers(spark, random.Random(1).sample(rows, len(rows)))
    assert {r.id: (r.library_id, r.rule) for r in linkage.match_library(shuffled, library).collect()} == found


def test_title_ratio_is_ratcliff_obershelp(spark):
    r = random.Random(20)
    pairs = [("".join(r.choice("abcd ") for _ in range(r.randint(1, 60))), "".join(r.choice("abcd ") for _ in range(r.randint(1, 60)))) for _ in range(300)]
    pairs += [(a, a[:-1]) for a, _ in pairs[:100]]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linkage.title_ratio(F.col("a"), F.col("b")).alias("r"))
    for row in df.collect():
        m = SequenceMatcher(None, row.a, row.b)
        assert row.r == (m.ratio() if m.quick_ratio() >= 0.9 else 0.0)


def test_components_and_absorb(spark):
    rows = [(0, "a", "", "t zero"), (1, "a", "10.1/q", ""), (2, "", "10.1/q", "t two"), (3, "", "", ""), (4, "", "", "")]
    own = papers(spark, rows)
    comp = linkage.self_components(own)
    assert {r.id: r.component for r in comp.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    out = {r.component: (r.norm_title, r.doi, r.merged) for r in linkage.absorbed(own, comp, ["norm_title", "doi"]).collect()}
    assert out[0] == ("t zero", "10.1/q", 3)


def test_tfidf_against_plain_python(spark):
    docs = ["quantum spin chains", "spin liquids and spin glasses", "", "the of and", "real words here and there", "quantum spin chains"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    counts = tfidf.term_counts(df, "id", F.col("t"), ["the", "of", "and"])
    got = {(r.doc, r.term): r.w for r in tfidf.fit(counts, len(docs)).transform(counts).collect()}
    grams = []
    for d in docs:
        w = [x for x in d.split() if x not in ("the", "of", "and")]
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    df_of = Counter(t for g in grams for t in g)
    for i, g in enumerate(grams):
        raw = {t: (1 + math.log(n)) * (math.log((len(docs) + 1) / (df_of[t] + 1)) + 1) for t, n in g.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for t, x in raw.items():
            assert math.isclose(got[i, t], x / norm, rel_tol=1e-12)
    assert len(got) == sum(map(len, grams))


def test_relevance_boundaries(spark):
    df = spark.createDataFrame([(1, "spin chain"), (2, "cooking pasta")], "id long, t string")
    get = lambda p: {r.doc: r.relevance for r in tfidf.relevance(p, df, "id", F.col("t"), []).collect()}
    assert get("spin chain") == {1: 1.0, 2: 0.0}
    assert get("") == {1: 0.5, 2: 0.5}
    assert get("unrelated query") == {1: 0.0, 2: 0.0}


def test_budgets_and_chat(spark):
    turns = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", "x" * 10) for i in range(6)] + [("d", 0, "assistant", "y" * 50)], "conv string, turn int, role string, text string")
    kept = {(r.conv, r.turn) for r in ranking.transcript(turns, "conv", "turn", "text", 5, 32).collect()}
    assert kept == {("c", 5), ("c", 4), ("c", 3), ("d", 0)}  # the third ends at 10 + 1 + 10 + 1 + 10, which still fits
    assert {(r.conv, r.turn) for r in ranking.undo_last_turn(turns, "conv", "turn").collect()} == {("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0)}
    assert ranking.budget(100, 4, 200, 5) == 34 and ranking.budget(10, 50, 200, 5) == 5


def test_history_rules(spark):
    cols = "arxiv_id string, at timestamp, score double, report string, analyzed boolean, summary string, title string, ideas string, authors string, published string, journal string, categories string, citations int, profile_fp string"
    row = lambda i, day, score, analyzed, summary: (i, day, score, f"r{day}", analyzed, summary, f"t{day}", "", "", "", "", "", None, "fp")
    import datetime as dt

    d = lambda n: dt.datetime(2024, 1, n)
    empty = state.upsert_history(state.replay(spark.createDataFrame([], cols)).withColumns({c: F.lit("") for c in ("title", "ideas", "authors", "published", "journal", "categories", "profile_fp")} | {"citations": F.lit(None).cast("int")}), spark.createDataFrame([row("a", d(1), 0.9, True, "why"), row("", d(1), 1.0, True, "x")], cols))
    second = state.upsert_history(empty, spark.createDataFrame([row("a", d(2), 0.5, False, "")], cols))
    r = second.first()
    assert second.count() == 1 and (r.times, r.best_score, r.first_at, r.last_at, r.summary, r.analyzed) == (2, 0.9, d(1), d(2), "why", True)
    assert state.migrate(spark.createDataFrame([("a",)], "arxiv_id string"), second).columns == second.columns
    assert state.fingerprint(None) == "" and len(state.fingerprint({"queries": ["q"]})) == 16


def test_scan_plan_opens_undecided_files_only(spark):
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4), ("e", 5, 5), ("f", 6, 6), ("g", 7, 7)], "path string, size long, mtime long")
    rows = [("a", 1, 1, "h1", "ok", "sections", 1), ("old", 2, 1, "h2", "ok", "fulltext", 1), ("c", 3, 3, "h3", "ok", "metadata", 1), ("e", 5, 4, "h5", "ok", "fulltext", 1)]
    rows += [("x", 9, 9, "h6", "ok", "fulltext", 1), ("y", 9, 9, "h6", "ok", "metadata", 2), ("z", 9, 9, "h9", "error", "fulltext", 3)]
    index = spark.createDataFrame(rows, "path string, size long, mtime long, sha1 string, status string, depth string, seen_at long")
    contents, opened = {"b": "h2", "c": "h3", "d": "h9", "e": None, "f": "h6", "g": "h1"}, []

    def hashed(paths):
        opened.extend(r.path for r in paths.collect())
        return spark.createDataFrame([(p, contents[p]) for p in opened], "path string, sha1 string")

    plan = {r.path: (r.action, r.from_path) for r in state.plan_scan(listing, index, "sections", hashed).collect()}
    assert plan == {
        "a": ("reuse", None), "b": ("move", "old"), "c": ("deepen", None), "d": ("parse", None), "e": ("failed", None),
        "f": ("parse", None), "g": ("move", "a"), "old": ("missing", None), "x": ("missing", None), "y": ("missing", None), "z": ("missing", None),
    }  # f: the row of its content that was seen last was read less deeply
    assert sorted(opened) == ["b", "c", "d", "e", "f", "g"]
    assert {r.path: r.status for r in state.mark_missing(index, listing).collect()}["old"] == "missing"
    whole = state.plan_scan(listing, index.limit(0), "sections", lambda paths: paths.withColumn("sha1", F.lit("h")))
    assert {r.action for r in whole.collect()} == {"parse"} and state.scan_stats(whole).first().parse == 7


def test_merge_keeps_first_and_longest(spark):
    rows = [(1, 0, "A1", "second", "longer text", "", "", "", "cs", "q2"), (0, 5, "a1", "first", "short", "c", "", "", "", "q1"), (0, 6, "", "none", "", "", "", "", "", "q1")]
    out = merging.merge_candidates(spark.createDataFrame(rows, "pool int, row int, arxiv_id string, title string, abstract string, comments string, journal_ref string, doi string, category string, query string")).collect()
    assert len(out) == 1 and (out[0].title, out[0].abstract, out[0].comments, out[0].category, out[0].queries) == ("first", "longer text", "c", "cs", ["q1", "q2"])


def test_guarded_skip(spark):
    df = spark.createDataFrame([(i, i < 3) for i in range(5)], "id int, seen_before boolean")
    assert merging.skip_seen_guarded(df, 2).count() == 2 and merging.skip_seen_guarded(df, 3).count() == 5


def test_search_expressions(spark):
    assert search.expression("sign problem") == "all:sign AND all:problem"
    assert search.expression('AND ti:"phase transition" OR', ["cs.LG", "cs.CL"]) == '(ti:"phase transition") AND (cat:cs.LG OR cat:cs.CL)'
    assert search.expression("", ["a"]) == "cat:a" and search.expression("a ANDNOT b or c") == "all:a ANDNOT all:b OR all:c"
    df = spark.createDataFrame([(1, "Quantum spin", "cs"), (2, "Spinning tops", "cs"), (3, "quantum tops", "q")], "id int, title string, category string")
    find = lambda q, cats=(): [r.id for r in df.where(search.predicate(q, {"title": F.col("title"), "category": F.col("category")}, cats)).orderBy("id").collect()]
    assert find("spin") == [1] and find("quantum ANDNOT tops") == [1] and find("ti:quantum", ["q"]) == [3] and find("") == [1, 2, 3]


RSS = """<rss xmlns:dc="d" xmlns:arxiv="a"><channel><item><title>T &amp;amp; U</title><link>https://arxiv.org/abs/2401.00001</link><guid>x</guid><description>arXiv:2401.00001v1 Announce Type: new Abstract: Some &lt;b&gt; text</description><category>hep-th</category><pubDate>Mon, 05 Feb 2024 00:00:00 -0500</pubDate><arxiv:announce_type>new</arxiv:announce_type><dc:creator>A B</dc:creator><dc:creator>C D</dc:creator></item>
<item><title>Old</title><link>https://arxiv.org/abs/2401.00002</link><arxiv:announce_type>replace</arxiv:announce_type></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="a"><entry><id>http://arxiv.org/abs/2401.00003v2</id><title>One
 two</title><summary>S</summary><published>2024-01-02T03:04:05Z</published><author><name>X</name></author><author><name>Y</name></author><arxiv:primary_category term="cs.LG"/><category term="cs.LG"/><category term="stat.ML"/></entry><entry><title>no id</title></entry></feed>"""


def test_feeds(spark):
    r = feeds.parse_rss(spark.createDataFrame([(RSS, "cond-mat")], "xml string, category string")).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].authors, r[0].categories) == ("2401.00001", ["A B", "C D"], ["cond-mat", "hep-th"])
    assert r[0].abstract.startswith("Some") and str(r[0].published) == "2024-02-05 00:00:00"
    a = feeds.parse_atom(spark.createDataFrame([(ATOM, "q"), ("<broken", "q"), (None, "q")], "xml string, query string")).collect()
    assert len(a) == 1 and (a[0].arxiv_id, a[0].version, a[0].title, a[0].authors, a[0].categories) == ("2401.00003", "v2", "One two", ["X", "Y"], ["cs.LG", "stat.ML"])


def test_streams_and_salvage(spark):
    lines = ['data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}', ": ping", "data: not json", 'data: {"choices":[{"delta":{"content":"Hi "}}]}', 'data: {"choices":[{"delta":{"content":"you"}}]}', 'data: {"choices":[],"usage":{"prompt_tokens":7,"completion_tokens":2}}', "data: [DONE]"]
    other = ['data: {"type":"message_start","message":{"usage":{"input_tokens":5}}}', 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"A"}}', 'data: {"type":"error","error":{"message":"busy"}}']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("s", i, x) for i, x in enumerate(other)], "reply string, n int, line string")
    out = {r.reply: r for r in feeds.decode_events(df).collect()}
    assert (out["r"].thinking, out["r"].answer, out["r"].tokens_in, out["r"].tokens_out, out["r"].error) == ("hm", "Hi you", 7, 2, None)
    assert (out["s"].answer, out["s"].tokens_in, out["s"].error) == ("A", 5, "busy")
    bad = ['{"a": 1}', 'Sure:\n```json\n{"a": 1,}\n```', "x {“a”：1} y", '{"scores": [{"id": 1}, {"id": 2}, {"id"', "nothing", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "i int, t string").select("i", feeds.salvage_json(F.col("t")).alias("j"))
    rows = {r.i: (r.a, r.second) for r in got.select("i", F.try_variant_get("j", "$.a", "int").alias("a"), F.try_variant_get("j", "$.scores[1].id", "int").alias("second")).collect()}
    assert rows == {0: (1, None), 1: (1, None), 2: (1, None), 3: (None, 2), 4: (None, None), 5: (None, None)}


def test_reports_round_trip(spark):
    report = "生成时间 2024-01-01 00:00:00\n| # | x |\n|---|---|\n| 1 | [A \\| B](https://x.org/1) | 2024-01-02 | 0.9 | 0.1 | 0.2 | **0.500** | — | 🆕新 ⭐经典 |\n| 2 | broken |\n### 1. A\n**作者**: P, Q · **提交**: 2023-05-06\n"
    out = reporting.parse_reports(spark.createDataFrame([("r", report), ("s", "garbage"), ("t", None)], "report string, text string")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["rank"], r.title, r.url, r.date, r.score, r.citations, r.flags, r.authors) == (1, "A | B", "https://x.org/1", "2023-05-06", 0.5, None, "新 经典", "P, Q")


def test_pipeline_stops_anywhere(spark):
    rows = [(i, 0, i, f"title number {i} about spin", "text of spin chains " * (i % 3), "", "", "cs", None, None, "", "") for i in range(12)]
    cols = "id long, pool int, row long, title string, abstract string, arxiv_id string, doi string, category string, published timestamp, citations int, journal_ref string, comments string"
    pools = recommend.with_keys(spark.createDataFrame(rows, cols), ascii_only=True)
    run = recommend.Recommendation(pools, pools.limit(0), "spin chains", recommend.Options(as_of="2024-01-01 00:00:00", min_relevance=0.0, top_n=5, fuzzy=False, candidate_cap=10))
    assert run.plan("candidates").count() == 10 and run.plan("scored").count() == 10 and run.plan("top").count() == 5
    assert recommend.Options(as_of="x").override(top_n=3, tau_days=None).top_n == 3


def test_first_wins_in_order(spark):
    rows = [(1, "a", "t1"), (2, "b", "t1"), (3, "b", "t3"), (4, "", "t3"), (5, None, ""), (6, "B", "t6"), (7, "c", "t6"), (8, "d", "t8"), (9, "D", "t1")]
    r = random.Random(4)
    rows += [(i, r.choice("efghijkl"), f"u{r.randrange(12)}") for i in range(10, 60)]
    want, ids, titles = [], set(), set()
    for n, a, t in rows:
        key = (a or "").lower()
        if (key and key in ids) or (t and t in titles):
            continue
        want.append(n)
        ids |= {key} - {""}
        titles |= {t} - {""}
    df = spark.createDataFrame(rows, "n int, a string, t string")
    assert sorted(x.n for x in linkage.first_wins(df, ["a", "t"], "n").collect()) == want
    assert linkage.first_wins(df.limit(0), ["a", "t"], "n").count() == 0


@pytest.mark.parametrize("joined", [0, 20_000])
def test_fuzzy_pairs_against_all_pairs(spark, monkeypatch, joined):
    monkeypatch.setattr(linkage, "JOINED", joined)  # 0: every word is hot
    monkeypatch.setattr(linkage, "BLOCK", 7)
    r = random.Random(9)
    vocabulary = ["quantum", "lattice", "spin", "of", "the", "models", "frustrated", "magnets", "dynamics", "in", "two", "dimensions", "part", "ii", "networks", "tensor"]
    titles = [" ".join(r.choice(vocabulary) for _ in range(r.randint(2, 11))) for _ in range(70)]
    titles += [t + r.choice([" ii", " and beyond", "s", ": more"]) for t in titles[:30]] + [t.replace("quantum", "quantom") for t in titles[30:45]] + ["", "ab"]
    rows = [(i, r.choice(["", "", "i1", "i2"]), "", t) for i, t in enumerate(titles)]
    left, right = rows[:70], rows[70:]
    series = __import__("re").compile(linkage.SERIES.replace("(?i)", ""), 2)
    want = {}
    for a, ia, _, t in left:
        for b, ib, _, u in right:
            if not {w for w in t.split() if len(w) >= 5} & {w for w in u.split() if len(w) >= 5} or (ia and ib and ia != ib):
                continue
            short, long = (t, u) if len(t) <= len(u) else (u, t)
            tail = long[long.find(short) + len(short) :]
            if short in long and len(short) >= 40 and not series.match(tail):
                want[a, b] = 4
            elif abs(len(t) - len(u)) <= max(20, 0.35 * len(t)):
                ratio = SequenceMatcher(None, t, u).ratio()
                if ratio >= (0.95 if len(t) < 40 else 0.9):
                    want[a, b] = 5
    got = {(x.a, x.b): x.rule for x in linkage.fuzzy_pairs(papers(spark, left), papers(spark, right)).collect()}
    assert got == want and set(want.values()) == {4, 5} and len(want) > 8


def test_ratio_behind_its_bounds(spark):
    """A ratio below what is asked may be 0, all others stay."""
    r = random.Random(21)
    say = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    firsts = [say(r.choice([1, 40, 63, 64, 65, 127, 128, 129, 190])) for _ in range(200)]
    pairs = [(t, t[: len(t) // 3] + r.choice(["", "x", "abc"]) + t[len(t) // 3 + r.randint(0, 6) :]) for t in firsts] + [(t, say(len(t))) for t in firsts] + [("", ""), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linkage.title_ratio(F.col("a"), F.col("b"), 0.9).alias("r"))
    kept = 0
    for row in df.collect():
        ratio = SequenceMatcher(None, row.a, row.b).ratio()
        assert row.r == ratio if ratio >= 0.9 else row.r in (0.0, ratio)
        kept += ratio >= 0.9
    assert kept > 100


def test_copies_are_classes(spark):
    """Copies of two similar titles: a row for each copy and each link of classes, not their product."""
    t = "frustrated magnets on a lattice in two dimensions and their dynamics"
    left = [(i, "", "", t) for i in range(50)]
    right = [(100 + i, "", f"10.1/{i % 2}", t + "s") for i in range(60)]
    out = [tuple(r) for r in linkage.class_pairs(papers(spark, left), papers(spark, right)).collect()]
    assert sorted(r[:3] for r in out if r[2]) == [(0, 100, 4), (0, 101, 4)]
    assert sorted(r[:2] for r in out if not r[2]) == [(i, 0) for i in range(1, 50)] + [(i, 100 + i % 2) for i in range(102, 160)]
    assert linkage.fuzzy_pairs(papers(spark, left), papers(spark, right)).count() == 3000


def _alike(seed):
    """Rows of few titles, many of them alike or contained, with and without identifiers."""
    r = random.Random(seed)
    bases = ["frustrated magnets on a lattice in two dimensions", "tensor networks for strongly correlated electrons", "quantum dynamics of cold atoms in a trap"]
    say = lambda: r.choice(bases) + r.choice(["", "", "s", " ii", " and beyond it", " part two"])
    return [(i, r.choice(["", f"A{r.randint(0, 60)}", f"a{i + 100}"]), r.choice(["", "", f"10.1/{r.randint(0, 60)}", f"10.2/{i}"]), say()) for i in range(80)]


def _fuzzy_rule(a, b):
    if any(a[k] and b[k] and a[k].lower() != b[k].lower() for k in (1, 2)):
        return None
    short, long = sorted((a[3], b[3]), key=len)
    if len(short) >= 40 and short in long and not __import__("re").match(linkage.SERIES, long[long.index(short) + len(short) :]):
        return 4, 0.0
    ratio = SequenceMatcher(None, a[3], b[3]).ratio()
    return (5, -ratio) if ratio >= (0.95 if len(a[3]) < 40 else 0.9) and abs(len(a[3]) - len(b[3])) <= max(20, 0.35 * len(a[3])) else None


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_copies(spark, monkeypatch, seed):
    """Rows that are alike by any rule, where titles have many rows: an edge for each row's key and each two titles."""
    rows, edges = _alike(seed), []
    root = {x[0]: x[0] for x in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for a in rows:
        for b in rows[: a[0]]:
            fuzzy = _fuzzy_rule(a, b) is not None
            pairs += fuzzy
            if fuzzy or any(a[k] and a[k].lower() == b[k].lower() for k in (1, 2, 3)):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    reach = linkage.smallest_reachable
    monkeypatch.setattr(linkage, "smallest_reachable", lambda nodes, links: edges.append(links.count()) or reach(nodes, links))
    assert {x.id: x.component for x in linkage.self_components(papers(spark, rows)).collect()} == {i: find(i) for i in root}
    assert edges[0] < pairs


@pytest.mark.parametrize("seed", [3, 4])
def test_matches_of_copies(spark, monkeypatch, seed):
    """The best row for each candidate, where titles have many rows: titles are paired once."""
    rows, counts = _alike(seed), []
    own, asked = rows[::2], [x for x in rows[1::2]]
    own = [x for x in own if "beyond" not in x[3] and not x[3].endswith("s")]
    want = {}
    for c in asked:
        keys = [[b[0] for b in own if c[k] and b[k].lower() == c[k].lower()] for k in (1, 2, 3)]
        hit = next(((min(k), n) for n, k in enumerate(keys, 1) if k), None)
        near = [(*rule, b[0]) for b in own if hit is None and (rule := _fuzzy_rule(c, b))]
        want[c[0]] = hit or ((min(near)[2], min(near)[0]) if near else (None, None))
    pairs = linkage.title_pairs
    monkeypatch.setattr(linkage, "title_pairs", lambda *a, **k: counts.append((out := pairs(*a, **k)).count()) or out)
    assert {x.id: (x.library_id, x.rule) for x in linkage.match_library(papers(spark, asked), papers(spark, own)).collect()} == want
    assert {rule for _, rule in want.values()} >= {3, 4, None} and counts[0] <= len({x[3] for x in own}) * len({x[3] for x in asked})


def test_copies_left_by_the_library(spark, monkeypatch):
    """Copies of a title like one of the library: those in conflict with all its rows are left, and one pair of titles is made."""
    t, counts = "frustrated magnets on a lattice in two dimensions and their dynamics", []
    own = papers(spark, [(i, f"A{i}", "", t + "s") for i in range(30)])
    asked = papers(spark, [(100 + i, f"B{i}" if i % 2 else "", "", t) for i in range(30)])
    pairs = linkage.title_pairs
    monkeypatch.setattr(linkage, "title_pairs", lambda *a, **k: counts.append((out := pairs(*a, **k)).count()) or out)
    assert sorted(x.id for x in linkage.not_in_library(asked, own).collect()) == [100 + i for i in range(1, 30, 2)]
    assert counts == [1]


def test_a_word_of_all_titles_makes_few_pairs(spark, monkeypatch):
    """Titles that all share one word: the similar ones are found, and few others leave the blocks."""
    r = random.Random(3)
    say = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))
    counts = []
    monkeypatch.setattr(linkage, "JOINED", 0)
    for n in (600, 1200, 2400):
        titles = [f"lattice {' '.join(say().split())} é{chr(0x1F600 + i % 3)}" for i in range(n)]
        titles += [t[:30] + "x" + t[31:] for t in titles[: n // 10]]
        rows = papers(spark, [(i, "", "", t) for i, t in enumerate(titles)]).withColumn("words", F.array(F.lit("lattice")))
        few, hot = linkage.word_pairs(rows, rows)
        assert few.count() == 0
        pairs = hot.select("a", "b").distinct().collect()
        counts.append(len(pairs))
        assert {(i, n + i) for i in range(n // 10)} <= {(p.a, p.b) for p in pairs}
        # Of n * n pairs the copies and each title with itself are left, and a handful more.
        assert len(pairs) <= 1.5 * len(titles) + 50
    assert counts[2] < 2.3 * counts[1] < 5.3 * counts[0]


def test_explanations_reach_unknown_papers(spark):
    old = spark.createDataFrame([("a", 1, 0.5, False, "", "", "", "T", "r1", None, None)], "arxiv_id string, times int, best_score double, analyzed boolean, summary string, ideas string, profile_fp string, title string, report string, first_at timestamp, last_at timestamp")
    new = spark.createDataFrame([("a", "x", "r2", "why", "i", "fp"), ("b", "New", "r2", "because", "", "fp"), (" ", "", "", "z", "", "")], "arxiv_id string, title string, report string, summary string, ideas string, profile_fp string")
    out = {x.arxiv_id: x for x in state.save_explanations(old, new, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"].title, out["a"].times, out["a"].report, out["a"].summary, out["a"].analyzed) == ("T", 1, "r1", "why", True)
    assert (out["b"].title, out["b"].times, out["b"].best_score, out["b"].report, out["b"].analyzed, str(out["b"].first_at)) == ("New", 1, 0.0, "r2", True, "2024-01-01 00:00:00")


def test_a_long_chain_and_a_hub_are_components(spark):
    from lumenlit.operators.graph import smallest_reachable

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 400), 999]], "id long")
    got = {x.id: x.component for x in smallest_reachable(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 400)} | {999: 999}


def test_history_and_reports_fill_each_other(spark):
    history = spark.createDataFrame([("a", "", "", "", "", "", None, "s", "i", True, 3, "2024"), ("b", "X", "2020-01-01", "J", "c", "T", 5, "", "", False, 1, "2023")], "arxiv_id string, authors string, published string, journal string, categories string, title string, citations int, summary string, ideas string, analyzed boolean, times int, last_at string")
    items = spark.createDataFrame([("a", 2, "late", "2021-01-01", "K", "d", "U", "9"), ("a", 1, "first", "", "", "", "V", "—"), ("c", 3, "p", "q", "", "", "W", "1"), ("", 4, "", "", "", "", "", "")], "arxiv_id string, place int, authors string, published string, journal string, categories string, title string, citations string")
    out = {x.arxiv_id: x for x in merging.history_with_reports(history, items).collect()}
    assert (out["a"].authors, out["a"].published, out["a"].title, out["a"].citations) == ("first", "", "V", None) and (out["b"].authors, out["b"].citations) == ("X", 5)
    back = {(x.arxiv_id, x.place): x for x in merging.items_with_history(items, history).collect()}
    assert len(back) == 3 and (back["a", 1].summary, back["a", 1].seen_times, back["c", 3].seen_before, back["c", 3].analyzed) == ("s", 3, False, False)


def test_conversations_and_index_lookups(spark):
    chat = spark.createDataFrame([(1, "a", "user", "q"), (4, "b", "user", "r")], "id int, arxiv_id string, role string, content string")
    more = spark.createDataFrame([(1, "a", "assistant", "x"), (2, "", "user", "y"), (3, "c", "user", "  ")], "id int, arxiv_id string, role string, content string")
    assert {tuple(x) for x in state.append_turns(chat, more).collect()} == {(1, "a", "user", "q"), (4, "b", "user", "r"), (5, "a", "assistant", "x")}
    assert {x.arxiv_id for x in state.clear_conversations(chat, chat.where("arxiv_id = 'a'")).collect()} == {"b"}
    index = spark.createDataFrame([("p", "h", "ok", 1, 7), ("q", "h", "ok", 3, 7), ("r", "h", "error", 9, 7), ("s", "", "ok", 1, 7)], "path string, sha1 string, status string, seen_at int, version int")
    assert [x.path for x in state.newest_readable(index, index.select("sha1")).collect()] == ["q"]
    assert {x.path for x in state.indexed_at(index, index.where("seen_at = 1")).collect()} == {"p", "s"}
    assert state.current_index(index, 7).count() == 4 and state.current_index(index, 8).count() == 0
    mixed = index.unionByName(index.withColumn("version", F.lit(6)))
    assert state.current_index(mixed, 7).count() == 0


def test_a_whole_report_is_read_back(spark, tmp_path):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = [(i, i, f"2401.{i:05d}", f"A title | of $x$ number {i}", "abs " * 30, "2024-01-02", ["Ada L", "Alan T"], ["cs.LG", "stat.ML"], "PRL 1" if i == 1 else "", None if i == 2 else 7 * i, 0.5, 0.25, 0.125, 0.4, "judged" if i == 1 else "", "why so" if i == 1 else "", f"https://arxiv.org/abs/2401.{i:05d}") for i in range(1, 4)]
    names = "id int, rank int, arxiv_id string, title string, abstract string, published string, authors array<string>, categories array<string>, journal_ref string, citations int, relevance double, recency double, importance double, score double, relevance_reason string, summary string, url string"
    ranked = spark.createDataFrame(rows, names).withColumn("published", F.col("published").cast("timestamp_ntz"))
    others = ranked.unionByName(ranked.withColumn("id", F.col("id") + 100).withColumn("title", F.lit("Another one")))
    removed = spark.createDataFrame([(f"t{i:03d}", "title") for i in range(70)], "title string, reason string")
    stats, profile = {"library_total": 9, "elapsed_sec": 1.25, "ai_calls": 2, "ai_tokens": 30}, {"summary": "S", "topics": ["a", "b"], "queries": ["q"], "generated_by": "ai"}
    lines = reporting.report_lines(ranked, as_of, "2024-02-01 10:11:12", stats, profile, others, removed)
    written = reporting.write_report(["markdown", "json"], str(tmp_path), "2024-02-01 10:11:12", "x", lines, ranked, stats, profile)
    assert [w.rsplit("/", 1)[1] for w in written] == ["arxiv_recommend_20240201_101112_x.md", "arxiv_recommend_20240201_101112_x.json"]
    text = "\n".join(r.value for r in spark.read.text(written[0]).collect())
    assert "| 文献库总量 | 9 篇 |" in text and "| 耗时 | 1.2 秒 |" in text and "**主要研究主题**: a、b" in text and "另有 10 篇" in text and text.count("- [Another one]") == 3
    assert text.index("## 三、推荐总览") < text.index("### 1. ") < text.index("### 3. ") < text.index("## 附录") < text.index("已排除的库内文献 (70 篇)")
    report = spark.createDataFrame([(written[0], text)], "report string, text string")
    back = {r["rank"]: r for r in reporting.parse_reports(report).collect()}
    assert set(back) == {1, 2, 3} and back[1].title == "A title | of x number 1" and back[1].authors == "Ada L, Alan T" and back[1].categories == ["cs.LG", "stat.ML"] and back[2].citations is None and back[1].date == "2024-01-02"
    runs = files.list_runs(report.unionByName(spark.createDataFrame([("/o/arxiv_recommend_20250101_000000.md", "no stamp"), ("/o/notes.md", "x")], "report string, text string")), reporting.parse_reports(report)).collect()
    assert [r.generated_at for r in runs] == ["2024-02-01 10:11:12", ""] and runs[0].label == "2024-02-01 10:11:12 · 3 篇 · x" and runs[1].label == "2025-01-01 00:00:00 · 0 篇"
    told = json.loads(spark.read.text(written[1]).first().value)
    assert told["stats"]["library_total"] == 9 and [r["rank"] for r in told["recommendations"]] == [1, 2, 3]


def test_profiles(spark):
    results = spark.createDataFrame([(2, ["Spin", "new"], ["QMC"], ["k"], []), (1, ["spin ", "Chains"], [], None, ["cm"])], "n int, topics array<string>, methods array<string>, keywords array<string>, subfields array<string>")
    one = profile.merged_groups(results).first()
    assert (one.topics, one.methods, one.keywords, one.subfields) == (["spin", "Chains", "new"], ["QMC"], ["k"], ["cm"])
    digest = profile.scoring_digest(spark.createDataFrame([("S", [f"t{i}" for i in range(20)], [], ["k"])], "summary string, topics array<string>, methods array<string>, keywords array<string>")).first().digest
    assert digest.split("\n") == ["研究方向概述: S", "主要主题: " + "、".join(f"t{i}" for i in range(15)), "关键词: k"]
    heuristic = {"queries": ["h"], "keywords": ["h"]}
    assert profile.decided(None, heuristic, [], 5)["generated_by"] == "heuristic" and profile.decided({"queries": ["a", "A", "b"]}, heuristic, [], 5)["queries"] == ["a", "b"]
    terms = profile.decided({"keywords": ["spin", "自旋"]}, heuristic, [], 5)
    assert terms["queries"] == ["spin"] and terms["generated_by"] == "ai+terms" and profile.decided({"keywords": ["自旋"]}, heuristic, [], 5)["generated_by"] == "heuristic"
    by_hand = profile.decided({"queries": ["a"]}, heuristic, ["x", " ", "y"], 1)
    assert by_hand["queries"] == ["x", "y"] and by_hand["generated_by"] == "ai+manual"


def test_searches_labels_and_feeds(spark):
    records = spark.createDataFrame([("Spin", "f1.pdf", "PRL", "", "", ["Ada"], ["mine"], ["arXiv"]), ("Other", "g.pdf", "", "", "", [], [], [])], "title string, file string, publication string, arxiv_id string, doi string, authors array<string>, tags array<string>, auto_tags array<string>")
    assert [r.title for r in search.library_search(records, " ARXIV").collect()] == ["Spin"] and search.library_search(records, " ").count() == 2
    items = spark.createDataFrame([(1, "T", "Ada", None, "新"), (12, "U", None, "J", None)], "rank int, title string, authors string, journal string, flags string")
    assert [r["rank"] for r in search.run_search(items, "12").collect()] == [12]
    relations = spark.createDataFrame([(1, "phases"), (1, "unknown"), (2, "spin"), (3, "")], "id int, label string")
    got = {(r.id, r.label): r.known for r in reporting.repaired_labels(relations, spark.createDataFrame([("phase",), ("spin",), ("spin glass",), ("",)], "label string")).collect()}
    assert got == {(1, "phases"): "phase", (2, "spin"): "spin"}
    feed = spark.createDataFrame([("a", RSS), ("b", None), ("c", "<broken"), ("", RSS)], "category string, xml string")
    assert {r.arxiv_id for r in feeds.scan_feeds(feed, types=None).collect()} == {"2401.00001", "2401.00002"}
    assert [r.arxiv_id for r in feeds.scan_feeds(feed, 1, None).collect()] == ["2401.00001"]


def test_judged_relevance_and_prefilters(spark):
    rows = [(i, 0, i, f"title number {i} about spin", "text of spin chains " * (1 + i % 3), f"24{i:02d}.00001", "", "cs", None, None, "", "") for i in range(12)]
    cols = "id long, pool int, row long, title string, abstract string, arxiv_id string, doi string, category string, published timestamp, citations int, journal_ref string, comments string"
    pools = recommend.with_keys(spark.createDataFrame(rows, cols), ascii_only=True)
    judged = spark.createDataFrame([(3, 0.99, "good"), (4, 0.0, None)], "id long, score double, reason string")
    works = spark.createDataFrame([(f"10.48550/arXiv.24{i:02d}.00001", 10 + i, "PRL", [("c", 0.5)]) for i in range(12)], "doi string, cited_by int, source string, concepts array<struct<display_name: string, score: double>>")
    options = recommend.Options(as_of="2024-01-01 00:00:00", min_relevance=0.0, fuzzy=False, enriched_cap=5, judged_cap=4)
    run = recommend.Recommendation(pools, pools.limit(0), "spin chains", options, works=works, judged=judged)
    out = {r.id: r for r in run.plan("scored").collect()}
    assert out[3].relevance == 0.99 and out[3].relevance_reason == "good" and out[4].relevance == 0.0 and out[5].relevance_reason == scoring.HEURISTIC_REASON
    assert sum(r.enriched for r in out.values()) == 5 and run.for_judge().count() == 4


def test_no_cap_looks_all_up(spark):
    rows = [(i, 0, i, f"title number {i}", "spin chains", "", f"10.1/{i}", "cs", None, None, "", "") for i in range(12)]
    cols = "id long, pool int, row long, title string, abstract string, arxiv_id string, doi string, category string, published timestamp, citations int, journal_ref string, comments string"
    pools = recommend.with_keys(spark.createDataFrame(rows, cols), ascii_only=True)
    works = spark.createDataFrame([(f"10.1/{i}", 10 + i, "PRL", [("c", 0.5)]) for i in range(12)], "doi string, cited_by int, source string, concepts array<struct<display_name: string, score: double>>")
    options = recommend.Options(as_of="2024-01-01 00:00:00", min_relevance=0.0, fuzzy=False, candidate_cap=0, enriched_cap=0)
    out = recommend.Recommendation(pools, pools.limit(0), "spin chains", options, works=works).plan("scored").collect()
    assert {r.id: r.citations for r in out} == {i: 10 + i for i in range(12)}


def test_bounds_lose_no_neighbour_and_spare_most_postings(spark):
    """Skewed terms, groups of like rows, ties and equal rows: the rows of the plain join, from far fewer postings."""
    r = random.Random(12)
    word = lambda: f"t{int(r.paretovariate(0.5))}"
    texts = []
    for _ in range(100):
        own = [word() for _ in range(30)]
        texts += [" ".join(w if r.random() < 0.8 else word() for w in own) for _ in range(6)]
    texts += texts[:40]  # equal rows
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    counts = df.select("doc", F.explode(F.split("text", " ")).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    weights = tfidf.fit(counts, len(texts)).transform(counts).checkpoint()
    some = weights.where("doc % 10 = 0").unionByName(spark.createDataFrame([(5000, "nowhere", 1.0)], "doc long, term string, w double"))
    want = Counter(map(tuple, tfidf.related(some, weights, 5).select("doc", "neighbor", "rank", "similarity").collect()))
    for block in (50, 10_000):
        assert Counter(map(tuple, nearest.nearest(some, weights, 5, block).select("doc", "neighbor", "rank", "similarity").collect())) == want
    told = nearest.searched(some, weights, 5, 100).agg(F.sum("read").alias("read"), F.sum("postings").alias("postings")).first()
    plain = some.join(weights.select("term"), "term").count()
    assert told.postings == plain and told.read < plain / 2
    assert nearest.nearest(some.limit(0), weights).count() == 0 and nearest.nearest(some, weights.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, 200_000])
def test_labels_are_repaired_by_the_longest(spark, monkeypatch, block):
    monkeypatch.setattr(reporting, "LABELS", block)
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé😀") for _ in range(n))
    known = {word(r.randint(1, 12)) for _ in range(60)} | {""}
    asked = [(i, r.choice((word(r.randint(0, 14)), r.choice(sorted(known)), word(2) + r.choice(sorted(known)), r.choice(sorted(known))[1:7]))) for i in range(400)]
    want = {}
    for i, label in asked:
        found = [k for k in known if k and label and (k in label or label in k)]
        if found:
            want[i, label] = max(found, key=lambda k: (k == label, len(k), k.encode()))
    df = reporting.repaired_labels(spark.createDataFrame([*asked, (900, None)], "id int, label string"), spark.createDataFrame([(k,) for k in sorted(known)] * 2, "label string"))
    assert {(x.id, x.label): x.known for x in df.collect()} == want and len(want) > 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_queries_from_terms_in_python_and_in_columns(spark):
    chinese = {"topics": ["符号问题", "量子临界"], "methods": ["张量网络"], "keywords": ["sign problem", "disorder operator"]}
    long = " ".join(f"word{i}" for i in range(20))
    cases = [chinese, {"topics": ["符号问题"], "methods": [], "keywords": []}, {}, chinese | {"queries": ["DQMC", "Sign Problem"]}, {"keywords": [long, f" {long} "], "methods": ["m", "M "], "topics": ["t"]}]
    want = [["sign problem", "disorder operator"], [], [], ["DQMC", "Sign Problem", "disorder operator"], [" ".join(long.split()[:6]), "m", "t"]]
    lists = [[c.get(k) for k in profile.TERM_LISTS] for c in cases]
    assert [profile.queries_from_terms([x or [] for x in c], 18) for c in lists] == want
    assert len(profile.queries_from_terms([chinese["keywords"]], 0)) == 1  # never none where there is one
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(lists)], "i int, " + ", ".join(f"{k} array<string>" for k in profile.TERM_LISTS))
    assert [r.q for r in df.orderBy("i").select(profile.term_queries(df, 18).alias("q")).collect()] == want
    assert profile.decided({"queries": ["a", "b", "A"], "keywords": []}, {}, [], 5)["queries"] == ["a", "b"]
    by_terms = profile.decided({"topics": ["spin"], "keywords": ["chain"], "methods": ["dmrg"]}, {}, [], 2)
    assert by_terms["queries"] == ["chain", "dmrg"] and by_terms["generated_by"] == "ai+terms"


def test_all_feeds_of_a_category_count_and_the_cap_acts(spark):
    xml = lambda *ids: "<rss><channel>" + "".join(f"<item><title>T{i}</title><link>arxiv.org/abs/2401.{i:05d}</link></item>" for i in ids) + "</channel></rss>"
    feed = spark.createDataFrame([("a", xml(1, 2, 3)), (" a ", xml(4, 2)), ("b", xml(1)), ("a", None)], "category string, xml string")
    found = lambda n: sorted((r.feed, int(r.arxiv_id[-2:])) for r in feeds.scan_feeds(feed, n, None).collect())
    assert found(0) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]
    assert found(2) == [("a", 1), ("a", 4), ("b", 1)]  # the first places, by identifier
    assert found(3) == [("a", 1), ("a", 2), ("a", 4), ("b", 1)]


def test_a_fit_that_leaves_nothing_is_an_error(spark):
    df = spark.createDataFrame([(1, "spin chain"), (2, "other words")], "id long, text string")
    counts = tfidf.term_counts(df, "id", F.col("text"), [], False)
    assert tfidf.fit(counts, 2).required().vocabulary.count() == 4
    with pytest.raises(tfidf.NothingLeft):
        tfidf.fit(counts, 2, min_df=2).required()
    with pytest.raises(tfidf.NothingLeft):
        tfidf.fit(counts, 2, min_df=2, max_df=0.5)
    assert profile.keywords(df, "id", F.col("text")).count() == 0  # its callers go on without
    assert profile.keywords(df.limit(0), "id", F.col("text")).count() == 0


def test_fingerprints_of_rows_are_those_of_mappings(spark):
    profiles = [{"queries": ["a", 'b "c"'], "topics": [], "methods": ["é\\n"], "keywords": None, "summary": "s\nt"}, {"queries": None, "topics": ["x"], "methods": None, "keywords": ["k"], "summary": None}, {"queries": [], "topics": [], "methods": [], "keywords": [], "summary": ""}]
    lists = ("queries", "topics", "methods", "keywords")
    df = spark.createDataFrame([(i, *(p[k] for k in lists), p["summary"]) for i, p in enumerate(profiles)], "i int, " + ", ".join(f"{k} array<string>" for k in lists) + ", summary string")
    got = [r.f for r in df.orderBy("i").select(state.fingerprint_of(*(F.col(k) for k in (*lists, "summary"))).alias("f")).collect()]
    assert got == [state.fingerprint(p) for p in profiles]


def test_neighbours_by_shared_words_need_no_pairs(spark):
    """Equal to counting every pair, ties by smaller id, over several blocks; no join makes a row for two documents."""
    r = random.Random(4)
    docs = [(i, r.sample(["hot", "warm", *(f"w{j}" for j in range(12))], r.randrange(0, 6)) + ["all"] * (i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc long, words array<string>")
    want = {}
    for i, a in docs:
        if i % 10 == 0:
            near = sorted((-len(set(a) & set(b)), j) for j, b in docs if j != i and set(a) & set(b))[:8]
            want |= {(i, j): (-n, k + 1) for k, (n, j) in enumerate(near)}
    for block in (tfidf.SHORT_BLOCK, 70):
        before, tfidf.SHORT_BLOCK = tfidf.SHORT_BLOCK, block
        found = tfidf.overlap_related(df.where("doc % 10 = 0"), df)
        tfidf.SHORT_BLOCK = before
        assert {(x.doc, x.neighbor): (x.shared, x["rank"]) for x in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_terms_are_shuffled_once(spark):
    """What is summed over a term and what is joined to it read one exchange."""
    docs = spark.createDataFrame([(i, f"word{i % 3} other words of {i % 5}x") for i in range(40)], "id long, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    counts = tfidf.by_term(tfidf.term_counts(docs, "id", F.col("t"), ["of"]))
    plan = tfidf.fit(counts, 40).transform(counts)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and plan.count("regexp_extract_all") <= 2, plan


def _rows_shuffled(spark, group):
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)


@pytest.mark.parametrize("pairs", [True, False])
def test_relevance_shuffles_no_row_for_each_term(spark, monkeypatch, pairs):
    """Many slices and shares, against plain Python; before, each document and term was a row of a shuffle (6,000 words here)."""
    monkeypatch.setattr(packed_terms, "SLICE", 700)
    monkeypatch.setattr(packed_terms, "SHARE_DOCS", 5)
    rng = random.Random(5)
    docs = [" ".join("the" if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.4)) % 5000}é" for _ in range(n)) for n in [300] * 18 + [1, 2, 900, 0]] + ["the of", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    profile, stop = "the w1é w1é w2é unheard w1é w2é", ["the", "of"]

    def terms(text):
        w = [x for x in (text or "").split() if x not in stop and len(x) > 1]
        return Counter(w + ([f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] if pairs else []))

    counts, n = [terms(d) for d in docs], len(docs) + 1
    df_of = Counter(t for c in [*counts, terms(profile)] for t in c)
    weights = lambda c: {t: (1 + math.log(k)) * (math.log((n + 1) / (df_of[t] + 1)) + 1) for t, k in c.items()}
    asked = weights(terms(profile))
    cosine = [sum(x * asked.get(t, 0.0) for t, x in w.items()) / math.sqrt(sum(x * x for x in w.values()) or 1.0) for w in map(weights, counts)]
    spark.sparkContext.setJobGroup(f"relevance {pairs}", "")
    try:
        got = {r.id: r.relevance for r in tfidf.relevance(profile, df, "id", F.col("t"), stop, pairs).select(F.col("doc").alias("id"), "relevance").collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: pytest.approx(round(min(1.0, (c / max(cosine)) ** 0.7), 4), abs=1.01e-4) for i, c in enumerate(cosine)}
    assert _rows_shuffled(spark, f"relevance {pairs}") < 1500


@pytest.mark.parametrize("pairs", [True, False])
def test_packed_weights_are_those_of_the_fit(spark, monkeypatch, pairs):
    """Many slices and shares, documents of several rows, without text or id, and longer than a slice: the rows of the long tables."""
    monkeypatch.setattr(packed_weights, "SLICE", 700)
    monkeypatch.setattr(packed_terms, "SHARE_DOCS", 5)
    rng = random.Random(6)
    docs = [(i % 40, " ".join("the" if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.4)) % 500}é" for _ in range(rng.choice((0, 1, 200, 900))))) for i in range(50)]
    for rows in ([*docs, (90, None), (None, "w1é w2é"), (None, "w2é w3é")], docs[:40]):
        df = spark.createDataFrame(rows, "id int, t string")
        counts = tfidf.term_counts(df, "id", F.col("t"), ["the"], pairs)
        words = df.select(F.col("id").alias("doc"), F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"\w\p{L}?[\p{L}\d]*"), 0).alias("words"))
        for least in (1, 3):
            want = {(r.doc, r.term): r.w for r in tfidf.fit(counts, len(rows), min_df=least).transform(counts).collect()}
            got = packed_weights.weights(words, len(rows), ["the"], pairs, least).collect()
            assert len(got) == len(want) and {(r.doc, r.term): r.w for r in got} == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_weights_shuffle_no_row_for_each_term(spark):
    """Before, each of the documents' terms was a row of a shuffle, twice."""
    spark.sparkContext.setJobGroup("weights", "")
    try:
        given = queries.QUERIES["tfidf_weights"](spark, "/root/testdata/sf0.001").agg(F.count("w").alias("n")).first().n
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert given > 20_000 and _rows_shuffled(spark, "weights") < 1500


@pytest.mark.parametrize(("block", "common"), [(40, 0.1), (40_000, 2.0), (40_000, 0.02)])
def test_packed_neighbours_are_those_of_the_plain_join(spark, monkeypatch, block, common):
    """Groups of like rows, equal rows, documents of several rows, without an id, without terms, and longer than a slice."""
    monkeypatch.setattr(packed_weights, "SLICE", 900)
    monkeypatch.setattr(packed_terms, "SHARE_DOCS", 20)
    monkeypatch.setattr(packed_weights, "ASKED_SLICE", 200)
    monkeypatch.setattr(packed_nearest, "BLOCK", block)
    monkeypatch.setattr(packed_nearest, "COMMON", common)
    r = random.Random(13)
    word = lambda: f"t{int(r.paretovariate(0.5)) % 9999}"
    texts = []
    for _ in range(40):
        own = [word() for _ in range(30)]
        texts += [" ".join(w if r.random() < 0.8 else word() for w in own) for _ in range(5)]
    rows = [*enumerate([*texts, *texts[:30], "", " ".join(word() for _ in range(1000))]), (7, texts[9]), (10, texts[3]), (None, texts[0]), (500, "alone"), (None, texts[5])]
    df = spark.createDataFrame(rows, "id int, t string")
    counts = tfidf.term_counts(df, "id", F.col("t"), ["t1"])
    weights = tfidf.fit(counts, len(rows)).transform(counts)
    want = Counter(map(tuple, tfidf.related(weights.where("doc % 10 = 0"), weights, 5).select("doc", "neighbor", "rank", "similarity").collect()))
    words = df.select(F.col("id").alias("doc"), F.regexp_extract_all("t", F.lit(r"\w+"), 0).alias("words"), (F.col("id") % 10 == 0).alias("asked"))
    found = packed_nearest.nearest(words, len(rows), ["t1"], k=5).select("doc", "neighbor", "rank", "similarity")
    assert Counter(map(tuple, found.collect())) == want and len(want) > 100
    assert packed_nearest.nearest(words.withColumn("asked", F.lit(False)), len(rows), []).count() == 0 and packed_nearest.nearest(words.limit(0), 0, []).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_related_rows_shuffle_no_row_for_each_term(spark):
    """Before, each of the documents' terms was a row of a shuffle, and each pair that shares a heavy term one too."""
    spark.sparkContext.setJobGroup("related", "")
    try:
        assert queries.QUERIES["related_knn"](spark, "/root/testdata/sf0.001").count() > 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _rows_shuffled(spark, "related") < 2500
