"""SimHash components, repeated passages and benchmark hits against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from parcelmart.llm import decontaminate, passages, queries, simhash
from parcelmart.llm.components import components
from parcelmart.llm.decontaminate import Phrases, benchmark_hits, without_benchmark
from parcelmart.llm.fm_index import FMIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), seed=42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_position_sets_cover_any_four_positions():
    sets = [set(s) for s in simhash.position_sets()]
    assert len(sets) == 20
    assert all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize("text", ["", " ", "one", "A b C", "a b c d", "É é a b\n\nc d e a b c d e", "x " * 500])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [7, 8192])
def test_pairs_join_what_all_pairs_join(spark, block):
    rng = random.Random(block)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):  # a walk of small steps: long chains, many in one list
            fps.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    want = plain_components([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4], fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), block)
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert plain_components(pairs, fps) == want
    found = {r["node"]: r["root"] for r in components(links).collect()}
    groups: dict = {}
    for (f,) in signed:
        groups.setdefault(found.get(f, f), set()).add(f % (1 << 64))
    theirs: dict = {}
    for f, r in want.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_path_and_none(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0


def test_near_duplicates_on_the_small_tables(spark, folder):
    docs = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = plain_components([(a, b) for a, b in combinations(sorted(docs), 2) if (docs[a] ^ docs[b]).bit_count() <= 4], docs)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_near_dedup(spark, folder).collect()}
    assert found == {d: (f"{f:016x}", want[d]) for d, f in docs.items()}


def test_near_duplicate_edges(spark):
    same = " ".join(f"w{i}" for i in range(80))
    rows = [(5, same, 1), (3, same, 2), (None, same, 3), (3, same, 4), (9, None, 5), (8, "", 6), (3, "other text here", 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    found = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted([("5", 3), ("3", 3), ("None", 3), ("3", 3), ("9", 8), ("8", 8), ("3", 3), ("None", 8)])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == ["3", "3", "8", "None", "None"]  # doc 3 has two texts that are not linked
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_texts_under_one_doc_id_stay_unless_linked(spark):
    rng = random.Random(4)
    one, two, three = (" ".join(prose(rng, 80)) for _ in range(3))
    rows = [(1, one, "a"), (1, two, "b"), (2, three, "c"), (2, two, "d"), (1, one, "e"), (3, three, "f")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, text_group string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, two), (2, three)])


def test_a_hub_that_thousands_quote(spark):
    rng = random.Random(6)
    hub = prose(rng, 60_000)
    rows, want = [(0, " ".join(hub))], {}
    for d in range(1, 1501):
        at, before = rng.randrange(len(hub) - 60), rng.randrange(20)
        rows.append((d, " ".join(prose(rng, before) + hub[at:at + 60] + prose(rng, 10))))
        want[d] = (before, before + 60, at, at + 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in passages.repeated_passages(docs).collect():
        if r["other_id"] == 0:
            found[r["doc_id"]] = tuple(r[c] for c in ("first_word", "end_word", "other_first", "other_end"))
    exact = [d for d, w in want.items() if all(abs(a - b) <= 3 for a, b in zip(found.get(d, (-9,) * 4), w, strict=True))]
    assert len(exact) == len(want)


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(3)
    exact, fuzzy, short = prose(rng, 52), prose(rng, 90), prose(rng, 30)
    rows, want = [], {}
    for i in range(60):
        words = prose(rng, rng.randint(5, 200))
        if i in (4, 17, 40, 59):
            at = rng.randint(0, len(words))
            words[at:at] = exact
            if i != 4:
                want[i] = (at, at + 52)
        if i in (9, 30):
            changed = [w if k % 9 or i == 9 else "changed" for k, w in enumerate(fuzzy)]
            at = rng.randint(0, len(words))
            words[at:at] = changed
            if i == 30:
                want[i] = (at, at + 90)
        if i in (12, 13):
            words += short
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in passages.repeated_passages(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["first_word"], r["end_word"], r["other_id"]))
    assert set(found) == set(want)
    for d, (a, b) in want.items():
        (x, y, other), = found[d]
        assert abs(x - a) <= 3 and abs(y - b) <= 3 and other == (9 if d == 30 else 4)
    cut = {r["doc_id"]: r["text"].split() for r in passages.without_repeats(docs).collect()}
    assert all(cut[i] == t.split() for i, t in rows if i not in want)
    assert all(len(cut[d]) <= len(dict(rows)[d].split()) - (b - a) + 6 for d, (a, b) in want.items())


def test_every_long_exact_passage_is_found_for_any_place(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        shared = prose(rng, 50 + i)
        rows += [(2 * i, " ".join(prose(rng, i) + shared)), (2 * i + 1, " ".join(shared + prose(rng, 40 - i)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]): r["end_word"] - r["first_word"] for r in passages.repeated_passages(docs).collect()}
    assert {k: n for k, n in found.items()} == {(2 * i + 1, 2 * i): 50 + i for i in range(40)}


def test_exact_passages_whose_seeds_first_occur_in_other_texts(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(20):
        passage, at = prose(rng, 60), 4 * k
        rows += [(at, prose(rng, 40) + passage[:34] + prose(rng, 40)), (at + 1, prose(rng, 30) + passage[26:] + prose(rng, 50)),
                 (at + 2, prose(rng, 20) + passage + prose(rng, 60)), (at + 3, prose(rng, 70) + passage + prose(rng, 10))]
        want.add((at + 3, 70, 130, at + 2))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["other_id"]) for r in found} == want


def plain_repeats(rows, length=50):
    """Words of exact windows that an earlier document has as well, by doc_id."""
    seen, want = set(), {}
    for d, text in sorted(rows):
        words = (text or "").encode().lower().split()
        here = [tuple(words[i:i + length]) for i in range(len(words) - length + 1)]
        want[d] = {i + j for i, w in enumerate(here) if w in seen for j in range(length)}
        seen.update(here)
    return want


def pieces_rows():
    rng = random.Random(21)
    pool = [prose(rng, rng.randint(8, 70)) for _ in range(60)]
    return [(i, " ".join(sum((rng.choice(pool) if rng.random() < 0.7 else prose(rng, 9) for _ in range(rng.randint(1, 9))), [])))
            for i in range(150)]


@pytest.mark.parametrize("made", [True, False])
def test_exact_windows_against_brute_force(spark, folder, made):
    if made:  # texts put together from common pieces: seeds first occur in very many other texts
        rows = pieces_rows()
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
        rows = [tuple(r) for r in docs.collect()]
    texts = {d: (t or "").encode().lower().split() for d, t in rows}
    found = {d: set() for d in texts}
    for r in passages.repeated_passages(docs).collect():
        a, b, c, e = r["first_word"], r["end_word"], r["other_first"], r["other_end"]
        assert b - a >= 50 and r["n_equal"] >= 0.8 * max(b - a, e - c) and r["other_id"] <= r["doc_id"]
        assert texts[r["doc_id"]][a] == texts[r["other_id"]][c] and texts[r["doc_id"]][b - 1] == texts[r["other_id"]][e - 1]
        found[r["doc_id"]].update(range(a, b))
    want = plain_repeats(rows)
    assert any(want.values()) and all(want[d] <= found[d] for d in want)


def test_fenwick_chains_are_the_best_ordered_ones():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 12)
        q = sorted(rng.sample(range(200), n))
        r = [rng.randrange(200) for _ in q]
        best = [0.0] * n
        for i in range(n):
            steps = [best[j] - passages.GAP_COST * (q[i] - q[j] + r[i] - r[j]) for j in range(i) if r[j] < r[i]]
            best[i] = passages.K + max([0.0, *steps])
        first = passages.chains(q, r)[0]
        score = passages.K * len(first) - passages.GAP_COST * (q[first[-1]] - q[first[0]] + r[first[-1]] - r[first[0]])
        assert abs(score - max(best)) < 1e-9 or len({a - b for a, b in zip(q, r, strict=True)}) == 1


def test_passage_edges(spark):
    text = " ".join(prose(random.Random(5), 120))
    rows = [(1, text, "a"), (1, text, "a"), (1, text + " more", "b"), (None, text, "c"), (2, None, "d"), (3, "", "e"), (4, text, "f"),
            (5, "same " * 300, "g"), (6, "same " * 300, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeat_version string")
    kept = passages.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    by = {}
    for r in kept.collect():
        by.setdefault(r["repeat_version"], []).append(r["text"])
    assert by["c"] == [text] and by["d"] == [None] and by["e"] == [""] and by["f"] == [""]
    assert sum(bool(t.strip()) for v in "ab" for t in by[v]) >= 1
    assert passages.without_repeats(docs.limit(0)).count() == 0


def plain_hits(words, items, window=10):
    hit, names = set(), set()
    for name, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for p in [w[i:i + window] for i in range(max(len(w) - window, 0) + 1)] if w else []:
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    names |= {name} - {None}
    return hit, names


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 9):
        segments = [rng.integers(1, sigma + 1, rng.integers(1, 40)) for _ in range(30)]
        index = FMIndex(segments, 5)
        firsts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in segments])))
        for n in (1, 3, 10):
            phrases = rng.integers(1, sigma + 1, (20, n))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = sorted(int(f) + i for f, s in zip(firsts, segments, strict=False) for i in range(len(s) - n + 1)
                              if (s[i:i + n] == p).all())
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_phrases_against_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        words = [f"w{i}" for i in range(rng.choice([2, 5, 30]))]
        items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(rng.randint(0, 5))]
        texts = []
        for _ in range(6):
            t = rng.choices([*words, "zz"], k=rng.randint(0, 120))
            if items and rng.random() < 0.7:
                t[3:3] = rng.choice(items)[1].split()
            texts.append(t)
        found = Phrases([(n, t.encode()) for n, t in items], 4).hits([[w.encode() for w in t] for t in texts])
        for t, (spans, names) in zip(texts, found, strict=True):
            assert ({i for a, b in spans for i in range(a, b)}, names) == plain_hits(t, items, 4)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("block_bytes", [1 << 25, 2500])
def test_benchmark_hits_on_the_small_tables(spark, folder, block_bytes):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {}
    for r in docs.collect():
        hit, names = plain_hits(words_of(r["text"]), items)
        want[r["doc_id"]] = (len(words_of(r["text"])), len(hit), len(names),
                             hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    found = benchmark_hits(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), block_bytes=block_bytes)
    assert {r["doc_id"]: tuple(r)[1:6] for r in found.collect()} == want
    assert any(x[4] for x in want.values())
    left = without_benchmark(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), block_bytes=block_bytes)
    for r in left.collect():
        assert not plain_hits(words_of(r["text"]), items)[0]
        if not want[r["doc_id"]][4]:
            assert len(words_of(r["text"])) == want[r["doc_id"]][0]


def test_benchmark_edges(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    rows = [(1, f"{ten[:14]} {ten}. {ten[15:]} end", "x"), (1, ten, "y"), (None, f"a {ten.upper()}!", "z"), (2, None, "n"), (3, "", "e"), (4, "Short, one", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    items = spark.createDataFrame([("b", ten), ("a", ten), (None, "short one"), ("c", None), ("d", "...")], "item_id string, text string")
    found = sorted((str(r["doc_id"]), r["n_hit"], r["n_items"], r["contaminated"]) for r in benchmark_hits(docs, items).collect())
    assert found == [("1", 10, 2, True), ("1", 10, 2, True), ("2", 0, 0, False), ("3", 0, 0, False), ("4", 2, 0, True), ("None", 10, 2, True)]
    left = without_benchmark(docs, items)
    texts = {r["items"]: r["text"] for r in left.collect()}
    assert left.columns == docs.columns and texts["n"] is None and texts["e"] == "" and texts["z"] == "a !"
    assert not words_of(texts["x"])[:-1] or plain_hits(words_of(texts["x"]), [("b", ten)])[0] == set()
    none = items.limit(0)
    assert benchmark_hits(docs, none).where("contaminated").count() == 0
    assert benchmark_hits(docs.limit(0), items).count() == 0
    assert without_benchmark(docs, none).count() == len(rows)


def test_repeated_benchmark_items_do_not_fill_a_block(spark):
    items = [("same", "x " * 50)] * 300 + [(f"i{k}", f"word{k} " * 12) for k in range(40)]
    sizes, real = [], decontaminate.Phrases
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "Phrases", lambda items, window: sizes.append(len(items)) or real(items, window))
        blocks = list(decontaminate.phrase_blocks(spark.createDataFrame(items, "item_id string, text string"), block_bytes=2000))
    assert sum(sizes) == 41 and len(blocks) == 2


@pytest.mark.parametrize("last", [0, 1])
def test_a_cut_for_a_later_block_makes_no_phrase_of_an_earlier(spark, monkeypatch, last):
    inner, outer = [f"in{k}" for k in range(10)], [f"out{k}" for k in range(10)]
    items = [("a", " ".join(inner).encode()), ("b", " ".join(outer).encode())]
    blocks = [items[1 - last], items[last]]
    monkeypatch.setattr(decontaminate, "phrase_blocks", lambda *_: ((i == 1, Phrases([b])) for i, b in enumerate(blocks)))
    texts = [" ".join(["head", *x[:4], *y, *x[4:], "tail"]) for x, y in ((inner, outer), (outer, inner))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = without_benchmark(docs, None).collect()
    assert {r["doc_id"]: r["text"].split() for r in found} == {0: ["head", "tail"], 1: ["head", "tail"]}
