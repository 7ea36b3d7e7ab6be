"""Quality rules, license scans and URL filters against plain code."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from parcelmart.llm import quality, queries
from parcelmart.llm.licenses import BASE, Scanner, evaluate, family, license_scan, postfix
from parcelmart.llm.urls import MOST_BLOCKS, blocks_for, judge_urls, listed_pages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("text", ["", " \n", "a b a b a b", "x\nx\n\nx \n", "é#é $ 日本\u00a0語", "a b c d a b c", "a\x0bb\x1cc"])
def test_statistics(text):
    assert quality.statistics(text)[0] == plain_statistics(text)


def test_statistics_on_the_small_tables(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op2_quality_rules(spark, folder).collect():
        want = plain_statistics(texts[r["doc_id"]])
        assert tuple(r[b] for b in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_trees_learn_held_out_rows_and_keep_their_directions():
    rng = np.random.default_rng(0)
    rows = rng.uniform(0, 1, (3000, len(quality.FEATURES)))
    f = quality.FEATURES.index("symbol_share")
    good = ((rows[:, f] < 0.5) & (rows[:, 1] > 0.2)).astype(float)
    trees = quality.fit(rows[:2000], good[:2000])
    assert ((trees.score(rows[2000:]) > 0) == good[2000:]).mean() > 0.98
    for name in quality.FALLING:
        worse = rows.copy()
        worse[:, quality.FEATURES.index(name)] += rng.uniform(0, 1, len(rows))
        assert (trees.score(worse) <= trees.score(rows) + 1e-9).all()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    trees, threshold = quality.fit_on_labels(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("doc_id % 3 > 0"))
    rows = quality.document_statistics(spark.read.parquet(f"{folder}/documents.parquet")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    found = rows.toPandas()
    kept = trees.score(np.array(found["features"].tolist())) >= threshold
    assert (kept == (found["quality"] == 1)).mean() > 0.9
    assert kept[(found["quality"] == 1).to_numpy()].mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "w " * 60, "c"), (None, " ".join(map(str, range(90))), "d")],
                                 "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.quality_rules(docs, none).collect()
    assert [r["kept"] for r in sorted(found, key=lambda r: r["n_words"])] == [False, False, False, True]
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and [r["kept"] for r in kept.collect()] == ["d"]
    one_kind = spark.createDataFrame([(2, 1), (2, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.quality_rules(docs, one_kind).count() == 4
    assert quality.quality_rules(docs.limit(0), one_kind).count() == 0


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    places = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("text", [
    "", "...", "MIT license", "mit\nLICENSE, apache/license mit license", "é mit license", "xmit license", "mit license mit license",
    "GNU General Public\tLicense general public license public license", "mit licensee", "\x00mit\x7flicense",
])
def test_license_places(text):
    assert Scanner().scan(text)[:5] == plain_licenses(text)


def test_license_places_on_the_small_tables(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op3_license_scan(spark, folder).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_expressions():
    assert postfix(["a", "or", "b", "and", "c", "with", "d"]) == ["a", "b", "c", "d", "with", "and", "or"]
    assert postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in ([], ["and"], ["a", "b"], ["(", "a"], ["a", ")"], ["a", "or"], ["(", ")"]):
        assert postfix(bad) is None
    assert evaluate("(mit or gpl-2.0-only) and apache-2.0") == ({"mit", "gpl", "apache"}, True)
    assert evaluate("mit and gpl-3.0-or-later with classpath-exception-2.0") == ({"mit", "gpl"}, False)
    assert evaluate("cc-by-nc-4.0") == ({"cc-by-nc"}, False)
    found = Scanner().scan("# SPDX-License-Identifier: MIT OR (\n# spdx-license-identifier: BSD-3-Clause\n")
    assert found[5:] == ("bsd,unknown-expression", 1.0, True)


def test_license_edges(spark):
    docs = spark.createDataFrame([(None, "MIT License", 1), (1, None, 2), (1, None, 3)], "doc_id long, text string, score int")
    assert sorted((r["n_base"], r["labels"]) for r in license_scan(docs).collect()) == [(0, ""), (0, ""), (1, "mit")]
    assert license_scan(docs.limit(0)).count() == 0


PAGES = [
    (1, "https://www.Example.ORG/es/1?x=/en/"), (2, "http://example.org/en/12#a"), (3, "http://sub.example.org/en/2"),
    (4, "http://example.com/fr/1"), (5, "http://example.com/de/1"), (6, "http://bad.net/a/"), (7, "https://www.bad.net/a.html?q"),
    (8, None), (9, "no scheme"), (10, "http://"), (11, "http://notexample.org"), (12, "x://HOST?y://z/a"), (12, "x://HOST?y://z/a"),
    (None, "http://bad.net/b"), (13, "http://ÄÖ.net/ä"), (14, "http://org/"),
]


def plain_verdict(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
    fits = []
    for says, rule in queries.judge_urls.__globals__["RULES"]:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, says))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    name = re.sub(r"^www\.", "", host) + re.sub(r"(\.html?|/+)$", "", path)
    return host, path, None, "block" if name in listed else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in PAGES], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("http://bad.net/a",), ("http://bad.net/a/",), (None,), ("",), ("http://host",)], "url string")
    for blocks in (1, 64, 1 << 16):  # one word lets nearly all through to the exact join
        found = sorted(tuple(r)[:5] for r in judge_urls(pages, listed, blocks=blocks).fillna(-1, ["page_id"]).collect())
        want = sorted((-1 if i is None else i, *plain_verdict(u, {"bad.net/a", "host"})) for i, u in PAGES)
        assert [tuple(map(str, r)) for r in found] == [tuple(map(str, r)) for r in want]
    assert judge_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, listed.limit(0), rules=()).collect()} == {"allow"}


def test_the_list_of_the_url_query_is_not_a_matter_of_hosts(spark):
    found = queries.op10_url_filter(spark, "/root/testdata/sf0.01").toPandas()
    by_host = found.groupby("host")["listed"].agg(["min", "max"])
    assert (by_host["min"] != by_host["max"]).sum() > 5
    assert (found["listed"] & found["rule"].isna() & (found["verdict"] == "block")).any()


def test_the_filter_grows_with_the_list():
    assert [blocks_for(n) for n in (0, 4 << 12, 4 << 30)] == [1 << 10, 1 << 12, MOST_BLOCKS]


def test_the_filter_never_loses_a_listed_url(spark):
    names = spark.range(5000).selectExpr("concat('h', id, '.net/a') AS canonical")
    asked = spark.range(10_000).selectExpr("id", "concat('h', id, '.net/a') AS canonical")
    assert listed_pages(asked, names, 256).where("listed != (id < 5000)").count() == 0


def test_tags_in_closed_comments_and_names_with_digits():
    scan = Scanner().scan
    assert scan("<!-- SPDX-License-Identifier: MIT -->")[5:] == ("mit", 1.0, True)
    assert scan("/* SPDX-License-Identifier: GPL-2.0-only OR CC0-1.0 */")[5:] == ("cc0,gpl", 1.0, True)
    names = {"cc0-1.0": "cc0", "cc0": "cc0", "bsd-3-clause": "bsd", "apache2": "apache", "gpl-2.0+": "gpl", "mit0": "mit",
             "cc-by-4.0": "cc-by", "mitre": "other", "0bsd": "other"}
    assert {n: family(n) for n in names} == names


def test_a_repeated_labelled_doc_id_does_not_fill_the_sample(spark):
    rows = [(1, f"copy {k} " * 30) for k in range(300)] + [(d, f"w{d} " * (20 + 7 * d)) for d in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 12)], "doc_id long, quality int")
    sizes, real = [], quality.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "fit", lambda features, good: sizes.append(len(good)) or real(features, good))
        quality.fit_on_labels(docs, labels, 11)
    assert sizes == [11]
