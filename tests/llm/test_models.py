"""Language ID, URL filters, licence scans and vector search: held-out accuracy and brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

from chunkloom.llm import langid, license_scan, url_filter, voronoi_knn
from tests.conftest import SF


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out_accuracy(documents):
    rows = {r["doc_id"]: r for r in langid.language_id(documents).collect()}
    right = total = 0
    for r in documents.select("doc_id", "lang").collect():
        out = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert rows[r["doc_id"]]["held_out"] == out and 0 <= rows[r["doc_id"]]["score"] <= 1
        if out:
            total += 1
            right += rows[r["doc_id"]]["lang_pred"] == r["lang"]
    assert right / total > 0.97


class PlainPPM:
    """PPM, escape method C with exclusion, by its definition: one language's tree as nested counters."""

    def __init__(self, texts):
        self.after = collections.defaultdict(collections.Counter)
        for t in texts:
            for i in range(len(t)):
                for order in range(min(i, langid.MAX_ORDER) + 1):
                    self.after[t[i - order : i]][t[i]] += 1

    def probability(self, context, byte):
        lower = self.probability(context[1:], byte) if context else 1 / 256
        seen = self.after.get(context)
        if not seen:
            return lower
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / total
        excluded = sum(self.probability(context[1:], b) if context else 1 / 256 for b in seen)
        return len(seen) / total * lower / (1 - excluded)

    def bits(self, text):
        return -sum(np.log2(self.probability(text[max(0, i - langid.MAX_ORDER) : i], text[i])) for i in range(len(text)))


def test_code_lengths_equal_an_independent_ppm():
    import random

    from chunkloom.llm.common import Texts

    r = random.Random(3)
    texts = {"a": [b"abab abba baab " * 20, b"b"], "b": [b"cdcd dccd ddcc " * 20], "c": ["".join(r.choices("abcd \u00e9", k=300)).encode() for _ in range(4)]}
    m = langid.train(texts)
    rows = [b"ab cd xabba", b"", b"dccd", "\u00e9\u00e9 ab\u4e2d".encode(), bytes(range(256)), b"z"] + ["".join(r.choices("abcdx \u00e9", k=40)).encode() for _ in range(20)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    want = [[PlainPPM(texts[lang]).bits(row) for lang in m.languages] for row in rows]
    for block in (4, 1 << 16):
        assert np.allclose(m.bits(Texts(0, data, offsets), block=block), want, rtol=1e-5, atol=1e-3)


def test_every_language_is_learned_and_none_means_all_stay(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(80):  # more languages than any table has, each with an alphabet of its own order
        mine = rng.permutation(letters)[:6]
        rows += [(k * 10 + i, "".join(rng.choice(mine, 200)), f"l{k:02d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 80
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95
    bare = spark.createDataFrame([(1, "words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_languages(bare).collect()] == [1]
    one = spark.createDataFrame([(i, "long text " * 40_000, "en") for i in range(3)], docs.schema)  # all above the usual size
    assert langid.fit(one).languages == ["en"]


def test_language_edges(spark, documents):
    model = langid.fit(documents)
    rows = [(1, None, "x", None), (2, "", "x", "en"), (3, "123 !!", "x", "en"), (None, "the of and tion", "x", None), (5, "😀😀", "x", "fr"), (5, "Le la les une des", "x", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "und"), (5, "fr")}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.where("doc_id = 1")).collect()} == {"und"}
    noise = "".join(chr(33 + (i * i * 7919 + i) % 90) for i in range(400))
    mixed = documents.unionByName(spark.createDataFrame([(10**6, noise, "en", "s", 400), (10**6 + 1, None, "en", "s", 0)], documents.schema))
    kept = {r["doc_id"] for r in langid.keep_languages(mixed).select("doc_id").collect()}
    assert 10**6 not in kept and 10**6 + 1 not in kept and len(kept) == documents.count()


RULES = list(url_filter.RULES)


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_verdicts(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1?q#f", "x://example.org/en/12", "http://www.example.org/en/2", "http://a.com/fr/1", "http://com/de/", "http://acom/de/", "http://a.org", "http://org?x", "no scheme", "", None, "http://a.net/fr/1", "a://b://c.org/d", "http://ÉA.org/é#x", "http://a.org/x", "://x.com/de/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(10_000 + i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, html string"))
    rows = url_filter.url_filter(pages.withColumnRenamed("html", "host")).collect()
    want = {(r["page_id"]): brute_rule(r["url"]) for r in pages.collect()}
    assert len(rows) == pages.count()
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == want[r["page_id"]]
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == url_filter.RULES[r["rule"]])
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.host_and_path(pages["url"])
    rows = [r for r in pages.select("url", url_filter.fitting_rule(host, path).alias("rule")).collect() if r["rule"]]
    y = [url_filter.RULES[r["rule"]] == "block" for r in rows]
    train = [i for i in range(len(rows)) if i % 3]
    model = url_filter.train([rows[i]["url"] for i in train], [y[i] for i in train])
    test = [i for i in range(len(rows)) if i % 3 == 0]
    p = model.blocked([rows[i]["url"] for i in test])
    accuracy = np.mean([(a >= 0.5) == y[i] for a, i in zip(p, test, strict=True)])
    assert accuracy > max(0.9, 1 - np.mean([y[i] for i in test]))
    assert url_filter.train([], []).blocked(["http://x"]).tolist() == [0.0]
    assert url_filter.train(["http://x"], [True]).blocked([None]).tolist() == [1.0]


LICENCES = [
    (1, "Released under the MIT License. And again UNDER-the mit LICENSE!"),
    (2, "Licensed under the Apache License, Version 2.0 (the License)"),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, "apache license version 22; under the mitlicense; cc by ncé"),
    (5, None),
    (6, ""),
    (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (8, "This work is licensed under the GNU General Public License, version 3."),
    (9, "permission software license restriction gnu apache mit cc " * 50),
    (None, "under the mit license"),
    (1, "nothing"),
    (10, "é漢 " * 2000 + "cc by nc"),
]


def test_licences(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in LICENCES], "doc_id long, text string, labels int")
    got = collections.Counter(tuple(r) for r in license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = collections.Counter()
    for key, text in LICENCES:
        w = license_scan.WORD.findall((text or "").translate(low))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        want[(key, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))] += 1
    assert got == want
    labels = {(r["doc_id"], r["labels"], r["score"] > 0) for r in license_scan.license_scan(docs).collect()}
    assert {(7, "mit", True), (8, "gpl", True), (9, "", False), (4, "", False), (2, "apache-2", True)} <= labels
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def every_alignment(words):
    """Labels and best share of all templates at all places."""
    found, best = set(), 0.0
    for label, body, phrases in license_scan.TEMPLATES:
        t = body.split()
        for shift in range(1 - len(t), len(words)):
            share = sum(0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(t)) / len(t)
            if share >= license_scan.LEAST_SHARE and all(license_scan.RareTokenIndex._stands(words, t, shift, p.split()) for p in phrases):
                found.add(label)
                best = max(best, share)
    return found, best


def test_no_licence_hides_another():
    import random

    r = random.Random(7)
    bodies = [body.split() for _, body, _ in license_scan.TEMPLATES]
    frequencies = [{}, {w: 900 for w in bodies[5]}, {w: r.randrange(1000) for w in license_scan.VOCABULARY}]
    for frequency in frequencies:
        index = license_scan.RareTokenIndex(frequency, 1000)
        texts = [[w for body in bodies for w in [*body, "x"]]]
        for _ in range(40):
            text = []
            for body in r.sample(bodies, r.randrange(1, 9)):
                text += [w if r.random() > 0.15 else r.choice(license_scan.VOCABULARY) for w in body] + r.choices(license_scan.VOCABULARY, k=r.randrange(6))
            texts.append(text)
        for text in texts:
            _, base, labels, score = index.scan(text)
            found, best = every_alignment(text)
            assert labels == found | base and score == (1.0 if base else best)
        assert {"gpl", "lgpl", "mpl-2", "unlicense", "isc", "bsd", "cc-by"} <= index.scan(texts[0])[2]


def brute_knn(rows, k, every):
    fine = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in fine:
        if q % every == 0:
            best = sorted(((-int(x @ y), i) for i, y in fine if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return collections.Counter(out)


@pytest.mark.parametrize("pivots", [1, 8])
def test_knn(spark, pivots, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "GROUP_QUERIES", 4)
    monkeypatch.setattr(voronoi_knn, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, [None] + rows[1][1][1:]), (502, [float("nan")] + rows[1][1][1:]), (510, [float("inf")] * 8), (520, [0.0] * 8), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = collections.Counter(tuple(r) for r in voronoi_knn.knn_join(df, 10, 10, pivots=pivots).collect())
    assert got == brute_knn(rows, 10, 10)
    few = df.where("vec_id in (0, 1, 2)")
    assert collections.Counter(tuple(r) for r in voronoi_knn.knn_join(few, 10, 10).collect()) == brute_knn(rows[:3], 10, 10)
    assert voronoi_knn.knn_join(df.limit(0)).count() == 0


def test_integer_products_beyond_doubles():
    a = np.array([[2**30 + 1, 3]], np.int64)
    assert voronoi_knn.products(a, a)[0, 0] == (2**30 + 1) ** 2 + 9
    b = np.array([[2**40 + 1, 3], [-(2**40), 0]], np.int64)
    assert voronoi_knn.products(b, b).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]


def test_knn_of_repeated_rows_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "QUERY_CHUNK", 2)
    monkeypatch.setattr(voronoi_knn, "BLOCK_ROWS", 4)
    monkeypatch.setattr(voronoi_knn, "MERGE", 2)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(10, rows[10][1]), (11, rows[11][1])]  # a query row and a candidate row once more
    short = [(100 + i, rng.normal(size=3).tolist()) for i in range(3)]
    df = spark.createDataFrame([(i, v) for i, v in rows + short], "vec_id long, embedding array<double>")
    got = collections.Counter(tuple(r) for r in voronoi_knn.knn_join(df, 12, 10).collect())
    twice = brute_knn(rows, 12, 10)
    once = collections.Counter({key: 1 for key in twice if key[0] == 10}) + collections.Counter({key: n for key, n in twice.items() if key[0] != 10})
    assert sum(once[key] for key in once if key[0] == 10) == 12
    assert got == once + brute_knn(short, 12, 10)


def test_url_sample_is_bounded_and_distinct(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(url_filter, "train", lambda urls, blocked: seen.append(urls))
    pages = spark.range(6000).selectExpr("id as page_id", "concat('http://a.', if(id % 3 = 0, 'org/x', concat('com/de/', id % 2000))) as url")
    url_filter.fit(pages, sample=300)
    assert 200 <= len(seen[0]) <= 300 and len(set(seen[0])) == len(seen[0])
    url_filter.fit(pages.limit(0))
    assert seen[1] == []
