"""Near-duplicate, exact-duplicate and substring operators against brute force on small fixtures."""

import collections
import hashlib
import random
import re

import pytest

from chunkloom.llm import jaccard_join, suffix_dedup
from chunkloom.llm.common import Texts, key_filter, maybe_in
from chunkloom.llm.exact_dedup import DedupState, exact_dedup, keep_one

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=5, n=160):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(4000)]
    passage = " ".join(rng.choices(words, k=60))
    rows, base = [], [rng.choices(words, k=rng.randint(30, 120)) for _ in range(12)]
    for i in range(n):
        kind = i % 8
        if kind < 4:
            w = list(base[rng.randrange(4 if kind < 3 else 12)])
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 4:
            w = [*rng.choices(words, k=20), passage, *rng.choices(words, k=20)]
        else:
            w = rng.choices(words, k=rng.randint(0, 50))
        text = " ".join(w)
        rows.append((i, text.upper() if i % 17 == 0 else text, "x", rng.choice([None, "s"])))
    rows += [(1000, None, "a", None), (1001, "", "a", None), (1002, " \t\n", "a", None), (1003, "one two", "a", None), (1004, "One  two", "b", None), (1005, "one", "b", None), (1006, rows[0][1], "c", "c"), (1007, "ÄÖ " * 300, "d", None), (1008, "äö " * 300, "d", None), (None, rows[1][1], "n", None), (None, "alone and null", "n", None), (7, rows[7][1], "again", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with the operators' own names come along
    return spark.createDataFrame(corpus(), "doc_id long, text string, label string, node string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, label string")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return collections.Counter((key, len(sets[i]), least.get(find(i), key)) for i, (key, *_) in enumerate(rows))


@pytest.mark.parametrize("group", [2048, 3])
def test_jaccard_components(docs, group, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", group)
    monkeypatch.setattr(jaccard_join, "ROUTES", 3 if group > 3 else 1)
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    want = brute_components(corpus())
    assert got == want
    assert any(n > 1 for n in collections.Counter(c for _, _, c in want.elements()).values())


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.keep_one_of_each(empty).columns == empty.columns


def test_one_of_each_component_stays(docs):
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    want = {c for _, _, c in brute_components(corpus()) if c is not None}
    assert set(ids) == want


def test_a_part_derives_overlaps_from_similar_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 300).astype(np.uint64)
    sets = []
    for i in range(60):
        s = base.copy()
        s[rng.integers(0, 300, rng.integers(0, 50))] = rng.integers(0, 2**60, 1).astype(np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    part = jaccard_join.Part(sizes, sets)
    part.links()
    for i in range(60):
        mine = part.overlaps(i)
        assert [int(x) for x in mine] == [len(np.intersect1d(sets[part.order[i]], sets[part.order[j]])) for j in range(60)]
    assert part.derived > 0


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for key, text, *_ in rows:
        groups[(text or "").translate(LOW)].append(key)
    out = collections.Counter()
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = False
        for k in sorted(keys, key=lambda k: (k is not None, k), reverse=True):
            out[(k, keep, len(keys), not stays, digest)] += 1
            stays = True
    return out


def test_exact_dedup(docs):
    assert collections.Counter(tuple(r) for r in exact_dedup(docs).collect()) == brute_exact(corpus())


def test_exact_dedup_compares_bytes_when_digests_collide(docs):
    from pyspark.sql import functions as F

    weak = exact_dedup(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    assert collections.Counter(tuple(r) for r in weak.collect()) == brute_exact(corpus())


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup(empty).count() == 0 and keep_one(empty).columns == empty.columns


def test_a_later_run_meets_the_state_of_the_earlier_one(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path}/state"
    early = docs.where(F.coalesce("doc_id", F.lit(0)) % 2 == 0)
    late = docs.where(F.coalesce("doc_id", F.lit(0)) % 2 == 1)
    DedupState(spark, folder).add(early)
    first = DedupState(spark, folder)
    assert first.values().agg(F.sum("group_size")).first()[0] == early.count()
    first.add(late)
    again = DedupState(spark, folder)  # another driver goes on from the folder alone
    assert collections.Counter(tuple(r) for r in again.groups(docs).drop("mark").collect()) == brute_exact(corpus())
    batches = again.spark.read.parquet(f"{folder}/state").select("batch").distinct().count()
    assert batches > 2
    again.add(early)  # the same rows once more: the state counts them
    assert again.values().agg(F.sum("group_size")).first()[0] == docs.count() + early.count()


def test_key_filter_loses_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.xxhash64("id").alias("part")).withColumn("bits", F.lit("clash"))
    some = rows.where("id % 50 = 0")
    got = maybe_in(rows.select("id", F.col("part").alias("key")), F.col("key"), key_filter(some, F.col("part")), "hit").where("hit").collect()
    assert {r["id"] for r in got} >= set(range(0, 3000, 50)) and len(got) < 70
    none = maybe_in(rows.select("id"), F.col("id"), key_filter(some.limit(0), F.col("part")), "hit")
    assert none.where("hit").count() == 0 and none.count() == 3000


@pytest.mark.parametrize("keep", [keep_one, jaccard_join.keep_one_of_each, suffix_dedup.strip_repeats])
def test_stages_carry_columns_of_any_name(spark, keep):
    names = ["__id", "__digest", "__keep", "__null", "id", "hash", "mark", "row", "kept", "digest", "k0", "text2", "first", "a.b"]
    rows = [(i, f"some words of text number {i % 4} and a little more", *(f"{i}-{c}" for c in names)) for i in range(8)]
    rows += [(3, "another text with the id of an earlier one", *(f"x-{c}" for c in names)), (None, rows[0][1], *names), (None, rows[0][1], *names)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    out = keep(docs)
    assert out.columns == docs.columns
    found = [tuple(r) for r in out.collect()]
    assert set(found) <= {tuple(r) for r in rows} and len(set(found)) >= 5
    if keep is not suffix_dedup.strip_repeats:
        assert len(found) == len({r[1] for r in found})


def test_keep_one_keeps_one_row_of_each_text(docs):
    kept = keep_one(docs)
    texts = [(r["text"] or "").translate(LOW) for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(set(texts)) == len({(t or "").translate(LOW) for _, t, *_ in corpus()})


def brute_cut(rows):
    seen = collections.Counter()
    bodies = [(t or "").encode() for _, t, *_ in rows]
    for b in bodies:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for (key, *_), b in zip(rows, bodies, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def long_corpus():
    rows = corpus()
    return [*rows, (2000, "ab" * 500, "p", None), (2001, "x" * 199, "p", None), (2002, "x" * 199 + "y", "p", None), (2003, "漢字" * 120, "p", None), (2004, rows[4][1][:150] + "!" + rows[4][1][150:], "p", None)]


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    docs = spark.createDataFrame(long_corpus(), "doc_id long, text string, verdict string, starts string").repartition(3)
    got = collections.Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect())
    want = collections.Counter((k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, n, gone, spans, kept in brute_cut(long_corpus()))
    assert got == want
    cut = suffix_dedup.strip_repeats(docs)
    assert cut.columns == docs.columns
    texts = collections.Counter((r["doc_id"], r["text"]) for r in cut.collect())
    assert texts == collections.Counter((row[0], None if row[1] is None else kept.decode(errors="ignore")) for row, (*_, kept) in zip(long_corpus(), brute_cut(long_corpus()), strict=True))


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_refinement_is_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1400] = data[100:500]
    start = np.arange(3000)
    bucket = suffix_dedup.refine(data, start, 3000 - start)
    count = collections.Counter(data[i : i + 200].tobytes() for i in range(2801))
    assert [b > 0 for b in bucket] == [i <= 2800 and count[data[i : i + 200].tobytes()] > 1 for i in range(3000)]


def test_anchors_cover_every_string():
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 2000).astype(np.uint8)
    texts = Texts(0, data, np.array([0, 150, 900, 900, 2000]))
    row, first, last, *_ = suffix_dedup.anchors(texts)
    starts = sorted(i for a, b in zip(first, last, strict=True) for i in range(a, b + 1))
    assert starts == [*range(150, 701), *range(900, 1801)] and set(row) == {1, 3}
