"""URL filters: rules where they fit, gradient-boosted trees on lexical features elsewhere.

A rule `host/path` fits its host and all subdomains when the url's path starts with the rule's path; the longest
fitting rule decides. The URLs that a rule decides are also the labelled URLs: from a bounded sample of
them (SAMPLE rows with the smallest url hashes, a documented parameter) boosted trees learn allow or block from
lexical features (lengths, depth, digit ratio, entropy, parameter counts, suffix statistics), and judge the URLs
that no rule fits. Every URL of the table is judged.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the method's verdict
on an empty url; equal urls get equal verdicts, and repeated rows and null ids are judged one by one; with no
labelled urls, or labels of one kind, the verdict is that kind (allow without any); very long urls are judged whole;
an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import ascii_lower

#: The rules and their verdicts.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
#: Labelled URLs that train the trees, at most.
SAMPLE = 20_000
FEATURES = ("url_length", "host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "letter_ratio", "entropy", "host_entropy", "path_entropy", "parameters", "values_length", "hyphens", "escapes", "longest_digits", "secure", "fragment", "host_suffix", "path_suffix", "path_prefix")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


_DIGITS = re.compile(r"[0-9]+")
_TAIL = re.compile(r"\.([A-Za-z0-9]{1,5})$")


@dataclass
class Statistics:
    """Smoothed shares of blocked URLs by suffix, from the training sample."""

    overall: float
    shares: dict[tuple[str, str], float] = field(default_factory=dict)

    def of(self, kind: str, value: str) -> float:
        return self.shares.get((kind, value), self.overall)


def parts_of(url: str | None) -> tuple[str, str, str, str]:
    """Host, path, query and fragment."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", "", ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path, query, fragment


def suffixes(url: str | None) -> dict[str, str]:
    host, path, _, _ = parts_of(url)
    tail = _TAIL.search(path)
    steps = [s for s in path.split("/") if s]
    return {"host_suffix": host.rpartition(".")[2], "path_suffix": tail[1].lower() if tail else "", "path_prefix": steps[0].lower()[:12] if len(steps) > 1 else ""}


def features(urls: list[str | None], statistics: Statistics) -> np.ndarray:
    """One row of FEATURES for each url."""
    out = np.zeros((len(urls), len(FEATURES)), np.float32)
    for i, url in enumerate(urls):
        u = url or ""
        host, path, query, fragment = parts_of(u)
        n = max(1, len(u))
        values = [p.partition("=")[2] for p in query.split("&")] if query else []
        runs = [len(m) for m in _DIGITS.findall(u)]
        tails = suffixes(u)
        out[i] = (
            len(u), len(host), len(path), len(query), host.count(".") + 1, path.count("/"), sum(runs) / n, sum(c.isalpha() for c in u) / n,
            _entropy(u), _entropy(host), _entropy(path), len(values), sum(map(len, values)), u.count("-"), u.count("%"), max(runs, default=0), u[:5].lower() == "https", bool(fragment),
            *(statistics.of(k, v) for k, v in tails.items()),
        )
    return out


class BoostedTrees:
    """Logistic gradient boosting over histograms: small trees grown level by level."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, penalty: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.start, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        total = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            total += self._apply(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.int64)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        split, threshold, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = self.rate * gs / (hs + self.penalty)
            if 2 * at + 2 >= size or len(rows) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                width = len(self.edges[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[rows], h[rows], None))
                ok = (nl >= self.least) & (len(rows) - nl >= self.least)
                if not ok.any():
                    continue
                gain = np.where(ok, gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                split[at], threshold[at] = best[1], best[2]
                node[rows] = 2 * at + 1 + (binned[rows, best[1]] > best[2])
        return split, threshold, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        split, threshold, value = tree
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            inner = split[node] >= 0
            right = binned[rows, np.maximum(split[node], 0)] > threshold[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._bin(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, binned) for t in self.trees))))


@dataclass
class UrlModel:
    statistics: Statistics
    trees: BoostedTrees | None
    only: float = 0.0  # the probability of block where labels are of one kind

    def blocked(self, urls: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.only)
        return self.trees.probability(features(urls, self.statistics))


def train(urls: list[str], blocked: list[bool]) -> UrlModel:
    y = np.array(blocked, float)
    if not len(y) or y.min() == y.max():
        return UrlModel(Statistics(0.0), None, float(y[0]) if len(y) else 0.0)
    overall = float(y.mean())
    seen: dict[tuple[str, str], list[float]] = {}
    for u, b in zip(urls, y, strict=True):
        for key in suffixes(u).items():
            seen.setdefault(key, []).append(b)
    statistics = Statistics(overall, {k: (sum(v) + 20 * overall) / (len(v) + 20) for k, v in seen.items() if len(v) >= 5})
    return UrlModel(statistics, BoostedTrees().fit(features(urls, statistics), y))


def fit(pages: DataFrame, rules: dict[str, str] = RULES, url_col: str = "url", sample: int = SAMPLE) -> UrlModel:
    """Train from the distinct labelled URLs with the smallest hashes.

    A first scan estimates how many there are, a second takes the share of the hash range that holds a few more than
    wanted; so the driver receives the sample and no more, whatever the number of partitions or of copies of a url.
    """
    host, path = host_and_path(F.col(url_col))
    labelled = pages.select(F.col(url_col).alias("url"), fitting_rule(host, path, rules).alias("rule")).where("rule is not null")
    known = labelled.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    place = F.shiftrightunsigned(F.xxhash64("url"), 11) / F.lit(float(1 << 53))
    near = labelled.where(place < min(1.0, 1.2 * sample / max(known, 1))) if known > sample else labelled
    rows = near.groupBy("url", "rule").agg(F.min(place).alias("place")).orderBy("place", "url").limit(sample).collect()
    return train([r["url"] for r in rows], [rules[r["rule"]] == "block" for r in rows])


def url_filter(pages: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url", model: UrlModel | None = None) -> DataFrame:
    """Per page: host, path, rule, verdict, and the trees' probability of block."""
    model = model or fit(pages, rules, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.blocked(batch.column(1).to_pylist())
            verdict = [rules[r] if r is not None else "block" if x >= 0.5 else "allow" for r, x in zip(batch.column(4).to_pylist(), p.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict, pa.string()), pa.array(p)], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    url = F.col(url_col)
    host, path = host_and_path(url)
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    narrow = narrow.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    return narrow.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")
