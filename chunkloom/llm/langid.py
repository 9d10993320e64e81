"""Language ID by prediction by partial matching over per-language byte context trees.

Every language has a variable-order context tree of byte statistics (orders MAX_ORDER down to 0, escape method
C with exclusion, a uniform order below), frozen after training. The trees of all languages share their
contexts, none of which is left out, so a place in a text has one state, its longest known context; each (state, byte)
that training met has its exact code length under every language, and a byte that no language met there escapes
to the shorter context at the state's escape cost. A text's score is the sum of its code lengths over all of its
bytes; the shortest code wins.

Training looks at text and lang alone, of a bounded sample: per language the documents with the smallest hash of
their id, at most TRAIN_DOCS of them and no further one once TRAIN_BYTES are reached, documents above
TRAIN_DOC_BYTES only where a language has too few others, none of them held out. These bounds are parameters; every
language that occurs is learned, and prediction covers every byte of every document.

Defined results: null text, or text without a letter, is `und` with score 0; ties go to the language that
sorts first; with no training rows every text is `und` (and keep_languages keeps all that have a letter); null lang
never trains; a null id never trains and is judged like any other; repeated rows are judged one by one; very long
texts are judged whole; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import KeyTable, Texts, serve, text_slices, trim

MAX_ORDER = 3
#: Bounds of the training sample: documents and bytes of each language, and the size above which others come first.
TRAIN_DOCS = 300
TRAIN_BYTES = 4 << 20
TRAIN_DOC_BYTES = 1 << 18
#: Bytes of text that are judged together.
SLICE_BYTES = 1 << 19
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    """Frozen context trees. States are numbered by order, state 0 is the empty context."""

    languages: list[str]
    symbol: np.ndarray  # of each byte; bytes that no training text holds share the last one
    contexts: list[np.ndarray]  # of each order, ascending: packed symbols, the nearest one leading
    first: list[int]  # the first state of each order
    parent: np.ndarray  # of each state
    pairs: np.ndarray  # state * width + symbol of every pair that training met
    cost: np.ndarray  # [pair, language]: bits
    escape: np.ndarray  # [state, language]: bits

    def __post_init__(self) -> None:
        self.width = int(self.symbol.max()) + 1
        self.table: KeyTable | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "deepest": None}

    def _index(self) -> None:
        """Lookup tables, built on first use: pair -> row, and symbols before a place -> state, per number of symbols."""
        self.table = KeyTable(self.pairs)
        self.deepest = [np.zeros(1, np.int32)]
        for order in range(1, MAX_ORDER + 1):
            state = np.repeat(self.deepest[-1], self.width)
            state[self.contexts[order]] = self.first[order] + np.arange(len(self.contexts[order]), dtype=np.int32)
            self.deepest.append(state)

    def lengths(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Bits of each symbol in its state under every language."""
        row = self.table.lookup(state * self.width + sym)
        out = self.cost[row]
        todo = np.flatnonzero(row < 0)
        if len(todo):
            at, what = state[todo], sym[todo]
            bits = np.zeros((len(todo), len(self.languages)), np.float32)
            alive = np.arange(len(todo))
            while len(alive):
                bits[alive] += self.escape[at[alive]]
                ended = at[alive] == 0
                bits[alive[ended]] += 8  # the uniform order
                alive = alive[~ended]
                at[alive] = self.parent[at[alive]]
                row = self.table.lookup(at[alive] * self.width + what[alive])
                bits[alive[row >= 0]] += self.cost[row[row >= 0]]
                alive = alive[row < 0]
            out[todo] = bits
        return out

    def bits(self, texts: Texts, block: int = 1 << 16) -> np.ndarray:
        """Code length in bits of each row under each language."""
        if self.table is None:
            self._index()
        n = len(texts.data)
        total = np.zeros((len(texts), len(self.languages)))
        sym = self.symbol[texts.data]
        offsets = texts.offsets
        for a in range(0, n, block):
            b = min(a + block, n)
            at = np.arange(a, b)
            row = np.searchsorted(offsets, at, "right") - 1
            since = at - offsets[row]
            state = np.zeros(b - a, np.int64)
            for order in range(1, MAX_ORDER + 1):
                here = np.flatnonzero(since >= order) if order == MAX_ORDER else np.flatnonzero(since == order)
                packed = np.zeros(len(here), np.int64)
                for back in range(1, order + 1):
                    packed = packed * self.width + sym[at[here] - back]
                state[here] = self.deepest[order][packed]
            bits = self.lengths(state, sym[a:b])
            first = int(row[0])
            edges = np.maximum(offsets[first : int(row[-1]) + 1], a) - a
            keep = np.flatnonzero(np.diff(np.append(edges, b - a)) > 0)
            total[first + keep] += np.add.reduceat(bits, edges[keep], axis=0, dtype=np.float64)
        return total


def train(samples: dict[str, list[bytes]]) -> Model:
    """Freeze the context trees of the languages."""
    languages = sorted(samples)
    used = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            used[np.frombuffer(t, np.uint8)] = True
    symbol = np.full(256, int(used.sum()), np.int64)
    symbol[used] = np.arange(int(used.sum()))
    width = int(symbol.max()) + 1
    contexts, first, parents, pairs, costs, escapes = [], [], [], [], [], []
    total = 0
    below_keys, below = np.zeros(0, np.int64), np.zeros((0, len(languages)))  # of the order below: its pairs, and their probabilities
    for order in range(MAX_ORDER + 1):
        grams = [_grams(samples[lang], symbol, width, order) for lang in languages]
        keys = np.unique(np.concatenate([k for k, _ in grams]))
        n = np.zeros((len(keys), len(languages)), np.int64)
        for j, (k, c) in enumerate(grams):
            n[np.searchsorted(keys, k), j] = c
        context, of = np.unique(keys // width, return_inverse=True)
        if not order:
            context, of = np.zeros(1, np.int64), np.zeros(len(keys), np.int64)
        # the pair below drops the last context digit, the farthest symbol
        lower = below[np.searchsorted(below_keys, keys // width // width * width + keys % width)] if order else np.full((len(keys), len(languages)), 1 / 256)
        seen, kinds, taken = (np.zeros((len(context), len(languages))) for _ in range(3))
        for total_, values in ((seen, n), (kinds, n > 0), (taken, np.where(n > 0, lower, 0.0))):
            np.add.at(total_, of, values)
        rest = np.maximum(1 - taken, 1e-12)
        escape = np.where(seen > 0, kinds / np.maximum(seen + kinds, 1) / rest, 1.0)
        p = np.where(n > 0, n / np.maximum(seen + kinds, 1)[of], escape[of] * lower)
        contexts.append(context), first.append(total)
        parents.append(first[order - 1] + np.searchsorted(contexts[order - 1], context // width) if order else np.zeros(1, np.int64))
        pairs.append((total + of) * width + keys % width)
        costs.append(-np.log2(np.maximum(p, 2.0**-60))), escapes.append(-np.log2(np.maximum(escape, 2.0**-60)))
        total += len(context)
        below_keys, below = keys, p
    return Model(languages, symbol, contexts, first, np.concatenate(parents), np.concatenate(pairs), np.concatenate(costs).astype(np.float32), np.concatenate(escapes).astype(np.float32))


def _grams(texts: list[bytes], symbol: np.ndarray, width: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of this order, ascending, and their counts."""
    keys = [np.zeros(0, np.int64)]
    for t in texts:
        s = symbol[np.frombuffer(t, np.uint8)]
        if len(s) > order:
            packed = np.zeros(len(s) - order, np.int64)
            for back in range(1, order + 1):
                packed = packed * width + s[order - back : len(s) - back]
            keys.append(packed * width + s[order:])
    return np.unique(np.concatenate(keys), return_counts=True)


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Train from a bounded, deterministic sample: two scans, and never more than the sample on the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    found = rows.groupBy("lang").count().collect()  # a row a language
    if not found:
        return None
    # a share of each language that holds twice the wanted documents, so that each window below is of bounded size; as an
    # Arrow table it is a local relation, and a list would start a second set of Python workers on the executors
    share = docs.sparkSession.createDataFrame(pa.table({"of": pa.array([r["lang"] for r in found], pa.string()), "share": pa.array([min(1.0, (2 * per_language + 100) / r["count"]) for r in found], pa.float64())}))
    place = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("place", place).join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.col("place") < F.col("share"))
    sized = near.where(F.col("text").isNotNull()).withColumn("size", F.octet_length("text").cast("long"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > TRAIN_DOC_BYTES, "place", "id", "text")
    picked = sized.withColumn("at", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    samples: dict[str, list[bytes]] = {}
    for r in picked.where((F.col("at") <= per_language) & (F.col("before") < most_bytes)).select("lang", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    samples = {lang: texts for lang, texts in samples.items() if any(texts)}
    return train(samples) if samples else None


def judge(batch: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, code length in bits (infinite without a letter, zero without a model) and bytes of each text."""
    n = len(batch)
    names, score, length, sizes = [UNKNOWN] * n, np.zeros(n), np.full(n, np.inf), np.ones(n, np.int64)
    letters = np.array([t is not None and LETTER.search(t) is not None for t in batch.to_pylist()], bool)
    if model is None:
        length[letters] = 0
        return names, score, length, sizes
    for texts in text_slices(batch, SLICE_BYTES):
        bits = model.bits(texts)
        best = bits.argmin(axis=1)
        gap = np.minimum(bits - bits[np.arange(len(best)), best][:, None], 1000.0)
        sure = 1 / np.exp2(-gap).sum(axis=1)
        sizes[texts.first : texts.first + len(texts)] = np.maximum(texts.lengths, 1)
        for i, j in enumerate(best.tolist()):
            at = texts.first + i
            if letters[at]:
                names[at], score[at], length[at] = model.languages[j], sure[i], bits[i, j]
    return names, score, length, sizes


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, lang_pred, score, bits_per_byte (null for `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("languages")
        for batch in batches:
            names, score, length, sizes = judge(batch.column(1), shared.value)
            rate = np.where(np.array(names, object) == UNKNOWN, np.nan, length / sizes)
            bits = pa.array(np.where(np.isfinite(rate.astype(float)), rate.astype(float), np.nan), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score), bits], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
            trim()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))


#: A text is rejected when even its best code is longer than this: bits a byte (random bytes cost 8) plus some for all,
#: so that a short text isn't judged by a few rare letters.
REJECT_BITS, REJECT_SLACK = 6.0, 128.0


def keep_languages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that are in no known language: no letter, or no language's tree codes them well.

    A null or empty text has no letter and goes; repeated rows stay or go together; where no row is labelled nothing is
    known of languages, and all rows with a letter stay.
    """
    model = fit(docs, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("languages")
        for batch in batches:
            _, _, length, sizes = judge(batch.column(batch.schema.get_field_index(text_col)), shared.value)
            yield batch.filter(pa.array(length <= REJECT_BITS * sizes + REJECT_SLACK))
            trim()

    return docs.mapInArrow(run, docs.schema)
