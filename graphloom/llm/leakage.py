"""Find held-out evaluation items whose passages occur in a corpus.

Every n-gram of an item is a seed, however many documents hold it. Documents that hold a seed are
aligned with the item (Smith-Waterman on words), which scores copies, edited ones too, and counts from
``LEAST`` on; so whether a document and an item are reported follows from the two alone, not from the
rest of the corpus.

Where only ``RUN`` consecutive words in common are asked for, the rarest n-gram of every window of
``RUN`` words is seed enough, rare by the number of corpus documents that hold it: such a document
holds all n-grams of that window, so its seed, and none is missed.

Words are maximal runs of letters and digits of the consistent form, without regard to case. Null
and empty texts have no words. Items of fewer than ``RUN`` words have no window. Repeated document or
item ids are reported once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .lookalike import Canonicaliser, rules

GRAM = 5
RUN = 13
#: Items are taken in blocks of about so many words; the n-grams of a block are what is sent to executors.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment counts from the score on that ``RUN`` words, of which four in five agree, can have.
LEAST = 0.8 * MATCH * RUN
#: Cells of alignments computed at once.
CELLS = 1 << 16

_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_Q = np.uint64(0xFF51AFD7ED558CCD)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_apart = re.compile(r"[\W_]+")
_powers: dict[str, np.ndarray] = {}
_held: dict[str, object] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) <= n:
        m = max(n + 1, 1 << 20)
        for name, base in (("p", _P), ("q", _P_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


class Words:
    """Words of texts, as strings or as hashes of n-grams."""

    def __init__(self, canon: Canonicaliser) -> None:
        self.canon = canon

    def plain(self, text: str | None) -> str:
        """Lower case in the consistent form; what stands between words of a text beyond ASCII is a blank."""
        if not text:
            return ""
        if text.isascii():
            return text.lower()
        form = self.canon.form
        return _apart.sub(" ", form(form(text).lower()))

    def list(self, text: str | None) -> list[str]:
        return [w for w in _apart.split(self.plain(text)) if w]

    def grams(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every n-gram of the texts."""
        raw = [t.encode() for t in plain]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        off = np.cumsum([0] + [len(r) + 1 for r in raw])
        inside = np.r_[False, _WORD[data], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        if len(begins) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, q = _pow(len(data))
        s = np.empty(len(data) + 1, np.uint64)
        s[0] = 0
        np.cumsum(_MIX[data] * p[: len(data)], out=s[1:])
        w = (s[ends] - s[begins]) * q[begins]
        w ^= w >> np.uint64(29)
        n = len(w) - GRAM + 1
        g = np.zeros(n, np.uint64)
        for i in range(GRAM):
            g = g * _Q + w[i : i + n]
        g ^= g >> np.uint64(32)
        row = np.searchsorted(off, begins, "right") - 1
        whole = row[:n] == row[GRAM - 1 :]
        return row[:n][whole], g[whole]


class Members:
    """Which hashes belong to a set: a bitmap first, then a search."""

    BITS = 22

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self._slot(self.values)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[self._slot(g)])
        x = np.searchsorted(self.values, g[at])
        x[x == len(self.values)] = 0
        return at[self.values[x] == g[at]]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, and the longest runs of words they share.

    Pairs of like size are aligned together, one word of all their first sequences at a time.
    """
    best, longest = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        m, k = len(pairs[order[-1]][1]), 1
        while k < len(order) and k * m < CELLS and 2 * len(pairs[order[-k - 1]][1]) >= m:
            k += 1
        group, order = order[-k:], order[:-k]
        n = max(len(pairs[i][0]) for i in group)
        a, b = np.full((k, n), -2, np.int32), np.full((k, m), -3, np.int32)  # padding equals nothing
        for r, i in enumerate(group):
            a[r, : len(pairs[i][0])], b[r, : len(pairs[i][1])] = pairs[i]
        prev, run = np.zeros((k, m + 1), np.int32), np.zeros((k, m + 1), np.int32)
        top, most = np.zeros(k, np.int32), np.zeros(k, np.int32)
        step = (np.arange(m + 1) * -GAP).astype(np.int32)
        for x in range(n):
            same = b == a[:, x : x + 1]
            h = np.zeros_like(prev)
            np.maximum(prev[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), prev[:, 1:] + np.int32(GAP), out=h[:, 1:])
            np.maximum(h, 0, out=h)
            h += step
            np.maximum.accumulate(h, axis=1, out=h)  # gaps within the second sequence
            h -= step
            np.maximum(top, h.max(1), out=top)
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            np.maximum(most, run.max(1), out=most)
            prev = h
        best[group], longest[group] = top, most
    return best, longest


def _hits(docs: DataFrame, grams: np.ndarray, lookalikes) -> DataFrame:  # noqa: ANN001
    """Documents with n-grams of the items: (doc_id, grams, plain)."""
    bc, key = docs.sparkSession.sparkContext.broadcast((grams, lookalikes)), uuid.uuid4().hex

    def make() -> tuple[Words, Members]:
        g, r = bc.value
        return Words(Canonicaliser(r)), Members(g)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = make()
        words, members = _held[key]
        schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.list_(pa.int64())), ("plain", pa.string())])
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                plain = [words.plain(t) for t in b.column(1).to_pylist()]
                row, g = words.grams(plain)
                hit = members.find(g)
                rows, g = row[hit], g[hit]
                heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
                of = rows[heads]
                lists = [np.unique(x).astype(np.int64) for x in np.split(g, heads[1:])] if len(rows) else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of.astype(np.int64))), pa.array(lists, pa.list_(pa.int64())), pa.array([plain[i] for i in of], pa.string())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, grams array<long>, plain string")


def _blocks(items: DataFrame, words: Words) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    n = 0
    for r in items.toLocalIterator():
        block.append((r.item_id, words.list(r.text)))
        n += len(block[-1][1])
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _seeds(grams: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, item) in ascending order: all n-grams, or with ``counts`` the rarest of every window, however frequent.

    ``counts`` are n-grams, ascending, and how many documents hold them; those that none holds are left out.
    """
    per, keys, items = RUN - GRAM + 1, [], []
    for item, g in enumerate(grams):
        g = g.astype(np.int64)
        if counts is not None:
            known, n = counts
            at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
            never = np.iinfo(np.int64).max
            c = np.where(known[at] == g, n[at], never) if len(known) else np.full(len(g), never)
            rarest = np.lib.stride_tricks.sliding_window_view(c, per).argmin(1) + np.arange(len(g) - per + 1)
            g = g[rarest[c[rarest] < never]]
        g = np.unique(g)
        keys.append(g)
        items.append(np.full(len(g), item, np.int64))
    k, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, items))
    order = np.lexsort((v, k))
    return k[order], v[order]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", runs: bool = False, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, identity, run) of documents that hold ``GRAM`` consecutive words of an item and align with it.

    ``score`` is that of the best local alignment (match 2, mismatch -1, gap -1), at least ``least``;
    ``identity`` the score by twice the item's words, ``run`` the most consecutive words in common. With
    ``runs``, documents without ``RUN`` consecutive words in common may be left out.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text") != "")
    its = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.col("text") != "")
    r = rules()
    words = Words(Canonicaliser(r))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out: DataFrame | None = None
    for block in _blocks(its, words):
        texts = [w for _, w in block if len(w) >= RUN]
        ids = [i for i, w in block if len(w) >= RUN]
        if not ids:
            continue
        row, g = words.grams([" ".join(w) for w in texts])
        grams = np.split(g, np.flatnonzero(row[1:] != row[:-1]) + 1)
        hits, counts = _hits(src, g, r), None
        if runs:
            hits = written(hits, "leak-hits")
            # at most as many rows as the block has n-grams
            df = hits.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("g")
            counts = df["g"].to_numpy(np.int64), df["n"].to_numpy(np.int64)
        code = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        coded = [np.array([code[w] for w in t], np.int32) for t in texts]
        bc, key = spark.sparkContext.broadcast((_seeds(grams, counts), code, coded)), uuid.uuid4().hex
        # pairs are spread over all tasks whatever documents they come from
        pairs = hits.mapInArrow(_candidates(bc, key), "doc_id long, item int, words binary").repartition(tasks, "doc_id", "item")
        found = pairs.mapInArrow(_aligner(bc, ids), "doc_id long, item_id long, score long, identity double, run long").filter(F.col("score") >= least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score long, identity double, run long")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("identity").alias("identity"), F.max("run").alias("run"))


def _candidates(bc, key: str):  # noqa: ANN001, ANN202
    """Documents with seeds -> one row for each item they may hold, with the document's words near the item's."""
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (seeds, of), code, coded = bc.value
        for b in batches:
            rows = []
            for doc, grams, plain in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                g = np.asarray(grams, np.int64)
                lo, hi = np.searchsorted(seeds, g), np.searchsorted(seeds, g, "right")
                near = sorted({int(i) for x, y in zip(lo.tolist(), hi.tolist(), strict=True) if x < y for i in of[x:y]})
                if not near:
                    continue
                d = np.array([code.get(w, -1) for w in _apart.split(plain) if w], np.int32)
                for i in near:
                    # words of the item in the document; what lies further than the item is long from any cannot align
                    rows.append((doc, i, _near(d, np.flatnonzero(np.isin(d, coded[i])), len(coded[i])).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _aligner(bc, ids: list[int]):  # noqa: ANN001, ANN202
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int64()), ("identity", pa.float64()), ("run", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = bc.value[2]
        for b in batches:
            items = b.column(1).to_pylist()
            score, longest = align([(coded[i], np.frombuffer(w, np.int32)) for i, w in zip(items, b.column(2).to_pylist(), strict=True)])
            whole = np.array([MATCH * len(coded[i]) for i in items])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ids[i] for i in items], pa.int64()), pa.array(score), pa.array(score / whole) if len(items) else pa.array([], pa.float64()), pa.array(longest)], schema=schema)

    return run


def _near(d: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The document's words without stretches of more than 3n words none of which is the item's.

    Such a gap costs more than the whole item can score, so no alignment crosses it.
    """
    if len(at) == 0:
        return d[:0]
    breaks = np.flatnonzero(np.diff(at) > 3 * n)
    parts = []
    for lo, hi in zip(np.r_[at[0], at[breaks + 1]], np.r_[at[breaks], at[-1]], strict=True):
        parts += [d[lo : hi + 1], np.full(3 * n, -1, np.int32)]
    return np.concatenate(parts)


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, **columns: str) -> DataFrame:
    """(doc_id, item_id) with at least ``run`` (>= 13) consecutive words in common; the exact check follows the alignment."""
    return leaks(docs, items, **columns, runs=True).filter(F.col("run") >= run).select("doc_id", "item_id")
