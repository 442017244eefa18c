"""Encode a whole corpus with a public byte-level BPE tokenizer, reusing what documents share.

Texts are cut into content-defined chunks by a rolling hash. Every distinct chunk of the corpus is
encoded once, its ids go back to the places where it occurs, and the chunks of a document are put
together. (A chunk that holds more than ``HOT`` of a task's chunks is spread by task, so that no task
gets all places of a hot chunk; it is then encoded once a part.) The corpus is read once.

Cuts prefer safe places, where the ids of both sides can simply be joined since the tokenizer's pattern
never spans them: a blank after anything visible, and a sign after an ideograph, kana or Hangul. A
stretch of more than ``MAX_CHUNK`` bytes without a safe place is cut anyway. Such joins are repaired:
pieces of the pattern that a cut went through, or changed, are encoded anew; in a piece that spans
several chunks, a window around each cut is encoded anew and widened until the pairs of ids at both
its edges agree with the ids beside it. Ids of a piece are right if every two neighbours are the ids
of their common bytes, so agreement at the edges is exact; the work is linear in the text's length.

Null and empty texts give an empty list. Rows are kept as they are: repeated rows and repeated or
null ids give one result row each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16  # bytes under the rolling hash
MEAN_CUTS = 40  # admissible places per cut: chunks of about 300 bytes
MAX_CHUNK = 8192
FORCED = 2048  # mean bytes of chunks in a stretch without safe places
#: Above this share of a task's chunks, a chunk's places are spread by task.
HOT, PARTS = 1 / 64, 64
#: Distinct chunks a task remembers.
KEPT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i <= n."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        m = max(n + 1, 1 << 16)
        for name, base in (("p", _P), ("q", _P_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"][: n + 1], _powers["q"][: n + 1]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any window follows in constant time."""
    p, _ = powers(len(data))
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_MIX[data] * p[:-1], out=s[1:])
    return s


def _safe(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` before which and after which ids are those of the whole; none is within a code point."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    blank = np.flatnonzero(_BLANK[data[1:]]) + 1
    before = data[blank - 1]
    wide = before >= 0x80
    ok = _SEEN[before]
    if wide.any():
        w = blank[wide]
        a, b, c = (np.where(w >= k, data[np.maximum(w - k, 0)], 0) for k in (3, 2, 1))
        # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
        space = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        ok[wide] = ~space
    blank = blank[ok]
    # after U+5000..U+9FFF, U+3041..U+3096, U+30A1..U+30FA or U+B000..U+CFFF: a sign of ASCII, U+3001, U+3002 or a full-width one
    at = np.flatnonzero((data[:-3] >= 0xE3) & (data[:-3] <= 0xEC)) if n > 3 else np.zeros(0, np.int64)
    if len(at):
        a, b, c, d = (data[at + k].astype(np.int64) for k in range(4))
        kana = (b << 8) | c
        letter = (a >= 0xE5) & (a <= 0xE9) | (a >= 0xEB) | (a == 0xE3) & ((kana >= 0x8181) & (kana <= 0x8296) | (kana >= 0x82A1) & (kana <= 0x83BA))
        at = at[letter & (_SIGN[d] | (d == 0xE3) | (d == 0xEF))] + 3
        wide = data[at] >= 0x80
        x, y = np.where(at + 1 < n, data[np.minimum(at + 1, n - 1)], 0), np.where(at + 2 < n, data[np.minimum(at + 2, n - 1)], 0)
        first = data[at]
        at = at[~wide | (first == 0xE3) & (x == 0x80) & ((y == 0x81) | (y == 0x82)) | (first == 0xEF) & (x == 0xBC) & ((y == 0x81) | (y == 0x8C) | (y >= 0x9A) & (y <= 0x9B) | (y == 0x9F))]
    return np.union1d(blank, at)


def cut_places(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content-defined cuts within texts that begin at ``starts`` of ``data``: (places, safe)."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    s, (_, q) = rolling(data), powers(n)
    places = _safe(data)
    begin = starts[np.searchsorted(starts, places, "right") - 1]
    places = places[places - begin >= WINDOW]
    h = (s[places] - s[places - WINDOW]) * q[places - WINDOW]
    places = places[(h >> np.uint64(33)) % np.uint64(MEAN_CUTS) == 0]
    bounds = np.union1d(starts, places)
    ends = np.append(bounds[1:], n)
    forced = []
    for b, e in zip(bounds[ends - bounds > MAX_CHUNK].tolist(), ends[ends - bounds > MAX_CHUNK].tolist(), strict=True):
        at = np.arange(b + WINDOW, e)
        at = at[data[at] & 0xC0 != 0x80]  # not within a code point
        hashes = (s[at] - s[at - WINDOW]) * q[at - WINDOW]
        chosen = at[(hashes >> np.uint64(33)) % np.uint64(FORCED) == 0].tolist()
        last = b
        for x in [*chosen, e]:
            while x - last > MAX_CHUNK:
                last += MAX_CHUNK
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                forced.append(last)
            if x < e:
                forced.append(x)
                last = x
    if not forced:
        return places, np.ones(len(places), bool)
    f = np.asarray(forced, np.int64)
    every = np.concatenate([places, f])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([np.ones(len(places), bool), np.zeros(len(f), bool)])[order]


def chunk_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk begins, chunk ends, row of each chunk, begins safely) of a batch; empty texts have no chunk."""
    raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    rows = np.flatnonzero(np.diff(off))
    starts = off[:-1][rows]
    places, safe = cut_places(data, starts)
    begins = np.concatenate([starts, places])
    order = np.argsort(begins, kind="stable")
    begins, safe = begins[order], np.concatenate([np.ones(len(starts), bool), safe])[order]
    return data, begins, np.append(begins[1:], len(data)), rows[np.searchsorted(starts, begins, "right") - 1], safe


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, pos, k1, k2, safe, near, text) of every chunk.

    ``text`` is there the first time a chunk occurs in the task, and for ``near``: chunks of a stretch
    that has joins to repair. ``doc_id`` is there with a text's first chunk. An empty text is a row
    whose position is -1.
    """
    import xxhash

    task = TaskContext.get().partitionId()
    row, part = task << 40, np.int64(task % PARTS + 1)
    seen: set[bytes] = set()
    met: Counter[bytes] = Counter()
    total = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            data, begins, ends, rows, safe = chunk_batch(b.column(1))
            mem = memoryview(data)
            keys = [xxhash.xxh3_128_digest(mem[x:y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(keys)
            total += n
            if len(met) > KEPT:  # a task's memory is bounded; chunks that come again bring their text again
                met.clear()
                seen.clear()
                total = n
            met.update(keys)
            hot = {k for k in keys if met[k] > max(total * HOT, 1000)}
            two = np.frombuffer(b"".join(keys), np.dtype(">i8")).astype(np.int64).reshape(-1, 2).copy()
            spread = np.fromiter((k in hot for k in keys), bool, n) if hot else np.zeros(n, bool)
            two[spread, 1] += part
            near = np.zeros(n, bool)
            if not safe.all():
                group = np.cumsum(safe)
                near = np.isin(group, group[~safe])
            text = []
            for i, (k, x, y) in enumerate(zip(keys, begins.tolist(), ends.tolist(), strict=True)):
                k = (k, True) if spread[i] else k
                if k not in seen:
                    seen.add(k)
                    text.append(bytes(mem[x:y]))
                else:
                    text.append(bytes(mem[x:y]) if near[i] else None)
            first = np.r_[True, rows[1:] != rows[:-1]] if n else np.zeros(0, bool)
            pos = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else rows
            empty = np.setdiff1d(np.arange(b.num_rows), rows)
            # an empty text meets no chunk; the key spreads such rows
            away = (empty + row) * 0x5851F42D
            pad = np.zeros(len(empty), np.int64)
            ids = b.column(0)
            ids = pa.concat_arrays([pa.compute.if_else(pa.array(first), ids.take(pa.array(rows)), pa.scalar(None, pa.int64())) if n else ids.slice(0, 0), ids.take(pa.array(empty))])
            cols = [np.concatenate([rows, empty]) + row, ids, np.concatenate([pos, pad - 1]).astype(np.int32), np.concatenate([two[:, 0], away]), np.concatenate([two[:, 1], pad]), np.concatenate([safe, pad == 0]), np.concatenate([near, pad != 0])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + [pa.array([*text, *[None] * len(empty)], pa.binary())], schema=_PLACES)
            row += b.num_rows


_PLACES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("safe", pa.bool_()), ("near", pa.bool_()), ("text", pa.binary())])


class Encoder:
    """Ids of a text as bytes of unsigned integers; short pieces are kept and not encoded again."""

    KEEP = 1 << 19

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import re

        import tiktoken

        import regex

        e = tiktoken.Encoding("graphloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.one = e.encode_ordinary, e._encode_single_piece
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).finditer
        self.dtype = np.dtype(np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.size[v] = len(k)
        self.pieces = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+").findall
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.plain(text), self.dtype)

    def encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not text.isascii():
            return self.ids(text).tobytes()
        memo, out = self.memo, []
        for p in self.pieces(text):
            x = memo.get(p)
            if x is None:
                x = self.ids(p).tobytes()
                if len(p) < 40:
                    if len(memo) >= self.KEEP:
                        memo.clear()
                    memo[p] = x
            out.append(x)
        return b"".join(out)

    def bpe(self, piece: bytes) -> np.ndarray:
        """Ids of bytes that are one piece of the pattern, or part of one."""
        return np.asarray(self.one(piece), self.dtype)

    def joined(self, parts: list[tuple[bytes | None, bytes, bool]]) -> bytes:
        """The ids of a document from ``(text near a repair, ids, begins safely)`` of its chunks, in order."""
        out: list[bytes] = []
        at = 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and not parts[end][2]:
                end += 1
            out.append(parts[at][1] if end == at + 1 else self._stretch([t or b"" for t, _, _ in parts[at:end]], [i for _, i, _ in parts[at:end]]))
            at = end
        return b"".join(out)

    def _pieces(self, text: bytes) -> np.ndarray | None:
        """Ends of the pattern's pieces in bytes; None if the text holds characters unknown to Unicode's tables here."""
        s = text.decode()
        ends = np.fromiter((m.end() for m in self.split(s)), np.int64)
        if s.isascii():
            return ends
        cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        if any(unicodedata.category(chr(c)) == "Cn" for c in np.unique(cp[cp > 0x7F]).tolist()):
            return None
        size = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        return np.r_[0, np.cumsum(size)][ends]

    def _stretch(self, texts: list[bytes], ids: list[bytes]) -> bytes:
        """The ids of consecutive chunks whose joins are not safe."""
        whole = b"".join(texts)
        ends = self._pieces(whole)
        if ends is None:
            return self.ids(whole.decode()).tobytes()
        starts = np.r_[0, ends[:-1]]
        cuts = np.cumsum([0] + [len(t) for t in texts])
        # where chunk i begins in the ids put end to end, and where each of its tokens begins in the text
        flat = np.frombuffer(b"".join(ids), self.dtype)
        token_at = np.r_[0, np.cumsum(self.size[flat])]
        same = np.zeros(len(starts), bool)  # pieces that a chunk has alike
        for i, t in enumerate(texts):
            own = self._pieces(t) + cuts[i]
            lo, hi = np.searchsorted(starts, cuts[i]), np.searchsorted(ends, cuts[i + 1], "right")
            at = np.searchsorted(own, ends[lo:hi])
            begin = np.r_[cuts[i], own[:-1]]
            at = np.minimum(at, len(own) - 1)
            same[lo:hi] = (own[at] == ends[lo:hi]) & (begin[at] == starts[lo:hi])
        out: list[np.ndarray] = []
        k = 0
        while k < len(starts):
            if same[k]:
                rest = np.flatnonzero(~same[k:])
                to = k + int(rest[0]) if len(rest) else len(starts)
                out.append(flat[np.searchsorted(token_at, starts[k]) : np.searchsorted(token_at, ends[to - 1])])
                k = to
                continue
            a, e = int(starts[k]), int(ends[k])
            marks = [a, *cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, e)].tolist(), e]
            done: list[int] = []
            for x, y in zip(marks, marks[1:], strict=False):
                i = int(np.searchsorted(cuts, x, "right")) - 1
                if x == cuts[i] and y == cuts[i + 1] and len(self._pieces(texts[i])) == 1:
                    new = flat[np.searchsorted(token_at, x) : np.searchsorted(token_at, y)]
                else:
                    new = self.bpe(whole[x:y])
                done = self._meet(done, new.tolist())
            out.append(np.asarray(done, self.dtype))
            k += 1
        return np.concatenate(out).astype(self.dtype).tobytes()

    def _meet(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two halves of a piece: a window around the join is widened until it agrees with both sides."""
        if not left:
            return right
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = left[len(left) - i :] + right[:j]
            mid = self.one(b"".join(self.bytes_of[x] for x in window))
            ok_a = i == len(left) or self._neighbours(left[-i - 1], mid[0])
            ok_b = j == len(right) or self._neighbours(mid[-1], right[j])
            if ok_a and ok_b:
                del left[len(left) - i :]
                left += mid
                left += right[j:]
                return left
            i, j = i if ok_a else 2 * i, j if ok_b else 2 * j

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether two ids are those of their common bytes."""
        return list(self.one(self.bytes_of[a] + self.bytes_of[b])) == [a, b]


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


_held: dict[str, Encoder] = {}


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens; their strings in a text are ordinary text."""
    spark = docs.sparkSession
    bc, key = spark.sparkContext.broadcast((read_vocabulary(vocabulary), pattern)), uuid.uuid4().hex

    def encoder() -> Encoder:
        if key not in _held:
            _held.clear()
            _held[key] = Encoder(*bc.value)
        return _held[key]

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    places = src.mapInArrow(_chunks, "row long, doc_id long, pos int, k1 long, k2 long, safe boolean, near boolean, text binary")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk come one after another, one with its text first: encoded once, its ids go to all."""
        e = encoder()
        last, ids = None, b""
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (3, 4))
            change = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else []
            out: list[bytes | None] = []
            text, pos = b.column(7), b.column(2).to_numpy()
            for x, y in zip(change, [*change[1:], len(k1)], strict=True):
                key = (k1[x], k2[x])
                if key != last:
                    last, ids = key, None if pos[x] < 0 else e.encode(text[x].as_py())
                out += [ids] * int(y - x)
            kept = pa.compute.if_else(b.column(6), text, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(5), kept, pa.array(out, pa.binary())], names=["row", "doc_id", "pos", "safe", "text", "ids"])

    coded = places.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("text").isNull())
    parts = coded.mapInArrow(encode, "row long, doc_id long, pos int, safe boolean, text binary, ids binary")

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        rest: pa.Table | None = None

        def finish(t: pa.Table) -> pa.RecordBatch:
            row = t.column("row").to_numpy()
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            ids = t.column("ids").combine_chunks()
            lens = np.asarray(pa.compute.binary_length(ids).fill_null(0), np.int64)
            data = ids.drop_null()
            flat = np.frombuffer(b"".join(data.to_pylist()), e.dtype)
            ends = np.append(head[1:], len(row))
            total = np.r_[0, np.cumsum(lens)] // e.dtype.itemsize
            safe = t.column("safe").to_numpy()
            lists = [flat[total[a] : total[b]] for a, b in zip(head, ends, strict=True)] if not safe.all() else None
            if lists is None:
                values, off = flat.astype(np.int32), np.append(total[head], total[-1])
            else:
                bad = np.unique(np.searchsorted(head, np.flatnonzero(~safe), "right") - 1)
                for k in bad.tolist():
                    rows = t.slice(head[k], ends[k] - head[k]).select(["text", "ids", "safe"]).to_pylist()
                    lists[k] = np.frombuffer(e.joined([(r["text"], r["ids"], r["safe"]) for r in rows]), e.dtype)
                values, off = np.concatenate(lists).astype(np.int32), np.r_[0, np.cumsum([len(x) for x in lists])]
            doc = t.column("doc_id").combine_chunks().take(pa.array(head))
            return pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))], schema=schema)

        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if not len(t):
                continue
            row = t.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))  # the last text may go on
            rest = t.slice(cut)
            if cut:
                yield finish(t.slice(0, cut))
        if rest is not None and len(rest):
            yield finish(rest)

    return parts.repartition("row").sortWithinPartitions("row", "pos").mapInArrow(assemble, "doc_id long, ids array<int>")
