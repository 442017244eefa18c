"""One consistent form for texts that look the same.

Look-alike classes are the transitive closure, by union-find over code points and strings, of
three relations: compatibility forms that keep the look (full width, ligatures, fonts, kinds of
blank), canonical composition, and letters or signs that look the same. The last are those of the
table below and of the public table of confusable characters (Unicode Technical Standard 39), which
is read from the ICU library that Spark ships. A character has one relation only: that of the table
below, else its decomposition, else the public table's. Each class has a representative chosen by
frequency in the corpus; an Aho-Corasick automaton rewrites members to representatives, the longest
match first. Invisible characters are removed.

Of the public table are left out, since they are real differences here or would change what is a
word: characters of ASCII, which never come together; right-to-left scripts, whose letters are
drawn otherwise beside each other; combining marks; pairs of a letter or digit and a sign, of a
letter and a digit, of two digits of different value, and of two cases of one letter; characters that
look like several (ligatures stay, since Unicode decomposes them), and ``EXCLUDED``.

Letter case, the presence of an accent, the number of blanks and line ends stay as they are.
Null stays null, the empty text stays empty; the form of a form is itself.
"""

from __future__ import annotations

import unicodedata as ud
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Letters and signs of several scripts that look alike; each line is one class.
LOOKALIKES = """
a а ɑ α
b Ь
c с ϲ
d ԁ
e е
g ɡ
h һ
i і ι
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ
s ѕ
u υ ս
v ν ѵ
w ԝ
x х
y у
A А Α
B В Β
C С Ϲ
E Е Ε
F Ϝ
G Ԍ
H Н Η
I І Ι Ӏ
J Ј Ϳ
K К Κ
M М Μ
N Ν
O О Ο Օ
P Р Ρ
Q Ԛ
S Ѕ Տ
T Т Τ
V Ѵ
W Ԝ
X Х Χ
Y Ү Υ
Z Ζ
- ‐ ‑ ‒ – − ˗ ⁃
' ’ ‘ ʼ ′ ʹ ´
" “ ” ″
, ‚
: ∶ ։
/ ∕ ⁄
* ∗
| ∣
~ ∼
< ‹
> ›
· ‧ ∙ ⋅
— ― ─
µ μ
"""

#: Letters whose compatibility form is another drawing of the same letter: they look like neither.
EXCLUDED = set("ſϱϐϑϕϖϰϴϵẛ")

#: Compatibility tags whose forms keep the look of what they decompose to.
TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Format characters that are drawn; the other format characters are invisible.
DRAWN = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


#: Beyond it are only unassigned code points, private use, tags and variation selectors.
LAST = 0x2FA20


def is_invisible(cp: int) -> bool:
    if 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F):
        return True
    return ud.category(chr(cp)) == "Cf" and cp not in DRAWN


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = sorted((a, b), key=lambda s: (len(s), s))
            self.up.setdefault(lo, lo)
            self.up[hi] = lo


def confusables(path: str | None = None) -> dict[str, str]:
    """character -> what it looks like, as the public table has it; the file lies in Spark's ICU library."""
    import glob
    import os
    import struct
    import zipfile

    if path is None:
        import pyspark

        found = glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar"))
        path = (found or glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar")))[0]
    with zipfile.ZipFile(path) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    data = raw[struct.unpack(">H", raw[:2])[0] :]
    keys, n, index, _, text, size = struct.unpack(">6i", data[12:36])
    table = data[text : text + 2 * size].decode("utf-16-be", "surrogatepass")
    units = [data[text + 2 * i : text + 2 * i + 2] for i in range(len(table.encode("utf-16-be", "surrogatepass")) // 2)]
    out = {}
    for k, at in zip(struct.unpack(f">{n}I", data[keys : keys + 4 * n]), struct.unpack(f">{n}H", data[index : index + 2 * n]), strict=True):
        length = (k >> 24) + 1  # a single unit is stored in place of its index
        out[chr(k & 0xFFFFFF)] = chr(at) if length == 1 else b"".join(units[at : at + length]).decode("utf-16-be")
    return out


def _other(ch: str, of: str) -> bool:
    """Whether two characters that are said to look alike stay apart."""
    if ch.isalnum() != of.isalnum() or ud.combining(of) or ud.category(of)[0] == "M" or is_invisible(ord(of)):
        return True
    a, b = ud.numeric(ch, None), ud.numeric(of, None)
    if (a is None) != (b is None) or a != b:
        return True
    return ch.isupper() != of.isupper() and (ch.lower() == of.lower() or ch.upper() == of.upper())


def _public() -> dict[str, str]:
    """The public table without what is left out; where it gathers several characters of ASCII, the one of the same kind."""
    table = confusables()
    ascii_of: dict[str, list[str]] = defaultdict(list)
    for c in map(chr, range(0x21, 0x7F)):
        ascii_of[table.get(c, c)].append(c)
    out = {}
    for ch, of in table.items():
        if ch.isascii() or ch in EXCLUDED or ud.category(ch)[0] in "MC" or ud.bidirectional(ch) in ("R", "AL", "AN"):
            continue
        kind = (lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" if c.isalpha() else "s")
        if of in ascii_of:
            same = [c for c in ascii_of[of] if kind(c) == kind(ch)] or (ascii_of[of] if len(ascii_of[of]) == 1 else [])
            if not same:
                continue
            of = same[0]
        if len(of) == 1 and not _other(ch, of):
            out[ch] = of
    twice = {ch for ch, of in out.items() for c in (ch.lower(), ch.upper()) if c != ch and out.get(c) == of}
    return {ch: of for ch, of in out.items() if ch not in twice}


def _decomposed(ch: str) -> str | None:
    """What a character is composed of, if that looks the same."""
    d = ud.decomposition(ch)
    if not d or ch in EXCLUDED:
        return None
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in TAGS:
            return None
        parts = parts[1:]
    return "".join(chr(int(p, 16)) for p in parts)


def _unfold(ch: str, apart: frozenset[str]) -> str:
    """The decomposition of a character, following only what keeps the look; those ``apart`` stay."""
    if ch in apart:
        return ch
    d = _decomposed(ch)
    if d is None:
        return ch
    out = "".join(_unfold(c, apart) for c in d)
    if out.strip() == "" and out != " ":
        return ch
    if out[0] == " " and len(out) > 1:  # spacing accents
        return ch
    return out


def _clusters(s: str) -> list[str]:
    out: list[str] = []
    for ch in s:
        if out and ud.combining(ch):
            out[-1] += ch
        else:
            out.append(ch)
    return out


@lru_cache(1)
def classes() -> tuple[dict[str, str], dict[str, list[str]]]:
    """``(skeleton of each member, members of each skeleton)``, from the Unicode data and the table above."""
    uf = UnionFind()
    apart: set[str] = set()
    for line in LOOKALIKES.strip().splitlines():
        first, *rest = line.split()
        apart |= set(rest)
        for x in rest:
            uf.union(first, x)
    public, listed = _public(), frozenset(apart)
    unfolded: dict[str, str] = {}
    for cp in range(0x80, LAST):
        ch = chr(cp)
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xDFFF or 0x20000 <= cp < 0x2F800 or is_invisible(cp):
            continue
        if ud.category(ch) == "Zs" or cp in (0x2800, 0x3164, 0xFFA0):
            uf.union(" ", ch)
            continue
        s = _unfold(ch, listed)
        if len(s) > 1:
            unfolded[ch] = s
        elif s != ch:
            uf.union(s, ch)
        elif ch not in listed and ch in public:
            to = _unfold(public[ch], listed)
            if len(to) > 1:
                unfolded[ch] = to
            else:
                uf.union(to, ch)
    # only now that all unions are made are skeletons read off, those of strings character by character
    base = lambda s: ud.normalize("NFD", "".join(uf.find(c) for c in ud.normalize("NFD", s)))
    skeleton = {x: base(uf.find(x)) for x in list(uf.up)}
    for ch, s in unfolded.items():
        sk = base(s)
        skeleton[ch] = sk
        skeleton[sk] = sk
    members: dict[str, list[str]] = defaultdict(list)
    for x, sk in skeleton.items():
        members[sk].append(x)
    same = defaultdict(list)
    for x, sk in skeleton.items():
        if len(x) == 1 and len(sk) == 1:
            same[sk].append(x)
    for sk in [s for s in members if len(s) > 1 and len(_clusters(s)) == 1]:
        head, marks = sk[0], sk[1:]
        for other in same.get(head, ()):  # a base of another script with the same accents
            if (x := other + marks) not in skeleton:
                skeleton[x] = sk
                members[sk].append(x)
    return skeleton, dict(members)


@lru_cache(1)
def invisible_class() -> str:
    return "[" + _ranges(chr(cp) for cp in [*range(0x80, LAST), *range(0xE0000, 0xE0200)] if is_invisible(cp)) + "]+"


def _ranges(chars: Iterable[str]) -> str:
    """The inside of a regular expression's character class."""
    out: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@dataclass(frozen=True)
class Rules:
    """What a worker needs to rewrite: member -> representative, characters that call for work, invisible ones."""

    rewrite: dict[str, str]
    need: str
    invisible: str


def rules(counts: Mapping[str, int] | None = None) -> Rules:
    """Representatives by frequency.

    Of equally frequent members one that is no compatibility form, the shortest, of ASCII, the one with
    most accented forms, so that letters with accents stay single characters, and the least code point.
    """
    counts = counts or {}
    skeleton, members = classes()
    reps: dict[str, str] = {}
    built = _accented()
    for sk, ms in members.items():
        if len(_clusters(sk)) == 1:
            stable = [m for m in {*ms, sk} if ud.normalize("NFC", m) == m]
            reps[sk] = min(stable or [ud.normalize("NFC", sk)], key=lambda m: (-counts.get(m, 0), ud.decomposition(m[0]).startswith("<"), len(m), not m.isascii(), -built[m[0]], m))
    for sk in members:
        if sk not in reps:
            reps[sk] = "".join(reps.get(c, c) for c in _clusters(sk))
    # a representative of several characters is matched too, lest its first one be rewritten
    rewrite = {m: reps[sk] for m, sk in skeleton.items() if len(_clusters(m)) == 1 and (m != reps[sk] or len(m) > 1)}
    touched = {c for m in rewrite for c in m if not c.isascii() or m.isascii()}
    return Rules(rewrite, "".join(sorted(touched | set(_normal_changes()))), invisible_class())


@lru_cache(1)
def _accented() -> Counter[str]:
    """How many characters are composed of each one and a mark."""
    return Counter(d[0] for cp in range(0x80, LAST) if len(d := ud.normalize("NFD", chr(cp))) > 1)


@lru_cache(1)
def _normal_changes() -> str:
    """Characters that normalisation C may join, reorder or replace, and the invisible ones."""
    return "".join(ch for ch in map(chr, [*range(0x80, LAST), *range(0xE0000, 0xE0200)]) if ud.combining(ch) or ud.normalize("NFC", ch) != ch or 0x1161 <= ord(ch) <= 0x11C2 or is_invisible(ord(ch)))


class Canonicaliser:
    def __init__(self, r: Rules | None = None) -> None:
        import re

        import ahocorasick

        r = r or rules()
        self.auto = ahocorasick.Automaton()
        for m, to in r.rewrite.items():
            self.auto.add_word(m, (len(m), to))
        self.auto.make_automaton()
        self.drop = re.compile(r.invisible)
        self.ascii_changes = any(m.isascii() for m in r.rewrite)
        self.need = frozenset(r.need)
        self.beyond = re.compile("[^\\x00-\\x7f]+")
        self._word = lru_cache(1 << 16)(self._rewrite)

    def _rewrite(self, s: str) -> str:
        s = ud.normalize("NFC", self.drop.sub("", s))
        out, at = [], 0
        for end, (n, r) in self.auto.iter_long(s):
            out += (s[at : end + 1 - n], r)
            at = end + 1
        if at:
            s = ud.normalize("NFC", "".join(out) + s[at:])
        return s

    def form(self, text: str | None) -> str | None:
        if text is None or (text.isascii() and not self.ascii_changes):
            return text
        if self.need.isdisjoint(text if self.ascii_changes else "".join(self.beyond.findall(text))):
            return text
        # no pattern holds a line end or, beyond its own, a blank: words can be rewritten one by one
        return "\n".join(self._line(x) if self.ascii_changes or not x.isascii() else x for x in text.split("\n"))

    def _line(self, line: str) -> str:
        return " ".join((self._word(x) if len(x) < 64 else self._rewrite(x)) if self.ascii_changes or not x.isascii() else x for x in line.split(" "))


class _Counter:
    def __init__(self, members: list[str], invisible: str) -> None:
        import re

        import ahocorasick

        self.ascii = [m for m in members if len(m) == 1 and m.isascii()]
        self.auto = ahocorasick.Automaton()
        for m in members:
            if not m.isascii():
                self.auto.add_word(m, m)
        self.auto.make_automaton()
        self.drop = re.compile(invisible)

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        words: dict[str, int] = defaultdict(int)

        def fold() -> None:
            for w, n in words.items():
                for _, m in self.auto.iter_long(ud.normalize("NFC", self.drop.sub("", w))):
                    counts[m] += n
            words.clear()

        for b in batches:
            whole = "\n".join(t for t in b.column(0).to_pylist() if t)
            for m in self.ascii:
                counts[m] += whole.count(m)
            for line in whole.split("\n"):
                if not line.isascii():
                    for w in line.split(" "):
                        if not w.isascii():
                            words[w] += 1
            if len(words) > 200_000:
                fold()
        fold()
        yield pa.RecordBatch.from_pydict({"member": list(counts), "n": list(counts.values())}, schema=pa.schema([("member", pa.string()), ("n", pa.int64())]))


def corpus_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each class member occurs in all of ``docs``.

    What reaches the driver is bounded by the number of members, some thousands, whatever the corpus.
    """
    members, invisible = list(classes()[0]), invisible_class()
    bc = docs.sparkSession.sparkContext.broadcast((members, invisible))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return held("counter", lambda: _Counter(*bc.value)).run(batches)

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r.member: r.n for r in rows}


_held: dict[str, object] = {}


def held(key: str, make):  # noqa: ANN001, ANN201
    """One value of a kind per worker process, kept between tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _halves(h: bytes) -> tuple[int, int]:
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def fingerprints(docs: DataFrame, counts: Mapping[str, int] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, c1, c2, r1, r2): 128-bit hashes of the consistent form and of the stored text.

    Null and empty texts have no row.
    """
    bc = docs.sparkSession.sparkContext.broadcast(rules(counts))
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        form = held(key, lambda: Canonicaliser(bc.value)).form
        for b in batches:
            cols: list[list[int]] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                r = xxhash.xxh3_128_digest(t)
                f = form(t)
                c = r if f == t else xxhash.xxh3_128_digest(f)
                for col, v in zip(cols, (*_halves(c), *_halves(r)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "c1", "c2", "r1", "r2"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text") != "")
    return src.mapInArrow(run, "doc_id long, c1 long, c2 long, r1 long, r2 long")


def lookalike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with text: (doc_id, class_id, n_variants of the class as stored, n_links).

    ``n_links`` counts the documents of the class that are stored otherwise. A class that holds very many
    documents is met by one row of counts per variant, so adaptive execution can split it.
    """
    fp = written(fingerprints(docs, corpus_counts(docs, text), doc_id, text), "lookalike")
    variants = fp.groupBy("c1", "c2", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))
    whole = variants.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("all"))
    per = variants.join(whole.hint("merge"), ["c1", "c2"]).select("c1", "c2", "r1", "r2", "n_variants", (F.col("all") - F.col("n")).alias("n_links"))
    return fp.join(per.hint("merge"), ["c1", "c2", "r1", "r2"]).select("doc_id", F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")).alias("class_id"), "n_variants", "n_links")


def lookalike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that differ as stored and agree in their consistent form.

    Pairs are formed between the stored variants of a class first, so no step is larger than the
    result: documents with the same stored text never meet. Only where an id has several texts can a
    pair come about twice; it is then reported once.
    """
    fp = written(fingerprints(docs, corpus_counts(docs, text), doc_id, text), "lookalike")
    per = fp.groupBy("c1", "c2").agg(F.min("r1").alias("lo1"), F.max("r1").alias("hi1"), F.min("r2").alias("lo2"), F.max("r2").alias("hi2"))
    multi = per.filter("lo1 <> hi1 or lo2 <> hi2").select("c1", "c2")
    # merge joins: what adaptive execution would broadcast grows with the corpus
    rows = written(fp.join(multi.hint("merge"), ["c1", "c2"], "left_semi").filter("doc_id is not null").distinct(), "lookalike-multi")
    var = rows.select("c1", "c2", "r1", "r2").distinct()
    a, b = var.select("c1", "c2", F.col("r1").alias("a1"), F.col("r2").alias("a2")), var.select("c1", "c2", F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    pairs = a.join(b.hint("merge"), ["c1", "c2"]).filter("a1 < b1 or (a1 = b1 and a2 < b2)")
    da = rows.select("c1", "c2", F.col("r1").alias("a1"), F.col("r2").alias("a2"), F.col("doc_id").alias("da"))
    db = rows.select("c1", "c2", F.col("r1").alias("b1"), F.col("r2").alias("b2"), F.col("doc_id").alias("db"))
    out = pairs.join(da.hint("merge"), ["c1", "c2", "a1", "a2"]).join(db.hint("merge"), ["c1", "c2", "b1", "b2"])
    out = out.filter("da <> db").select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if several.isEmpty() else out.distinct()
