"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, units and names (capitalised words inside a sentence) turn into the typed
placeholders <num>, <unit> and <name>, runs of one placeholder count once, and other words stay, lower-cased and without
punctuation.  Windows of template tokens of benchmark items and documents are joined by hash, in shuffles:

1. Items give a table of window hashes.  Documents give the windows whose hashes pass a bitmap of the items' (of SIEVE bits, whatever the size of the
   benchmark), with their places and slot values.
2. An item that is found needs several of its windows, so its most frequent ones can be left out of the search for candidates.
   Pairs of a text and an item are those that share one of the others; each text counts a window once, and the items' side
   stands in PARTS copies, so that a window in very many texts is dealt to tasks.
3. Only for candidates all windows of the item are looked up in the text, by text and hash.

For each (text, item) the joined windows that lie on one diagonal are aligned; the alignment tells how many of the item's tokens the
text covers and which value each slot of the item has there.  Slots are consistent if equal values of the item are
equal in the text and different ones differ; a window whose slots break the consistency of the alignment is not counted.
An item whose slot values all agree is found verbatim, else re-parameterised.

Windows of mostly slots say little by themselves.  Such a window is a hit if its slot values agree as well, or if it is joined
as part of a longer span (of up to SPAN tokens of the item) that has as many words as a window of mostly words.  So items
with too few words for that are found with their own values only.

Null and empty texts contain nothing; items of fewer than LEAST template tokens are no evidence and are never found; items
shorter than a window are one window.  Equal texts are looked at once, and each of their rows, and each of the rows of equal items, has its
own results; rows with a null id are reported with it; ids may be of any type; other columns are ignored, whatever their names.  An
empty benchmark or table gives no rows.  Texts are scanned whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEP_LUT, BROADCAST_IDS, Words, arrow_map, discard, hash_words, mix64, pieces, shingle_hashes, stored, texts_of, within

WINDOW, LEAST = 6, 4
#: Longest span that a window of mostly slots is joined with.
SPAN = 12
#: A document holds an item if it covers this share of its tokens, or so many of them.
COVERAGE, COVERED = 0.5, 24
#: Bits of the bitmap that documents' windows have to pass (4 MB), and copies of the items' side of a join.
SIEVE, PARTS = 1 << 25, 16

#: Words of measurement.
UNITS = (
    "mm cm m km in ft yd mile miles meter meters metre metres inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons"
    " ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " mph kmh kph dollar dollars cent cents euro euros usd eur percent degree degrees kb mb gb tb hz khz mhz ghz w kw watt watts volt volts"
).split()
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003))
_UNIT_HASHES = np.sort(hash_words(UNITS))
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:;|\n\r\"'([{*-"]] = True


class Templates:
    """Template tokens of some texts: hash, slot value (0 for words), and per text the first token and their number."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, ALNUM_SEP_LUT)
        n = len(w.hash)
        text = np.repeat(np.arange(len(texts)), w.n)
        first = w.raw[w.starts] if n else np.empty(0, np.uint8)
        after = w.raw[np.minimum(w.starts + 1, len(w.raw) - 1)]
        digit = (first >= 48) & (first < 58) & (w.buf[w.ends - 1] >= 48) & (w.buf[w.ends - 1] < 58)
        upper = ((first >= 65) & (first < 91)) | ((first == 0xC3) & (after >= 0x80) & (after < 0x9F))
        upper &= ((after >= 97) & (after < 123) | (after >= 0x80)) & (w.ends - w.starts > 1)  # all capitals are no name
        one, two = w.raw[np.maximum(w.starts - 1, 0)], w.raw[np.maximum(w.starts - 2, 0)]
        opens = (w.starts <= w.text_at[text] + 1) | _SENTENCE_END[one] | _SENTENCE_END[two]
        unit = np.isin(w.hash, _UNIT_HASHES) & np.concatenate(([False], digit[:-1] & (text[1:] == text[:-1]))) if n else np.empty(0, bool)
        token = np.where(digit, _NUM, np.where(unit, _UNIT, np.where(upper & ~opens, _NAME, w.hash)))
        slot = digit | unit | (upper & ~opens)
        keep = np.ones(n, bool)
        if n:
            keep[1:] = ~(slot[1:] & (token[1:] == token[:-1]) & (text[1:] == text[:-1]))
        at = np.flatnonzero(keep)
        self.hash = token[at]
        # A slot's value is that of all words of its run.
        with np.errstate(over="ignore"):
            self.value = np.where(slot[at], np.add.reduceat(mix64(w.hash), at) | np.uint64(1), np.uint64(0)) if n else np.empty(0, np.uint64)
        bounds = np.searchsorted(text[at], np.arange(len(texts) + 1))
        self.first, self.n = bounds[:-1], np.diff(bounds)
        self.text = text[at]


def _exact(t: Templates) -> np.ndarray:
    """Hash of each token with its slot value."""
    with np.errstate(over="ignore"):
        return mix64(t.hash + t.value * np.uint64(0x9E3779B97F4A7C15))


def _spans(value: np.ndarray, width: int) -> list[tuple[int, int, bool]]:
    """(place, tokens, whether slot values are part of the hash) of the windows and longer spans that an item is looked for by; value: its slot values, 0 for words."""
    words = np.append(0, np.cumsum(value == 0))
    plain = 2 * (words[width:] - words[:-width]) >= width
    spans = {(p, width, False) for p in np.flatnonzero(plain).tolist()}
    for p in np.flatnonzero(~plain).tolist():
        spans.add((p, width, True))
        spans.update(_with_words(words, p, width))
    return sorted(spans)


def _with_words(words: np.ndarray, p: int, width: int) -> list[tuple[int, int, bool]]:
    """The shortest span of up to SPAN tokens that holds the window at p and as many words as a window of mostly words, if there is one; words: their running number."""
    for w in range(width + 1, min(SPAN, len(words) - 1) + 1):
        for a in range(max(p + width - w, 0), min(p, len(words) - 1 - w) + 1):
            if 2 * (words[a + w] - words[a]) >= WINDOW:
                return [(a, w, False)]
    return []


def item_windows(texts: list[bytes]):
    """(text, tokens, width, slot values, [(hash, place, tokens, with values)], windows that may be left out) of each text of LEAST tokens or more."""
    t = Templates(texts)
    exact = _exact(t)
    for k, (a, n) in enumerate(zip(t.first, t.n, strict=True)):
        if n < LEAST:
            continue
        width, value, hashes, rows = min(WINDOW, int(n)), t.value[a : a + n], {}, []
        for p, w, values in _spans(value, width):
            if (w, values) not in hashes:
                hashes[w, values] = shingle_hashes((exact if values else t.hash)[a : a + n], w)
            rows.append((int(hashes[w, values][p]), p, w, values))
        need = min(COVERED, COVERAGE * int(n))
        yield k, int(n), width, value, rows, math.ceil(need / max(w for _, _, w, _ in rows)) - 1


def document_windows(texts: list[bytes], kinds: list[tuple[int, bool]], sieve: np.ndarray):
    """(text, hash, place, slot values) of each window of the kinds that passes the sieve; kinds: (tokens, with values)."""
    t = Templates(texts)
    exact = _exact(t) if any(values for _, values in kinds) else None
    for w, values in kinds:
        h = shingle_hashes(exact if values else t.hash, w)
        place = h >> np.uint64(39)
        at = np.flatnonzero((sieve[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
        at = at[t.text[at] == t.text[at + w - 1]] if len(at) else at
        if len(at):
            yield t.text[at], h[at], at - t.first[t.text[at]], t.value[at[:, None] + np.arange(w)]


def align(n: int, width: int, value, hits) -> tuple[int, int, bool] | None:
    """(covered tokens, windows, verbatim) of an item in a text, None without enough evidence.

    hits: (place in the item, place in the text, slot values there) of the joined windows and spans.  The union of the item's tokens under
    windows whose slots are consistent counts; the diagonals with most windows set the slots first.
    """
    need = min(COVERED, COVERAGE * n)
    found: dict[tuple[int, int], tuple] = {}
    for p, there, other in hits:  # each window of a longer span is a hit; a window may be hit by several of its rows
        for k in range(len(other) - width + 1):
            found[there - p, p + k] = tuple(other[k : k + width])
    places = sorted({p for _, p in found})
    if sum(min(b - a, width) for a, b in zip(places, places[1:], strict=False)) + width < need:  # tokens under any window: no alignment covers more
        return None
    counts: dict[int, int] = {}
    for d, _ in found:
        counts[d] = counts.get(d, 0) + 1
    there, back, covered, windows, verbatim = {}, {}, np.zeros(n, bool), 0, True
    for d, p in sorted(found, key=lambda x: (-counts[x[0]], x)):
        pairs = [(a, b) for a, b in zip(value[p : p + width], found[d, p], strict=True) if a or b]
        if any(there.get(a, b) != b or back.get(b, a) != a for a, b in pairs):
            continue
        there.update(pairs)
        back.update((b, a) for a, b in pairs)
        verbatim &= all(a == b for a, b in pairs)
        covered[p : p + width] = True
        windows += 1
    total = int(covered.sum())
    return (total, windows, verbatim) if total >= need else None


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    sieve, place = np.zeros(SIEVE >> 6, np.uint64), hashes >> np.uint64(39)
    np.bitwise_or.at(sieve, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    return sieve


class Benchmark:
    """Items in memory: the same search without Spark, for a few texts."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.items, self.rows = ids, {}, {}
        for k, n, width, value, rows, _ in item_windows(texts):
            self.items[k] = n, width, value.tolist()
            for h, p, _, _ in rows:
                self.rows.setdefault(h, []).append((k, p))
        self.n = np.array([self.items[k][0] if k in self.items else 0 for k in range(len(texts))])
        self.kinds = sorted({(w, values) for _, _, _, _, rows, _ in item_windows(texts) for _, _, w, values in rows})
        self.sieve = _bitmap(np.array(list(self.rows), np.uint64))

    def find(self, texts: list[bytes]):
        """(text, item, covered tokens, coverage, windows, verbatim) for each text and item with enough evidence."""
        hits: dict[tuple[int, int], list] = {}
        for who, hashes, places, values in document_windows(texts, self.kinds, self.sieve):
            for doc, h, there, other in zip(who.tolist(), hashes.tolist(), places.tolist(), values.tolist(), strict=True):
                for k, p in self.rows.get(h, ()):
                    hits.setdefault((doc, k), []).append((p, there, other))
        for (doc, k), own in sorted(hits.items()):
            n, width, value = self.items[k]
            found = align(n, width, value, own)
            if found:
                yield doc, k, found[0], found[0] / n, found[1], found[2]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


_ITEMS = "item string, n int, width int, value array<bigint>, spare int, hash array<bigint>, place array<int>, tokens array<int>, exact array<boolean>"


def _item_table(batches):
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        out = [(keys[k], n, width, value.view(np.int64).tolist(), spare, np.array([r[0] for r in rows], np.uint64).view(np.int64).tolist(), *([r[c] for r in rows] for c in (1, 2, 3)))
               for k, n, width, value, rows, spare in item_windows(texts)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in _ITEMS.split(", ")])


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the texts of df; equal texts have one key."""
    return df.select(F.md5(F.col(text_col).cast("string").cast("binary")).alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str) -> DataFrame:
    """(key, item, covered, coverage, windows, verbatim) by the keys of texts and items; stored."""
    spark = docs.sparkSession
    items = stored(arrow_map(_keyed(benchmark, item_text_col).dropDuplicates(["key"]), _item_table, _ITEMS), "items")
    each = items.select("item", "spare", F.explode(F.arrays_zip("hash", "place", "tokens", "exact")).alias("w")).select("item", "spare", "w.*")
    windows = stored(each, "windows")
    kinds = [(r["tokens"], r["exact"]) for r in windows.select("tokens", "exact").distinct().orderBy("tokens", "exact").collect()]
    # The bitmap, 64 hashes a row: at most SIEVE / 64 rows, whatever the number of windows.
    bits = windows.select(F.shiftrightunsigned("hash", 45).alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 39) & 63 AS int))").alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    sieve = np.zeros(SIEVE >> 6, np.uint64)
    sieve[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    spec = spark.sparkContext.broadcast((kinds, sieve))

    def look(batches):
        kinds, sieve = spec.value
        names = ["key", "hash", "there", "other"]
        for batch in batches:
            keys, texts = batch.column(0), texts_of(batch.column(1))
            for i, j in pieces(texts):
                for who, hashes, places, values in document_windows(texts[i:j], kinds, sieve):
                    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
                    other = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * values.shape[1], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(who + i)), _longs(hashes), pa.array(places.astype(np.int32)), other], names=names)

    seen = stored(arrow_map(_keyed(docs, text_col), look, "key string, hash bigint, there int, other array<bigint>"), "seen")

    # Candidates by the rarer windows of each item; the others are only looked up for them.
    often = windows.groupBy("hash").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("often"), "hash", "place"))
    index = windows.join(often, "hash").withColumn("rank", rank).where("rank > spare").select("item", "hash").distinct()
    parted = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part")
    once = seen.select("key", "hash", part).distinct()
    pairs = stored(once.join(parted(index), ["hash", "part"]).select("key", "item").distinct(), "pairs")
    wanted = pairs.select("key", "item", part).join(parted(windows.select("item", "hash", "place")), ["item", "part"]).select("key", "item", "hash", "place")
    hits = wanted.join(seen.dropDuplicates(["key", "hash", "there"]), ["key", "hash"]).groupBy("key", "item").agg(F.collect_list(F.struct("place", "there", "other")).alias("hits"))
    whole = hits.withColumn("part", part).join(parted(items.select("item", "n", "width", "value")), ["item", "part"]).select("key", "item", "n", "width", "value", "hits")

    def judge(batches):
        names = ["key", "item", "covered", "coverage", "windows", "verbatim"]
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                key, item, n, width, value, own = (c[k].as_py() for c in batch.columns)
                found = align(n, width, value, [(h["place"], h["there"], h["other"]) for h in own])
                if found:
                    out.append((key, item, found[0], found[0] / n, found[1], found[2]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=names)

    out = stored(arrow_map(whole, judge, "key string, item string, covered long, coverage double, windows long, verbatim boolean"), "found")
    for table in (items, windows, seen, pairs):
        discard(table)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, covered, coverage, windows, verbatim) for each document that holds a benchmark item; item_col is named item_<item_col> if both are called alike."""
    found = _found(docs, benchmark, text_col, item_text_col)
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = docs.select(F.col(id_col).alias("__id"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("key"))
    items = benchmark.select(F.col(item_col).alias("__item"), F.md5(F.col(item_text_col).cast("string").cast("binary")).alias("item"))
    named = found.join(items, "item").drop("item")
    both = ids.join(F.broadcast(named) if small else named.hint("shuffle_merge"), "key")
    return both.select(F.col("__id").alias(id_col), F.col("__item").alias(item_col if item_col != id_col else f"item_{item_col}"), "covered", "coverage", "windows", "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    leaked = _found(docs, benchmark, text_col, item_text_col).select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit("")))
    return within(keyed, leaked, "__key", "left_anti").drop("__key")
