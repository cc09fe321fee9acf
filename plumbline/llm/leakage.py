"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

Looking for a short set (a passage of an item) inside a much larger one (a document) with MinHash is
hopeless while the sizes differ: the Jaccard similarity of a passage of 20 shingles and a document of
ten thousand is near zero even if the passage is wholly contained. So passages are partitioned by
size, the number of their word shingles, and for each size class documents are cut to windows little
larger than the class. A containment of t then is a Jaccard similarity of t n / (n + w - t n) for n
shingles in windows of w, and bands and rows of the signatures follow from it and a target recall.

Two kinds of passages are sought:

- whole items, in classes that grow by a quarter, at a containment threshold (contained_items);
- every run of ``min_run`` words of an item (leaked_items). They have one size, windows have that very
  size, containment is wanted in full, so the similarity is 1: one band of one row misses nothing.
  With ``whole_short_items``, shorter items are classes of their own, one for each length.

The index of the passages is a table made by tasks; of it the driver sees the size classes and a bit
map of bounded size, which is sent out. Documents are read once, in whole, in no shuffle; only stretches
whose signatures hit the bit map leave the pass, are joined with the index by band, and are verified by
exact containment of the passage's shingles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import ceil, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import broadcast_if_small, cut

#: The bit map of all keys has 64 bits a key, at most 2 ** MOST_BITS (16 MB); fuller ones filter less.
MOST_BITS = 27
#: A stretch of a document that leaves the pass has at most so many windows; longer ones are divided.
STRETCH = 48
#: Words that are hashed at once.
BATCH_WORDS = 500_000
MOST_HASHES = 64

_WORD = re.compile(r"[^\W_]+")
_DIVIDED = re.compile(r"(?<=[^\W_])[-\u2010\u2011][^\S\r\n]*(?:\r\n|[\r\n\x0b\x0c\x85\u2028\u2029])\s*(?=[^\W_])")
_SOFT = re.compile(r"\xad(?=\s*[\r\n])")
# The format characters (general category Cf) of the basic plane and its tags, the
# variation selectors and the blank letters.
_INVISIBLE = re.compile(
    r"[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
    r"\ufff9-\ufffb\U000e0000-\U000e0fff]"
)


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, regardless of case, punctuation, spacing,
    line breaks (a word divided by a hyphen at a line end is one), compatibility form and invisible
    characters."""
    if not text:
        return []
    if text.isascii():
        if "-" in text:
            text = _DIVIDED.sub("", text)
        return _WORD.findall(text.lower())
    # A soft hyphen is visible at a line's end only; no invisible character may stand after a hyphen.
    text = _INVISIBLE.sub("", _SOFT.sub("-", text))
    text = _DIVIDED.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))


class _Ids(dict):
    """Stable 64-bit numbers of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        n = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return n


_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by minima of 1, 2, 4 ... of them."""
    if len(h) < width:
        return h[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


@dataclass(frozen=True)
class SizeClass:
    """Passages of ``low`` to ``high`` shingles, sought in windows of ``window`` shingles, one every
    ``stride``, by signatures of ``bands`` bands of ``rows`` MinHash values."""

    low: int
    high: int
    window: int
    stride: int = 1
    bands: int = 1
    rows: int = 1

    @staticmethod
    def of(size: int, threshold: float, recall: float) -> SizeClass:
        """The class of passages of this size that are to be found at this containment."""
        high = 4
        while high < size:
            low, high = high + 1, high + max(1, high // 4)
        low = low if high > 4 else 1
        stride = max(1, high // 4)
        window = high + stride - 1  # every run of ``high`` shingles lies in a window
        jaccard = threshold * low / (low + window - threshold * low)
        best = (ceil(log1p(-recall) / log1p(-min(jaccard, 0.999))), 1)
        for rows in (2, 3, 4):
            bands = ceil(log1p(-recall) / log1p(-min(jaccard, 0.999) ** rows))
            if bands * rows <= MOST_HASHES:
                best = (bands, rows)
        return SizeClass(low, high, window, stride, *best)

    def keys(self, h: np.ndarray, window: int, stride: int) -> np.ndarray:
        """(windows, bands): the signatures of windows over shingle hashes; _NONE where there is no shingle."""
        out = []
        for band in range(self.bands):
            key = np.uint64((self.high * 1000003 + band) * 2654435761 % 2**64)
            for row in range(self.rows):
                salted = h if band == row == 0 else np.where(h == _NONE, _NONE, _mixed(h ^ np.uint64((band * self.rows + row) * 0x9E3779B97F4A7C15 % 2**64)))
                least = minima(salted, window)[::stride]
                key = (key + least) * _MULT
            key = _mixed(key)
            out.append(np.where(least == _NONE, _NONE, key))
        return np.stack(out, axis=1)


def shingle_hashes(ids: np.ndarray, shingle: int) -> np.ndarray:
    n = max(0, len(ids) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(shingle):
        h = h * _MULT + ids[i : i + n]
    return _mixed(h)


@dataclass(frozen=True)
class Search:
    """What is sought: runs of min_run words of the items, or whole items (min_run None)."""

    shingle: int
    min_run: int | None
    threshold: float
    recall: float
    whole_short_items: bool

    def size_class(self, size: int) -> SizeClass:
        return SizeClass(size, size, size) if self.min_run is not None else SizeClass.of(size, self.threshold, self.recall)

    def passages(self, n_words: int) -> tuple[int, int]:
        """(number of passages, words of each) of an item."""
        if n_words < self.shingle or (self.min_run is not None and n_words < self.min_run and not self.whole_short_items):
            return 0, 0
        words = n_words if self.min_run is None else min(n_words, self.min_run)
        return n_words - words + 1, words


def _index(items: DataFrame, id: str, text: str, s: Search) -> DataFrame:
    """(key, item_id, at, size, of, passage, shingles): a row per passage and band; ``at`` numbers the
    passages of an item, ``size`` and ``of`` count the shingles of the passage and of the item."""
    rows = items.select(F.col(f"`{id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id is not null and text is not null").distinct()
    kind = dict(rows.dtypes)["item_id"]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for b in batches:
            for item, t in zip(b["item_id"], b["text"]):
                w = words_of(t)
                n, words = s.passages(len(w))
                if not n:
                    continue
                size = words - s.shingle + 1
                h = shingle_hashes(np.fromiter(map(ids.__getitem__, w), np.uint64, len(w)), s.shingle)
                keys = s.size_class(size).keys(h, size, 1).view(np.int64)
                pieces = [f" {' '.join(w[i : i + s.shingle])} " for i in range(len(h))]
                for a in range(0, n, 10_000):  # an item may be very long
                    at = range(a, min(n, a + 10_000))
                    yield pd.DataFrame({
                        "keys": list(keys[at.start : at.stop]), "item_id": [item] * len(at), "at": list(at), "size": size, "of": len(h),
                        "passage": [f" {' '.join(w[i : i + words])} " for i in at], "shingles": [sorted(set(pieces[i : i + size])) for i in at],
                    })

    made = rows.mapInPandas(make, f"keys array<long>, item_id {kind}, at int, size int, of int, passage string, shingles array<string>")
    return made.select(F.explode("keys").alias("key"), *made.columns[1:])


def _bit_map(index: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every key, put together by an aggregation."""
    bits = max(16, min(MOST_BITS, (index.count() * 64).bit_length()))
    lead = F.shiftrightunsigned("key", 64 - bits)
    words = index.select(F.shiftright(lead, 6).alias("w"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % f"shiftrightunsigned(key, {64 - bits})").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (MOST_BITS - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def _stretches(docs: list, words: list[list[str]], ids: _Ids, classes: list[SizeClass], shingle: int, bit_map: np.ndarray) -> Iterator[tuple]:
    """(doc, keys, stretch) of the windows whose signatures hit the bit map, neighbours put together."""
    pad = max(c.window for c in classes) + shingle  # no window reaches from one document into another
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + pad) - lengths - pad
    doc = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = starts[doc] + inside
    flat = np.zeros(int((lengths + pad).sum()), np.uint64)
    flat[at] = np.fromiter(map(ids.__getitem__, (x for w in words for x in w)), np.uint64, len(doc))
    h = shingle_hashes(flat, shingle)
    ok = np.zeros(len(h), bool)
    ok[at[inside <= lengths[doc] - shingle]] = True
    h[~ok] = _NONE
    shift = np.uint64(64 - len(bit_map).bit_length() - 5)
    for c in classes:
        keys = c.keys(h, c.window, c.stride)
        lead = keys >> shift
        hit = ((bit_map[lead >> np.uint64(6)] >> (lead & np.uint64(63))) & np.uint64(1)).astype(bool) & (keys != _NONE)
        where = np.flatnonzero(hit.any(axis=1))
        if not len(where):
            continue
        owner = np.searchsorted(starts, where * c.stride, side="right") - 1
        owner = np.where(where * c.stride >= starts[owner] + lengths[owner], owner + 1, owner)  # starts in the gap before
        new = np.flatnonzero(np.diff(where, prepend=-2) > 1)
        cuts = sorted({*new.tolist(), *(np.flatnonzero(np.diff(owner, prepend=-1)).tolist()), *(x for a, b in zip(new, [*new[1:], len(where)]) for x in range(a, b, STRETCH))})
        for a, b in zip(cuts, [*cuts[1:], len(where)]):
            w, rows = where[a:b], slice(a, b)
            d = int(owner[a])
            if d >= len(words):
                continue
            first = max(0, int(w[0]) * c.stride - int(starts[d]))
            last = int(w[-1]) * c.stride - int(starts[d]) + c.window + shingle - 1
            found = np.unique(keys[where[rows]][hit[where[rows]]]).view(np.int64)
            yield docs[d], found.tolist(), f" {' '.join(words[d][first:last])} "


def containment_search(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, s: Search) -> DataFrame:
    """(doc_id, item_id, at, size, of, containment) of every passage that a stretch of a document
    contains at the threshold, verified on the shingles; runs of words in order, too."""
    spark = documents.sparkSession
    index = cut(_index(items, item_id, item_text, s))
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    classes = sorted({s.size_class(r[0]) for r in index.select("size").distinct().collect()}, key=lambda c: c.high)  # as many as there are sizes
    sent = spark.sparkContext.broadcast(_bit_map(index)) if classes else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()

        def found(docs: list, words: list[list[str]]) -> pd.DataFrame:
            out = list(_stretches(docs, words, ids, classes, s.shingle, sent.value)) if classes and docs else []
            return pd.DataFrame(out, columns=["doc_id", "keys", "stretch"])

        for b in batches:
            docs, words, n = [], [], 0
            for d, t in zip(b["doc_id"].tolist(), b["text"]):
                w = words_of(t)
                if len(w) < s.shingle:
                    continue
                docs.append(d)
                words.append(w)
                n += len(w)
                if n > BATCH_WORDS:
                    yield found(docs, words)
                    docs, words, n = [], [], 0
            yield found(docs, words)

    hits = rows.mapInPandas(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, keys array<long>, stretch string")
    met = hits.select("doc_id", "stretch", F.explode("keys").alias("key")).join(broadcast_if_small(index), "key")
    shared = F.size(F.filter("shingles", lambda x: F.col("stretch").contains(x)))
    met = met.withColumn("containment", shared / F.size("shingles")).where(F.col("containment") >= s.threshold)
    if s.min_run is not None:  # the same shingles in another order are no run
        met = met.where(F.col("stretch").contains(F.col("passage")))
    return met.select("doc_id", "item_id", "at", "size", "of", "containment")


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_run: int = 12,
    shingle: int = 5,
    whole_short_items: bool = False,
) -> DataFrame:
    """The runs of ``min_run`` words that a document and an item share; see containment_search."""
    if not 1 <= shingle <= min_run:
        raise ValueError("shingle must be between 1 and min_run")
    return containment_search(documents, items, doc_id, text, item_id, item_text, Search(shingle, min_run, 1.0, 1.0, whole_short_items))


def leaked_items(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id) of every document that shares a run of at least ``min_run`` words with an item.

    Options are those of leaked_passages. Null and blank texts match nothing, nor do items with fewer
    words, unless ``whole_short_items``: then an item of ``shingle`` to ``min_run - 1`` words matches
    where it is contained whole. Repeated rows give one row, rows without id none; other columns
    aren't read; an empty table gives no rows.
    """
    return leaked_passages(documents, items, **options).select("doc_id", "item_id").distinct()


def leak_shares(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, shared_shingles, item_shingles, containment): as leaked_items, with the number
    of the item's shingles (by place) that lie in runs shared with the document, and their share."""
    runs = leaked_passages(documents, items, **options)
    each = runs.select("doc_id", "item_id", "of", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("place")).distinct()
    n = each.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_shingles"), F.max("of").alias("item_shingles"))
    return n.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def contained_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    recall: float = 0.99,
) -> DataFrame:
    """(doc_id, item_id, containment) of items whose distinct shingles lie to at least ``threshold`` in
    one stretch of a document: the greatest share found. The share ``recall`` of the pairs at the very
    threshold is found, and more of closer ones. Dirty rows as in leaked_items."""
    if shingle < 1 or not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("shingle, threshold or recall out of range")
    found = containment_search(documents, items, doc_id, text, item_id, item_text, Search(shingle, None, threshold, recall, True))
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
