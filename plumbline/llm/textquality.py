"""Per-document text statistics, and structure by Jensen-Shannon divergence from profiles.

One pass over the whole texts, without a shuffle, gives each document's basic counts and the distributions
of its character classes and function words. A task looks at all texts of an Arrow batch as one array of
code points: classes come from a table, words, lines and their ends from places where classes change, and
function words are told by a hash of their lower-case code points and compared in full. No loop runs over
documents, words or characters.

From the distributions, not from the texts again, come the profiles: documents whose basic counts are
typical of prose in a language, of lists, tables or junk are added up over the whole corpus, on top of a
small fixed prior that also serves where a kind doesn't occur. A document's structure is that of the
profile with the least mean of the two divergences, that of its character classes and that of its
function words (each word of the list, and all other words together).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

#: The list of common words is sent to all tasks; it may hold at most as many.
MAX_WORDS = 100_000
#: Texts that are looked at together, by their characters; a longer one is looked at alone.
BATCH_CHARS = 2_000_000
CLASSES = ("lower", "upper", "letter", "digit", "blank", "line_end", "stop", "mark", "symbol")
STOPS = ".!?\u2026"
# Marks of running text, other than those that end sentences.
MARKS = ",;:'\"()-\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u00ab\u00bb\u00bf\u00a1"
# Characters per hundred of each class, typical of the structure.
PRIOR = {
    "prose": (76, 3, 0.5, 1, 16, 0.5, 1.5, 1.5, 0.1),
    "list": (66, 6, 0.5, 5, 12, 4, 0.5, 4, 2),
    "table": (40, 6, 0.5, 22, 14, 4, 1.5, 3, 9),
    "junk:code": (36, 34, 0.5, 15, 1, 1.5, 0.5, 1.5, 10),
    "junk:marks": (18, 5, 0.5, 6, 18, 3, 30, 6, 13),
}
PRIOR_WEIGHT = 2000
# Separators that str.isspace accepts and that aren't Unicode white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Roles that characters play in counting.
ALNUM, BLANK, LF, CR, STOP, OTHER = range(6)
#: Lower case of these isn't one character for one, or depends on the word.
_ODD_CASE = "\u0130\u03a3"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "letters", "visible", "lines", "stopped", "common")
SHARES = ("mean_word_length", "symbol_ratio", "stop_line_share", "common_word_share")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, role, lower case) of every character; made once per worker."""
    n = 0x110000
    kind, role, lower = np.full(n, CLASSES.index("symbol"), np.uint8), np.full(n, OTHER, np.uint8), np.arange(n, dtype=np.uint32)
    for c in range(n):
        s = chr(c)
        if s.isalpha() or unicodedata.category(s)[0] in "LN":
            role[c] = ALNUM
            kind[c] = 3 if not s.isalpha() else 0 if s.islower() else 1 if s.isupper() else 2
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif s.isspace():
            kind[c] = 5 if s in "\n\r" else 4
            role[c] = LF if s == "\n" else CR if s == "\r" else OTHER if s in _SEPARATORS else BLANK
    for name, chars in (("stop", STOPS), ("mark", MARKS)):
        kind[[ord(x) for x in chars]] = CLASSES.index(name)
    role[[ord(x) for x in STOPS]] = STOP
    return kind, role, lower


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lexicon:
    """A list of words in lower case, to be found among the words of many texts at once."""

    def __init__(self, words: list[str]) -> None:
        self.longest = max(map(len, words), default=0)
        self.ids = {w: i for i, w in enumerate(words, 1)}
        spelled = np.zeros((len(words), self.longest), np.uint32)
        for i, w in enumerate(words):
            spelled[i, : len(w)] = _codes(w)
        hashes = (spelled.astype(np.uint64) * self._powers(self.longest)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.spelled, self.order = hashes[order], spelled[order], order + 1

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = _FACTOR
        return np.cumprod(out, dtype=np.uint64)[:n]

    def find(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The id of each word (a run of codes), or 0. Equal hashes are compared in full."""
        out = np.zeros(len(starts), np.int32)
        may = np.flatnonzero(lengths <= self.longest)
        if not self.longest or not len(may):
            return out
        starts, lengths = starts[may], lengths[may]
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        chars = _tables()[2][codes[np.repeat(starts, lengths) + place]]
        hashes = np.add.reduceat(chars.astype(np.uint64) * self._powers(self.longest)[place], first)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        spelled = np.zeros((len(hit), self.longest), np.uint32)
        column = np.arange(self.longest)
        inside = column < lengths[hit][:, None]
        spelled[inside] = chars[(first[hit][:, None] + column)[inside]]
        hit = hit[(spelled == self.spelled[at[hit]]).all(axis=1)]
        out[may[hit]] = self.order[at[hit]]
        return out


def count_texts(texts: list[str], lexicon: Lexicon, whole: bool) -> dict[str, np.ndarray | list]:
    """COUNTS of each text, and if ``whole`` its distributions: chars (by CLASSES), word_ids, word_counts."""
    n = len(texts)
    kind, role, _ = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, n)
    ends = np.cumsum(sizes)
    starts, codes = ends - sizes, _codes("".join(texts))
    roles = role[codes]

    def per_text(places: np.ndarray) -> np.ndarray:
        """How many of the places, in order, lie in each text."""
        return np.diff(np.searchsorted(places, np.append(starts, len(codes))))

    alnum = roles == ALNUM
    before = np.empty(len(codes), bool)
    before[1:] = alnum[:-1]
    before[starts[sizes > 0]] = False
    after = np.empty(len(codes), bool)
    after[:-1] = alnum[1:]
    after[ends[sizes > 0] - 1] = False
    word = np.flatnonzero(alnum & ~before)
    length = np.flatnonzero(alnum & ~after) - word + 1

    # Among all but blanks, a visible character ends its line if a line end or another text comes next.
    seen = np.flatnonzero(roles != BLANK)
    here = roles[seen]
    breaks = (here == LF) | (here == CR)
    closes = np.append(breaks[1:], True)
    last = np.searchsorted(seen, ends) - 1
    closes[last[last >= 0]] = True
    closing = ~breaks & closes
    ids = lexicon.find(codes, word, length)
    for i in _words_with(codes, word, _ODD_CASE):
        ids[i] = lexicon.ids.get(codes[word[i] : word[i] + length[i]].tobytes().decode("utf-32-le", "surrogatepass").lower(), 0)
    out: dict[str, np.ndarray | list] = {
        "n_words": per_text(word), "letters": per_text(np.flatnonzero(alnum)), "visible": per_text(seen[~breaks]),
        "lines": per_text(seen[closing]), "stopped": per_text(seen[closing & (here == STOP)]), "common": per_text(word[ids > 0]),
    }
    if whole:
        owner = np.repeat(np.arange(n), sizes)
        out["chars"] = list(np.bincount(owner * len(CLASSES) + kind[codes], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)))
        found = word[ids > 0]
        pairs, counts = np.unique((np.searchsorted(ends, found, side="right")) * (len(lexicon.ids) + 1) + ids[ids > 0], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(1, n) * (len(lexicon.ids) + 1))
        out["word_ids"] = np.split((pairs % (len(lexicon.ids) + 1)).astype(np.int32), cuts) if n else []
        out["word_counts"] = np.split(counts, cuts) if n else []
    return out


def _words_with(codes: np.ndarray, word: np.ndarray, chars: str) -> np.ndarray:
    """The words, by number, that hold one of the letters."""
    hit = np.flatnonzero(reduce(np.logical_or, (codes == ord(c) for c in chars)))
    return np.unique(np.searchsorted(word, hit, side="right") - 1)


def listed_words(common_words: DataFrame) -> dict[str, list[str]]:
    """The languages of each common word (lang, word), in lower case; bounded by MAX_WORDS."""
    listed = common_words.select(F.lower("word").alias("word"), "lang").where("word is not null").distinct().limit(MAX_WORDS + 1).collect()
    if len(listed) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    out: dict[str, list[str]] = {}
    for w, lang in sorted(listed, key=str):
        out.setdefault(w, []).append(lang or "")
    return out


def _counted(documents: DataFrame, words: list[str], doc_id: str, text: str, whole: bool) -> DataFrame:
    """doc_id, as text, and what count_texts gives of every text that isn't null."""
    # Ids travel as text, in which a null doesn't turn whole numbers into fractions.
    rows = documents.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    names = [*COUNTS, *(("chars", "word_ids", "word_counts") if whole else ())]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(words)
        for b in batches:
            texts = b["text"].tolist()
            cuts = [0, *np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // BATCH_CHARS)) + 1, len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].tolist(), **count_texts(texts[i:j], lexicon, whole)})[["doc_id", *names]]

    schema = ", ".join(["doc_id string", *(f"{c} long" for c in COUNTS), *(("chars array<long>", "word_ids array<int>", "word_counts array<long>") if whole else ())])
    return rows.mapInPandas(count, schema)


def text_counts(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id, COUNTS, SHARES and ``flags``, how many limits of natural prose it breaks.

    common_words: lang, word. Words are maximal runs of Unicode letters and numbers, lines lie between
    \\n, \\r\\n or \\r, blank ones don't count; visible is what isn't Unicode white space. Null texts give
    no row, blank ones zeros; a mean or a share over nothing is 0. Repeated rows and rows without id are
    kept; other columns aren't read; an empty table gives no rows.
    """
    rows = _counted(documents, list(listed_words(common_words)), doc_id, text, False)
    kind = documents.select(F.col(f"`{doc_id}`")).dtypes[0][1]
    return with_shares(rows).withColumn("flags", flags()).withColumn("doc_id", F.col("doc_id").cast(kind))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def with_shares(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "mean_word_length": _share("letters", "n_words"),
            "symbol_ratio": F.when(F.col("visible") > 0, (F.col("visible") - F.col("letters")) / F.col("visible")).otherwise(0.0),
            "stop_line_share": _share("stopped", "lines"),
            "common_word_share": _share("common", "n_words"),
        }
    )


def flags() -> Column:
    """How many of the five limits of natural prose a document breaks."""
    return sum(
        (
            F.when(x, 1).otherwise(0)
            for x in (
                F.col("n_words") < 25,
                (F.col("mean_word_length") < 3) | (F.col("mean_word_length") > 8),
                F.col("symbol_ratio") > 0.15,
                F.col("stop_line_share") < 0.3,
                F.col("common_word_share") < 0.15,
            )
        ),
        F.lit(0),
    )


def seed() -> Column:
    """The structure that the basic counts alone make plain, or null."""
    w, s, p, c = (F.col(x) for x in ("n_words", "symbol_ratio", "stop_line_share", "common_word_share"))
    per_line = _share("n_words", "lines")
    digits = F.col("chars")[CLASSES.index("digit")] / F.greatest(F.col("visible"), F.lit(1))
    return (
        F.when((w >= 40) & (s < 0.1) & (p >= 0.6) & (c >= 0.25), "prose")
        .when((w >= 25) & (F.col("lines") >= 5) & (digits >= 0.2), "table")
        .when((w >= 25) & (F.col("lines") >= 5) & (per_line <= 10) & (p < 0.2) & (s < 0.1) & (F.col("mean_word_length") <= 8), "list")
        .when((c < 0.03) & (F.col("mean_word_length") > 9), "junk:code")
        .when((c < 0.03) & (s > 0.3), "junk:marks")
    )


def profiles(rows: DataFrame, groups: dict[int, list[str]], n_ids: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(character classes, function words) of each structure, prose by language, as distributions.

    Sums over all documents; the result has as many numbers as there are structures, classes and words.
    """
    languages = sorted({x for g in groups.values() for x in g})
    sent = {x: [i for i, g in groups.items() if x in g] for x in languages}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {x: set(i) for x, i in sent.items()}
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for kind, n, chars, ids, counts in zip(b["seed"], b["n_words"], b["chars"], b["word_ids"], b["word_counts"]):
                if kind == "prose":
                    score = {x: sum(c for i, c in zip(ids, counts) if i in s) for x, s in own.items()}
                    kind = "prose:" + max(sorted(score), key=score.get, default="")
                v = sums.setdefault(kind, np.zeros(len(CLASSES) + n_ids + 1, np.int64))
                v[: len(CLASSES)] += chars
                v[len(CLASSES)] += n - sum(counts)
                np.add.at(v, len(CLASSES) + np.asarray(ids, int), np.asarray(counts, np.int64))
            yield pd.DataFrame({"kind": list(sums), "v": list(sums.values())})

    parts = rows.where("seed is not null").select("seed", "n_words", "chars", "word_ids", "word_counts").mapInPandas(add, "kind string, v array<long>")
    total = parts.select("kind", F.posexplode("v").alias("at", "n")).groupBy("kind", "at").agg(F.sum("n").alias("n")).where("n > 0")
    names = [f"prose:{x}" for x in languages] or ["prose:"]
    out = {k: np.zeros(len(CLASSES) + n_ids + 1) for k in (*names, *PRIOR) if k != "prose"}
    for k, at, n in total.collect():
        out[k][at] += n
    done = {}
    for k, v in out.items():
        base = np.array(PRIOR[k if k in PRIOR else "prose"])
        words = np.zeros(n_ids + 1)
        words[0] = PRIOR_WEIGHT / 5
        if k.startswith("prose"):  # before any text is seen: two words of five are function words
            own = sent.get(k[6:], [])
            words[own] += 0.4 * words[0] / max(1, len(own))
            words[0] *= 0.6
        chars, words = v[: len(CLASSES)] + PRIOR_WEIGHT * base / base.sum(), v[len(CLASSES) :] + words
        done[k] = (chars / chars.sum(), words / words.sum())
    return done


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from q; 1 for rows of zeros."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(p.sum(axis=1) > 0, np.clip((a + b) / 2, 0, 1), 1.0)


STATS = ("n_words", *SHARES, "flags", "prose_divergence", "structure", "divergence")


def text_quality(documents: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id and STATS.

    Counts, shares and dirty rows are as in text_counts; a blank text's structure is junk.
    ``prose_divergence`` is the least mean divergence from a language's prose, ``structure`` the nearest
    of prose, list, table and junk, ties in this order, and ``divergence`` its.
    """
    listed = listed_words(common_words)
    ids = {w: i for i, w in enumerate(listed, 1)}
    groups = {ids[w]: langs for w, langs in listed.items()}
    # The distributions are read twice, for the profiles and for the divergences; the texts once.
    rows = with_shares(_counted(documents, list(listed), doc_id, text, True))
    rows = cut(rows.withColumns({"flags": flags(), "seed": seed()}))
    known = profiles(rows, groups, len(ids))
    ends = rows.select("doc_id", *STATS[:6], "chars", "word_ids", "word_counts")
    kind = documents.select(F.col(f"`{doc_id}`")).dtypes[0][1]

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _rated(b, list(known), known)

    schema = "doc_id string, n_words long, mean_word_length double, symbol_ratio double, stop_line_share double, common_word_share double, flags int, prose_divergence double, structure string, divergence double"
    return ends.mapInPandas(rate, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def sparse_divergence(doc: np.ndarray, at: np.ndarray, p: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """Divergence of each of n distributions, given as entries (doc, at, p > 0), from q. What a
    document lacks adds half of q's share of it, so only its own entries are looked at."""
    here = q[at]
    m = (p + here) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = p * np.log2(p / m) + np.where(here > 0, here * np.log2(here / m), 0)
    own = np.bincount(doc, parts, n) + 1 - np.bincount(doc, here, n)
    return np.where(np.bincount(doc, p, n) > 0, np.clip(own / 2, 0, 1), 1.0)


def _rated(b: pd.DataFrame, names: list[str], known: dict) -> pd.DataFrame:
    n = len(b)
    chars = np.array(b["chars"].tolist(), float).reshape(n, len(CLASSES))
    with np.errstate(divide="ignore", invalid="ignore"):
        chars = np.nan_to_num(chars / chars.sum(axis=1, keepdims=True))
    total, sizes = b["n_words"].to_numpy(float), [len(x) for x in b["word_ids"]]
    doc = np.repeat(np.arange(n), sizes)
    at, count = (np.concatenate([np.asarray(x, kind) for x in b[c]]) if n else np.empty(0, kind) for c, kind in (("word_ids", int), ("word_counts", float)))
    rest = np.maximum(total - np.bincount(doc, count, n), 0)
    other = np.flatnonzero(rest > 0)
    doc, at, count = np.concatenate([doc, other]), np.concatenate([at, np.zeros(len(other), int)]), np.concatenate([count, rest[other]])
    p = count / np.bincount(doc, count, n)[doc]
    far = np.stack([(divergence(chars, known[k][0]) + sparse_divergence(doc, at, p, n, known[k][1])) / 2 for k in names], axis=1)
    prose = [i for i, k in enumerate(names) if k.startswith("prose")]
    nearest = far.argmin(axis=1)
    structure = np.array([k.partition(":")[0] for k in names], object)[nearest]
    structure[np.bincount(doc, count, n) == 0] = "junk"
    out = b[["doc_id", *STATS[:6]]].copy()
    out["prose_divergence"], out["structure"], out["divergence"] = far[:, prose].min(axis=1), structure, far[np.arange(n), nearest]
    return out
