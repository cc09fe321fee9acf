"""Text as Columns: white space, lines and terms as defined by Unicode, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.hashing import WHITE, strip

# White space and line ends as in str.isspace and str.splitlines, letters and digits.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BREAK = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
TERM = r"([\p{L}\p{N}]+)"


def normalized(text: Column) -> Column:
    """Runs of white space as one blank, none outside; case is kept."""
    return F.btrim(F.regexp_replace(text, WS + "+", " "), F.lit(" "))


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def stripped_length(text: Column) -> Column:
    return F.length(strip(text))


def text_lines(text: Column) -> Column:
    """The normalized lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE), normalized), lambda x: x != "")


def boundary_lines(text: Column, min_chars: int) -> Column:
    """First and last line, distinct and long enough; none of a text with fewer than two lines.

    Line ends are white space, so of a stripped text these are what stands before the first and after
    the last one: two regular expressions, however many lines lie between.
    """
    s = strip(text)
    ends = F.array(*(normalized(F.regexp_extract(s, p, 1)) for p in (rf"^([^{BREAK}]*)[{BREAK}]", rf"(?s)^.*[{BREAK}]([^{BREAK}]*)$")))
    return F.filter(F.array_distinct(ends), lambda x: F.length(x) >= min_chars)


def terms(text: Column) -> Column:
    """The distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda x: x != "")


def split_words(text: Column, words_per_chunk: int = 400, overlap: int = 40) -> Column:
    """Overlapping runs of words: the start of each is words_per_chunk - overlap after the last one's."""
    if words_per_chunk < 1 or not 0 <= overlap < words_per_chunk:
        raise ValueError("words_per_chunk must be positive and overlap smaller")
    step = words_per_chunk - overlap

    def runs(w: Column) -> Column:
        n = F.when(F.size(w) <= words_per_chunk, 1).otherwise(F.ceil((F.size(w) - words_per_chunk) / step) + 1)
        each = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(words_per_chunk)), " "))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<string>"))

    # Bound as a lambda's variable, the words are split once and not once per run.
    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def citations(answer: Column) -> Column:
    """The passage numbers cited as [n]."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("bigint"))


def citation_errors(answer: Column, passages: Column) -> Column:
    """Whether an answer cites a passage it wasn't given, or none without saying that it cannot answer."""
    cited = citations(answer)
    return (F.size(F.array_except(cited, passages)) > 0) | ((F.size(cited) == 0) & ~F.lower(answer).contains("cannot answer"))


__all__ = ["BREAK", "LINE", "TERM", "WHITE", "WS", "blank", "boundary_lines", "citation_errors", "citations", "normalized", "split_words", "stripped_length", "terms", "text_lines", "words"]
