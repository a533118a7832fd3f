"""Text cleaning, statistics and similarity as native columns.

Regular expressions use only what Java's engine and RE2 share (no
back-references, explicit Unicode classes), so each column stays inside
whole-stage code and has a DuckDB twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.han import SIMPLIFIED, TRADITIONAL

#: one character of a word, of white space
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
SPACE = r"[\s\x{0B}\x{85}\p{Z}]"
_MARKS = "".join(sorted(set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\" + "—‘’“”…《》！（），：；？、。￥")))


def escaped(c: str) -> str:
    return "\\" + c if c in "\\[]^-|{}()*+?.$&~" else c


UBB = r"(?s)\[.{1,3}?\]"
URL = rf"(?i)https?://(?:{WORD}|-)+(?:[.](?:{WORD}|-)+)+(?:/(?:{WORD}|[-. /?%&=])*)?"
_PART = f"{WORD}+(?:[-.]{WORD}+)*"
EMAIL = rf"{WORD}+(?:[-.+']{WORD}+)*@{_PART}[.]{_PART}"
COMMENT = r"(?s)<!--.*?-->"
REPEATED = "|".join(f"[{escaped(c)}]{{3,}}" for c in _MARKS)
#: what the JVM matches in place of the above: the same language, in linear time
_EMAIL_FAST = rf"(?<!{WORD}){WORD}++(?:[-.+']{WORD}++)*+@{_PART}[.]{_PART}"
# a look at what most characters aren't comes before the classes, which are slow
_REPEATED_FAST = rf"(?=[!-/:-@\[-`{{-~\x{{2014}}-\x{{FFFF}}])([{''.join(map(escaped, _MARKS))}])\1{{2,}}"
_ODD_FAST = r"(?![\x{00}-\x{A3}\x{A5}-\x{218F}])"
_SPACE_FAST = r"(?![!-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}])" + SPACE
SPACED_MARKS = rf"{SPACE}+[{''.join(map(escaped, _MARKS))}]+{SPACE}+"
_KEPT = "".join(escaped(c) for c in _MARKS if c not in "-_/\\—")
SPACED_MARKS_KEEPING = rf"{SPACE}+[{_KEPT}]+{SPACE}+"
CONTROL = r"[\x{00}-\x{1F}]+"
CODE = r"&#.{2,4};"
#: symbols that say nothing: boxes, blocks, shapes, circled numbers
ODD = r"[\x{2190}-\x{21FF}\x{2460}-\x{27BF}\x{FE30}-\x{FE4F}¤囧〓]"
#: with the letters that a Chinese text has no use for
ODD_LETTERS = r"[\x{2190}-\x{21FF}\x{2460}-\x{27BF}\x{FE30}-\x{FE4F}¤囧〓\x{0400}-\x{045F}āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜüê]"
FILE_NAME = '[\\\\/:：*？?“”"<>|]'
ALPHA_RUN = r"[a-zA-Z0-9 +\-*\\/]+"
#: full-width forms and the ideographic space, and what they stand for
FULL = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = " " + "".join(chr(c) for c in range(0x21, 0x7F))
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _or_null(c: Column, out: Column) -> Column:
    """Null for null and empty texts, as the cleaning functions have it."""
    return F.when(F.length(c) > 0, out)


def clean_ubb(c: Column) -> Column:
    """Without bracket codes of one to three characters."""
    return _or_null(c, F.regexp_replace(c, UBB, ""))


def clean_url(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def clean_email(c: Column) -> Column:
    # few texts have an @ at all
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, _EMAIL_FAST, "")).otherwise(c)


def clean_comments(c: Column) -> Column:
    return F.regexp_replace(c, COMMENT, "")


def clean_repetition(c: Column) -> Column:
    """Three or more of the same mark become one full stop."""
    return _or_null(c, F.regexp_replace(c, _REPEATED_FAST, "."))


def clean_nonsense(c: Column, *, keep_connection: bool = False, letters: bool = False) -> Column:
    """Without marks between blanks, control characters (newlines too), odd
    symbols and character codes. ``letters`` also drops the letters that the
    Chinese setting counts as odd, which damages other languages."""
    return _or_null(c, _sensible(c, keep_connection, letters))


def _sensible(c: Column, keep_connection: bool, letters: bool) -> Column:
    marks = SPACED_MARKS_KEEPING if keep_connection else SPACED_MARKS
    inner = marks[len(SPACE) + 1 : -len(SPACE) - 1]
    # nothing is gained by a start within a run of blanks
    out = F.regexp_replace(c, f"{_SPACE_FAST}(?<!{SPACE}{{2}}){SPACE}*{inner}+{SPACE}+", "")
    out = F.regexp_replace(out, CONTROL, "")
    out = F.regexp_replace(out, ODD_LETTERS if letters else _ODD_FAST + ODD, "")
    return F.regexp_replace(out, CODE, "")


def to_half_width(c: Column) -> Column:
    return _translated(c, r"[\x{3000}\x{FF01}-\x{FF5E}]", FULL, HALF)


def _translated(c: Column, some: str, old: str, new: str) -> Column:
    """``translate`` looks up each character: only for texts that have one."""
    return F.when(c.rlike(some), F.translate(c, old, new)).otherwise(c)


def is_full_width(c: Column) -> Column:
    """The first character is a full-width form."""
    return F.coalesce(c.rlike(r"^[\x{3000}\x{FF01}-\x{FF5E}]"), F.lit(False))


def is_half_width(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[ -~]"), F.lit(False))


def to_simplified(c: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    return _translated(c, r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]" if all("㐀" <= x for x in traditional) else f"[{''.join(map(escaped, traditional))}]", traditional, simplified)


def is_traditional(c: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    return to_simplified(c, traditional, simplified) != c


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags away, block ends to newlines, core entities decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table)\s*>", "\n")
    out = F.when(F.contains(c, F.lit("<")), F.regexp_replace(out, r"(?s)<[^>]*>", "")).otherwise(c)
    return F.when(F.contains(out, F.lit("&")), decode_entities(out)).otherwise(out)


ANNOTATION = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|&[a-z#0-9]{2,8};"


def strip_annotations(c: Column, rounds: int = 3) -> Column:
    """Comments, scripts, styles, tags, entities and blanks away, and once more
    what that brings to light, ``rounds`` times. A text that still holds some
    after these is nested on purpose; ``annotated`` tells it."""
    for _ in range(rounds):
        c = F.regexp_replace(c, ANNOTATION, "")
    return F.regexp_replace(c, SPACE, "")


def annotated(c: Column) -> Column:
    """Whether there is something left for ``strip_annotations``."""
    return F.coalesce(c.rlike(ANNOTATION), F.lit(False))


def count_pattern(c: Column, pattern: str) -> Column:
    """How often a pattern occurs, without overlap; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


#: marks of Chinese typing and their ASCII forms
CN_MARKS = "，。；：？！“”‘’（）【】《》、～"
EN_MARKS = ",.;:?!\"\"''()[]<>,~"


def to_ascii_marks(c: Column) -> Column:
    """Chinese marks as ASCII ones, full-width forms as half-width ones."""
    return _translated(to_half_width(c), f"[{CN_MARKS}]", CN_MARKS, EN_MARKS)


def same_bytes(a: Column, b: Column) -> Column:
    """Whether two binary columns are equal, byte by byte; null for a null one."""
    return a == b


def valid_title(c: Column, language: str = "English") -> Column:
    """Long enough, five characters in Chinese and more than five words else, and
    less than half digits."""
    t = F.trim(c)
    enough = F.length(t) >= 5 if language == "Chinese" else F.size(F.split(t, r"\s+")) > 5
    return F.coalesce(enough & (F.regexp_count(t, F.lit(r"\p{Nd}")) * 2 < F.length(t)), F.lit(False))


def without_marks(c: Column) -> Column:
    """Letters, digits and blanks only."""
    return F.regexp_replace(c, r"[\p{P}\p{S}]", "")


def decode_entities(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def full_clean(c: Column, *, clean_html: bool = True, keep_connection: bool = False, keep_url_email: bool = False, comments: bool = True, ubb: bool = True, letters: bool = False) -> Column:
    """All cleaning steps in their order; empty for null and empty texts."""
    out = clean_comments(c) if comments else c
    out = strip_html(out) if clean_html else out
    out = F.regexp_replace(out, UBB, "") if ubb else out
    out = F.regexp_replace(_sensible(out, keep_connection, letters), _REPEATED_FAST, ".")
    out = clean_url(out) if clean_html else out
    out = out if keep_url_email else clean_email(out)
    return F.coalesce(to_simplified(to_half_width(out)), F.lit(""))


def thumb_text(c: Column, length: int = 200, **options: bool) -> Column:
    return F.substring(full_clean(c, **options), 1, length)


def shorten(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def count_in_set(c: Column, chars: str, *, spaces: bool = True) -> Column:
    chars += " " if spaces and " " not in chars else ""
    return F.when(F.trim(c) != "", F.length(c) - F.length(F.translate(c, chars, ""))).otherwise(0)


def count_digit_chars(c: Column, *, spaces: bool = True) -> Column:
    return count_in_set(c, "0123456789.", spaces=spaces)


def remove_stop_words(c: Column, words: Sequence[str]) -> Column:
    """Without the first occurrence of each word, whatever its case."""
    for w in words:
        at = F.locate(w.lower(), F.lower(c))
        c = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(w), F.length(c)))).otherwise(c)
    return c


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, FILE_NAME, "")


def _share(c: Column, cls: str) -> Column:
    return F.when(F.length(c) > 0, 1 - F.regexp_count(c, F.lit(cls)) / F.length(c)).otherwise(0.0)


def non_numeric_density(c: Column) -> Column:
    return _share(c, r"\p{N}")


def non_digit_punctuation_density(c: Column) -> Column:
    return _share(c, r"[\p{Nd}\p{P}]")


def high_char_density(c: Column) -> Column:
    """Share of characters above 128."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[^\x{00}-\x{80}]")) / F.length(c))


def only_digits_and_marks(c: Column, extra: str | None = None, *, marks: bool = False) -> Column:
    cls = r"\p{Nd}\p{P}" if extra is None else r"\p{Nd}\s\p{Z}" + (r"\p{P}" if marks else "") + "".join(map(escaped, extra))
    return c.rlike(f"^[{cls}]*$")


def nth_index(c: Column, char: str, n: int) -> Column:
    """0-based place of the n-th occurrence, or -1."""
    return F.when(F.length(c) - F.length(F.replace(c, F.lit(char), F.lit(""))) >= n, F.length(F.substring_index(c, char, n))).otherwise(-1)


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def non_space_length(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, SPACE, "")), F.lit(0))


def safe_substring(c: Column, offset: int) -> Column:
    """From a 0-based offset on; empty where less than two characters are left."""
    return F.when(F.length(c) - 1 > offset, F.substring(c, offset + 1, 1 << 30)).otherwise("")


def weighted_length(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """Length without blanks and stop words; ASCII words count half."""
    s = remove_stop_words(F.regexp_replace(decode_entities(c), SPACE, ""), stop_words)
    rest = F.length(F.regexp_replace(s, ALPHA_RUN, ""))
    return F.coalesce(F.floor((F.length(s) + rest) / 2).cast("int"), F.lit(0))


def language(c: Column) -> Column:
    """Chinese for any Han character and for empty texts, else English."""
    return F.when(c.isNull() | (c == "") | c.rlike(r"[\x{4E00}-\x{9FFF}]"), "Chinese").otherwise("English")


def safe_int(c: Column) -> Column:
    """The first run of digits as a number, or 0."""
    return F.coalesce(F.regexp_extract(c, "([0-9]+)", 1).try_cast("int"), F.lit(0))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def likeliness(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def alike(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Equal, one the start or end of the other, or close in edit distance.
    Long texts are compared in full, not by random samples."""
    near = (F.length(a) >= threshold * F.length(b)) & (F.length(b) >= threshold * F.length(a))
    limit = F.floor((1 - threshold) * F.length(b) + 1e-9).cast("int")
    return (a == b) | F.endswith(a, b) | F.startswith(a, b) | (near & (F.levenshtein(a, b) <= limit))


def common_prefix_length(a: Column, b: Column) -> Column:
    x, y = F.split(a, ""), F.split(b, "")  # characters, so that each is looked at once
    n = F.least(F.size(x), F.size(y))
    same = F.aggregate(F.arrays_zip(F.slice(x, F.lit(1), n).alias("x"), F.slice(y, F.lit(1), n).alias("y")), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda acc, s: F.struct((acc["k"] + (acc["on"] & (s["x"] == s["y"])).cast("int")).alias("k"), (acc["on"] & (s["x"] == s["y"])).alias("on")), lambda acc: acc["k"])
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(same)


def common_prefix(a: Column, b: Column) -> Column:
    return F.substring(a, F.lit(1), common_prefix_length(a, b))


def group_prefix(c: Column) -> Column:
    """Aggregate: what all texts of a group begin with. The least and the
    greatest of them share it, so it takes two partial aggregates."""
    return F.when(F.count(c) >= 2, common_prefix(F.min(c), F.max(c)))


def to_unicode_escapes(c: Column) -> Column:
    r"""Each UTF-16 unit as \uXXXX."""
    return F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1"))


def from_unicode_escapes(c: Column) -> Column:
    r"""The text of \uXXXX escapes."""
    return F.decode(F.unhex(F.regexp_replace(c, r"\\u", "")), "UTF-16BE")


def epoch_time(c: Column, default: Column | None = None) -> Column:
    """Timestamp of a string of 10 (seconds), 13 (ms) or 17 digits (ticks of
    100 ns); ``default`` or null for anything else."""
    ok = c.rlike(r"^(?:[0-9]{10}|[0-9]{13}|[0-9]{17})$")
    t = F.timestamp_micros(F.expr("0L") + F.floor(F.rpad(c, 17, "0").try_cast("long") / 10))
    return F.when(ok, t).otherwise(default if default is not None else F.lit(None).cast("timestamp"))
