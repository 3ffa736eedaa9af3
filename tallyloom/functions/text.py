"""Text keys and label clean-up, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a match key drops, and the marks that stand for a missing value.
KEY_MARKS = "·･‧・_/-"
MISSING = ("", "-", "－", "—", "–")
# Words of a request that say nothing about what is looked for.
STOP_TOKENS = ("알려줘", "알려주세요", "보여줘", "보여주세요", "찾아줘", "찾아주세요", "검색해줘", "검색해주세요", "통계", "현황")
TOTAL_WORDS = ("계", "합계", "소계", "총계", "total", "subtotal")
# Java's \s is ASCII unless the pattern asks for Unicode; the ideographic space must go too.
SPACES = r"(?U)\s+"


def once(c: Column, fn) -> Column:
    """fn(c), where c is evaluated once however often fn uses it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """Trimmed, runs of white space as one blank, null if nothing is left."""
    return nullif_empty(F.regexp_replace(F.trim(c), SPACES, " "))


def simple_key(c: Column) -> Column:
    return nullif_empty(F.lower(F.trim(c)))


def match_key(c: Column) -> Column:
    """The key by which items of different editions are joined: no spaces, no joining marks, lower case."""
    return nullif_empty(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)[\s{KEY_MARKS}]", "")))


def match_key_value(text: str) -> str:
    """match_key of a value of the request."""
    return re.sub(rf"[\s{KEY_MARKS}]", "", text).lower()


def contains_any_key(c: Column, keys: list[str]) -> Column:
    """Whether the match key contains one of the keys; no pattern characters to escape."""
    found = F.lit(False)
    for k in keys:
        found = found | match_key(c).contains(F.lit(k))
    return F.coalesce(found, F.lit(False))


def not_blank(c: Column) -> Column:
    return nullif_empty(F.trim(c)).isNotNull()


def clean_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def label_key(c: Column) -> Column:
    """Lower case, letters, digits and Hangul only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w가-힣]+", "")


def compact_hangul(c: Column) -> Column:
    """Words joined by blanks, but for those of Hangul that follow Hangul or a digit, which are joined as they are."""

    def put(line: Column, word: Column) -> Column:
        close = F.right(line, F.lit(1)).rlike("[가-힣0-9]") & F.left(word, F.lit(1)).rlike("[가-힣]")
        return F.when(line == "", word).otherwise(F.concat(line, F.when(close, "").otherwise(" "), word))

    return F.aggregate(F.split(clean_label(c), " "), F.lit(""), put)


def hangul_head(c: Column) -> Column:
    """The words before an English gloss, which begins with a word of Latin letters only, or one like 20s."""

    def of(text: Column) -> Column:
        words = F.split(text, " ")
        gloss = F.transform(words, lambda w, i: F.when((i > 0) & (w.rlike("^[A-Za-z]+$") | w.rlike("^[0-9]+s\\b")), i))
        head = once(F.array_min(gloss), lambda n: F.array_join(F.slice(words, 1, n), " "))
        return F.when(text.rlike("[가-힣]"), F.coalesce(head, text)).otherwise(text)

    return once(clean_label(c), of)


def display_label(c: Column) -> Column:
    """A label without its gloss; only its Hangul, if it begins with two or more of it."""

    def of(text: Column) -> Column:
        stop = F.array_position(F.transform(F.split(text, ""), lambda x: x.rlike("[가-힣･·ㆍ ]")), F.lit(False))
        begin = F.when(stop > 0, F.substring(text, F.lit(1), (stop - 1).cast("int"))).otherwise(text)
        return once(F.trim(begin), lambda k: F.when(F.regexp_count(k, F.lit("[가-힣]")) >= 2, k).otherwise(text))

    return once(compact_hangul(hangul_head(c)), of)


def short_label(c: Column) -> Column:
    return compact_hangul(hangul_head(c))


def label_keys(c: Column) -> Column:
    """All keys under which a label may be asked for: its own, that without gloss, and that of its parts without theirs."""

    def of(text: Column) -> Column:
        parts = F.array_join(F.transform(F.split(text, "_"), short_label), "_")
        return F.array_distinct(F.filter(F.transform(F.array(text, short_label(text), parts), label_key), lambda k: k != ""))

    return once(clean_label(c), of)


def leaf(c: Column) -> Column:
    """The last part of a label in several parts; empty if it has one."""
    return once(F.split(clean_label(c), "_"), lambda parts: F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""))


def is_total(c: Column) -> Column:
    """Whether one of the label's words is a word for a total."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([가-힣a-z]+)"), 1)
    return F.arrays_overlap(words, F.array(*map(F.lit, TOTAL_WORDS)))


def query_tokens(text: str) -> list[str]:
    """Words of a request that are worth looking for."""
    words = [t for t in re.split(r"[\s,()·/]+", text.strip()) if len(t) >= 2]
    return [t for t in words if t not in STOP_TOKENS and not re.fullmatch(r"\d{4}년?", t)]


def text_tokens(c: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)([\w]+)"), 1)
