"""Text functions: Column in, Column out, native expressions only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms

_CJK = "一-鿿"
#: White space as Python's str.strip and \\s see it.
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The characters of ``_WS``.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def quoted(words: Iterable[str]) -> str:
    """A Java pattern that matches any of the words literally."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    # plain searches: an alternation tries each of its words at each character of a text
    first, *rest = list(words) or [""]
    return reduce(lambda c, w: c | text.contains(w), rest, text.contains(first))


def tokens(text: Column) -> Column:
    """Latin words of two or more characters and CJK runs, then every single CJK character; lower case."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(rf"[a-zA-Z][a-zA-Z0-9\-]+|[{_CJK}]{{2,}}"), F.lit(0))
    # a text of as many bytes as characters has no CJK, so it need not be searched again
    return F.when(F.octet_length(low) == F.length(low), words).otherwise(F.concat(words, F.regexp_extract_all(low, F.lit(f"[{_CJK}]"), F.lit(0))))


def strip(text: Column) -> Column:
    # from both ends: a pattern would look at every blank of the text
    return F.btrim(text, F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_WS}+", " "))


def normalize(text: Column) -> Column:
    """Unify spaces and separators of a cell; null is empty."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "　", " "), r"\|", "。")
    x = F.regexp_replace(F.regexp_replace(x, r"\?\?+", "？"), r"\s+", " ")
    return F.btrim(F.regexp_replace(x, r"([。；;]) +", "$1"), F.lit(" ;；。"))


def normalize_name(text: Column) -> Column:
    return F.regexp_replace(normalize(text), f"{_WS}+", "")


def lookup_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"{_WS}+", ""))


def clean_page(text: Column) -> Column:
    """Line ends, page-number lines, runs of blanks and of empty lines.

    A pattern is tried at each character of a text, so plain searches first tell whether there is something to do. A page number
    leaves one line end and changes no other run of them, so one pattern does for both; it takes white space without going back.
    """
    x = F.when(text.contains("\r"), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(text)
    x = F.regexp_replace(x, r"\n(?:\s*+(?:-\s*+)?\d++(?:\s*+-)?\s*\n|(\n)\n+)", "\n$1")
    blanks = F.regexp_replace(F.replace(x, F.lit("\t"), F.lit(" ")), "  +", " ")
    return strip(F.when(x.contains("  ") | x.contains("\t"), blanks).otherwise(x))


def without_tags(html: Column) -> Column:
    """The text of a page: tags give way to blanks, runs of white space to one."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")


def clean_guideline(text: Column) -> Column:
    x = F.regexp_replace(text, r"\n\s*-?\s*\d+\s*-?\s*\n", "\n")
    x = F.regexp_replace(x, r"(?<=[，、；。])\n(?=[^\n])", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def base_name(name: Column, forms: Sequence[str] = terms.DOSAGE_FORMS) -> Column:
    """Without a trailing parenthesis and the longest dosage form that leaves two characters or more."""
    x = F.regexp_replace(lookup_name(name), r"[（(][^（）()]{1,12}[）)]$", "")
    rest = F.regexp_extract(x, f"^(.{{2,}}?)(?:{'|'.join(forms)})$", 1)
    return F.when(rest != "", rest).otherwise(x)


def without_salt(name: Column, salts: Sequence[str] = terms.SALT_PREFIXES) -> Column:
    x = lookup_name(name)
    rest = F.regexp_extract(x, f"^(?:{'|'.join(sorted(salts, key=len, reverse=True))})(.{{2,}})$", 1)
    return F.when(rest != "", rest).otherwise(x)


def spelling_variants(name: Column, one: str, other: str) -> Column:
    return F.array_distinct(F.array(name, F.replace(name, F.lit(one), F.lit(other)), F.replace(name, F.lit(other), F.lit(one))))


def name_of_title(title: Column, cut: str = "说明书|指南|共识|手册|临床|用药|_|-") -> Column:
    x = F.regexp_replace(F.regexp_replace(title, f"({cut}).*$", ""), r"\s+", "")
    return F.when(F.length(x) >= 2, x).otherwise(title)


def name_of_file(stem: Column, cut: str = "说明书|指南|共识|手册|_|-") -> Column:
    x = F.regexp_replace(F.regexp_replace(stem, f"({cut}).*$", ""), r"\s+", "")
    return F.when(F.length(x) >= 2, x)


_DIGITS = "零〇一二两三四五六七八九"
_VALUES = "001223456789"


def chinese_number(x: Column) -> Column:
    """Digits as they stand, one Chinese digit, or forms with 十 and 百 below a thousand; null for all else."""
    plain = F.translate(x, _DIGITS, _VALUES)

    def digit(part: Column, empty: int | None) -> Column:
        return F.when(part == "", F.lit(empty)).when(part.rlike(r"^\d$"), part.try_cast("int"))

    def below_hundred(part: Column, empty: int | None) -> Column:
        left, right = F.substring_index(part, "十", 1), F.substring_index(part, "十", -1)
        return F.when(part.contains("十"), digit(left, 1) * 10 + digit(right, 0)).otherwise(digit(part, empty))

    hundreds, rest = F.substring_index(plain, "百", 1), F.substring_index(plain, "百", -1)
    with_hundreds = digit(hundreds, 1) * 100 + below_hundred(rest, 0)
    return F.when(x.rlike(r"^[0-9]{1,3}$"), x.try_cast("int")).when(plain.contains("百"), with_hundreds).otherwise(below_hundred(plain, None))


def ages(text: Column, pattern: str = terms.AGE) -> Column:
    """The ages 0..130 that a text states, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(F.transform(found, chinese_number), lambda a: a.between(0, 130))


def age_group(age: Column) -> Column:
    return F.when(age < 18, F.lit("儿童")).when(age >= 65, F.lit("老年人"))


_ENDS = " ;；。"


def _pieces(text: Column, pattern: str, least: int) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.btrim(x, F.lit(_ENDS))), lambda x: F.length(x) >= least)


def sentences(text: Column, least: int = 4) -> Column:
    # the ordinal first: after an empty match Java would not find one at the same place
    return _pieces(text, r"(?:\s*\d+[.)、]\s*)|(?<=[。！？；;])", least)


def items(x: Column, least: int = 4) -> Column:
    """What stands between the numbers of a text without runs of white space."""
    return _pieces(x, r"(?:^|[。；;]\s*|\n+)\s*(?:\d+|[一二三四五六七八九十]+)[.、)]\s*", least)


def items_or_sentences(x: Column, found: Column, least: int = 4) -> Column:
    """``found``; where there are fewer than two, the sentences of ``x``; where there are none, ``x``."""
    plain = sentences(x, least)
    return F.when(x == "", F.array().cast("array<string>")).when(F.size(found) > 1, found).when(F.size(plain) > 0, plain).otherwise(F.array(x))


def numbered_items(text: Column, least: int = 4) -> Column:
    """Numbered items; where there are fewer than two, the sentences; where there are none, the text."""
    x = collapse(text)
    return items_or_sentences(x, items(x, least), least)


def tags(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Names of the table whose patterns occur, in the table's order."""
    return F.filter(F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in table]), lambda x: x.isNotNull())


def present(text: Column, words: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, dict.fromkeys(words))), lambda w: F.instr(text, w) > 0)


def longest_present(text: Column, words: Sequence[str]) -> Column:
    """Words that occur, without those inside another one that occurs, sorted."""
    found = present(text, words)
    return F.array_sort(F.filter(found, lambda x: ~F.exists(found, lambda y: (y != x) & (F.instr(y, x) > 0))))


def first_section(text: Column, table: Sequence[tuple[str, Sequence[str]]] = terms.SECTION_KEYWORDS) -> Column:
    low = F.lower(text)
    named = lambda words: contains_any(low, [w.lower() for w in words])
    return reduce(lambda c, row: c.when(named(row[1]), F.lit(row[0])), table[1:], F.when(named(table[0][1]), F.lit(table[0][0])))


def hash_bucket(token: Column, size: int = 384) -> Column:
    """The 128-bit MD5 value modulo ``size``, folded from four 32-bit parts."""
    digest = F.md5(F.encode(token, "UTF-8"))
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return reduce(lambda rest, part: (rest * (2**32 % size) + part) % size, parts[1:], parts[0] % size).cast("int")


def json_object(text: Column, schema: str) -> Column:
    """The object a text is, or holds between its outermost braces."""
    return F.from_json(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text), schema)


def near_terms(text: Column, anchors: Sequence[str], signals: Sequence[str], window: int = 48) -> Column:
    """True where a signal lies wholly within ``window`` characters around an occurrence of an anchor."""
    parts = []
    for a in anchors:
        for s in signals:
            after = len(a) + window - len(s)  # how far from the anchor's start a signal may start
            if after >= 0:
                parts.append(rf"(?=\Q{a}\E).{{0,{after}}}\Q{s}\E")
            parts.append(rf"(?=\Q{s}\E).{{1,{window}}}\Q{a}\E")
    return text.rlike("(?s)" + "|".join(parts))


def ordinal_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*\d+[.、)]\s*", "")


def iso_utc(time: Column) -> Column:
    """A UTC time as ISO 8601 text with its offset; a fraction of six digits only where there is one."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
