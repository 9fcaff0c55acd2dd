"""Text functions as Spark columns: folds, slugs, tokens, cleaning, hashes and dates. No Python runs on the executors."""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.word_lists import QUERY_STOP, SUBSTANCE_QUALIFIERS

#: Blocks whose characters are folded by rule; what lies outside is dropped, as it is no Latin text.
FOLDED_BLOCKS = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
#: Accents that are folded one to one.
ACCENT_GROUPS = (("àâäáãå", "A"), ("ç", "C"), ("èéêë", "E"), ("ìíîï", "I"), ("ñ", "N"), ("òóôöõ", "O"), ("ùúûü", "U"), ("ýÿ", "Y"))


def _decomposed(block, form: str) -> dict[str, str]:
    return {chr(i): d for i in range(*block) if (d := unicodedata.normalize(form, chr(i))) != chr(i)}


@cache
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, what each becomes, replacements of several characters) of NFKD without what is not ASCII."""
    ones, several = {}, []
    for block in FOLDED_BLOCKS:
        for c, d in _decomposed(block, "NFKD").items():
            ascii_ = d.encode("ascii", "ignore").decode()
            if len(ascii_) == 1:
                ones[c] = ascii_
            elif len(ascii_) > 1:
                several.append((c, ascii_))
    return "".join(ones), "".join(ones.values()), tuple(several)


def _is_plain(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def ascii_fold(c: Column) -> Column:
    """NFKD, then everything beyond ASCII deleted: accents go, ligatures like œ vanish."""
    one, to, several = _fold_tables()
    odd = F.translate(c, one, to)
    for char, text in several:
        odd = F.replace(odd, F.lit(char), F.lit(text))
    return F.when(_is_plain(c), c).otherwise(F.regexp_replace(odd, r"[^\x00-\x7F]", ""))


@cache
def _mark_tables() -> tuple[str, str]:
    """Latin letters with marks U+0300 to U+036F -> the letter, as NFD has it; nothing is deleted."""
    pairs = {}
    for block in FOLDED_BLOCKS[:2]:
        for c, d in _decomposed(block, "NFD").items():
            bare = "".join(x for x in d if not 0x300 <= ord(x) <= 0x36F)
            if len(bare) == 1:
                pairs[c] = bare
    return "".join(pairs), "".join(pairs.values())


def search_fold(c: Column) -> Column:
    """NFD, marks dropped, lower case; letters such as œ stay."""
    one, to = _mark_tables()
    return F.when(_is_plain(c), F.lower(c)).otherwise(F.lower(F.regexp_replace(F.translate(c, one, to), "[̀-ͯ]", "")))


def same_length_fold(c: Column) -> Column:
    """Upper case and eight groups of accents, one to one, so that offsets stay; œ and ß stay too."""
    source = "".join(chr(i) for i in range(97, 123)) + "".join(g + g.upper() for g, _ in ACCENT_GROUPS)
    target = "".join(chr(i) for i in range(65, 91)) + "".join(b * 2 * len(g) for g, b in ACCENT_GROUPS)
    return F.when(_is_plain(c), F.upper(c)).otherwise(F.translate(c, source, target))


def linkable_words(c: Column) -> Column:
    """Distinct runs of A-Z and digits of the same-length fold, in order of their first place; null has none."""
    return F.array_remove(F.array_distinct(F.split(same_length_fold(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+")), "")


def distinct_words(c: Column, least: int = 3) -> Column:
    """The distinct words of :func:`fold_words`, in order."""
    return F.filter(F.array_distinct(F.split(search_fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")), lambda w: F.length(w) >= least)


def tokens(c: Column) -> Column:
    """Distinct runs of A-Z and digits of the folded upper-case text, in order of their first place; null has none.

    A text beyond ASCII is first cut at the ASCII characters that no fold changes, and only its distinct parts are folded, all at once.
    """
    text = F.coalesce(c, F.lit(""))
    parts = F.array_distinct(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    folded = F.when(_is_plain(text), F.upper(text)).otherwise(ascii_fold(F.upper(F.array_join(parts, " "))))
    return F.array_remove(F.array_distinct(F.split(folded, "[^A-Z0-9]+")), "")


def slug(c: Column, limit: int = 80, empty: str = "rcp") -> Column:
    """Folded, runs of other characters to one hyphen, outer hyphens off, lower case, and only then cut."""
    s = F.lower(F.trim(F.regexp_replace(ascii_fold(c), "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(F.left(s, F.lit(limit)), F.lit("")), F.lit(empty))


def sort_key(c: Column) -> Column:
    return F.lower(ascii_fold(c))


def trimmed_fold(c: Column) -> Column:
    return F.trim(F.lower(ascii_fold(c)), F.lit(" \t\n\r\x0b\x0c"))


def browse_letter(c: Column) -> Column:
    """The first ASCII letter anywhere, upper case; ``#`` without one."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(ascii_fold(c), "[A-Za-z]", 0)), F.lit("")), F.lit("#"))


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces included, to one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def query_terms(c: Column, least: int = 3) -> Column:
    """Distinct words of a query in order, folded, of ``least`` letters or more, without stop words."""
    words = F.filter(F.split(search_fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*sorted(QUERY_STOP))))


def fold_words(c: Column, least: int = 3) -> Column:
    return F.filter(F.split(search_fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


@cache
def _cp1252() -> tuple[str, str, str]:
    known, lost = {}, ""
    for b in range(0x80, 0xA0):
        try:
            known[chr(b)] = bytes((b,)).decode("cp1252")
        except UnicodeDecodeError:
            lost += chr(b)
    return "".join(known), "".join(known.values()), lost


def repair_cp1252(c: Column) -> Column:
    """C1 controls become what Windows-1252 means by them; its five undefined ones are dropped."""
    source, target, lost = _cp1252()
    return F.translate(c, source + lost, target)


def brand_root(c: Column) -> Column:
    """The words before the first with a digit, commas as spaces; all of the name if none are left."""
    words = F.filter(F.split(F.regexp_replace(c, ",", " "), r"(?U)\s+"), lambda w: w != "")
    digit = F.array_position(F.transform(words, lambda w: w.rlike("[0-9]")), True)
    head = F.when(digit > 0, F.slice(words, 1, F.greatest(digit - 1, F.lit(0)).cast("int"))).otherwise(words)
    return F.when(F.size(head) > 0, F.array_join(head, " ")).otherwise(F.array_join(words, " "))


def clean_substance(c: Column) -> Column:
    """A substance without entities, what follows ``(`` or ``,`` and salts; with salts if nothing else is left."""
    head = F.split_part(F.split_part(unescape(c), F.lit("("), F.lit(1)), F.lit(","), F.lit(1))
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~same_length_fold(w).isin(*sorted(SUBSTANCE_QUALIFIERS)))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def is_filler(c: Column) -> Column:
    """A paragraph without content: empty, a stock phrase, five characters or less, or two words or less."""

    def stock(folded: Column) -> Column:
        return (F.trim(folded, F.lit(" .;:")) == "sans objet") | folded.contains("completer ulterieurement")

    def judged(t: Column) -> Column:
        return (F.length(t) <= 5) | (F.size(F.split(t, " ")) <= 2) | F.exists(F.array(F.lower(ascii_fold(t))), stock)

    return F.exists(F.array(collapse(F.coalesce(c, F.lit("")))), judged)  # arrays of one: each fold is made once


def html_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def json_for_script(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def heading_path(*titles: Column) -> Column:
    return F.array_join(F.filter(F.array(*titles), lambda t: F.coalesce(t, F.lit("")) != ""), " > ")


def heading_level(css_class: Column, prefix: str = "AmmAnnexeTitre") -> Column:
    return F.regexp_extract(css_class, rf"{prefix}(\d)", 1).try_cast("int")


def eu_number(c: Column) -> Column:
    return F.regexp_extract(c, r"EU/\d/\d{2}/\d+", 0)


def auth_key(eu: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(eu, F.lit("")), brand_root(name))


def looks_like_pdf(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 5) == F.unhex(F.lit("255044462D")), F.lit(False))


def content_hash(raw: Column, version: str = "6", digits: int = 16) -> Column:
    return F.left(F.sha2(F.concat(F.lit(version), F.char(F.lit(0)), raw).cast("binary"), 256), F.lit(digits))


def record_hash(*fields: Column) -> Column:
    """sha256 of the fields, parted by NUL; null counts as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), "\0").cast("binary"), 256)


# dates


def first_dmy_date(c: Column) -> Column:
    """The first d/m/yyyy as yyyy-mm-dd; empty if there is none or it does not exist."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"\d{1,2}/\d{1,2}/\d{4}", 0), F.lit("")), F.lit("d/M/yyyy")), "yyyy-MM-dd"), F.lit(""))


def packed_date(*candidates: Column) -> Column:
    """yyyymmdd of the first candidate that holds it, as yyyy-mm-dd; its validity is not looked at."""
    out = F.lit("")
    for c in reversed(candidates):
        d = F.regexp_extract(c, r"(\d{4})(\d{2})(\d{2})", 0)
        out = F.when(F.coalesce(d, F.lit("")) != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(out)
    return out


#: Month names.
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


def long_date(iso: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(F.to_date(iso)))
    day = F.dayofmonth(F.to_date(iso))
    return F.concat_ws(" ", F.when(day == 1, F.lit("1er")).otherwise(day.cast("string")), month, F.year(F.to_date(iso)).cast("string"))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000)


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(s, F.lit(60))))


def last_modified(asof: Column) -> Column:
    return F.split_part(asof, F.lit("T"), F.lit(1))


def human_age(days: Column) -> Column:
    """Whole days as a reader says them: today, days below a month, months below a year, years."""
    n = days.cast("long")
    months, years = F.greatest(F.floor(n / 30 + 0.5), F.lit(1)), F.floor(n / 365)
    plural = lambda c, word: F.concat(F.lit("il y a "), c.cast("string"), F.lit(f" {word}"), F.when(c > 1, "s").otherwise(""))
    return F.when(n < 1, "aujourd'hui").when(n < 31, plural(n, "jour")).when(n < 365, F.concat(F.lit("il y a "), months.cast("string"), F.lit(" mois"))).otherwise(plural(years, "an"))


def is_old_copy(days: Column, most: int = 365) -> Column:
    return F.coalesce(days > most, F.lit(False))


def _units(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = F.floor(seconds).cast("long")
    return F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))


def dhm(seconds: Column) -> Column:
    """Days, hours and minutes; less than nothing is nothing."""
    d, h, m, _ = _units(F.greatest(seconds, F.lit(0)))
    return F.concat(d.cast("string"), F.lit("d"), h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"))


def two_units(seconds: Column) -> Column:
    """The two largest units of a duration that are there; a dash for null and below nothing."""
    units = zip(_units(seconds), ("j", "h", "min", "s"), strict=True)
    parts = F.filter(F.array(*[F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {name}"))) for c, name in units]), lambda x: x.isNotNull())
    return F.when(seconds.isNull() | (seconds < 0), "-").when(seconds < 1, "moins d'une seconde").otherwise(F.array_join(F.slice(parts, 1, 2), " "))


def percent(score: Column) -> Column:
    """A score up to one in whole percent, halves up."""
    return F.floor(F.least(F.lit(1.0), score) * 100 + 0.5).cast("long")


def page_hash(kind: str, *fields: Column) -> Column:
    """The cache key of a page: its kind and what it is made of."""
    return record_hash(F.lit(kind), *fields)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All HTML entities, in batches; Spark has no function for them."""
    return text.map(lambda t: html.unescape(t) if t and "&" in t else t)
