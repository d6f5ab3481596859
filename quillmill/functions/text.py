"""Column functions on text: folding, keys, counts, masks, identifiers.  All stay inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds() -> tuple[str, str]:
    """Letters of one code point that are a base letter with marks, and their base letters, from the Unicode tables."""
    pairs = [(chr(c), base) for c in range(0x80, 0x2C00) if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c) and base.isalnum()]
    pairs += [("ł", "l"), ("ø", "o"), ("đ", "d")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _forms() -> tuple[str, str]:
    """Code points whose compatibility form (NFKC) is one other code point, and that form: wide letters, digits in circles and the like."""
    pairs = [(chr(c), f) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folds()
_FORMS, _COMPATIBLE = _forms()
#: Ligatures and their letters.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ĳ": "ij", "…": "...", "™": "tm"}


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip_accents(c: Column) -> Column:
    """Lower case without accents, also those that stand as marks of their own."""
    spelt = F.replace(F.replace(casefold(c), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(F.translate(spelt, _ACCENTED, _PLAIN), r"\p{M}", "")


@cache
def _spelling() -> tuple[dict[int, str | int | None], bytes, str]:
    """What strip_accents does to a lower-case text, as a table for str.translate; the same for Latin-1 bytes, other signs than letters and digits as spaces; Latin-1 that has no place there."""
    marks = {k: None for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"}
    folds = {k: k for k in range(256)} | marks | str.maketrans(_ACCENTED, _PLAIN) | str.maketrans({"æ": "ae", "œ": "oe"})
    latin = [chr(k).translate(folds) for k in range(256)]
    fits = [len(x) == 1 and x < "\u0100" for x in latin]
    return folds, bytes(ord(x) if ok and x.isalnum() else 32 for x, ok in zip(latin, fits)), "".join(chr(k) for k in range(256) if not fits[k])


def spelt_words(text: str) -> str:
    """Words of letters and digits of a lower-case text, as strip_accents spells them, between spaces."""
    folds, latin, others = _spelling()
    if not any(x in text for x in others):
        try:
            return text.encode("latin-1").translate(latin).decode("latin-1")
        except UnicodeEncodeError:
            pass
    return re.sub(r"[\W_]+", " ", text.translate(folds))


def compatible(c: Column) -> Column:
    """Compatibility forms (wide letters, ligatures, circled digits) as plain characters, as NFKC has them."""
    spelt = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _LIGATURES.items(), c)
    return F.translate(spelt, _FORMS, _COMPATIBLE)


def normalize_text(c: Column) -> Column:
    """Case-folded words of the compatible text, one space apart."""
    return F.array_join(F.regexp_extract_all(casefold(compatible(c)), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def normalize_compact(c: Column) -> Column:
    return F.regexp_replace(casefold(compatible(c)), r"(?U)[^\p{Alnum}]", "")


def match_key(c: Column) -> Column:
    """Letters and digits alone, without accents: for keys across spellings."""
    return F.regexp_replace(strip_accents(compatible(c)), r"(?U)[^\p{Alnum}]", "")


def safe_id(c: Column) -> Column:
    """Letters, digits, _ and - of an id; runs of others as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")


def question_slug(c: Column, length: int = 40) -> Column:
    """A page name from a question: each character that is no letter or digit as _, the first ones, no _ at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]", "_"), 1, length), "^_+|_+$", "")


def flat(c: Column) -> Column:
    """Case-folded, white space collapsed to one space."""
    return F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")


def slug(c: Column, fallback: Column | None = None, length: int = 80) -> Column:
    """Lower-case words joined by hyphens; where nothing is left, ``unbekannt-`` and 12 digits of a SHA-256."""
    base = F.substring(F.regexp_replace(F.regexp_replace(casefold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)
    source = F.coalesce(F.nullif(fallback, F.lit("")), c) if fallback is not None else c
    return F.when(base != "", base).otherwise(F.concat(F.lit("unbekannt-"), F.substring(F.sha2(source, 256), 1, 12)))


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\p{Alnum}]", ""))


def word_count(c: Column) -> Column:
    """Words of two or more characters with a letter or digit among them."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: (F.length(w) > 1) & w.rlike(r"(?U)\p{Alnum}")))


def insufficient_page(c: Column) -> Column:
    return (alnum_count(c) < 20) | (word_count(c) < 3)


def insufficient_document(c: Column, quality: Column | None = None) -> Column:
    words = F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b[a-zA-ZäöüÄÖÜß]{3,}\b"), F.lit(0)))
    poor = (alnum_count(c) < 20) | (words < 3)
    return poor | F.coalesce(quality < 0.2, F.lit(False)) if quality is not None else poor


def mask(c: Column, shown: int = 4) -> Column:
    """All but the last characters as asterisks; short values wholly."""
    return F.when(F.length(c) <= shown, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - shown), F.right(c, F.lit(shown))))


def redact(c: Column, length: int = 4000) -> Column:
    """Key-value secrets, IBANs and mail addresses replaced."""
    c = F.regexp_replace(c, r"(?i)(authorization|token|password|secret)(\s*[:=]\s*)\S+", "$1$2[REDACTED]")
    c = F.regexp_replace(c, r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[IBAN-REDACTED]")
    c = F.regexp_replace(c, r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL-REDACTED]")
    return F.substring(c, 1, length)


def strong_ids(c: Column) -> dict[str, Column]:
    """Distinct IBANs (of the text without spaces), VAT numbers and mail addresses, sorted."""
    up = F.upper(F.regexp_replace(c, " ", ""))
    # a pattern is asked only of texts that hold what it cannot do without
    found = lambda needed, x, p: F.when(needed | c.isNull(), F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(p), F.lit(0))))).otherwise(F.array().cast("array<string>"))
    return {
        "ibans": found(c.rlike("[0-9] *[0-9]"), up, r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
        "vat_ids": found(c.rlike("[0-9]{8}"), F.regexp_replace(F.upper(c), r"(DE|ATU|CHE)[\s\-]?([0-9]{8,11})", "$1$2"), r"(?:DE|ATU|CHE)[0-9]{8,11}"),
        "emails": found(c.contains("@"), c, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    }


def formula_guard(c: Column) -> Column:
    """A leading quote where a spreadsheet would take the cell for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def german_decimal(c: Column) -> Column:
    """1.234,56 as a number: every dot goes, the comma is the point; null where that is no number."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def iso_date(c: Column) -> Column:
    """DD.MM.YYYY or ISO text as ISO text; null otherwise."""
    german = F.regexp_replace(c, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")
    return F.when(german.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(german, F.lit("yyyy-MM-dd")).isNotNull(), german)


def query_words(c: Column, most: int | None = 20) -> Column:
    """Search words: three letters or more, no stop words, each once, in order; the first ``most``, or all where that is None."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.split(F.trim(F.regexp_replace(casefold(c), r"(?U)[^\w\s]", " ")), r"\s+")
    found = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))
    return found if most is None else F.slice(found, 1, most)


#: Words that a search ignores.
STOP_WORDS = ("seite", "rechnung", "datum", "betrag", "lieferant", "eur", "und", "der", "die", "das")


def expected_decimal(c: Column) -> Column:
    """A number of a ground-truth file: with both separators the dot groups and the comma is the point, else a comma is the point."""
    t = F.trim(c)
    both = t.contains(",") & t.contains(".")
    return F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("."))).try_cast("double")


def page_digits(c: Column) -> Column:
    """A page number of digits alone; null otherwise."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("int"))
