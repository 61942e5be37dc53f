"""Column functions for noisy recognised text.  All but ``normalize_text`` take text that is already normalised."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike letters and what they are read as.
LOOKALIKE_FROM = "ABCEHKMOPTXYabcehkmoptxyΔδΛλ"
LOOKALIKE_TO = "АВСЕНКМОРТХУАВСЕНКМОРТХУДДЛЛ"
# Headings and field labels.
SERVICE_LABELS = (
    r"РОССИЙСКАЯ\s*ФЕДЕРАЦИЯ", r"ПАСПОРТ\s*ВЫДАН", r"ДАТА\s*ВЫДАЧИ", r"КОД\s*ПОДРАЗДЕЛЕНИЯ", "ФАМИЛИЯ", "ИМЯ",
    "ОТЧЕСТВО", "ПОЛ", r"ДАТА\s*РОЖДЕНИЯ", r"МЕСТО\s*РОЖДЕНИЯ", r"ЛИЧНАЯ\s*ПОДПИСЬ"
)
# What each cleaner takes out, in order.
ISSUER_LABELS = (
    r"РОССИЙСКАЯ\s*ФЕДЕРАЦИЯ", r"ПАСПОРТ\s*ВЫДАН", "ПАСПОРТ", "ВЫДАН", r"ДАТА\s*ВЫДАЧИ", "ДАТА", "ВЫДАЧИ",
    r"КОД\s*ПОДРАЗДЕЛЕНИЯ", "КОД", "ПОДРАЗДЕЛЕНИЯ"
)
PERSON_LABELS = ("ФАМИЛИЯ", "ИМЯ", "ОТЧЕСТВО", "ПОЛ", r"ДАТА\s*РОЖДЕНИЯ", "ДАТА", "РОЖДЕНИЯ", r"МЕСТО\s*РОЖДЕНИЯ", "МЕСТО", r"МУЖ\.?", r"ЖЕН\.?")
PLACE_LABELS = (r"МЕСТО\s*РОЖДЕНИЯ", r"МЕС\s*Т?\s*О", r"МЕСТ\s*О", "МЕСТО", "РОЖДЕНИЯ", r"ДАТА\s*РОЖДЕНИЯ", "ДАТА", "ПОЛ", r"МУЖ\.?", r"ЖЕН\.?")
SIGNATURE_LABELS = (r"ЛИЧНАЯ\s*ПОДПИСЬ", r"[АЛ]ИЧНАЯ\s*ПОД[ПН]ИСЬ", "ПОДПИСЬ", "ПОДНИСЬ")
# Compact texts that carry no value.
ISSUER_NOISE = ("РОССИЙСКАЯФЕДЕРАЦИЯ", "ПАСПОРТ", "ВЫДАН", "ПАСПОРТВЫДАН", "ДАТА", "ВЫДАЧИ", "ДАТАВЫДАЧИ", "КОД", "ПОДРАЗДЕЛЕНИЯ", "КОДПОДРАЗДЕЛЕНИЯ")
PERSON_NOISE = (
    "ФАМИЛИЯ", "ИМЯ", "ОТЧЕСТВО", "ПОЛ", "ДАТА", "РОЖДЕНИЯ", "ДАТАРОЖДЕНИЯ", "МЕСТО", "МЕСТОРОЖДЕНИЯ", "ЛИЧНАЯПОДПИСЬ",
    "АИЧНАЯПОДНИСЬ", "ПОДПИСЬ", "ПОДНИСЬ", "МУЖ", "ЖЕН"
)
PLACE_NOISE = (
    "МЕСТО", "РОЖДЕНИЯ", "МЕСТОРОЖДЕНИЯ", "ДАТА", "ДАТАРОЖДЕНИЯ", "ПОЛ", "ЛИЧНАЯПОДПИСЬ", "АИЧНАЯПОДНИСЬ", "ПОДПИСЬ",
    "ПОДНИСЬ", "МУЖ", "ЖЕН"
)
# Letters read as digits in a document number.
DIGIT_FROM, DIGIT_TO = "OОQIL|!ЗSБBВ", "000111135688"

DATE = r"(?U)\b(\d{2})[.\-/](\d{2})[.\-/](\d{4})\b"
CODE = r"(?U)\b\d{3}[-\s]?\d{3}\b"


#: Characters that NFKC leaves alone wherever they stand, but for combining marks, which are not among them.
_STABLE = r"\x00-\x7FÀ-ÖØ-öø-ÿ\u0391-\u03A1\u03A3-\u03A9\u03B1-\u03C9\u0400-\u0482\u048A-\u04FF«»\u2013\u2014\u2018\u2019\u201C-\u201E"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    if text.notna().any():
        return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))
    return text


def compatible(text: Column) -> Column:
    """NFKC, which Spark lacks: texts of stable characters stay in the JVM, for the others a column of them goes to Python."""
    other = text.rlike(f"[^{_STABLE}]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Every run of blanks as one space, trimmed; a single space is not replaced."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


#: Broken abbreviations and their repair.  The literal comes first, so that the search skips from letter to letter.
ABBREVIATIONS = (
    (r"ФОП(?<!\wФОП)(?:\.|\b)", "ГОР."), (r"Г(?<!\wГ)\s*О\s*Р\s*\.", "ГОР."), (r"ГОР\.(?<!\wГОР\.)\s*", "ГОР. "),
    (r"Р(?<!\wР)\s*О\s*В\s*Д\b", "РОВД")
)


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """One spelling for each text: look-alikes, case, quotes, dashes, blanks and broken abbreviations; null is ''."""
    out = F.coalesce(text, F.lit(""))
    out = compatible(out) if nfkc else out
    out = F.upper(F.translate(out, "Ёё" + LOOKALIKE_FROM, "Ее" + LOOKALIKE_TO))
    return repaired(squeeze(F.translate(out, "–—«»\"`'’", "--")))


def repaired(norm: Column) -> Column:
    """Repairs the broken abbreviations of a text that is normalised but for them."""
    out = norm
    for pattern, to in ABBREVIATIONS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return squeeze(out)


def joined(parts: Column, chars: str) -> Column:
    """Normalised parts in one text, which is normalised again: an abbreviation may have been broken over parts."""
    whole = F.array_join(parts, " ")
    # A one-element array binds the text, so that it is made once.
    fixed = F.transform(F.array(whole), lambda t: F.when(t.rlike(r"(?U)ФОП|Г\s*О\s*Р\s*\.|Р\s*О\s*В\s*Д"), repaired(t)).otherwise(t))
    return strip(F.element_at(fixed, 1), chars)


def compact_text(norm: Column) -> Column:
    return F.regexp_replace(norm, "[^А-ЯA-Z0-9]+", "")


def is_service_label(norm: Column) -> Column:
    return norm.rlike(r"(?U)\b(?:" + "|".join(SERVICE_LABELS) + r")\b")


def find_dates(norm: Column) -> Column:
    """Every dd.mm.yyyy as yyyy-mm-dd, in order; days and months are not checked."""
    return F.transform(
        F.regexp_extract_all(norm, F.lit(DATE), F.lit(0)),
        lambda d: F.concat_ws("-", F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2))
    )


def find_department_codes(norm: Column) -> Column:
    """Every group of six digits, as ddd-ddd."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return F.transform(
        F.regexp_extract_all(norm, F.lit(CODE), F.lit(0)),
        lambda c: F.concat_ws("-", F.substring(digits(c), 1, 3), F.substring(digits(c), 4, 3))
    )


def without(norm: Column, *labels: Iterable[str]) -> Column:
    """Dates, codes and labels as blanks.  Each group of labels is taken out at once, one group after another."""
    out = F.regexp_replace(F.regexp_replace(norm, DATE, " "), CODE, " ")
    for group in labels:
        out = F.regexp_replace(out, rf"(?U)\b(?:{'|'.join(group)})\b", " ")
    return out


def clean_issued_by_line(norm: Column) -> Column:
    return strip(squeeze(without(norm, ISSUER_LABELS)), " .,-;:")


def clean_person_line(norm: Column) -> Column:
    return strip(squeeze(F.regexp_replace(without(norm, PERSON_LABELS, SIGNATURE_LABELS), r"[^А-Я \-]", " ")), " -")


#: Repairs of a birth place only; elsewhere these letters may be something else.
_PLACE_REPAIRS = (
    (r"(?:ФОП|ГОП|Г0Р|ГОР)(?<!\w(?:ФОП|ГОП|Г0Р|ГОР))\s*\.\s*", "ГОР. "),
    (r"(?:ФОП|ГОП|Г0Р)(?<!\w(?:ФОП|ГОП|Г0Р))\b", "ГОР."), (r"Г(?<!\wГ)\s*[О0]\s*[РП]\s*\.\s*", "ГОР. "),
    (r"ГОР\.(?<!\wГОР\.)\s*", "ГОР. ")
)


def normalize_birth_place_value(norm: Column) -> Column:
    out = norm
    for pattern, to in _PLACE_REPAIRS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return strip(squeeze(out), " .,-")


def clean_birth_place_line(norm: Column) -> Column:
    return normalize_birth_place_value(squeeze(F.regexp_replace(without(norm, PLACE_LABELS, SIGNATURE_LABELS), r"[^А-Я0-9 .\-]", " ")))


def _noise(norm: Column, words: tuple[str, ...], least: int) -> Column:
    c = compact_text(norm)
    return (F.length(c) < least) | c.isin(*words) | c.rlike("^[0-9]+$")


def is_empty_issued_by(norm: Column) -> Column:
    return _noise(norm, ISSUER_NOISE, 3)


def is_empty_person_value(norm: Column) -> Column:
    return _noise(norm, PERSON_NOISE, 2)


def is_empty_birth_place(norm: Column) -> Column:
    return _noise(norm, PLACE_NOISE, 1)


def join_person_parts(parts: Column) -> Column:
    """Parts of a name cleaned once more and joined; null if nothing is left."""
    clean = F.filter(F.transform(parts, clean_person_line), lambda p: ~is_empty_person_value(p))
    return F.nullif(strip(squeeze(F.array_join(clean, " ")), " -"), F.lit(""))


def extract_sex(norm: Column) -> Column:
    undated = F.regexp_replace(norm, DATE, " ")
    c = compact_text(undated)
    alone = F.nullif(F.regexp_extract(undated, r"(?U)\b([МЖ])\b", 1), F.lit(""))
    return F.when(c.contains("ЖЕН"), "ЖЕН").when(c.contains("МУЖ"), "МУЖ").otherwise(alone)


def detect_label_types(norm: Column) -> Column:
    """The label tags of one item, in a fixed order."""
    c = compact_text(norm)
    tags = (
        ("service_header", c.contains("РОССИЙСКАЯФЕДЕРАЦИЯ")),
        ("issued_by_label", c.contains("ПАСПОРТВЫДАН") | c.isin("ПАСПОРТ", "ВЫДАН")),
        ("issue_date_label", c.contains("ДАТАВЫДАЧИ")),
        ("department_code_label", c.contains("КОДПОДРАЗДЕЛЕНИЯ")),
        ("last_name_label", c.contains("ФАМИЛИЯ")),
        ("first_name_label", c == "ИМЯ"),
        ("middle_name_label", c.contains("ОТЧЕСТВО")),
        ("sex_label", c.isin("ПОЛ", "ILОЛ", "IЛОЛ", "1ЛОЛ")),
        ("date_label_fragment", c == "ДАТА"),
        ("birth_date_label", c.contains("ДАТАРОЖДЕНИЯ")),
        ("birth_related_label_fragment", c.isin("РОЖДЕНИЯ", "РОЖДЕН")),
        ("birth_place_label", c.contains("МЕСТОРОЖДЕНИЯ") | c.isin("МЕС", "МЕСТ", "МЕСТОРОЖДЕН") | c.rlike("^МЕСТ?.?О$")),
        ("signature_label", c.contains("ЛИЧНАЯПОДПИСЬ") | c.contains("АИЧНАЯПОДНИСЬ") | c.isin("ПОДПИСЬ", "ПОДНИСЬ")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tags]))


def refine_label_types(types: Column, norm: Column, line: Column) -> Column:
    """Adds the birth labels that only the whole line tells apart."""
    c, whole = compact_text(norm), compact_text(line)
    birth = whole.contains("РОЖДЕН")
    date = birth & whole.contains("ДАТА") & c.isin("ДАТА", "РОЖДЕНИЯ", "РОЖДЕН")
    place = birth & whole.contains("МЕС") & (c.isin("МЕС", "МЕСТ", "РОЖДЕНИЯ", "РОЖДЕН") | c.rlike("^МЕСТ?.?О$"))
    more = F.array_compact(F.array(F.when(date, F.lit("birth_date_label")), F.when(place, F.lit("birth_place_label"))))
    return F.array_union(types, more)


def classify_font(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio <= 0.45, "small").when(ratio >= 0.80, "large").otherwise("normal")


def document_number_digits(text: Column) -> Column:
    """The digits of a text, with the letters that are read for digits; any script's digits count."""
    return F.regexp_replace(F.translate(F.upper(compatible(F.coalesce(text, F.lit("")))), DIGIT_FROM, DIGIT_TO), r"(?U)\D", "")


def format_document_number(digits: Column) -> Column:
    return F.when(F.length(digits) == 10, F.concat_ws(" ", F.substring(digits, 1, 4), F.substring(digits, 5, 6)))


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"(?U)^\d{4}-\d{2}-\d{2}\z")


def sanitize_archive_name(name: Column) -> Column:
    out = F.left(strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[^\p{L}\p{N}\-_.]", "_"), "._"), F.lit(120))
    return F.when(out == "", "request").otherwise(out)
