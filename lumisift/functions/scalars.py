"""Column expressions for measurements: coercion, normalisation, geometry, photometry and small scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and codes that the formats define.
NULL_WORDS = ("", "nan", "none", "null")
NULL_BANDS = ("", "<na>", "nan", "nat", "none", "null")
TRUE_WORDS = ("true", "t", "yes", "y", "detected", "detection", "1", "1.0")
FALSE_WORDS = ("false", "f", "no", "n", "nondetection", "non-detection", "0", "0.0")
GOOD_WORDS = ("good", "clean", "ok", "pass", "passed")
BAD_WORDS = ("bad", "reject", "rejected", "fail", "failed")
YES_WORDS = ("true", "t", "yes", "y")
NO_WORDS = ("false", "f", "no", "n")
#: Names of quality columns in which true means usable; in all others a flag means unusable.
POSITIVE_QUALITY = ("quality", "quality_ok", "is_good", "good_quality")
#: Filter names of one survey's three passbands.
ZTF_BANDS = {"1": "g", "2": "r", "3": "i", "zg": "g", "zr": "r", "zi": "i", "ztfg": "g", "ztfr": "r", "ztfi": "i"}
VARIABLE_CODES = ("v*", "v*?", "cv*", "lpv*", "pulsv*", "eclbin", "nova")
VARIABLE_MARKERS = ("variable", "mira", "cepheid", "rr lyr", "rrlyr", "eclips", "pulsating", "long-period variable")
HOST_CODES = ("g", "galaxy", "agn", "qso", "quasar", "seyfert", "blazar", "bllac", "radiog", "emg", "ginpair", "gincluster")
STELLAR_MARKERS = ("star", "stellar", "yso", "white dwarf", "*")


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null: only nulls reach aggregates."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rounded(c: Column, places: int = 6) -> Column:
    """A double rounded as SQL's round does: half away from zero of the scaled double, not of its decimal text."""
    scaled = F.round(c * 10.0**places)
    return F.when(F.abs(scaled) < float("inf"), scaled / 10.0**places).otherwise(c)


def number(c: Column) -> Column:
    """Text as a finite number; blank or malformed text is null."""
    return finite(F.trim(c).try_cast("double"))


def malformed(c: Column) -> Column:
    """Whether non-blank text is not a finite number."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin("") & number(c).isNull()


def flag(c: Column) -> Column:
    """Words and digits as a boolean, null if unknown."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def identifier(c: Column) -> Column:
    """An identifier, null if blank or a word for missing."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def passband(c: Column) -> Column:
    """Canonical band name."""
    name = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(x) for kv in ZTF_BANDS.items() for x in kv))
    return F.when(~name.isin(*NULL_BANDS), F.coalesce(F.try_element_at(known, F.regexp_replace(name, "[_-]", "")), name))


def quality(c: Column, name: str) -> Column:
    """Text of a quality column as usable or not, null if unknown; ``name`` decides which sense its values have."""
    word, value = F.lower(F.trim(c)), number(c)
    if name.lower() in POSITIVE_QUALITY:
        return F.when(value.isNotNull(), value > 0).when(word.isin(*GOOD_WORDS, *YES_WORDS), True).when(word.isin(*BAD_WORDS, *NO_WORDS), False)
    good = F.when(word.isin(*GOOD_WORDS, *NO_WORDS, "clear"), True).when(word.isin(*BAD_WORDS, *YES_WORDS), False)
    return F.when(value >= 0, value == 0).when(value.isNull(), good)


def broker_quality(by_sign: Column, sign: Column, flags: list[Column], withdrawn: Column) -> Column:
    """Whether a broker row is usable: by a positive subtraction in one survey, by flags and withdrawal in the other."""
    word = F.lower(F.trim(sign))
    positive = F.when(word.isin("1", *YES_WORDS), True).when(word.isin("-1", "0", *NO_WORDS), False)
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.coalesce(f == 1, F.lit(False))
    return F.when(by_sign, positive).otherwise(~(bad | F.coalesce(F.trim(withdrawn) != "", F.lit(False))))


def age_hours(mjd: Column, now_mjd: float) -> Column:
    """Hours before ``now_mjd``, null for times more than a minute in the future, negative or not finite."""
    age = (F.lit(now_mjd) - finite(mjd)) * 24.0
    return F.when((mjd >= 0) & (age >= -1.0 / 60.0), F.greatest(F.lit(0.0), age))


def first_number(*columns: str) -> Column:
    """The first of several text columns that holds a number."""
    return F.coalesce(*(number(F.col(c)) for c in columns))


def has_label(labels: Column, wanted: Column) -> Column:
    """Whether a comma list holds a label, in any case and spacing."""
    return F.array_contains(F.transform(F.split(F.upper(labels), ","), lambda x: F.trim(x)), F.upper(F.trim(wanted)))


def survey(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def channel(survey_: Column, band: Column) -> Column:
    return F.concat_ws("/", survey(survey_), passband(band))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine; the wrap of right ascension needs no care."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))) * 3600


def ab_flux_jy(magnitude: Column) -> Column:
    return 3631.0 * F.pow(F.lit(10.0), -0.4 * magnitude)


def ab_flux_error_jy(magnitude: Column, error: Column) -> Column:
    return math.log(10) / 2.5 * ab_flux_jy(magnitude) * error


def saturate(x: Column, scale: float) -> Column:
    return F.when(x > 0, -F.expm1(-x / scale)).otherwise(0.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def log_score(x: Column, scale: float) -> Column:
    return unit(F.log1p(F.greatest(x, F.lit(0.0))) / math.log1p(scale))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval."""
    p, n = successes / total, total.cast("double")
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - half) / (1 + z * z / n)), F.least(F.lit(1.0), (centre + half) / (1 + z * z / n))


def object_category(otype: Column) -> Column:
    """veto, host or unknown: codes match whole, markers anywhere; one-letter codes never inside a word."""
    name = F.regexp_replace(F.trim(F.regexp_replace(F.lower(otype), "_", " ")), r"\s+", " ")
    code = lambda codes: name.isin(*codes) | F.replace(name, F.lit(" ")).isin(*codes)
    mark = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    veto = F.when(code(VARIABLE_CODES) | mark(VARIABLE_MARKERS), "veto")
    return veto.when(code(HOST_CODES), "host").when(mark(STELLAR_MARKERS), "veto").otherwise("unknown")


def digest(*columns: str) -> Column:
    """SHA-256 of canonical JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
