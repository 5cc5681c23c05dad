"""String, number and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions.arrays import bind

# fixed values: file types the upload gate and the object store accept
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "tif", "tiff")

TOKEN_PATTERN = "[A-Za-z0-9]+"
WORD_PATTERN = "[^ \\t\\r\\n]+"
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))


def stripped(value: Column) -> Column:
    """Text without white space at its ends, all kinds of it."""
    return F.btrim(value, F.lit(WHITE))


def split_words(text: Column) -> Column:
    """Whitespace-separated words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def tokenize(words: Column) -> Column:
    """Lower-case alphanumeric runs of all words; an empty document is ['empty']."""
    runs = F.regexp_extract_all(F.concat_ws(" ", words), F.lit(TOKEN_PATTERN), F.lit(0))
    return bind(
        F.transform(runs, F.lower), lambda t: F.when(F.size(t) == 0, F.array(F.lit("empty"))).otherwise(t)
    )


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def clean_key_part(value: Column, fallback: Column) -> Column:
    """Keep letters, digits, `_.-`; every other run becomes one dash."""
    dashed = F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(blank_to_null(F.btrim(dashed, F.lit("-"))), fallback)


def safe_stem(value: Column) -> Column:
    """Replace each character that is no letter, digit, dash or underscore."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")


def base_name(split: Column, image_id: Column, file_name: Column) -> Column:
    return F.concat_ws("__", split, image_id.cast("string"), safe_stem(path_stem(file_name)))


def slugify(value: Column) -> Column:
    slug = F.btrim(F.regexp_replace(value, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(blank_to_null(slug), F.lit("template"))


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(path_name(path), r"^(.+)\.[^.]*$", "$1")


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path_name(path), r"^.+\.([^.]+)$", 1))


def upload_extension(name: Column) -> Column:
    """Lower-case text from the last dot on, dot included; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def image_extension(name: Column, content_type: Column) -> Column:
    suffix, kind = path_suffix(F.coalesce(name, F.lit(""))), F.lower(content_type)
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES), suffix)
        .when(kind == "image/png", F.lit("png"))
        .when(kind.isin("image/jpeg", "image/jpg"), F.lit("jpg"))
        .when(kind == "image/webp", F.lit("webp"))
        .otherwise(F.lit("bin"))
    )


def mime_type(path: Column) -> Column:
    suffix = path_suffix(path)
    return (
        F.when(suffix.isin("jpg", "jpeg"), F.lit("image/jpeg"))
        .when(suffix.isin("tif", "tiff"), F.lit("image/tiff"))
        .when(suffix.isin("webp", "gif", "bmp"), F.concat(F.lit("image/"), suffix))
        .when(suffix == "pdf", F.lit("application/pdf"))
        .otherwise(F.lit("image/png"))
    )


def split_of_file(name: Column) -> Column:
    return F.get(F.split(name, "-"), F.lit(0))


def parse_number(text: Column) -> Column:
    """Double, or null for text that is no plain decimal number (NaN included)."""
    return F.when(text.rlike(NUMBER_PATTERN), stripped(text).try_cast("double"))


def iso_utc(ts: Column, instant: bool = True) -> Column:
    """ISO-8601 text with microseconds and a UTC offset, whatever the session's time zone.

    `instant` is false for timestamps without a zone, which already hold UTC.
    """
    ts = F.to_utc_timestamp(ts, F.current_timezone()) if instant else ts
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def stable_seed(text: Column, seed: int) -> Column:
    """First 16 hex digits of sha256('seed:text') as an unsigned number in text form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10)


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def half_even(value: Column) -> Column:
    return F.bround(value, 0)


def score_percent(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(score * 100).cast("int")))


def clean_email(value: Column) -> Column:
    return F.lower(stripped(value))


def is_email(value: Column) -> Column:
    """One '@', a local part, and a dot in the domain."""
    parts = F.split(value, "@")
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (F.size(parts) == 2) & (F.length(local) > 0) & F.contains(domain, F.lit("."))


def is_safe_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]+$")


def dictionary_words(text: Column) -> Column:
    """Letter runs of a text, outer apostrophes removed, 2 to 12 letters long."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z']+"), F.lit(0))
    clean = F.transform(raw, lambda w: F.lower(F.btrim(w, F.lit("'"))))
    return F.filter(clean, lambda w: F.length(w).between(2, 12))


def vector_literal(values: Column) -> Column:
    """`[0.12345678,...]`, the text form vector databases exchange."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(values, lambda v: F.format_string("%.8f", v.cast("double"))), ","), F.lit("]")
    )
