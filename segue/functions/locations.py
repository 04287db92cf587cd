"""Locations as the programs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue.functions.text import let, normalise_path

# File kind labels, device file-type codes, formats players cannot play.
KIND_LABELS = {
    "mp3": "MP3 File", "m4a": "M4A File", "mp4": "M4A File", "aac": "AAC File",
    "flac": "FLAC File", "wav": "WAV File", "aif": "AIFF File", "aiff": "AIFF File",
}
FILE_TYPE_CODES = {
    "mp3": 1, "m4a": 4, "mp4": 4, "aac": 4, "flac": 5, "wav": 11, "aif": 12, "aiff": 12,
}
FILE_TYPE_ALAC = 6
UNPLAYABLE = ("ogg", "oga", "opus", "wma", "ape", "wv", "caf", "mka", "webm")
# Analysis folder hash multipliers, modulus, and (shift, mask) of the bucket bits.
HASH_MULTIPLIERS = (0x5BC9, 0x93B5)
HASH_MODULUS = 200003
BUCKET_BITS = ((0, 1), (1, 2), (4, 4), (4, 8), (5, 16), (8, 32), (10, 64))


def _lookup(mapping: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, key)


def kind_label(ext: Column) -> Column:
    return F.coalesce(_lookup(KIND_LABELS, ext), F.lit(""))


def file_type_code(ext: Column, codec: Column | None = None) -> Column:
    code = F.coalesce(_lookup(FILE_TYPE_CODES, ext), F.lit(1))
    if codec is None:
        return code
    return F.when(F.coalesce(codec, F.lit("")) == "alac", F.lit(FILE_TYPE_ALAC)).otherwise(code)


def is_unplayable(ext: Column) -> Column:
    return ext.isin(*UNPLAYABLE)


def location_to_path(location: Column) -> Column:
    """``file://localhost/C:/a%20b.mp3`` -> ``C:/a b.mp3``; POSIX paths keep their slash."""
    body = F.regexp_replace(location, "^file://(localhost)?", "")
    # '+' is literal here, and a '%' that starts no valid escape stays a '%'
    safe = F.regexp_replace(F.replace(body, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    path = F.url_decode(safe)
    return F.regexp_replace(path, "^/([A-Za-z]:/)", "$1")


def _quote(path: Column, keep_colon: bool) -> Column:
    text = F.url_encode(path)
    fixes = [("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")]
    if keep_colon:
        fixes.append(("%3A", ":"))
    for old, new in fixes:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def path_to_location(path: Column) -> Column:
    slashed = normalise_path(path)
    return (
        F.when(
            slashed.rlike("^[A-Za-z]:/"),
            F.concat(F.lit("file://localhost/"), _quote(slashed, keep_colon=True)),
        )
        .when(slashed.startswith("//"), F.concat(F.lit("file:"), _quote(slashed, False)))
        .otherwise(F.concat(F.lit("file://localhost"), _quote(slashed, False)))
    )


def to_root_relative(location: Column, root: Column) -> Column:
    """Absolute path -> relative to ``root`` (compared without case), no leading slash."""
    path = normalise_path(location)
    base = F.rtrim(normalise_path(root), F.lit("/"))
    inside = (base != "") & F.startswith(F.lower(path), F.concat(F.lower(base), F.lit("/")))
    stripped = (
        F.when(inside, F.substring(path, F.length(base) + 2, F.length(path)))
        .when(path.rlike("^[A-Za-z]:/"), F.substring(path, F.lit(4), F.length(path)))
        .otherwise(path)
    )
    return F.ltrim(stripped, F.lit("/"))


def from_root_relative(stored: Column, root: Column) -> Column:
    base = F.rtrim(normalise_path(root), F.lit("/"))
    return F.concat(base, F.lit("/"), F.ltrim(stored, F.lit("/")))


def analysis_folder(path: Column) -> Column:
    """``/PIONEER/USBANLZ/Pxxx/xxxxxxxx``: a 32-bit rolling hash over UTF-16 units.

    The JVM's own string units are read from the UTF-16 encoding, four hex digits each;
    each unit is folded in twice with different multipliers.
    """
    low32 = F.lit(0xFFFFFFFF)

    def fold(acc: Column, unit: Column) -> Column:
        for m in HASH_MULTIPLIERS:
            acc = (acc * m + unit).bitwiseAND(low32)
        return acc

    def hashed(digits: Column) -> Column:
        units = F.filter(F.sequence(F.lit(0), F.length(digits), F.lit(4)), lambda i: i < F.length(digits))
        return F.aggregate(
            units, F.lit(0).cast("bigint"),
            lambda acc, i: fold(acc, F.conv(F.substring(digits, i + 1, F.lit(4)), 16, 10).cast("bigint")),
        ) % HASH_MODULUS

    def folder(r: Column) -> Column:
        bucket = F.lit(0).cast("bigint")
        for shift, mask in BUCKET_BITS:
            bits = F.shiftright(r, shift).bitwiseAND(F.lit(mask).cast("bigint"))
            bucket = bucket.bitwiseOR(bits)
        return F.concat(
            F.lit("/PIONEER/USBANLZ/P"), F.lpad(F.hex(bucket), 3, "0"), F.lit("/"),
            F.lpad(F.hex(r), 8, "0"),
        )

    return let(let(F.hex(F.encode(path, "UTF-16BE")), hashed), folder)


def playlist_path(parents: Column, name: Column) -> Column:
    return F.array_join(F.concat(parents, F.array(name)), " / ")


def flat_playlist_name(parents: Column, name: Column, is_crate: Column) -> Column:
    """Display path for targets without folders; crates lose the "Crates" folder."""
    kept = F.filter(parents, lambda p: (p != "Crates") | ~is_crate)
    return F.array_join(F.concat(kept, F.array(name)), " / ")
