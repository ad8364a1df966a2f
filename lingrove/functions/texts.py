"""Scalar functions on descriptors, keys and encodings."""

from __future__ import annotations

import enum
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DESCRIPTOR = r"^([^_/-]*)(?:_([^/-]*))?(?:-([^/]*))?(?:/(.*))?$"


def descriptor_parts(text: Column) -> Column:
    """struct(language, region, encoding, source) of ``lang_REG-enc/source``; a part that isn't there is null, and ``/`` binds first."""
    part = lambda i: F.nullif(F.regexp_extract(text, _DESCRIPTOR, i), F.lit(""))
    return F.when(text.isNotNull(), F.struct(part(1).alias("language"), part(2).alias("region"), part(3).alias("encoding"), part(4).alias("source")))


def descriptor(language: Column, region: Column, encoding: Column) -> Column:
    """``lang_REG-enc`` without the parts that are null or empty."""
    some = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(F.coalesce(language, F.lit("")), some("_", region), some("-", encoding))


SCRIPTS: list[tuple[str, list[str], list[str]]] = [  # script, encodings, beginnings of encodings; lower case, the first that fits
    ("Arabic", ["iso-8859-6"], []),
    ("Armenian", ["armscii8"], []),
    ("Cyrillic", ["koi7", "cp866", "ruscii", "windows-1251", "iso-8859-5", "latin-5", "maccyrillic"], ["koi8-"]),
    ("Devanagari", ["iscii"], []),
    ("Greek", ["iso-8859-7", "cp737"], []),
    ("Han", ["gb2312", "gb-2312", "gb18030", "gbk", "big5", "euc-cn", "euc-tw"], []),
    ("Hangul", ["euc-kr"], []),
    ("Hebrew", ["cp862"], ["iso-8859-8"]),
    ("Kanji", ["shiftjis", "shift-jis", "iso-2022", "euc-jp"], ["euc-jis"]),
    ("Thai", ["tis620", "tscii", "iso-8859-11"], []),
    ("Vietnamese", ["viscii"], []),
    ("Latin", ["ascii", "cp437"], ["ascii-16", "iso-8859-", "latin"]),
]


def guess_script(encoding: Column, script: Column | None = None) -> Column:
    """Script that an encoding implies, unless one is known; UNKNOWN where nothing is."""
    e = F.lower(encoding)
    guess = None
    for name, whole, begins in SCRIPTS:
        test = e.isin(*whole)
        for b in begins:
            test = test | e.startswith(b)
        guess = F.when(test, F.lit(name)) if guess is None else guess.when(test, F.lit(name))
    known = F.lit(None) if script is None else F.when(F.upper(script).isin("", "UNKNOWN"), None).otherwise(script)
    return F.coalesce(known, guess, F.lit("UNKNOWN"))


def matches(language: Column, region: Column, encoding: Column, source: Column, want: Column) -> Column:
    """Whether a model fits a wanted descriptor (a struct as ``descriptor_parts`` gives): the language in any case, the others where both have one."""
    fits = lambda have, w: F.coalesce(w, F.lit("")).eqNullSafe("") | F.coalesce(have, F.lit("")).eqNullSafe("") | (F.lower(have) == F.lower(w))
    return (F.lower(language) == F.lower(want["language"])) & fits(region, want["region"]) & fits(encoding, want["encoding"]) & fits(source, want["source"])


def same_language(a: dict[str, Column], b: dict[str, Column], ignore_region: bool = False, with_source: bool = False) -> Column:
    """Equality of (language, region, encoding), null equal to null; optionally without the region, or with the source."""
    names = ["language", *([] if ignore_region else ["region"]), "encoding", *(["source"] if with_source else [])]
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def unique_model(languages: DataFrame, wanted: str) -> DataFrame:
    """The one model that fits a descriptor; no row when several do."""
    want = descriptor_parts(F.lit(wanted))
    found = languages.where(matches(F.col("language"), F.col("region"), F.col("encoding"), F.col("source"), want))
    n = found.agg(F.count("*").alias("_n"))
    return found.crossJoin(F.broadcast(n)).where("_n = 1").drop("_n")


# ---- keys -------------------------------------------------------------------

_QUOTED = {0: "\\0", 10: "\\n", 13: "\\r", 9: "\\t", 12: "\\f", 32: "\\ ", 92: "\\\\"}
_UNQUOTED = {"0": b"\0", "n": b"\n", "r": b"\r", "t": b"\t", "f": b"\f", " ": b" ", "\\": b"\\"}


def quote_key(key: bytes) -> str:
    """Form of a key in frequency lists; bytes that aren't UTF-8 are kept as surrogate escapes."""
    return "".join(_QUOTED.get(b, chr(b)) if b < 128 else chr(b) for b in key).encode("latin-1").decode("utf-8", "surrogateescape")


def unquote_key(text: str) -> bytes:
    raw, out, i = text.encode("utf-8", "surrogateescape"), bytearray(), 0
    while i < len(raw):
        if raw[i] == 92 and i + 1 < len(raw):
            out += _UNQUOTED.get(chr(raw[i + 1]), raw[i + 1 : i + 2])
            i += 2
        else:
            out.append(raw[i])
            i += 1
    return bytes(out)


def escaped_key(key_hex: Column) -> Column:
    """Form of a key in dumps of the database: backslashes and blanks after a backslash, bytes below 0x20 as backslash and two hex digits."""
    pairs = F.regexp_extract_all(key_hex, F.lit("(..)"), F.lit(1))
    safe = F.transform(pairs, lambda p: F.when(p == "5C", F.lit("5C5C")).when(p == "20", F.lit("5C20")).when(p < "20", F.concat(F.lit("5C"), F.hex(p))).otherwise(p))
    return F.try_to_binary(F.array_join(safe, ""), F.lit("hex")).cast("string")


def _each(fn, kind: str):
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fn(x) for x in col.to_pylist()], pa.binary() if kind == "binary" else pa.string())

    return F.arrow_udf(run, kind)


def unquoted(text: Column) -> Column:
    return _each(unquote_key, "binary")(text)


def quoted(key: Column) -> Column:
    return _each(lambda b: quote_key(bytes(b)), "string")(key)


# ---- encodings --------------------------------------------------------------


class Extension(enum.Enum):
    """How 8-bit input becomes 16-bit units before n-grams are taken."""

    NONE = "none"
    ASCII_LITTLE = "2l"
    ASCII_BIG = "2b"
    UTF8_LITTLE = "8l"
    UTF8_BIG = "8b"


def latin1_to_utf8(b: Column) -> Column:
    return F.encode(F.decode(b, "ISO-8859-1"), "UTF-8")


def widened(b: Column, ext: Extension) -> Column:
    """16-bit units: of the bytes themselves, or of the code points of UTF-8 (those beyond the first plane as surrogate pairs)."""
    if ext is Extension.NONE:
        return b
    little = ext in (Extension.ASCII_LITTLE, Extension.UTF8_LITTLE)
    if ext in (Extension.ASCII_LITTLE, Extension.ASCII_BIG):
        return F.encode(F.decode(b, "ISO-8859-1"), "UTF-16LE" if little else "UTF-16BE")
    # bytes that are no UTF-8 break off their character, and reading goes on
    broken = _each(lambda x: bytes(x).decode("utf-8", "ignore").encode("utf-16-le" if little else "utf-16-be"), "binary")
    text = b.cast("string")
    return F.when(F.is_valid_utf8(text), F.encode(text, "UTF-16LE" if little else "UTF-16BE")).otherwise(broken(F.when(~F.is_valid_utf8(text), b)))


def from_utf16(b: Column, big: bool) -> Column:
    """Text of 16-bit units, surrogates joined; units that are no character are left out."""
    return _each(lambda x: bytes(x).decode("utf-16-be" if big else "utf-16-le", "ignore"), "string")(b)


def without_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def without_blank_bytes(b: Column) -> Column:
    """Bytes without 0x20."""
    return F.unhex(F.regexp_replace(F.hex(b), "\\G((?:(?!20)..)*)20", "$1"))


def transliterated(b: Column, source: str, target: str = "utf-8") -> Column:
    """Bytes in another encoding; bytes that aren't valid in ``source`` pass through, characters that ``target`` lacks lose their accents, or become ?."""

    def one(x: bytes) -> bytes:
        text = bytes(x).decode(source, "surrogateescape")
        out = bytearray()
        for ch in text:
            if 0xDC80 <= ord(ch) <= 0xDCFF:
                out.append(ord(ch) - 0xDC00)
                continue
            try:
                out += ch.encode(target)
            except UnicodeEncodeError:
                out += "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).encode(target, "replace")
        return bytes(out)

    return _each(one, "binary")(b)


def code_point_utf8(cp: Column) -> Column:
    """UTF-8 bytes of a code point; null outside Unicode and for surrogates."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if c is None or not 0 <= c <= 0x10FFFF or 0xD800 <= c <= 0xDFFF else chr(c).encode() for c in col.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(cp.cast("bigint"))


def code_point_ranges(spec: str) -> list[tuple[int, int]]:
    """``0x410-0x412, 0x416`` as (first, last) pairs; a part that can't be read raises."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        a = int(first.strip(), 0)
        out.append((a, int(last.strip(), 0) if last else a))
    return out


# ---- romanization -----------------------------------------------------------

_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўјљњћђџ", ["a", "b", "v", "g", "d", "e", "ë", "ž", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "č", "š", "ŝ", "ʺ", "y", "ʹ", "è", "û", "â", "ì", "ï", "ê", "g̀", "ŭ", "ǰ", "l̂", "n̂", "ć", "đ", "d̂"], strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ", ["a", "v", "g", "d", "e", "z", "ī", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "f", "ch", "ps", "ō", "á", "é", "ī́", "í", "ó", "ý", "ṓ", "ï", "ÿ", "ḯ", "ÿ́"], strict=True))
_ARABIC = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئةى", ["ā", "b", "t", "ṯ", "ǧ", "ḥ", "ẖ", "d", "ḏ", "r", "z", "s", "š", "ṣ", "ḍ", "ṭ", "ẓ", "ʿ", "ġ", "f", "q", "k", "l", "m", "n", "h", "w", "y", "ʾ", "ʾā", "ʾ", "ʾ", "ʾ", "ʾ", "ẗ", "ỳ"], strict=True)) | {"،": ",", "؛": ";", "؟": "?"} | {chr(0x660 + d): str(d) for d in range(10)} | dict(zip("ًٌٍَُِّْ", ["an", "un", "in", "a", "u", "i", "", ""], strict=True))
ROMAN = {**_CYRILLIC, **_GREEK, **_ARABIC}
ROMAN |= {k.upper(): v[:1].upper() + v[1:] for k, v in (_CYRILLIC | _GREEK).items() if len(k.upper()) == 1 and k.upper() != k}


def romanized(text: Column) -> Column:
    """Greek, Cyrillic and Arabic letters in Latin ones (after ISO 9, ISO 843 and DIN 31635); everything else as it is. One pass over each text that has such a letter."""
    table = str.maketrans(ROMAN)
    some = text.rlike("[\u0370-\u03ff\u0400-\u04ff\u0600-\u06ff]")
    return F.when(some, _each(lambda x: x.translate(table), "string")(F.when(some, text))).otherwise(text)
