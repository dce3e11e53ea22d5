"""Text, hash, identifier and language expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "(?U)\\s+"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def clean_text(x: Column) -> Column:
    """White space squeezed to single blanks and stripped."""
    return F.btrim(F.regexp_replace(x, WHITE, " "))


def repair_mojibake(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again as what it is; any other text as it is."""
    single = x.rlike("^[\\x{00}-\\x{ff}]*$") & x.rlike("[\\x{c2}-\\x{f4}][\\x{80}-\\x{bf}]")
    raw = F.encode(F.when(single, x), "ISO-8859-1")
    read = F.try_validate_utf8(raw.cast("string"))
    return F.when(single & read.isNotNull(), read).otherwise(x)


def sanitize_filename(x: Column, max_length: int = 50) -> Column:
    """A safe file stem; 'untitled' if nothing is left."""
    safe = F.regexp_replace(x, '[<>:"/\\\\|?*]', "")
    safe = F.regexp_replace(F.regexp_replace(safe, WHITE, "_"), "_+", "_")
    safe = F.regexp_replace(F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, max_length), "_+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled"))


def text_hash(x: Column, algorithm: str = "sha256") -> Column:
    known = {"sha256": lambda v: F.sha2(v, 256), "sha512": lambda v: F.sha2(v, 512), "md5": F.md5, "sha1": F.sha1}
    return known[algorithm](x.cast("binary"))


def generate_id(x: Column, prefix: str = "", length: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.substring(text_hash(x), 1, length))


def fuzzy_hash(x: Column, n: int = 3, step: int = 10, parts: int = 5) -> Column:
    """The first ``parts`` of every ``step``-th character n-gram of the text without white space, as short digests."""
    plain = F.regexp_replace(F.lower(x), WHITE, "")
    starts = F.filter(F.array(*[F.lit(1 + step * i) for i in range(parts)]), lambda i: i <= F.char_length(plain) - (n - 1))
    return F.array_join(F.transform(starts, lambda i: F.substring(F.md5(F.substr(plain, i, F.lit(n)).cast("binary")), 1, 8)), "-")


def chunk_id(text: Column, source: Column, index: Column) -> Column:
    return F.concat(source.cast("string"), F.lit("_chunk"), index.cast("string"), F.lit("_"), F.substring(F.md5(F.substring(text, 1, 100).cast("binary")), 1, 8))


def file_version(stem: Column, modified: Column) -> Column:
    """A version number in the name, or a date in it, or the day of the last change."""
    number = F.regexp_extract(stem, "v?(\\d+\\.\\d+(?:\\.\\d+)?)", 1)
    date = F.regexp_extract(stem, "(\\d{4}-?\\d{2}-?\\d{2})", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(date, F.lit("")), F.date_format(modified, "yyyyMMdd"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by number, missing parts as 0; as text if a part is no number."""
    split = lambda v: F.split(v, "\\.")
    numbers = lambda v: F.transform(split(v), lambda x: x.try_cast("long"))
    size = F.greatest(F.size(split(a)), F.size(split(b)))
    padded = lambda v: F.slice(F.concat(numbers(v), F.array_repeat(F.lit(0).cast("long"), size)), F.lit(1), size)
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    odd = F.exists(F.concat(numbers(a), numbers(b)), lambda x: x.isNull())
    return F.when(odd, sign(a, b)).otherwise(sign(padded(a), padded(b)))


# Character ranges of the scripts.
HIRAGANA, KATAKANA, KANJI, HANGUL = "\\x{3040}-\\x{309F}", "\\x{30A0}-\\x{30FF}", "\\x{4E00}-\\x{9FFF}", "\\x{AC00}-\\x{D7AF}"


def _share(x: Column, ranges: str) -> Column:
    return F.regexp_count(x, F.lit(f"[{ranges}]")) / F.char_length(x)


def detect_language(x: Column, korean: bool = False, sample: int = 300) -> Column:
    """ja, ko (if asked for), zh, en or other from the scripts of the first characters; unknown if empty."""
    head = F.substring(x, 1, sample)
    kana, kanji = _share(head, HIRAGANA + KATAKANA), _share(head, KANJI)
    found = F.when(F.coalesce(F.char_length(head), F.lit(0)) == 0, "unknown").when(kana > 0.15, "ja")
    if korean:
        found = found.when(_share(head, HANGUL) > 0.3, "ko")
    return found.when((kanji > 0.3) & (kana < 0.05), "zh").when(_share(head, "\\x00-\\x7F") > 0.7, "en").otherwise("other")


def document_language(x: Column, sample: int = 500) -> Column:
    """ja if kana and kanji make up over 0.3 of the first characters, else en."""
    head = F.substring(x, 1, sample)
    return F.when((F.char_length(head) > 0) & (_share(head, HIRAGANA + KATAKANA + KANJI) > 0.3), "ja").otherwise("en")


#: Sizes and overlaps of retrieval and graph chunks by language.
CHUNK_SIZES = {"en": (320, 120, 512, 50), "ja": (200, 80, 350, 35)}


def split_sentences(x: Column) -> Column:
    return F.filter(F.split(x, "(?<=[。．.!?])\\s+"), lambda s: stripped(s) != "")


def split_japanese_sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "(?<=[。！？])|(?<=[.!?]\\n)"), stripped), lambda s: s != "")


def token_estimate(x: Column) -> Column:
    return F.floor(F.char_length(x) / 4)


def safe_get(*choices: Column, default: object = None) -> Column:
    """The first value that is there."""
    return F.coalesce(*choices, F.lit(default))


def ensure_list(x: Column) -> Column:
    return F.coalesce(x, F.array())


def path_nodes(x: Column) -> Column:
    """Nodes of 'a -> b -> c'."""
    return F.filter(F.transform(F.split(x, "->"), stripped), lambda n: n != "")


def path_pairs(nodes: Column) -> Column:
    """Consecutive nodes of a path."""
    return F.when(F.size(nodes) > 1, F.zip_with(F.slice(nodes, F.lit(1), F.size(nodes) - 1), F.slice(nodes, F.lit(2), F.size(nodes) - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))
