"""Column functions for text: blank handling, folding, tokenising, signatures."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a general-purpose string strip sees it, written so that both the JVM
# and RE2 accept the class.
WS = r"[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# A word character run; letters, marks, digits and underscore of any script.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"

# The character map applied before tokenising (letter -> base letter).
CHAR_MAP_FROM = "đĐăâáàảãạấầẩẫậắằẳẵặ"
CHAR_MAP_TO = "dDaaaaaaaaaaaaaaaaa"

# The 26 stop words.
STOP_WORDS = [
    "của", "và", "trong", "với", "đã", "được", "có", "là", "từ",
    "cho", "về", "theo", "như", "khi", "nếu", "để", "sẽ", "đến",
    "tại", "các", "những", "một", "này", "đó", "không", "hoặc",
]


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """Two aligned strings for ``translate``: accented Latin letters and their base letters.

    Built from Unicode decompositions; letters without one are given by hand.
    """
    src, dst = ["đ", "Đ", "ø", "Ø", "ł", "Ł", "ı"], ["d", "D", "o", "O", "l", "L", "i"]
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_ascii(col: Column) -> Column:
    """Replace accented Latin letters by their base letters (one letter to one letter)."""
    src, dst = fold_tables()
    return F.translate(col, src, dst)


def fold_word(word: str) -> str:
    src, dst = fold_tables()
    return word.translate(str.maketrans(src, dst))


def py_strip(col: Column) -> Column:
    """Strip every kind of whitespace from both ends, not only blanks."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def is_blank(col: Column) -> Column:
    return F.coalesce(~col.rlike(f"[^{WS[1:]}"), F.lit(True))


def signature(col: Column, length: int | None = None) -> Column:
    """A short key of a lower-cased, stripped text, empty for a blank one; equal signatures count as the same passage.

    With ``length`` only so many characters count.
    """
    head = F.lower(py_strip(col if length is None else F.substring(col, 1, length)))
    return F.when(head == "", "").otherwise(F.md5(head))


def words(col: Column) -> Column:
    """Whitespace-separated words, blanks dropped."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def cut(col: Column) -> Column:
    """The word tokens of a text that is mapped and in lower case already."""
    return F.regexp_extract_all(col, F.lit(f"({TOKEN})"), F.lit(1))


def tokens(col: Column) -> Column:
    """Character map, word tokens, lower case; one entry per position."""
    return cut(F.lower(F.translate(col, CHAR_MAP_FROM, CHAR_MAP_TO)))


def token_lists(col: Column) -> tuple[Column, Column]:
    """``tokens`` and the same tokens folded; the second is null where folding changes nothing.

    Folding turns a letter into a letter, so the folded text has its words at the same positions.
    """
    mapped = F.lower(F.translate(col, CHAR_MAP_FROM, CHAR_MAP_TO))
    folded = fold_ascii(mapped)
    return cut(mapped), F.when(folded != mapped, cut(folded))


def is_ascii(col: Column) -> Column:
    """Told by its lengths alone; such a text has no letter to map or fold."""
    return F.octet_length(col) == F.length(col)


def mapped_lower(col: Column) -> Column:
    """Character map and lower case; only texts that are not ASCII are looked through for letters to map."""
    return F.lower(F.when(is_ascii(col), col).otherwise(F.translate(col, CHAR_MAP_FROM, CHAR_MAP_TO)))


def fold_token(token: Column) -> Column:
    """``fold_ascii`` for a single word, most of which have nothing to fold."""
    return F.when(is_ascii(token), token).otherwise(fold_ascii(token))


def stop_list(strict: bool = False, stop_words: list[str] | None = None) -> list[str]:
    """Stop words as matched after folding.

    ``strict`` keeps the list as it is, so a stop word that the character map has already
    rewritten slips through; otherwise mapped and folded spellings are removed as well.
    """
    base = STOP_WORDS if stop_words is None else stop_words
    if strict:
        return sorted(set(base))
    mapped = [w.translate(str.maketrans(CHAR_MAP_FROM, CHAR_MAP_TO)) for w in base]
    return sorted({*base, *mapped, *(fold_word(w) for w in base)})


def stem_plural(col: Column) -> Column:
    """Light English plural stemming: ies -> y, es -> e, s -> nothing, with the usual guards."""
    return (
        F.when(F.length(col) < 3, col)
        .when(col.rlike("[^ea]ies$"), F.regexp_replace(col, "ies$", "y"))
        .when(col.rlike("[^aeo]es$"), F.regexp_replace(col, "s$", ""))
        .when(col.rlike("[^us]s$") & ~col.rlike("(ies|es)$"), F.regexp_replace(col, "s$", ""))
        .otherwise(col)
    )


def analyzed_forms(
    token: Column, strict: bool = False, stem: bool = False, stop_words: list[str] | None = None
) -> Column:
    """Forms one token is indexed under: the folded one and the original, minus stop words."""
    forms = F.array_distinct(F.array(fold_ascii(token), token))
    stops = stop_list(strict, stop_words)
    if stops:
        forms = F.filter(forms, lambda f: ~f.isin(stops))
    if stem:
        forms = F.array_distinct(F.transform(forms, stem_plural))
    return forms


def analyze(
    col: Column, mode: str = "search", strict: bool = False, stem: bool = False,
    stop_words: list[str] | None = None,
) -> Column:
    """Flat list of analysed terms. ``mode='index'`` with ``stem`` stems; search never does."""
    use_stem = stem and mode == "index"
    return F.flatten(
        F.transform(tokens(col), lambda t: analyzed_forms(t, strict, use_stem, stop_words))
    )


def keyword_normal(col: Column) -> Column:
    """Whole value as one term: character map, lower case, folded."""
    return fold_ascii(F.lower(F.translate(col, CHAR_MAP_FROM, CHAR_MAP_TO)))


def sentence_spans(text: Column, min_len: int = 10) -> Column:
    """Spans of the pieces between '. ', offsets in characters of the original text.

    For passages: the list is built piece by piece. Whole documents go through ``keyword.char_spans``.
    """
    pieces = F.split(text, r"\. ")
    widths = F.transform(pieces, lambda p: F.length(p))
    acc = F.aggregate(
        F.arrays_zip(pieces.alias("p"), widths.alias("w")),
        F.struct(
            F.lit(0).alias("pos"),
            F.expr("cast(array() as array<struct<start:int,end:int,text:string,type:string>>)").alias("out"),
        ),
        lambda a, x: F.struct(
            (a["pos"] + x["w"] + F.lit(2)).alias("pos"),
            F.when(
                F.length(py_strip(x["p"])) > min_len,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            a["pos"].alias("start"),
                            (a["pos"] + x["w"]).alias("end"),
                            py_strip(x["p"]).alias("text"),
                            F.lit("sentence").alias("type"),
                        )
                    ),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return acc


def content_span(text: Column, start: Column, end: Column, cut: int = 100) -> Column:
    """One whole-passage span where both offsets are given, else an empty list."""
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.array(
            F.struct(
                start.cast("int").alias("start"),
                end.cast("int").alias("end"),
                F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("...")))
                .otherwise(text).alias("text"),
                F.lit("content").alias("type"),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string,type:string>>)"))
