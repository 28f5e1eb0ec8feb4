"""One consistent form for texts that look the same but differ in their characters.

Each Arrow batch of texts runs through an embedded DuckDB: regular expressions
take out invisible characters, ``nfc_normalize`` composes accents, ``translate``
maps width forms, word spaces and look-alike letters one to one, and a table opens
ligatures. What a reader can tell apart stays apart: case, accents, raised,
lowered and circled signs, line breaks, and the number of spaces. Compatibility
folding (NFKC) would merge those, so it isn't used. Instead the maps follow the
tags of Unicode's own decompositions (``unicodedata``): width, no-break and Arabic
presentation forms change no look, raised, lowered, circled, squared, fraction,
small, vertical and font forms do, and of those tagged compat the ones that open
into letters alone count (ligatures, digraphs, Roman numerals, radicals, the micro
sign), with the exceptions listed. What Unicode data can't say is in word lists.

Joiners, selectors and tags that make up an emoji stay: a flag, a profession or a
text presentation of a sign looks different without them. Every kind of line break
is one: CR LF, CR, vertical tab, form feed, NEL and both separators.

Null stays null and an empty text empty. A text of nothing but spaces, line
breaks and invisible characters shows nothing; ``shows`` is false for it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartiq.session import materialize, ship, slices

TEXTS_AT_ONCE = 4096

# Characters that leave no mark of their own, as ranges of a regular
# expression (controls, soft hyphen, joiners, direction marks, fillers, byte order
# mark, variation selectors, tags). Tabs and line breaks stay.
INVISIBLE = (
    r"[\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)
# Signs that have an emoji presentation or may join into emoji.
PICTOGRAPHS = (
    r"\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{2300}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}"
    r"\x{2934}\x{2935}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
)
# Spaces between words other than the plain one. Tabs and line breaks stay.
SPACES = "\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
# Line breaks other than LF and CR.
BREAKS = "\u000b\u000c\u0085\u2028\u2029"
# Tags of decompositions that change no look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
# Compatibility letters whose shape isn't that of the letters they stand for, as ranges:
# long s, a with half ring, Greek symbol variants, Hangul letters that would join, the Euler constant.
OTHER_SHAPE = ((0x017F, 0x017F), (0x1E9A, 0x1E9A), (0x03D0, 0x03FF), (0x3131, 0x318E), (0x2107, 0x2107))
# Letters and signs of other scripts with the look of Latin ones.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W",
    "Х": "X", "Ү": "Y", "Ӏ": "I", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È", "ӓ": "ä", "Ӓ": "Ä",
    "ӧ": "ö", "Ӧ": "Ö", "ӑ": "ă", "Ӑ": "Ă", "ӗ": "ĕ", "Ӗ": "Ĕ", "ӱ": "ÿ", "ӯ": "ȳ",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ό": "ó", "ὸ": "ò", "Ϊ": "Ï", "Ϋ": "Ÿ",
    # Armenian, Latin variants, hyphens, signs
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-",
    # Mathematical and modifier signs with the look of Greek letters and of punctuation
    "∆": "Δ", "∑": "Σ", "∏": "Π", "⋅": "·", "∕": "/", "⁄": "/", "∣": "|", "∶": ":", "ʼ": "’",
}


@lru_cache(maxsize=1)
def compatibility_forms() -> dict[str, str]:
    """Characters with the look of others by Unicode's decompositions, with those others."""
    forms: dict[str, str] = {}
    for code in range(0x10000):
        char = chr(code)
        tag, *codes = unicodedata.decomposition(char).split() or [""]
        if not tag.startswith("<") or not codes or codes[0] == "0020" or any(low <= code <= high for low, high in OTHER_SHAPE):
            continue
        usual = "".join(chr(int(c, 16)) for c in codes)
        letters = all(unicodedata.category(c)[0] in "LM" or c == "\u00b7" for c in usual)
        if (tag in SAME_LOOK and len(usual) <= 4) or (tag == "<compat>" and letters):
            forms[char] = usual
    # Degree signs that are one character with their letter.
    return forms | {"\u2103": "°C", "\u2109": "°F"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: list[str]) -> str:
    """A regular expression's character class, with neighbours as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{low:04X}}}-\\x{{{high:04X}}}" for low, high in ranges) + "]"


def _translated(sql: str, one: dict[str, str]) -> str:
    return f"translate({sql}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"


@lru_cache(maxsize=1)
def form_sql(column: str = "text") -> str:
    """The DuckDB expression of a text's consistent form."""
    forms = compatibility_forms()
    usual = {s: " " for s in SPACES} | {s: "\n" for s in BREAKS} | LOOKALIKES
    # Width forms, which are common, go with the look-alikes; rarer ones are only looked for in texts that hold any.
    common = {c: LOOKALIKES.get(f, f) for c, f in forms.items() if len(f) == 1 and 0xFF01 <= ord(c) <= 0xFF5E}
    rare = {c: f for c, f in forms.items() if len(f) == 1 and c not in common and c not in usual}
    several = {c: f for c, f in forms.items() if len(f) > 1}
    mods = r"[\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
    emoji = rf"[{PICTOGRAPHS}]{mods}(?:\x{{200D}}[{PICTOGRAPHS}]{mods})*(?:[\x{{E0020}}-\x{{E007E}}]+\x{{E007F}})?|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
    broken = f"replace(replace(translate({column}, {_quoted(BREAKS)}, repeat(chr(10), {len(BREAKS)})), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    seen = f"regexp_replace({broken}, {_quoted(f'({emoji})|{INVISIBLE}')}, '\\1', 'g')"
    # Ligatures open piece by piece, by one look-up table: hundreds of nested replacements would take long to plan.
    signs, letters = (f"[{', '.join(map(_quoted, x))}]" for x in (several, several.values()))
    one_or_none = _class(list(several))
    pieces = f"regexp_extract_all({_translated('s', rare)}, {_quoted(f'{one_or_none}|[^{one_or_none[1:]}+')})"
    opened = f"array_to_string(list_transform({pieces}, lambda p: coalesce(map_extract(map({signs}, {letters}), p)[1], p)), '')"
    # Accents compose before and after the letters change: an accent may stand on either kind.
    plain = f"list_transform([nfc_normalize({seen})], lambda s: CASE WHEN regexp_matches(s, {_quoted(_class([*rare, *several]))}) THEN {opened} ELSE s END)[1]"
    return f"nfc_normalize({_translated(plain, usual | common)})"


def consistent_form(df: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "form") -> DataFrame:
    """``keep`` columns with ``name``, the consistent form of the text, and ``shows``."""
    keep = df.columns if keep is None else keep
    ship(df.sparkSession)
    sql = (
        f"SELECT * EXCLUDE (t__, f__), f__ AS \"{name}\", regexp_matches(f__, '[^\\s]') AS shows "
        f"FROM (SELECT *, {form_sql('t__')} AS f__ FROM batch)"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"}) as db:
            for batch in slices(batches, TEXTS_AT_ONCE, 16 << 20):
                db.register("batch", pa.table(batch))
                yield from db.sql(sql).to_arrow_table().to_batches()
                db.unregister("batch")

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("t__")).mapInArrow(run, f"{fields}, `{name}` string, shows boolean")


def variant_classes(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the class of its look: the smallest id among texts that look the same.

    Columns: the id, ``class_id``, ``n_docs`` and ``n_spellings`` (different texts)
    of the class. Documents that show nothing have a null class and zero counts.
    """
    keyed = _keyed(df, ident, text)
    per_text = keyed.filter("shows").groupBy("look", "spelling").agg(F.min(ident).alias("least"), F.count(F.lit(1)).alias("n"))
    classes = per_text.groupBy("look").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_spellings")
    )
    shown = F.when(F.col("shows"), F.col("look"))
    zero = F.lit(0).cast("long")
    return (
        keyed.select(ident, shown.alias("look"))
        .join(classes, "look", "left")
        .select(ident, "class_id", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_spellings", zero).alias("n_spellings"))
    )


def _keyed(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Ids with digests of a text's look and of its characters (SHA-256, so equal means equal), written once."""
    formed = consistent_form(df.withColumn("raw__", F.sha2(text, 256)), text, [ident, "raw__"])
    return materialize(formed.select(ident, "shows", F.sha2("form", 256).alias("look"), F.col("raw__").alias("spelling")), "looks")


def variant_pairs(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents whose texts look the same but differ in their characters.

    Only looks with at least two different spellings are paired, and only across
    spellings, so exact copies never meet each other. The pairs of a look grow with
    the square of its documents: a look that many documents share is better read
    from ``variant_classes``, one row per document. Columns ``<ident>_a`` and
    ``<ident>_b``, the smaller id first. A document id that comes up several times
    is paired once; null ids aren't paired.
    """
    keyed = _keyed(df, ident, text).filter(F.col("shows") & F.col(ident).isNotNull()).drop("shows").distinct()
    several = keyed.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).filter("lo < hi")
    # Only the few documents of such looks are left, so they are written once for both sides of the pairing.
    left = materialize(keyed.join(several.select("look"), "look", "left_semi"), "variants")
    a, b = left.alias("a"), left.alias("b")
    paired = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.spelling") != F.col("b.spelling")) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")))
    return paired.select(F.col(f"a.{ident}").alias(f"{ident}_a"), F.col(f"b.{ident}").alias(f"{ident}_b")).distinct()
