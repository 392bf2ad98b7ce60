"""Visually identical text in one form: DuckDB inside Arrow partitions.

Every Arrow batch is a table of an embedded DuckDB, which maps it with one SQL expression: ``translate`` for the
forms of width, the blanks and the look-alike letters, a regular expression for the characters that don't show,
and ``nfc_normalize`` for the encoding of accents. ASCII texts pass as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataloom.session import staged

#: Letters of other scripts that look like Latin ones, and those Latin letters, in the same order.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХҮԚԜЁЇ": "ABESIJKMHOPCTYXYQWËÏ",
    "асеѕіјорухүһԁԛԝёї": "acesijopyxyhdqwëï",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονϳ": "ovj",
    "ΆΈΉΊΌΎό": "ÁÉHÍÓÝó",
    "ıɑɡ": "iag",
    "ՕՍօսհոց": "OUouhng",
}
#: Characters that don't show, besides the Unicode categories Cf and the variation selectors.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
JOINER, HELD = "‍", "﷐"
#: Ranges whose characters are drawn together when a joiner stands between them.
PICTURES = "←-⇿⌀-➿⤀-⥿⬀-⯿\U0001f000-\U0001faff"


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Single characters and what they become: look-alikes, forms of width and blanks. Tabs and line breaks show and stay."""
    out = {a: b for left, right in LOOK_ALIKES.items() for a, b in zip(left, right, strict=True)}
    for code in [*range(0x80, 0x3100), *range(0xFF00, 0xFFF0)]:
        c = chr(code)
        kind, _, plain = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind in ("<wide>", "<narrow>") and c not in UNSEEN:
            out[c] = chr(int(plain, 16))
    return out


@lru_cache(maxsize=1)
def unseen() -> str:
    """The characters that don't show, as the inside of a regular expression's class."""
    codes = [*range(0x80, 0x3100), *range(0xFE00, 0xFFFF), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0200)]
    hidden = [c for c in codes if unicodedata.category(chr(c)) == "Cf" or chr(c) in UNSEEN or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180F or 0xE0100 <= c <= 0xE01EF]
    hidden += [c for c in range(0x20) if chr(c) not in "\t\n\r\x0b\x0c"] + [0x7F]
    spans: list[list[int]] = []
    for c in sorted(set(hidden) - {0}):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def canonical_sql(text: str) -> str:
    """DuckDB's expression for the consistent form of the column or expression ``text``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = mapping()
    join = f"([{PICTURES}]️?){JOINER}([{PICTURES}])"
    held = f"case when contains({text}, {quoted(JOINER)}) then regexp_replace(regexp_replace({text}, {quoted(join)}, {quoted(chr(92) + '1' + HELD + chr(92) + '2')}, 'g'), {quoted(join)}, {quoted(chr(92) + '1' + HELD + chr(92) + '2')}, 'g') else {text} end"
    seen = f"regexp_replace(translate({held}, {quoted(''.join(table))}, {quoted(''.join(table.values()))}), {quoted('[' + unseen() + ']')}, '', 'g')"
    return f"case when regexp_matches({text}, '[^\\x20-\\x7e]') then nfc_normalize(translate({seen}, {quoted(HELD)}, {quoted(JOINER)})) else {text} end"


def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": "1", "memory_limit": "300MB"})
    con.execute("set preserve_insertion_order = true")
    return con


def mapped(df: DataFrame, query: str, schema: str) -> DataFrame:
    """``df`` through DuckDB: ``query`` reads the rows of an Arrow batch as the table ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in batches:
            if batch.num_rows:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(query).to_arrow_table().to_batches()
                con.unregister("batch")

    return df.mapInArrow(run, schema)


def canonical_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): the texts in one form, so that texts that look the same are equal.

    Full and half width, the kind of blank, the encoding of accents, characters that don't show and letters of
    other scripts that look like Latin ones are brought to one form. Letter case, visible accents, punctuation, tabs,
    line breaks and the number of blanks stay. A joiner between pictures stays, because it shows. Null texts stay null, empty texts
    empty; null ids are kept; other columns are dropped, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, f"select id, {canonical_sql('text')} as text from batch", "id bigint, text string")


def lookalike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first_id) for every record that looks like the first of its group but has another text.

    first_id is the smallest id of the records with the same form; records whose text equals that of the first are
    not listed. Null ids and null texts are left out, the empty text is a text like any other. Ids are expected to
    be unique. An empty table gives no rows.

    Only ids and digests (126 bits of the form, 63 of the text) are shuffled, combined before the shuffle.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    form = f"select id, text, {canonical_sql('text')} as form from batch"
    query = f"""select id, (md5_number_lower(form) >> 1)::bigint as f1, (md5_number_upper(form) >> 1)::bigint as f2,
        (hash(text) >> 1)::bigint as raw from ({form})"""
    forms = mapped(rows, query, "id bigint, f1 bigint, f2 bigint, raw bigint")
    forms = staged(forms, "forms")
    groups = (
        forms.groupBy("f1", "f2")
        .agg(F.min("id").alias("first_id"), F.min_by("raw", "id").alias("first_raw"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        .where("lo <> hi")
        .drop("lo", "hi")
    )
    return forms.join(groups, ["f1", "f2"]).where("raw <> first_raw").select("id", "first_id")
