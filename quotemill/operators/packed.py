"""Several values packed in one text: split into one value a row, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.columns import let, stripped, without

#: Delimiters, the most telling first; a text is split on the first that stands outside its quotes.
DELIMITERS = ("||", "|", ";", "\t", "\n", ",")
_OPEN, _BACK, _DOUBLE, _SINGLE, _CUT = "\x01", "\x02", "\x03", "\x04", "\x05"


def _literal(delimiter: str) -> str:
    return "".join("\\" + ch if ch in "|;,." else ch for ch in delimiter)


def _mark(text: Column, delimiter: str, quote: str) -> Column:
    """Quotes that enclose a whole item between delimiters become _OPEN; all others stay text."""
    d, q = _literal(delimiter), quote
    return F.regexp_replace(text, f"(^|{d})\\s*{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+){q}(?=\\s*(?:{d}|\\z))", f"$1{_OPEN}$2{_OPEN}")


def items(text: Column) -> Column:
    """array<string>: the values packed in a text, in order.

    Read are JSON arrays (also one level encoded as a JSON string), bracketed lists in single quotes,
    delimited texts with doubled or escaped quotes, and delimited texts without quotes. The text is
    split on its enclosing quotes: odd pieces are literals, even pieces are split on the delimiter,
    and a fold over the pieces puts the values together again. Values are trimmed and lose the quotes
    around them. A delimiter at the end adds no value; an empty value between two delimiters is kept
    to hold its place; null, empty and blank texts and empty brackets give an empty array. A text
    without delimiter is one value.
    """
    none = F.array().cast("array<string>")
    clean = stripped(F.regexp_replace(text, "\r\n?", "\n"))
    return F.coalesce(let(let(clean, _decoded), lambda t: let(_body(t), _split)), none)


def _decoded(t: Column) -> Column:
    """A JSON string that holds a JSON array, decoded one level."""
    inner = F.replace(F.replace(F.regexp_replace(t, r'^"|"\z', ""), F.lit("\\\\"), F.lit(_BACK)), F.lit('\\"'), F.lit('"'))
    return F.when(t.rlike(r'^"\s*\[(?s).*\]\s*"\z') & t.contains('\\"'), F.trim(F.replace(inner, F.lit(_BACK), F.lit("\\")))).otherwise(t)


def _body(t: Column) -> Column:
    """struct<listed, text>: whether brackets stand around, and what is inside, escapes set apart."""
    listed = t.rlike(r"^\[(?s).*\]\z")
    inside = F.when(listed, F.regexp_replace(t, r"^\[\s*|\s*\]\z", "")).otherwise(t)
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit(_BACK)), F.lit('\\"'), F.lit(_DOUBLE)), F.lit("\\'"), F.lit(_SINGLE))
    return F.struct(listed.alias("listed"), let(inside, lambda x: F.when(x.contains("\\"), escaped(x)).otherwise(x)).alias("text"))


def _split(b: Column) -> Column:
    text, listed = b["text"], b["listed"]

    def delimiter(bare: Column) -> Column:
        pick = F.when(listed, F.lit(","))
        for d in DELIMITERS:
            pick = pick.when(bare.contains(d), F.lit(d))
        return pick.otherwise(F.lit(","))

    def marked(d: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for x in DELIMITERS[:-1]:
            out = out.when(d == x, _mark(text, x, '"'))
        # Lists of single quotes also use double ones, for items with an apostrophe.
        single = F.regexp_replace(text, r'"[^"]*"', "").rlike(r"(?:^|,)\s*'")
        return out.otherwise(F.when(listed & single, _mark(_mark(text, ",", '"'), ",", "'")).otherwise(_mark(text, ",", '"')))

    def folded(d: Column) -> Column:
        literal = lambda p: F.concat(F.lit(_OPEN), F.replace(p, F.lit('""'), F.lit('"')), F.lit(_OPEN))
        return F.array_join(F.transform(F.split(marked(d), _OPEN, -1), lambda p, i: F.when(i % 2 == 1, literal(p)).otherwise(F.replace(p, d, F.lit(_CUT)))), "")

    def restored(pieces: Column) -> Column:
        # A piece without its own quotes that is blank at the end comes from a closing delimiter.
        kept = F.when(F.element_at(pieces, -1).rlike(r"^\s*\z"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
        back = lambda x: F.translate(x, _OPEN + _DOUBLE + _SINGLE + _BACK, "\x07\"'\\")
        return F.transform(kept, lambda x: stripped(F.replace(back(x), F.lit("\x07"), F.lit(""))))

    cut = let(let(F.regexp_replace(text, r'"[^"]*"', ""), delimiter), folded)
    return F.when(~text.rlike(r"^\s*\z"), let(F.split(cut, _CUT, -1), restored))


def unpack(df: DataFrame, text: Column) -> DataFrame:
    """df with one row for each value packed in text: pos from 1, and item (columns of these names are replaced; text must be another). Rows without values give none."""
    return without(df, "pos", "item").select("*", F.posexplode(items(text)).alias("pos", "item")).withColumn("pos", F.col("pos") + 1)
