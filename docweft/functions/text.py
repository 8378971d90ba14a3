"""Scalar text functions as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that mean true and false.
TRUE_WORDS = ("true", "yes", "y", "1", "是", "有", "已", "通过", "开启")
FALSE_WORDS = ("false", "no", "n", "0", "否", "无", "未", "失败", "关闭")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The Unicode characters that are white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def utrim(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.btrim(c, F.lit(WHITE))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the variable of a one-element array stands for it."""
    return F.get(F.transform(F.array(value), use), 0)


def blank_to_null(c: Column) -> Column:
    return bind(utrim(c), lambda t: F.when(t != "", t))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def quoted(label: str) -> str:
    """A label as a literal inside a pattern."""
    return "".join("\\" + c if not (c.isalnum() or c.isspace() or ord(c) > 127) else c for c in label)


#: Fixed value: what may stand before a label.
_LEAD = r"(?mdU)^\s*(?:[-*•]\s*)?"


def label_pattern(label: str) -> str:
    """A line that begins with a label, perhaps behind a bullet, and a colon; group 1 is the value."""
    return rf"{_LEAD}{quoted(label)}\s*[:：]\s*([^\n\r]+)$"


def label_values(text: Column, label: str) -> Column:
    """Trimmed values of a label in a text, in order, blanks dropped."""
    found = F.regexp_extract_all(text, F.lit(label_pattern(label)), F.lit(1))
    return F.filter(F.transform(found, utrim), lambda v: v != "")


#: Fixed value: a number.
NUMBER = r"(?U)[-+]?\d+(?:\.\d+)?"


def number_json(raw: Column) -> Column:
    """The first number of a text as JSON: a whole number if it fits a long, else a double, else null."""

    def read(digits: Column) -> Column:
        real = digits.try_cast("double")
        return F.coalesce(
            F.when(~digits.contains("."), digits.try_cast("bigint").cast("string")), F.when(~F.isnan(real) & (F.abs(real) != float("inf")), real.cast("string"))
        )

    return bind(F.regexp_extract(F.replace(raw, F.lit(",")), NUMBER, 0), read)


def boolean_json(raw: Column) -> Column:
    return bind(ascii_lower(utrim(raw)), lambda word: F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false"))


def string_json(raw: Column) -> Column:
    text = F.to_json(F.array(raw))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def coerce_json(raw: Column, field_type: str) -> Column:
    """A raw value as JSON text of its field's type; null if it has none."""
    if field_type == "number":
        return number_json(raw)
    if field_type == "boolean":
        return boolean_json(raw)
    return bind(blank_to_null(raw), lambda text: F.when(text.isNotNull(), string_json(text)))


def preview(text: Column, n: int) -> Column:
    """At most n characters, with ``...`` behind a longer text."""
    if n == 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def char_slice(text: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop (exclusive); null out of range or if there are none."""
    inside = (start >= 0) & (stop > start) & (stop <= F.length(text))
    return F.when(inside, F.substring(text, start + 1, stop - start))


def header_suffix(key: Column) -> Column:
    """A metadata key as part of a header name; null if nothing is left."""
    dashed = F.regexp_replace(ascii_lower(key), "[_\\-. /]+", "-")
    kept = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-")
    return F.nullif(F.regexp_replace(kept, "^-+|-+$", ""), F.lit(""))


def xml_entities(text: Column) -> Column:
    """The five named entities decoded one after another, ampersands first."""
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def nonblank_lines(text: Column) -> Column:
    """Trimmed lines that are not blank; carriage returns end lines too."""
    return F.filter(F.transform(F.split(F.translate(text, "\r", "\n"), "\n", -1), utrim), lambda x: x != "")


def real(x: float) -> Column:
    return F.lit(x).cast("float")


def confidence(meaningful: Column, required: bool, has_evidence: Column, many: Column) -> Column:
    """Confidence of a value, in single precision at every step."""
    out = real(0.55)
    out = F.when(has_evidence, (out + real(0.2)).cast("float")).otherwise(out)
    if required:
        out = (out + real(0.05)).cast("float")
    out = F.when(many, (out + real(0.05)).cast("float")).otherwise(out)
    out = F.greatest(real(0.0), F.least(out, real(0.95)))
    return F.when(meaningful, out).otherwise(real(0.05 if required else 0.2))


def keep_first(items: Column, key) -> Column:
    """Items whose key did not occur before; sorts the keys, so the cost is that of a sort."""

    def firsts(it: Column, marks: Column) -> Column:
        new = F.filter(marks, lambda e, j: (j == 0) | ~F.get(marks, j - 1)["k"].eqNullSafe(e["k"]))
        return F.transform(F.sort_array(F.transform(new, lambda e: e["i"])), lambda i: F.get(it, i))

    return bind(items, lambda it: bind(F.sort_array(F.transform(it, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), lambda marks: firsts(it, marks)))


def object_json(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of members whose values are JSON text; null values are ``null``."""
    parts = [F.concat(string_json(F.lit(k)), F.lit(":"), F.coalesce(v, F.lit("null"))) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def to_json(value: Column) -> Column:
    """JSON text of any value, nulls inside kept."""
    return F.get(F.from_json(F.to_json(F.struct(F.array(value).alias("v")), {"ignoreNullFields": "false"}), "v array<string>")["v"], 0)


def whole_text(x: Column) -> Column:
    """A number as text, without a fraction where it has none."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
