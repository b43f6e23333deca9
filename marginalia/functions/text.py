"""String helpers with the semantics of web text: white space, lengths, Markdown lines.

All are Catalyst expressions. Regular expressions use notations that mean the
same to Java and RE2; ``\\b`` is spelled out because Java's is Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web scripts see it, as the inside of a character class.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def ascii_boundaries(pattern: str) -> str:
    """The pattern with every ``\\b`` between ASCII word characters and others only.

    Patterns have word characters on the inner side of each ``\\b``, so one look
    is enough: backwards where something of the pattern follows, else forwards.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        out += (_AFTER if not part or part[0] in "|)[.*+?$" else _BEFORE) + part
    return out


def js_pattern(pattern: str) -> str:
    """A pattern written with ``\\s``, ``\\S`` and ``\\b`` as web scripts read them, for Java."""
    pattern = pattern.replace(r"[\s\S]", r"(?s:.)").replace(r"[^\s", "[^" + WS).replace(r"[\s", "[" + WS)
    return ascii_boundaries(pattern.replace(r"\s", f"[{WS}]"))


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+", " ")


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which is how web scripts count."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def normalised_body(c: Column) -> Column:
    """Line ends as LF, at most one blank line, trimmed."""
    c = F.replace(text_of(c), F.lit("\r\n"), F.lit("\n"))
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


def demoted_headings(c: Column) -> Column:
    """Lines that open with one to six # and a space get a backslash before them."""
    return F.regexp_replace(c, rf"(?m)^(#{{1,6}})([{WS}])", r"\\$1$2")


def truncated(c: Column, most: int) -> Column:
    """On one line; beyond ``most`` characters cut, without the last partial word, and marked with an ellipsis."""
    flat = trimmed(collapsed(text_of(c)))
    cut = F.regexp_replace(F.substring(flat, 1, most), rf"[{WS}]+[^{WS}]*\z", "")
    return F.when(F.char_length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)


def longest_run(c: Column, mark: str = "`") -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"{mark}+"), F.lit(0)), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence_for(c: Column) -> Column:
    """Backticks for a fence: three, or one more than the longest run inside."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(c) + 1))


def inline_code(c: Column) -> Column:
    """Inline code with a marker longer than any run inside, padded where the body's edge is a backtick."""
    mark = F.repeat(F.lit("`"), longest_run(c) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(mark, pad, c, pad, mark)


def indented(c: Column, by: str) -> Column:
    """Every non-blank line moved by ``by``; blank lines become empty."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(trimmed(x) == "", F.lit("")).otherwise(F.concat(F.lit(by), x))), "\n")


def safe_inline(c: Column, most: int = 200) -> Column:
    """On one line, Markdown marks escaped, cut to ``most`` characters after that."""
    flat = trimmed(collapsed(text_of(c)))
    return F.substring(F.regexp_replace(flat, r"([\\\[\]`*_])", r"\\$1"), 1, most)


def safe_target(c: Column) -> Column:
    """A link target whose white space, angle and round brackets and backslashes are percent-encoded, in <>."""
    # The characters that end or break a target, with their encodings.
    out = text_of(c)
    for raw, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("<", "%3C"), (">", "%3E"), ("(", "%28"), (")", "%29"), ("\\", "%5C")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.concat(F.lit("<"), out, F.lit(">"))


#: The entities that are decoded by name.
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded_entities(c: Column) -> Column:
    """Named and numeric entities decoded in one pass from left to right; what names no character stays."""
    entity = r"(?i)&(?:amp|lt|gt|quot|apos|nbsp|#x[0-9a-f]+|#[0-9]+);"
    found = F.regexp_extract_all(c, F.lit(entity), F.lit(0))
    rest = F.split(c, entity)
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES for x in pair])

    def value(e):
        low = F.lower(e)
        digits = F.when(low.startswith("&#x"), F.conv(F.substring(low, 4, 8), 16, 10)).otherwise(F.regexp_extract(low, "[0-9]+", 0)).try_cast("long")
        digits = F.when(F.length(low) > 12, F.lit(None).cast("long")).otherwise(digits)
        valid = (digits <= 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        # A code point as UTF-32 bytes, decoded.
        char = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(named, low), F.when(low.startswith("&#") & valid, char), e)

    pieces = F.concat(F.transform(F.arrays_zip(F.slice(rest, 1, F.size(found)).alias("t"), found.alias("e")), lambda z: F.concat(z["t"], value(z["e"]))), F.slice(rest, F.size(found) + 1, 1))
    return F.when(c.rlike(entity), F.array_join(pieces, "")).otherwise(c)


def stripped_tags(c: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    return trimmed(collapsed(decoded_entities(F.regexp_replace(text_of(c), "<[^>]*>", " "))))


def folded_emoji_lines(c: Column) -> Column:
    """Lines of pictographs only join the last non-blank line before them; trailing spaces go."""
    icon = r"^[\p{So}\p{Sk}\x{200D}\x{FE0F}\x{20E3}\x{1F1E6}-\x{1F1FF}" + WS + r"]+\z"

    def step(out, line):
        text = F.regexp_replace(line, rf"[{WS}]+\z", "")
        alone = (text != "") & text.rlike(icon) & (F.size(out) > 0)
        kept = F.size(F.array_compact(F.transform(out, lambda x, i: F.when(x != "", i))))
        last = F.coalesce(F.array_max(F.array_compact(F.transform(out, lambda x, i: F.when(x != "", i)))), F.lit(-1))
        joined = F.concat(F.slice(out, 1, last), F.array(F.concat(F.get(out, last), F.lit(" "), trimmed(text))))
        return F.when(alone & (kept > 0), joined).otherwise(F.concat(out, F.array(text)))

    return F.array_join(F.aggregate(F.split(c, "\n"), F.array().cast("array<string>"), step), "\n")
