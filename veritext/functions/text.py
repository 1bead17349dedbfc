"""Text column expressions: whitespace, entities, tokens, HTML text, names.

Everything here returns a ``Column`` built from Spark built-ins, so it runs
inside the JVM (no Python workers) and composes into any projection.
Regular expressions are Java syntax; character classes are spelled out
where Python's Unicode-aware ``\\s``/``\\w`` differ from Java's ASCII ones.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext import fixed as FX

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Characters Python's str.strip()/str.isspace() treat as whitespace.
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Python's Unicode \w (letters, numbers, underscore).
WORD = r"\p{L}\p{N}_"
# Token: maximal run of letters and digits, on lower-cased text.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Character references, from the standard library's table of HTML names:
# names that need their semicolon, and the older ones that do without it.
_NAMES = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
_LOOSE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Code points 128-159 of a reference mean Windows-1252 characters.
_CP1252 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
MAX_CODE_POINT = 0x10FFFF

# Blocks whose text is not visible: script, style, comments, doctype.  One
# that is never closed reaches to the end of the page.
INVISIBLE_BLOCKS = (r"(?is)<script\b[^>]*+>.*?(?:</script\s*+>|\z)|<style\b[^>]*+>.*?(?:</style\s*+>|\z)"
                    r"|<!--.*?(?:-->|\z)|<!doctype[^>]*+>")
# A tag, as an HTML tokenizer sees it: "<" then a letter, "/letter", "!" or
# "?"; quoted attribute values may hold ">".  A "<" before anything else
# (e.g. "a < b") is text.  Atomic and possessive: no backtracking into a tag,
# so neither many attributes nor an unclosed quote cost more than one pass.
ANY_TAG = r"""<(?:/?[A-Za-z](?>[^>"']+|"[^"]*"|'[^']*')*+|[!?][^>]*+)>"""
H1_BLOCK = r"(?is)<h1(?:\s[^>]*+)?>.*?(?:</h1\s*+>|\z)"
H1_INNER = r"(?is)<h1(?:\s[^>]*+)?>(.*?)(?:</h1\s*+>|\z)"
H2_INNER = r"(?is)<h2(?:\s[^>]*+)?>(.*?)(?:</h2\s*+>|\z)"
TITLE_INNER = r"(?is)<title(?:\s[^>]*+)?>(.*?)(?:</title\s*+>|\z)"
# Inside the first h1 only: superscripts and glossary links are removed.
H1_NOISE = (rf"(?is)<{FX.H1_NOISE_TAG}(?:\s[^>]*)?>.*?</{FX.H1_NOISE_TAG}>"
            rf"|<a\s[^>]*class\s*=\s*[\"']{FX.H1_NOISE_LINK_CLASS}[\"'][^>]*>.*?</a>")
# RFC 3986 appendix B URL split: 4 = authority, 5 = path, 7 = query.
URL_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

NO_TITLE = FX.NO_TITLE
NO_TITLE_FILE = FX.NO_TITLE_FILE
FILE_NAME_CHARS = FX.FILE_NAME_CHARS
QUERY_NAME_CHARS = FX.QUERY_NAME_CHARS


#: References that pages are full of.
COMMON_NAMES = ("nbsp", "quot", "lt", "gt", "copy", "middot", "apos", "ndash", "mdash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "raquo", "laquo", "reg")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+$", "")


def not_blank(col) -> Column:
    """Whether anything is left of a text that is stripped."""
    return _c(col).rlike(f"[^{WS[1:]}")


def stripped(name: str) -> Column:
    """``py_strip`` of a column; texts that begin and end with other characters are not searched."""
    end = lambda at: F.substring(name, at, 1).rlike(WS)
    return F.when(end(1) | end(-1), py_strip(name)).otherwise(F.col(name))


def _codepoint_char(cp: Column) -> Column:
    # One code point as a string: 4-byte big-endian UTF-32, decoded.
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _number_char(digits: Column, base: int, width: int) -> Column:
    # The character of a numeric reference, as the HTML standard has it: no
    # such code point or half a pair is U+FFFD, other control characters and
    # non-characters vanish.  Every branch is safe for any number.
    short = F.regexp_replace(digits, "^0+", "")
    cp = F.when(F.length(short) > width, F.lit(MAX_CODE_POINT + 1)).otherwise(F.conv(F.concat(F.lit("0"), F.substring(short, 1, width)), base, 10).cast("bigint"))
    lost = (cp == 0) | (cp > MAX_CODE_POINT) | cp.between(0xD800, 0xDFFF)
    gone = (cp.between(1, 8) | (cp == 11) | cp.between(14, 31) | (cp == 127) | cp.between(0xFDD0, 0xFDEF)
            | (cp.bitwiseAND(0xFFFE) == 0xFFFE))
    windows = F.element_at(F.lit(_CP1252), F.when(cp.between(128, 159), cp - 127).otherwise(1).cast("int"))
    char = _codepoint_char(F.when(lost | gone, 0xFFFD).otherwise(cp))
    return F.when(lost, "\ufffd").when(cp.between(128, 159), windows).when(gone, "").otherwise(char)


def decode_entities(col) -> Column:
    """Decode character references once, left to right, as an HTML parser does
    in text: names of the HTML table (older ones also without ``;``) and
    numbers of any length.  What is no reference stays."""
    c = _c(col)
    # one literal, folded to a map when the query is planned
    names = F.str_to_map(F.lit("\u0002".join(f"{n}\u0001{v}" for n, v in sorted(_NAMES.items()))), F.lit("\u0002"), F.lit("\u0001"))

    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_replace(number, "[#xX;]", "")
        char = F.when(F.substring(number, 2, 1).isin("x", "X"), _number_char(digits, 16, 6)).otherwise(_number_char(digits, 10, 7))
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        value = F.when(name == "amp", "&").when(name != "", F.try_element_at(names, name))
        loose = F.regexp_extract(p, f"^(?:{'|'.join(_LOOSE)})", 0)
        older = F.when(loose != "", F.try_element_at(names, loose))
        return (F.when(number != "", F.concat(char, F.substr(p, F.length(number) + 1)))
                .when(value.isNotNull(), F.concat(value, F.substr(p, F.length(name) + 2)))
                .when(older.isNotNull(), F.concat(older, F.substr(p, F.length(loose) + 1)))
                .otherwise(F.concat(F.lit("&"), p)))

    # nearly all references are one of a few names: told by their first characters, without a pattern or the table
    def piece(p: Column) -> Column:
        found = F.when(p.startswith("amp;"), F.concat(F.lit("&"), F.substr(p, F.lit(5))))
        for common in COMMON_NAMES:
            found = found.when(p.startswith(f"{common};"), F.concat(F.lit(_NAMES[common]), F.substr(p, F.lit(len(common) + 2))))
        return found.when(p.rlike("^[#A-Za-z]"), one(p)).otherwise(F.concat(F.lit("&"), p))

    pieces = F.split(c, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.when(c.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(c)


def tokens(col) -> Column:
    """Lower-cased runs of letters/digits, in order, empties removed."""
    return F.array_remove(F.split(F.lower(_c(col)), TOKEN_SPLIT), "")


def _text_pieces(html: Column) -> Column:
    # The strings between tags, decoded, then stripped like Python's str.strip().
    parts = F.split(html, ANY_TAG)
    return F.filter(F.transform(parts, lambda p: py_strip(decode_entities(p))), lambda p: p != "")


# Removed parts leave the text around them as separate strings (as a parser
# removing the element does), so they are replaced by a break, not by nothing.
NOISE_CUT = "<br>"


def visible(html) -> Column:
    """The page without scripts, styles, comments and doctype."""
    return F.regexp_replace(_c(html), INVISIBLE_BLOCKS, NOISE_CUT)


def _h1_pieces_joined(inner: Column) -> Column:
    return F.array_join(_text_pieces(F.regexp_replace(inner, H1_NOISE, NOISE_CUT)), "")


def h1_title(html, missing: str = NO_TITLE) -> Column:
    """Title from the first h1 (noise removed, stripped pieces, no separator)."""
    h = visible(html)
    return F.when(h.rlike(H1_BLOCK), _h1_pieces_joined(F.regexp_extract(h, H1_INNER, 1))).otherwise(F.lit(missing))


def without_h1_noise(html) -> Column:
    """The visible page with superscripts/glossary links removed from its first h1."""
    h = visible(html)
    block = F.regexp_extract(h, H1_BLOCK, 0)
    pos = F.instr(h, block)
    cleaned = F.regexp_replace(block, H1_NOISE, NOISE_CUT)
    return F.when(block != "", F.concat(F.substr(h, F.lit(1), pos - 1),
                                        cleaned, F.substr(h, pos + F.length(block)))).otherwise(h)


def html_to_text(html) -> Column:
    """Visible strings of a page, each stripped, empties dropped, one per line."""
    return F.array_join(_text_pieces(visible(html)), "\n")


def normalize_whitespace(text) -> Column:
    """Blank-line runs become one empty line, then space runs one space."""
    t = F.regexp_replace(_c(text), rf"\n{WS}*\n", "\n\n")
    return F.regexp_replace(t, " +", " ")


def page_text(html) -> Column:
    """Clean document text of a page: h1 noise removed, text, whitespace."""
    return normalize_whitespace(html_to_text(without_h1_noise(html)))


def safe_title(title) -> Column:
    """Characters not allowed in file names become ``_``."""
    return F.regexp_replace(_c(title), "[" + "".join("\\" + ch for ch in FX.UNSAFE_FILE_CHARS) + "]", "_")


def _tag_text_stripped(html: Column, inner_re: str) -> Column:
    # get_text() of the first such tag (pieces joined as they are), stripped.
    inner = F.regexp_extract(html, inner_re, 1)
    return py_strip(decode_entities(F.regexp_replace(inner, ANY_TAG, "")))


def name_from_titles(html, max_chars: int = FILE_NAME_CHARS) -> Column:
    """File base name from <title>, else h1, else h2; null if all blank."""
    h = visible(html)
    title = F.coalesce(F.nullif(_tag_text_stripped(h, TITLE_INNER), F.lit("")),
                       F.nullif(_tag_text_stripped(h, H1_INNER), F.lit("")),
                       F.nullif(_tag_text_stripped(h, H2_INNER), F.lit("")))
    name = F.regexp_replace(title, rf"[^{WORD}{WS[1:-1]}\-]", "")
    name = F.regexp_replace(name, rf"{WS}+", "_")
    return F.substring(name, 1, max_chars)


def name_from_url(url, query_chars: int = QUERY_NAME_CHARS) -> Column:
    """File base name from the URL: last three path parts (+ query), or host."""
    u = _c(url)
    path = F.regexp_extract(u, URL_PARTS, 5)
    query = F.regexp_extract(u, URL_PARTS, 7)
    host = F.regexp_extract(u, URL_PARTS, 4)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    q = F.substring(F.regexp_replace(query, rf"[^{WORD}\-]", "_"), 1, query_chars)
    name = F.when(F.size(parts) > 0,
                  F.concat(F.array_join(last, "_"),
                           F.when(query != "", F.concat(F.lit("_"), q)).otherwise(F.lit(""))))
    name = name.otherwise(F.replace(host, F.lit("."), F.lit("_")))
    name = F.regexp_replace(name, rf"[^{WORD}\-]", "_")
    name = F.regexp_replace(name, "_+", "_")
    return F.regexp_replace(name, "^_+|_+$", "")


def page_file_name(html, url) -> Column:
    """Base name for a saved page: title-based, else URL-based."""
    return F.coalesce(F.nullif(name_from_titles(html), F.lit("")), name_from_url(url))


def clean_given_name(name) -> Column:
    """A caller-given name: last extension dropped, other characters -> ``_``."""
    n = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    return F.regexp_replace(n, rf"[^{WORD}\-]", "_")
