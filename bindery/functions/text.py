"""Text functions as columns, all evaluated in the JVM.

Lengths that are compared with a limit count bytes where the published behaviour does (``octet_length``).
Null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word ends without regard to letters beyond ASCII, as most engines have them.
EDGE_A, EDGE_B = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
LINE = "\n"


def lines(text: Column) -> Column:
    return F.split(text, LINE)


def normalize_line(line: Column) -> Column:
    """Trimmed, in lower case, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def strip_header_footer(text: Column, header: Column, footer: Column) -> Column:
    """Text without the lines that equal, in normal form, its header or footer; empty ones match nothing."""
    head, foot = normalize_line(F.coalesce(header, F.lit(""))), normalize_line(F.coalesce(footer, F.lit("")))
    keep = lambda x: ~(
        ((head != "") & (normalize_line(x) == head)) | ((foot != "") & (normalize_line(x) == foot))
    )
    return F.array_join(F.filter(lines(text), keep), LINE)


def is_number_line(line: Column) -> Column:
    """Whether a line, marks of emphasis apart, is one to four digits."""
    return F.trim(F.replace(line, F.lit("*"), F.lit(""))).rlike("^[0-9]{1,4}$")


def clean_page_text(text: Column) -> Column:
    """Text without the first short line (under 50 bytes) among its first three that holds a slash or
    is a page number; trimmed."""
    parts = lines(text)
    furniture = lambda x: (F.octet_length(F.trim(x)) < 50) & (F.trim(x) != "") & (x.contains("/") | is_number_line(x))
    first = F.array_position(F.transform(F.slice(parts, 1, 3), furniture), True)
    kept = F.filter(parts, lambda x, i: (i + 1) != first)
    return F.regexp_replace(F.array_join(kept, LINE), r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def apply_edits(text: Column, edits: Column) -> Column:
    """Replace the first occurrence of each edit's ``old`` by its ``new``, in order; empty old texts are skipped."""

    def one(t: Column, e: Column) -> Column:
        at = F.position(e["old"], t)
        return F.when((F.length(e["old"]) == 0) | (at == 0), t).otherwise(
            F.concat(F.substring(t, F.lit(1), at - 1), e["new"], F.substring(t, at + F.length(e["old"]), F.length(t)))
        )

    return F.aggregate(edits, text, one)


def join_kind(before: Column) -> Column:
    """How a page's text goes on from what stands before: 'glue' after a cut word, 'none' after
    nothing, 'break' after the end of a sentence, else 'space'."""
    t = F.regexp_replace(before, r"\s+$", "")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "none")
        .when(t.rlike(r"[a-z]-$"), "glue")
        .when(t.rlike("[.!?\"']$"), "break")
        .otherwise("space")
    )


def headings(text: Column) -> Column:
    """``array<struct<level, text, line_number>>`` of the lines that are headings of one to six signs
    and hold a letter or digit."""
    rows = F.transform(lines(text), lambda x, i: F.struct(F.trim(x).alias("line"), (i + 1).alias("no")))
    good = F.filter(rows, lambda r: r["line"].rlike(r"^#{1,6}\s+.*[A-Za-z0-9]"))
    return F.transform(
        good,
        lambda r: F.struct(
            F.length(F.regexp_extract(r["line"], "^(#{1,6})", 1)).alias("level"),
            F.trim(F.regexp_extract(r["line"], r"^#{1,6}\s+(.+)$", 1)).alias("text"),
            r["no"].alias("line_number"),
        ),
    )


def template_variables(text: Column) -> Column:
    """Distinct names of ``{{ .Name }}``, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{-?\s*\.([A-Za-z_][A-Za-z0-9_]*)"), 1)))


def paragraphs(text: Column) -> Column:
    """Paragraphs parted by blank lines: line ends as blanks, double blanks as one, empty ones left out."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(
        F.transform(F.split(t, "\n\n"), lambda x: F.regexp_replace(F.trim(F.replace(x, F.lit("\n"), F.lit(" "))), " {2,}", " ")),
        lambda x: x != "",
    )


def key_prefix(key: Column) -> Column:
    """What stands before ``_para_``, or '' if nothing does."""
    at = F.instr(key, F.lit("_para_"))
    return F.when(at > 1, F.substring(key, F.lit(1), at - 1)).otherwise("")


def second_part(key: Column, book: Column) -> Column:
    """What stands in a key after its book up to the next colon; '' for keys of another book and null."""
    rest = F.substring(key, F.length(book) + 2, F.length(key))
    return F.when(F.startswith(key, F.concat(book, F.lit(":"))), F.substring_index(rest, ":", 1)).otherwise("")


def title_case(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def numbered_title(level_name: Column, number: Column, title: Column) -> Column:
    """'Chapter 5: War' for chapters and parts with a number, unless the title is the number itself."""
    t, n = F.coalesce(title, F.lit("")), F.coalesce(number, F.lit(""))
    numbered = F.coalesce(level_name.isin("chapter", "part"), F.lit(False)) & (n != "")
    said = t.isin(F.concat(F.lit("Chapter "), n), F.concat(F.lit("Part "), n))
    return F.when(numbered & ~said, F.concat(title_case(level_name), F.lit(" "), n, F.lit(": "), t)).otherwise(t)


def file_title(path: Column) -> Column:
    """Base name without extension and number of the part."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(-\d+)?\.[^.]*$", "")


def safe_filename(name: Column, longest: int = 100) -> Column:
    """Characters that files can't have as underscores, no blanks or dots at the ends, cut to a length."""
    clean = F.regexp_replace(name, r'[/\\:*?"<>|]', "_")
    return F.left(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), F.lit(longest))


def shortened(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def escape_xml(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def smil_time(ms: Column) -> Column:
    return F.format_string("%.3fs", ms / F.lit(1000.0))


def clock_time(ms: Column) -> Column:
    m = ms.cast("long")
    part = lambda unit, of: F.pmod(F.floor(m / F.lit(unit)), F.lit(of)).cast("long")
    return F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(m / F.lit(3600000)).cast("long"), part(60000, 60), part(1000, 60), F.pmod(m, F.lit(1000)).cast("long")
    )


def unfenced_json(text: Column) -> Column:
    """The outermost object or array of a text, code fences taken off; null if there is none."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def short_number(n: Column) -> Column:
    """1.2K, 3.4M."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6)))
        .when(n >= 1000, F.format_string("%.1fK", n / F.lit(1e3)))
        .otherwise(F.format_string("%d", n.cast("long")))
    )


def snippets(text: Column, pattern: str, most: int = 3, around: int = 50) -> Column:
    """The first matches of a pattern, each with the characters around it, which may hold other matches."""
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), 0), 1, most)
    between = F.split(text, pattern, most + 1)
    size = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + F.length(y))

    def cut(match, i):
        start = size(F.slice(between, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i))
        first = F.greatest(start - around, F.lit(0))
        return F.substring(text, first + 1, start + F.length(match) + around - first)

    return F.transform(found, cut)


def confidence(word: Column) -> Column:
    """high and medium as they are, all else low."""
    return F.when(word.isin("high", "medium"), word).otherwise("low")
