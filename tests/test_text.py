import pytest
from pyspark.sql import functions as F

from bindery.functions import numerals as N
from bindery.functions import text as T
from bindery.functions.prose import long_parts, sentences, xhtml


@pytest.fixture
def one(spark):
    """Value of an expression over one row of string columns."""

    def value(make, **columns):
        df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in columns.items()] or [F.lit(1)])
        return df.select(make(*[F.col(k) for k in columns]).alias("v")).first()["v"]

    return value


def test_lines(one):
    page = "My Header\nLine one\nLine two\nPage Footer"
    assert one(T.strip_header_footer, t=page, h="my header", f="page  footer") == "Line one\nLine two"
    assert one(T.strip_header_footer, t=page, h=None, f="") == page
    assert one(T.clean_page_text, t="12\nA / B\nText") == "A / B\nText"
    assert one(T.clean_page_text, t="a\nb\nc\n12") == "a\nb\nc\n12"
    assert [one(T.is_number_line, t=x) for x in ("**12**", "12345", "")] == [True, False, False]
    assert one(T.normalize_line, t="  A \t b ") == "a b"
    assert one(T.word_count, t="") == 0 and one(T.word_count, t=" a  b ") == 2


def test_edits(one):
    edits = lambda *e: F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in e])
    assert one(lambda t: T.apply_edits(t, edits(("b", "X"), ("", "Q"), ("a", "aa"))), t="a b b") == "aa X b"
    assert one(lambda t: T.apply_edits(t, edits(("no", "X"))), t="é") == "é"


def test_headings(one):
    got = one(T.headings, t="# A\n#B\n## ---\n  ### C")
    assert [(h["level"], h["text"], h["line_number"]) for h in got] == [(1, "A", 1), (3, "C", 4)]


def test_keys_and_titles(one):
    assert [one(T.key_prefix, k=k) for k in ("doc1_para_3", "_para_3", "x")] == ["doc1", "", ""]
    shown = lambda *a: one(T.numbered_title, l=a[0], n=a[1], t=a[2])
    assert shown("chapter", "5", "War") == "Chapter 5: War"
    assert shown("chapter", "5", "Chapter 5") == "Chapter 5"
    assert shown("section", "5", "War") == "War"
    assert shown(None, None, None) == ""
    paths = ["/path/to/crusade-europe.pdf", "my-book-1.pdf", "my-book-10.pdf", "simple.pdf"]
    assert [one(T.file_title, p=p) for p in paths] == ["crusade-europe", "my-book", "my-book", "simple"]
    assert one(T.safe_filename, n=' a/b: "c". ') == "a_b_ _c_"
    assert one(T.template_variables, t="{{ .B }} {{.A}} {{ .B }}") == ["A", "B"]
    assert one(T.paragraphs, t="One.\r\n\r\nTwo\nlines.\n\n\n\nThree.") == ["One.", "Two lines.", "Three."]


def test_times_json_numbers(one):
    assert one(lambda t: T.smil_time(t.cast("int")), t="12345") == "12.345s"
    assert one(lambda t: T.clock_time(t.cast("int")), t="3723004") == "01:02:03.004"
    assert one(T.unfenced_json, t='```json\n{"ok":true}\n```') == '{"ok":true}'
    assert one(T.unfenced_json, t="none") is None
    assert [one(lambda t: T.short_number(t.cast("long")), t=x) for x in ("999", "1200", "3400000")] == ["999", "1.2K", "3.4M"]
    assert one(T.escape_xml, t="a<b & 'c'") == "a&lt;b &amp; &apos;c&apos;"
    assert one(T.shortened, t="x" * 2001).endswith("x...") and one(T.shortened, t=None) is None


def test_numerals(one):
    assert [one(N.roman_to_int, t=t) for t in ("IV", "xiv", "ABC", "")] == [4, 14, 0, 0]
    assert one(lambda t: N.int_to_roman(t.cast("int")), t="9") == "IX"
    seq = lambda a, b: one(N.sequence_of, a=a, b=b)
    assert seq("1", "3") == ["1", "2", "3"] and seq("I", "III") == ["I", "II", "III"]
    assert seq("A", "C") == ["A"] and seq("3", "1") == []
    assert len(seq("C", "D")) == 401


def test_sentences():
    assert len(sentences("First sentence. Second sentence! Third sentence? Fourth.")) == 4
    assert sentences("Mr. Smith measured 3.14 meters. Dr. Jones agreed.")[1] == "Dr. Jones agreed."
    assert sentences("Wait... really? Yes.") == ["Wait... really?", "Yes."]
    assert sentences(None) == sentences(" \n ") == []
    assert sentences("Il vint. école. École.") == ["Il vint.", "école.", "École."]
    parts = sentences(", ".join(["clause"] * 1200))
    assert len(parts) >= 2 and all(len(p) <= 4096 for p in parts)
    assert [len(p) for p in long_parts("x" * 9000)] == [4096, 4096, 808]


def test_xhtml():
    assert xhtml("", "T & x") == "<h1>T &amp; x</h1>\n"
    got = xhtml("# A\nsome *it* text\nmore **b**\n\n> q\n---\nend", ids=True)
    assert got == '<h1>A</h1>\n<p id="p0">some <em>it</em> text more <strong>b</strong></p>\n<blockquote><p id="p1">q</p></blockquote>\n<hr/>\n<p id="p2">end</p>\n'
