"""Operators on segments.text: scanned pages, encodings, splitting, look-alikes, markup."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import encoding, lookalike, markup, scanned, splitting
from quirework.llm.arrow import code_points, strings

SEGMENT = "book_id string, id string, ord int, kind string, text string, heading_level int, title string"
#: Every operator must ignore columns it does not know, whatever their names.
CLASHING = SEGMENT + ", piece_no int, n_found int, languages string, affected boolean, line_no int, defect string, marks string, side string"


def segments(spark, rows, clashing=False):
    full = [(r + (None,) * 7)[:7] for r in rows]
    if clashing:
        return spark.createDataFrame([(*r, 9, 9, "x", True, 9, "x", "x", "x") for r in full], CLASHING)
    return spark.createDataFrame(full, SEGMENT)


# --- splitting ---------------------------------------------------------------


def rejoin(pieces):
    return "".join(p.text[p.overlap :] for p in sorted(pieces, key=lambda p: p.piece_no))


@pytest.mark.parametrize("clashing", [False, True])
def test_split_edges(spark, clashing):
    long = "word " * 3000
    rows = [("b", "1", 1, "paragraph", None), ("b", "2", 2, "paragraph", ""), ("b", "3", 3, None, long), ("b", "3", 3, None, long), ("b", "4", 4, "list", "x" * 9000), ("b", "5", 5, "list", "x" * 9001), (None, "6", 6, "code", "y" * 30000)]
    out = splitting.split_oversized(segments(spark, rows, clashing)).collect()
    assert {r.id for r in out} == {"3", "5", "6"}
    assert all(len(r.text) <= 9000 for r in out)
    assert rejoin([r for r in out if r.id == "3"]) == long
    assert rejoin([r for r in out if r.id == "6"]) == "y" * 30000
    for r in out:
        assert r.overlap == (0 if r.piece_no == 1 else 200)


def test_split_empty(spark):
    assert splitting.split_oversized(segments(spark, [])).count() == 0


def test_split_prefers_structure():
    chapter = "# One\n\n" + "A sentence here. " * 30 + "\n\n# Two\n\n" + "Another sentence. " * 30
    pieces = splitting.pack(chapter, "paragraph", 700)
    assert [chapter[a : a + 5] for a, _, _ in pieces] == ["# One", "# Two"]
    rows = "| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(200))
    assert all(rows[b - 1] == "\n" for _, b, _ in splitting.pack(rows, "table", 300)[:-1])
    code = "```\n" + "".join(f"def f{i}():\n    return {i}\n\n" for i in range(60)) + "```"
    assert all(code[a : a + 3] in ("def", "```") for a, _, _ in splitting.pack(code, "code", 200))


def test_split_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "é", "- x\n", "；", "。", "# h\n"]) for _ in range(rng.randrange(1, 400)))
        limit = rng.randrange(5, 60)
        pieces = splitting.pack(text, rng.choice(["paragraph", "list", "code", "table", None]), limit)
        assert "".join(text[a:b] for a, b, _ in pieces) == text
        assert all(0 < b - a <= limit for a, b, _ in pieces)


def test_split_takes_no_comment_in_a_fence_for_a_heading():
    text = "Intro.\n\n```python\n" + "# c\nx = 1\n\n" * 100 + "```\n\n# After\n\nAn end."
    pieces = splitting.pack(text, "paragraph", 200)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    assert [text[a : a + 7] for a, _, name in pieces if name == "heading"] == ["# After"]
    assert {name for _, _, name in pieces} == {"text", "block", "definition", "heading"}


def test_split_knows_the_level_of_a_heading():
    text = "Top\n\n### a\n\nx\n\n## b\n\ny"
    tops = lambda level: [text[n.start : n.end].split("\n")[0] for n in splitting.parse(text, "heading", level).parts]
    assert tops(1) == ["Top"] and tops(2) == ["Top", "## b"] and tops(4) == ["Top", "### a", "## b"]


def test_split_does_not_mix_subtrees():
    text = "# A\n\n" + ("word " * 12 + "\n\n") * 3 + "# B\n\nshort\n\n# C\n\nshort"
    pieces = [text[a:b] for a, b, _ in splitting.pack(text, None, 150)]
    assert pieces[-1].startswith("# B") and "# C" in pieces[-1] and all("# B" not in x for x in pieces[:-1])
    items = "- a\n" + "  - deep word word\n" * 8 + "- b\n- c\n"
    cuts = [items[a:b] for a, b, _ in splitting.pack(items, "list", 60)]
    assert cuts[-1] == "- b\n- c\n"


def test_split_of_very_long_texts():
    for text in ("x" * 400_000, "- a\n" * 100_000, "```\na\n```\n" * 40_000, "# h\n" * 100_000, "a\n---\n" * 60_000, "\n" * 300_000, "<pre " * 80_000):
        pieces = splitting.pack(text, None, 8800)
        assert "".join(text[a:b] for a, b, _ in pieces) == text and all(b - a <= 8800 for a, b, _ in pieces)


def test_split_rejects_bad_overlap(spark):
    with pytest.raises(ValueError):
        splitting.split_oversized(segments(spark, []), limit=10, overlap=10)


# --- look-alikes -------------------------------------------------------------

LOOKALIKES = [
    ("ｆｕｌｌ １２", "full 12", True),
    ("ﬁnanced", "financed", True),
    ("cafe\u0301", "café", True),
    ("no\u200bw", "now", True),
    ("\u0440r\u0456n\u0441\u0456\u0440\u0430l", "principal", True),
    ("Lu\u0445us", "Luxus", True),
    ("10\u00a0km", "10 km", True),
    ("half\u2011way", "half-way", True),
    ("\u2f47\u5fd7", "\u65e5\u5fd7", True),
    ("𝐩𝐥𝐚𝐭𝐞𝐧", "platen", True),
    ("60 μm, angle Δ", "60 μm, angle Δ", False),
    ("«мост» and bridge", "«мост» and bridge", False),
    ("“q” – ’ ² ³ ½ №", "“q” – ’ ² ³ ½ №", False),
    ("宽度（见附录）：共１２项", "宽度（见附录）：共12项", True),
    ("宽度（见附录）：共12项！", "宽度（见附录）：共12项！", False),
    ("plain", "plain", False),
    ("", "", False),
    ("👨‍👩‍👧 ❤️", "👨‍👩‍👧 ❤️", False),
    ("\u0301x", "\u0301x", True),
]


def test_lookalike_cases():
    out, found = lookalike.normalise(pa.array([a for a, _, _ in LOOKALIKES]))
    assert out.to_pylist() == [b for _, b, _ in LOOKALIKES]
    assert [bool(n) for n in found] == [c for _, _, c in LOOKALIKES]


def test_lookalike_is_stable_and_splits_rows():
    rng = random.Random(5)
    alphabet = "aé\u0301Ж\u0440o\u200dﬁ 漢\u2f47Ａ\U0001d41a"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(300)]
    together = lookalike.normalise(pa.array(texts))[0].to_pylist()
    assert together == [lookalike.normalise(pa.array([t]))[0].to_pylist()[0] for t in texts]
    assert lookalike.normalise(pa.array(together))[0].to_pylist() == together


@pytest.mark.parametrize("clashing", [False, True])
def test_lookalike_edges(spark, clashing):
    wrong = "The foreman\u00e2\u20ac\u2122s note\u00a0reads"  # a case of the encoding problem, so none here
    rows = [("b", "1", 1, "heading", "Ａ", 1, "Ａ"), ("b", "2", 2, None, None), ("b", "3", 3, None, ""), ("b", "4", 4, None, "x" * 100000 + "\u200b"), ("b", "1", 1, "heading", "Ａ", 1, "Ａ"), ("b", "5", 5, None, wrong)]
    df = segments(spark, rows, clashing)
    assert {r.id for r in lookalike.find_lookalikes(df).collect()} == {"1", "4"}
    out = {r.id: r for r in lookalike.normalise_segments(df).collect()}
    assert out["1"].text == out["1"].title == "A" and out["2"].text is None and out["3"].text == "" and len(out["4"].text) == 100000


def test_lookalike_empty(spark):
    assert lookalike.find_lookalikes(segments(spark, [])).count() == lookalike.normalise_segments(segments(spark, [])).count() == 0


# --- encodings ---------------------------------------------------------------

ENGLISH = "The foreman’s note reads ‘façade’, at £26 per piece – a café price."
RUSSIAN = "Никто не знал, почему пристань остановилась ночью."
CHINESE = "没有灌溉渠，水泵会在4分钟内停止。每个测量装置都有一个编号。"
GERMAN = "Die Lieferkette prüfen und das Ergebnis für die Arbeitsanweisung notieren."


@pytest.mark.parametrize("text,codec", [(t, c) for t in (ENGLISH, GERMAN, RUSSIAN) for c in ("cp1252", "cp1251", "mac_roman", "cp437")] + [(CHINESE, c) for c in ("latin-1", "mac_roman", "cp437")])
def test_utf8_read_as_one_byte(text, codec):
    try:
        wrong = text.encode().decode(codec)
    except UnicodeDecodeError:
        wrong = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())
    assert encoding.repair(wrong) == (text, True)


def test_twice_and_in_part():
    twice = GERMAN.encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice) == (GERMAN, True)
    part = ENGLISH + " " + "La edición".encode().decode("latin-1")
    assert encoding.repair(part) == (ENGLISH + " La edición", True)


@pytest.mark.parametrize(
    "text,wrong",
    [
        (RUSSIAN, RUSSIAN.encode("cp1251").decode("cp1252")),
        (RUSSIAN, RUSSIAN.encode("koi8_r").decode("cp1251")),
        (CHINESE, CHINESE.encode("gbk").decode("latin-1")),
        (ENGLISH, ENGLISH.encode("cp1252").decode("mac_roman")),
        (RUSSIAN, RUSSIAN.encode().decode("gbk", "ignore")),
        (RUSSIAN, RUSSIAN.encode("cp1251").decode("cp866")),
        (RUSSIAN, RUSSIAN.encode("koi8_r").decode("cp866")),
        ("Après l’été, la crémaillère fut cédée à un négociant.", "Après l’été, la crémaillère fut cédée à un négociant.".replace("’", "'").encode("latin-1").decode("iso8859_2").replace("'", "’")),
        ("El año 1998 trajo más lluvia que ningún otro.", "El año 1998 trajo más lluvia que ningún otro.".encode("latin-1").decode("iso8859_2")),
        ("The term “Zürich line”. The term façade isn’t listed.", "The term “Zürich line”. " + "The term façade isn’t listed.".encode("cp1252").decode("mac_roman")),
    ],
)
def test_legacy_to_legacy(text, wrong):
    fixed, affected = encoding.repair(wrong)
    assert affected
    same = sum(a == b for a, b in zip(fixed, text, strict=False))
    assert same > 0.9 * len(text) or fixed[:40] == text[:40]


@pytest.mark.parametrize(
    "text", [ENGLISH, RUSSIAN, CHINESE, GERMAN, "", "plain", "The old spelling Ðat with the letter Ð survives, at 5 € or £4.", "Ça n’a coûté que 102 écus.", "СССР» и РФ…", "¡Qué pequeña era la cigüeña!", "每3小时", "Use 储罐 here.", "A radius of 60 μm", "ГЛАВА ПЕРВАЯ О ТОМ, КАК", "Za żółtą jaźń čeština není snadná řeč", "№ 5 и √2", "It covers 68 m².每598小时检查一次培训课程。"]
)
def test_clean_text_is_left(text):
    assert encoding.repair(text) == (text, False)


def test_damage_is_a_case():
    assert encoding.repair("caf\ufffd") == ("caf\ufffd", True)


@pytest.mark.parametrize("clashing", [False, True])
def test_encoding_edges(spark, clashing):
    wrong = GERMAN.encode().decode("cp1252")
    rows = [("b", "1", 1, None, wrong, None, wrong), ("b", "1", 1, None, wrong, None, wrong), ("b", "2", 2, None, None), ("b", "3", 3, None, ""), ("b", "4", 4, None, GERMAN * 500), (None, None, None, None, "caf\ufffd")]
    df = segments(spark, rows, clashing)
    found = encoding.repair_segments(df, only_affected=True).collect()
    assert sorted((r.id or "", r.restored) for r in found) == [("", False), ("1", True), ("1", True)]
    every = {r.id: r for r in encoding.repair_segments(df).collect()}
    assert every["1"].text == every["1"].title == GERMAN and every["2"].text is None and every["4"].text == GERMAN * 500 and not every["4"].affected


def test_encoding_empty(spark):
    assert encoding.repair_segments(segments(spark, [])).count() == 0


# --- markup ------------------------------------------------------------------

MARKUP = [
    ("paragraph", "A <b>bold</b> word.<br>Next &amp; last", "A bold word.\nNext & last"),
    ("paragraph", "<ul><li>one<li>two</ul>", "- one\n- two"),
    ("table", "<table><tr><th>a</th><th>bb</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a   | bb  |\n|-----|-----|\n| 1   | 2   |"),
    ("paragraph", "<script>x()</script>seen<!-- not -->", "seen"),
    ("paragraph", "<pre><code>a  = 1\nb</code></pre>", "```\na  = 1\nb\n```"),
    ("paragraph", "see [the page](https://example.org/x) and **more**", "see the page and more"),
    ("paragraph", "Title\n=====\ntext", "# Title\n\ntext"),
    ("paragraph", "== Head ==\n[[a|b]] ''c''", "## Head\n\nb c"),
    ("paragraph", "{| class=\"w\"\n! x !! y\n|-\n| 1 || 2\n|}", "| x   | y   |\n|-----|-----|\n| 1   | 2   |"),
    ("paragraph", "\\section{Head}\n\\label{s}\nText \\emph{it}.", "## Head\n\nText it."),
    ("paragraph", "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"),
    ("paragraph", "where \\(x = 1\\) holds", "where $x = 1$ holds"),
    ("heading", "## The *faded* graft", "## The faded graft"),
    ("list", "- one **two**\n- three", "- one two\n- three"),
    ("paragraph", "控制阀**取决于**起重设备", "控制阀取决于起重设备"),
]


@pytest.mark.parametrize("kind,text,clean", MARKUP)
def test_markup_is_rendered(kind, text, clean):
    out = markup.clean(text, kind)
    assert out.languages and out.text == clean


@pytest.mark.parametrize(
    "kind,text",
    [
        ("paragraph", "If a < b and c > d, then x * y * 2."),
        ("paragraph", "The price rose from $12 to $58 and Marsh & Sons [sic] paid it."),
        ("paragraph", "The file a_b_v2 lies under D:\\textures\\begin on the disk."),
        ("paragraph", "The flow follows $v_{0} + z \\leq \\sqrt{m}$ as long."),
        ("paragraph", "R&D said x == y"),
        ("paragraph", "täg=\nlich\n[57]\nHEAD\n- 32 -\ntext"),
        ("heading", "## Head"),
        ("list", "* a\n* b"),
        ("table", "| a | b |\n|---|---:|\n| 1 | 2 |"),
        ("code", "```\n<b>x</b>\n```"),
        ("image", "![a](b.png)"),
        (None, "plain"),
    ],
)
def test_no_markup(kind, text):
    assert markup.clean(text, kind) == (text, [])


def test_markup_survives_anything():
    rng = random.Random(11)
    bits = ["<b>", "</b>", "<table>", "<td>", "**", "*", "_", "[[", "]]", "{{", "}}", "\\begin{itemize}", "\\item", "\\emph{", "}", "$", "`", "\n", "a ", "&amp;", "<!--", "==", "{|", "|}", "<li>", "'''", "> "]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        markup.clean(text, rng.choice(["paragraph", "list", "table", "heading", None]))


@pytest.mark.parametrize("clashing", [False, True])
def test_markup_edges(spark, clashing):
    rows = [("b", "1", 1, None, "<b>x</b>"), ("b", "1", 1, None, "<b>x</b>"), ("b", "2", 2, "paragraph", None), ("b", "3", 3, "paragraph", ""), ("b", "4", 4, "code", "<b>x</b>"), ("b", "5", 5, "paragraph", "word " * 50000 + "<i>y</i>")]
    df = segments(spark, rows, clashing)
    assert sorted(r.id for r in markup.clean_segments(df, only_found=True).collect()) == ["1", "1", "5"]
    out = {r.id: r for r in markup.clean_segments(df).collect()}
    assert out["1"].text == "x" and out["2"].text is None and out["3"].text == "" and out["4"].text == "<b>x</b>"


def test_markup_empty(spark):
    assert markup.clean_segments(segments(spark, []), only_found=True).count() == 0


# --- scanned pages -----------------------------------------------------------

WORDS = "the steam boiler stood near an old harbour while every lantern marked another narrow channel along the eastern wall".split()


def page(rng, n, head):
    """Greedily wrapped lines with divided and misread words under a head and a number; (text, defects)."""
    words = [rng.choice(WORDS) for _ in range(60)]
    words[20] = "tbe"
    lines, defects, line = [head, str(n)], [(1, "furniture"), (2, "furniture")], ""
    for word in words:
        if len(line) + 1 + len(word) <= 58:
            line = f"{line} {word}".strip()
            continue
        if word == "harbour" and len(line) + 5 <= 58:
            lines.append(line + " har-")
            defects.append((len(lines), "hyphen"))
            line = "bour"
        else:
            lines.append(line)
            line = word
    lines.append(line)
    at = next(i for i, x in enumerate(lines, 1) if "tbe" in x.split())
    return "\n".join(lines), [*defects, (at, "misread")]


def scanned_book(spark, clashing=False):
    rng = random.Random(2)
    rows, want = [("b", "h", 0, "heading", "# The Old Mill", 1, "The Old Mill")], set()
    for n in range(20):
        text, defects = page(rng, n + 11, "THE OLD MILL")
        rows.append(("b", f"s{n:02}", n + 1, "paragraph", text))
        want |= {(f"s{n:02}", line, defect) for line, defect in defects}
    rows += [rows[3], ("b", "v", 30, "paragraph", "It stood at 73.\n1942\nwas the year."), ("b", "z", 31, "paragraph", None), ("c", "p", 1, "paragraph", "O mill,\nthat held")]
    rows += [("c", f"q{i}", 2 + i, "paragraph", "one line only") for i in range(5)]
    books = spark.createDataFrame([("b", "The Old Mill", "pdf"), ("c", None, "pdf"), ("d", None, "epub")], "book_id string, title string, source_format string")
    return segments(spark, rows, clashing), books, want


@pytest.mark.parametrize("clashing", [False, True])
def test_scanned_defects(spark, clashing):
    df, books, want = scanned_book(spark, clashing)
    defects, _ = scanned.line_defects(df, books, ratio=3)
    got = {(r.id, r.line_no, r.defect) for r in defects.collect()}
    assert {x for x in got if x[2] != "misread"} == {x for x in want if x[2] != "misread"}
    assert {x for x in want if x[2] == "misread"} <= got


def test_scanned_repair(spark):
    df, books, _ = scanned_book(spark)
    out = {r.id: r for r in scanned.repair_scanned(df, books, ratio=3).collect()}
    text = out["s04"].text
    assert "harbour" in text and "har-" not in text and "MILL" not in text and "tbe" not in text and "\n" not in text
    assert len(text.split()) == 60 and set(text.split()) <= set(WORDS)
    assert out["v"].text == "It stood at 73.\n1942\nwas the year."


def test_scanned_empty(spark):
    books = spark.createDataFrame([], "book_id string, title string, source_format string")
    assert scanned.line_defects(segments(spark, []), books)[0].count() == 0
    assert scanned.repair_scanned(segments(spark, []), books).count() == 0


def test_page_values():
    assert scanned.page_value("  — 28 —") == (28, True)
    assert scanned.page_value("Page 31 of 303") == (31, True)
    assert scanned.page_value("[4]") == (4, True)
    assert scanned.page_value("p. 7") == (7, True)
    assert scanned.page_value("xl") == (40, False)
    assert scanned.page_value("1942") == (1942, False)
    assert scanned.page_value("civil") is None
    assert scanned.parts("p. 34    Improved spindles") == ("Improved spindles", (34, True))


@pytest.mark.parametrize("right,wrong", [("registered", "registerecl"), ("technical", "techriical"), ("weakened", "vveakened"), ("coastal", "c0astal"), ("steht", "5teht"), ("September", "Septernber"), ("cylinder", "cyhnder"), ("Druckanzeige", "Driickanzeige"), ("liegen", "hegen"), ("library", "li6rary")])
def test_misreadings_share_a_key(right, wrong):
    assert scanned.fold(right) == scanned.fold(wrong)


def test_misread_numbers():
    assert all(map(scanned.is_misread_number, ("l966", "I98O", "7O6")))
    assert not any(map(scanned.is_misread_number, ("1990s", "v2", "2nd", "1966", "mill")))


def _composed(texts):
    points, offsets = code_points(pa.array(texts, pa.string()))
    points, offsets, counts = lookalike._compose(points, offsets, lookalike.tables())
    return strings(points, offsets).to_pylist(), counts.tolist()


def test_every_assigned_character_is_composed_as_the_standard_does():
    every = [chr(p) for p in range(0x20, 0x32000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    apart = [unicodedata.normalize("NFD", c) for c in every]
    assert _composed(apart)[0] == [unicodedata.normalize("NFC", c) for c in apart]


@given(st.lists(st.text(st.sampled_from("sSae\u00e1\u1e61\u304b\u304c\u3099\u1112\u1161\u11ab\ud55c\u0338\u0327\u0323\u0307\u0301\u0308\u0623"), max_size=9), max_size=6))
@settings(max_examples=300, deadline=None)
def test_marks_in_any_order_are_composed_as_the_standard_does(texts):
    assert _composed(texts)[0] == [unicodedata.normalize("NFC", x) for x in texts]


def test_equal_looking_marks_come_to_one_form():
    texts = ["s\u0307\u0323", "s\u0323\u0307", "\u1e61\u0323", "\u304b\u3099", "\u1112\u1161\u11ab", "plain"]
    new, found = lookalike.normalise(pa.array(texts))
    assert new.to_pylist() == ["\u1e69"] * 3 + ["\u304c", "\ud55c", "plain"] and (found > 0).tolist() == [True] * 5 + [False]


SCRIPTS = {
    "ru": "Привет, это русский текст", "ja": "日本語の文章です", "ko": "안녕하세요 한국어 문장입니다", "he": "שלום עולם זה טקסט", "ar": "مرحبا بالعالم هذا نص", "th": "สวัสดีชาวโลก",
    "vi": "Tiếng Việt là ngôn ngữ của người Việt", "hi": "नमस्ते दुनिया",
}


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp437", "koi8_r", "mac_roman"])
@pytest.mark.parametrize("language", SCRIPTS)
def test_any_script_is_restored_and_left_alone(language, codec):
    text = SCRIPTS[language]
    garbled = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())
    assert encoding.repair(garbled) == (text, True)
    assert encoding.repair(text) == (text, False)


@pytest.mark.parametrize("bad", [b"\xc0\xaf", b"\xe0\x80\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf0\x80\x80\xaf", b"\xe3\x81"])
def test_the_automaton_takes_well_formed_sequences_only(bad):
    classes = encoding.byte_classes()
    assert not encoding.sequences(classes[np.frombuffer(bad, np.uint8)]).any()
    mixed = np.frombuffer(bad + "é漢".encode(), np.uint8)
    assert encoding.sequences(classes[mixed])[len(bad) :].tolist() == [2, 0, 3, 0, 0]


def test_a_garbled_title_alone_is_repaired_too(spark):
    rows = [("b", "1", "plain", "CafÃ©"), ("b", "2", "plain", "plain"), ("b", "3", "CafÃ©", None), ("b", "4", None, None)]
    got = {r.id: r for r in encoding.repair_segments(spark.createDataFrame(rows, "book_id string, id string, text string, title string"), only_affected=True).collect()}
    assert sorted(got) == ["1", "3"] and got["1"].title == "Café" and not got["1"].affected and got["1"].title_affected and got["3"].affected


@pytest.mark.parametrize(
    "line,want",
    [
        ("THE ART OF THE BOOKBINDER 1234", ("THE ART OF THE BOOKBINDER", (1234, False))),
        ("12 A HISTORY OF WORK", ("A HISTORY OF WORK", (12, False))),
        ("  Page 31 of 303 ", ("", (31, True))),
        ("x" * 100 + "   7", ("x" * 100, (7, False))),
        ("It was sold for 12", ("It was sold for 12", None)),
        ("HOUSE 7 AND HOUSE 8", ("HOUSE 7 AND HOUSE 8", None)),
        ("xiv", ("", (14, False))),
    ],
)
def test_heads_and_page_numbers_of_any_length(line, want):
    assert scanned.parts(line) == want


PLACES = "mill river stone wheel grain water roof beam yard wall gate bridge road cart horse field barn lamp rope chain".split()


def test_a_running_head_of_a_hundred_characters_is_found(spark):
    rng = random.Random(4)
    head = "A very long running head that a printer set over every single page of this book on the history of looms"
    rows = []
    for k in range(40):
        body = "\n".join("and " + " ".join(rng.choice(PLACES) for _ in range(10)) for _ in range(5))
        rows.append(("b", f"s{k}", k, "paragraph", (head + "\n" if k % 4 == 0 else "") + body + " and it was so."))
    books = spark.createDataFrame([("b", "T", "pdf")], "book_id string, title string, source_format string")
    got = {(r.id, r.line_no) for r in scanned.line_defects(segments(spark, rows), books)[0].where("defect = 'furniture'").collect()}
    assert got == {(f"s{k}", 1) for k in range(0, 40, 4)}


DEEP = [
    ("<b>" * 1500 + "deep" + "</b>" * 1500, "deep"),
    ("<div>" * 3000 + "open", "open"),
    ("\\textbf{\\emph{\\textit{\\texttt{\\underline{\\textsc{deep}}}}}} end", "`deep` end"),
    ("a {{lang|fr|{{small|{{nobr|{{big|mot}}}}}}}} b", "a fr mot b"),
]


@pytest.mark.parametrize("text,want", DEEP)
def test_markup_of_any_depth(text, want):
    assert markup.clean(text, "paragraph").text == want


def test_long_formulas_and_row_spans():
    formula = "$" + "x_{1} + " * 100 + "y$"
    assert formula in markup.clean(f"<b>bold</b> {formula}", "paragraph").text
    table = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td colspan=2>d</td></tr></table>"
    rows = [[c.strip() for c in r.strip("|").split("|")] for r in markup.clean(table, "table").text.split("\n")]
    assert rows == [["a", "b"], ["", "c"], ["d", ""]]
