"""Problem 1: noise in text from scanned pages.

The lines of a segment are labelled head, body or break by a linear conditional
model over layout features, decoded by Viterbi; running heads and page numbers
fall out, body lines are joined and a break stays a break. Evidence that spans
a book (page numbers that count on, heads that repeat or match a heading) and
the corpus's own vocabulary (divided words, misread characters) is gathered by
joins on small rows, never by collecting a book.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quirework.llm.arrow import map_batches
from quirework.session import cut

#: A book is scanned if so large a part of its paragraphs keep their printed lines.
SCANNED_SHARE = 0.3
#: A form is a misreading if the word it stands for occurs so many times as often; for words of
#: ``LONG_WORD`` letters, few of which have a real neighbour, a third of that is enough.
MISREAD_RATIO, LONG_WORD = 12, 5

#: Positions of a book in one bucket of its page sequence.
BUCKET = 4096
#: A printed line of running text is no shorter, in characters.
LEAST_WIDTH = 36

HEAD, BODY, BREAK = 0, 1, 2
#: Weights of the linear conditional model: feature -> (head, body, break).
WEIGHTS = {
    "bias": (-1.5, 0.5, -0.5),
    "page in a frame": (5.0, -1.0, -1.0),
    "page number that counts on": (5.0, -2.0, -2.0),
    "number out of sequence": (-3.0, 0.5, 0.5),
    "known head": (6.0, -1.0, -1.0),
    "capitals only": (3.5, -0.5, -0.5),
    "centred": (1.0, 0.0, 0.0),
    "head and page": (3.0, -1.0, -1.0),
    "running text": (-4.0, 1.0, 0.5),
    "full line": (0.0, 1.5, -1.5),
    "room for the next word": (0.0, -1.5, 1.5),
    "ends with a division mark": (-2.0, 2.0, -3.0),
    "last line": (0.0, 0.0, 1.0),
}
#: Weights of neighbours: from -> to.
STEPS = ((0.5, 0.0, 0.0), (0.0, 0.5, 0.0), (0.0, 0.0, 0.3))

_ROMAN_DIGITS = (("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))
_NUMBER = r"(\d{1,4}|[ivxlcIVXLC]{1,7})"
_FRAMED = re.compile(rf"(?:(?:p|pp|s|с|стр|pág)\.|page|seite|página|стр)\s*{_NUMBER}(?:\s+(?:of|von|de|sur|из|/)\s*\d+)?|[\[(—–-]\s*{_NUMBER}\s*[\])—–-]", re.I)
_PLAIN = re.compile(_NUMBER)
#: No page number in words or signs is longer, unless it ends in a digit.
_LONGEST_PAGE = 40
_END_MARK = re.compile(r"([^\W\d_]+(?:[@\d][^\W\d_]*)*)([-¬=­‐][ \t]?)$")
_MARKS = frozenset("-¬=\u00ad\u2010")
_WORD = re.compile(r"[\w@]+(?:-[\w@]+)*")
_LETTERS = re.compile(r"[^\W\d_]")
_DIGIT_FOR = str.maketrans("lIioOsSbBzZgq", "1110055882299")
_REAL_MIXED = re.compile(r"\d+(?:s|st|nd|rd|th|er|ers|ste|ten|te|a|b|c|x|v|cm|mm|km|kg|m|g|h|%)?|(?![lios])[a-z]\d+", re.I)


def page_value(text: str) -> tuple[int, bool] | None:
    """The page number a line consists of, and whether it stands in a frame (``[4]``, ``Page 31 of 303``)."""
    text = text.strip()
    m = _FRAMED.fullmatch(text)
    framed = bool(m)
    if not m:
        m = _PLAIN.fullmatch(text)
    if not m:
        return None
    value = next(g for g in m.groups() if g)
    if value.isdigit():
        return int(value), framed
    worth = dict(_ROMAN_DIGITS)
    numerals = [worth[c] for c in value.lower()]
    total = sum(n if n >= after else -n for n, after in zip(numerals, [*numerals[1:], 0], strict=True))
    return (total, framed) if _roman(total) == value.lower() else None


def _roman(value: int) -> str:
    out = ""
    for digit, worth in _ROMAN_DIGITS:
        while value >= worth:
            out, value = out + digit, value - worth
    return out


# What recognition takes for each other, each as the strokes it is printed with.
_STROKES = str.maketrans(
    {
        "m": "rrl", "n": "rl", "u": "ll", "ü": "ll", "w": "vv", "d": "cl", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "ß": "ll", "i": "l", "1": "l", "|": "l",
        "e": "c", "3": "c", "f": "t", "7": "t", "q": "g", "9": "g", "0": "o", "ö": "o", "5": "s", "@": "a", "4": "a", "ä": "a",
    }
)


def fold(word: str) -> str:
    """One key for a word and its misreadings."""
    return word.lower().translate(_STROKES)


def fold_head(text: str) -> str:
    """One key for a running head, whatever its case and misreadings."""
    text = re.sub(r"^[#=\s]+", "", text).upper().replace("II", "H").replace("VV", "W").replace("RN", "M").replace("RI", "N").replace("CL", "D")
    return re.sub(r"[^\w]", "", text.translate(str.maketrans("F1|L05869QCÖÄÜ", "EIIIOSBBGOEOAU")))


def parts(line: str) -> tuple[str, tuple[int, bool] | None]:
    """A line as head text and page number; either may be missing."""
    text = line.strip()
    page = page_value(text) if len(text) <= _LONGEST_PAGE or text[-1:].isdigit() else None
    if page:
        return "", page
    if "  " in text or "\t" in text:
        columns = re.split(r"\s{2,}|\t", text)
        if len(columns) == 2:
            for head, number in (columns, columns[::-1]):
                page = page_value(number)
                if page:
                    return head, page
    elif text[-1:].isdigit() or text[:1].isdigit():
        # one space between them: only a head in capitals is one beyond doubt
        for head, number in (text.rpartition(" ")[::2], text.partition(" ")[::-2]):
            if number.isdigit() and len(number) < 5 and is_capitals(head) and not re.search(r"\d", head):
                return head, (int(number), False)
    return text, None


def is_capitals(text: str) -> bool:
    bare = text.replace("ß", "")
    return bare == bare.upper() and len(_LETTERS.findall(text)) >= 4


def features(lines: list[str], marks: dict[int, tuple[bool, bool]]) -> list[list[str]]:
    """Layout features of each line; ``marks``: line number -> (its page counts on, its head is known)."""
    split = [parts(x) for x in lines]
    capitals = [bool(head) and is_capitals(head) for head, _ in split]
    none = (False, False)
    known_heads = [bool(head) and marks.get(i + 1, none)[1] for i, (head, _) in enumerate(split)]
    heads = [c or k or page is not None and not head for c, k, (head, page) in zip(capitals, known_heads, split, strict=True)]
    bare = [x.rstrip() for x in lines]
    width = max(LEAST_WIDTH, *(len(x) for x, h in zip(bare, heads, strict=True) if not h), 0)
    following: list[str | None] = [None] * len(lines)
    after = None
    for i in range(len(lines) - 1, -1, -1):
        following[i] = after
        if not heads[i]:
            after = lines[i]
    out = []
    for i, line in enumerate(lines):
        head, page = split[i]
        has = ["bias"]
        if page:
            if page[1]:
                has.append("page in a frame")
            if marks.get(i + 1, none)[0]:
                has.append("page number that counts on")
            elif not page[1] and not head:
                has.append("number out of sequence")
        if known_heads[i]:
            has.append("known head")
        if capitals[i]:
            has.append("capitals only")
        if page and (known_heads[i] or capitals[i]):
            has.append("head and page")
        if line.startswith("      "):
            has.append("centred")
        if head and not known_heads[i] and not capitals[i]:
            has.append("running text")
        if bare[i][-1:] in _MARKS and _END_MARK.search(line):
            has.append("ends with a division mark")
        if following[i] is None:
            has.append("last line")
        else:
            first = following[i].split(None, 1)[0] if following[i].strip() else ""
            has.append("full line" if len(bare[i]) + 1 + len(first) > width else "room for the next word")
        out.append(has)
    return out


def label(lines: list[str], marks: dict[int, tuple[bool, bool]]) -> list[int]:
    """The best labels of the lines, by Viterbi."""
    states = (HEAD, BODY, BREAK)
    best, back = None, []
    for has in features(lines, marks):
        score = [0.0, 0.0, 0.0]
        for f in has:
            w = WEIGHTS[f]
            score[0] += w[0]
            score[1] += w[1]
            score[2] += w[2]
        if best is None:
            best = score
            continue
        came = [max(states, key=lambda a, b=b: best[a] + STEPS[a][b]) for b in states]
        best = [best[came[b]] + STEPS[came[b]][b] + score[b] for b in states]
        back.append(came)
    path = [max(states, key=lambda a: best[a])]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def divided(lines: list[str], labels: list[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, next body line, first half, second half, mark) of words that run over a line's end; lines from 0."""
    body = [i for i, x in enumerate(labels) if x != HEAD]
    out = []
    for i, j in zip(body, body[1:], strict=False):
        m = _END_MARK.search(lines[i]) if lines[i].rstrip()[-1:] in _MARKS else None
        rest = _WORD.match(lines[j].lstrip()) if m else None
        if m and labels[i] != BREAK and rest and _LETTERS.search(rest.group()):
            out.append((i, j, m.group(1), rest.group().split("-")[0], m.group(2).strip()))
    return out


def is_misread_number(token: str) -> bool:
    """Digits with letters among them that only look like digits."""
    if not (re.search(r"\d", token) and _LETTERS.search(token)) or _REAL_MIXED.fullmatch(token):
        return False
    digits = token.translate(_DIGIT_FOR)
    return digits.isdigit() and (sum(c.isdigit() for c in token) * 2 >= len(token) or token[0] in "lI" and token[1:].isdigit())


# --- plans ----------------------------------------------------------------------


def scanned_segments(segments: DataFrame, books: DataFrame, share: float = SCANNED_SHARE) -> DataFrame:
    """Paragraphs with printed lines, of books in format pdf most of whose paragraphs keep them."""
    pdf = books.where(F.lower(F.col("source_format")) == "pdf").select(F.col("book_id").cast("string").alias("book_id")).distinct()
    paragraphs = segments.where(F.col("kind") == "paragraph").select(
        F.col("book_id").cast("string").alias("book_id"), F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text")
    )
    lined = F.coalesce(F.col("text").contains("\n"), F.lit(False))
    stats = paragraphs.groupBy("book_id").agg(F.avg(lined.cast("int")).alias("lined")).where(F.col("lined") >= share)
    chosen = stats.join(pdf, "book_id", "left_semi").select("book_id")
    return paragraphs.where(lined).join(chosen, "book_id", "left_semi").dropDuplicates(["book_id", "id", "text"])


CANDIDATES = "book_id string, id string, ord bigint, line_no int, page int, head string"


def _candidates(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {n: [] for n in ("book_id", "id", "ord", "line_no", "page", "head")}
    for row in batch.to_pylist():
        for i, line in enumerate(row["text"].split("\n")):
            head, page = parts(line)
            text = line.strip()
            if page is None and (len(text) < 4 or not is_capitals(text) and text.endswith((",", ";", "-", "¬"))):
                continue
            key = fold_head(head) if head else None
            for column, value in zip(out.values(), (row["book_id"], row["id"], row["ord"], i + 1, page[0] if page else None, key or None), strict=True):
                column.append(value)
    kinds = {"ord": pa.int64(), "line_no": pa.int32(), "page": pa.int32()}
    return {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}


def line_marks(scanned: DataFrame, segments: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, id, marks``: which lines hold a page number that counts on or a known head."""
    found = cut(map_batches(scanned, ["book_id", "id", "ord", "text"], _candidates, CANDIDATES))
    # Neighbours are looked for within buckets of positions, in two grids half a bucket apart, so that
    # every row has its neighbours in one of them and no task sorts a whole book.
    numbered = found.where(F.col("page").isNotNull()).select("book_id", "id", "ord", "line_no", "page", F.explode(F.array(F.lit(0), F.lit(BUCKET // 2))).alias("grid"))
    numbered = numbered.withColumn("bucket", F.floor((F.col("ord") + F.col("grid")) / BUCKET))
    order = Window.partitionBy("book_id", "grid", "bucket").orderBy("ord", "id", "line_no")
    near = None
    for k in (1, 2, 3):
        for ahead in (F.lead("page", k).over(order) - F.col("page"), F.col("page") - F.lag("page", k).over(order)):
            test = F.coalesce((ahead > 0) & (ahead <= k + 2), F.lit(False))
            near = test if near is None else near | test
    pages = numbered.withColumn("near", near).groupBy("book_id", "id", "line_no").agg(F.bool_or("near").alias("page_ok"))
    fold_udf = F.pandas_udf(lambda s: s.map(lambda x: fold_head(x) if x else None), StringType())
    ids = scanned.select("book_id").distinct()
    titles = segments.where((F.col("kind") == "heading") & F.col("text").isNotNull()).select(F.col("book_id").cast("string").alias("book_id"), F.col("text").alias("title"))
    titles = titles.unionByName(books.where(F.col("title").isNotNull()).select(F.col("book_id").cast("string").alias("book_id"), "title"))
    titles = titles.join(ids, "book_id", "left_semi").distinct().select("book_id", fold_udf("title").alias("head"))
    repeated = found.where(F.col("head").isNotNull()).groupBy("book_id", "head").agg(F.count("*").alias("n")).where(F.col("n") >= 3).select("book_id", "head")
    known = titles.unionByName(repeated).where(F.length("head") >= 4).distinct()
    heads = found.where(F.col("head").isNotNull()).join(known, ["book_id", "head"], "left_semi").select("book_id", "id", "line_no", F.lit(True).alias("head_ok"))
    marks = pages.join(heads, ["book_id", "id", "line_no"], "full_outer")
    return marks.groupBy("book_id", "id").agg(
        F.collect_set(F.struct("line_no", F.coalesce("page_ok", F.lit(False)).alias("page_ok"), F.coalesce("head_ok", F.lit(False)).alias("head_ok"))).alias("marks")
    )


TOKENS = "book_id string, id string, what string, line_no int, line2 int, first int, token string, second string, mark string, words array<string>, lines array<int>"


def _marks_of(row: dict) -> dict[int, tuple[bool, bool]]:
    out: dict[int, tuple[bool, bool]] = {}
    for m in row["marks"] or ():
        old = out.get(m["line_no"], (False, False))
        out[m["line_no"]] = (old[0] or m["page_ok"], old[1] or m["head_ok"])
    return out


def _tokens(batch: pa.RecordBatch) -> dict:
    """One row a head line, a word over a line's end, a misread number; and one a segment with its words and their lines."""
    names = [p.split(" ")[0] for p in TOKENS.split(", ")]
    out: dict[str, list] = {n: [] for n in names}

    def add(row: dict, what: str, line: int | None = None, line2: int | None = None, first: int | None = None, token: str | None = None, second: str | None = None, mark: str | None = None, words: list | None = None, lines: list | None = None) -> None:
        values = (row["book_id"], row["id"], what, None if line is None else line + 1, None if line2 is None else line2 + 1, first, token, second, mark, words, lines)
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)

    for row in batch.to_pylist():
        lines = row["text"].split("\n")
        labels = label(lines, _marks_of(row))
        over = {i: (j, a, b, mark) for i, j, a, b, mark in divided(lines, labels)}
        skip_first = {j for j, *_ in over.values()}
        words: list[str] = []
        places: list[int] = []
        for i, line in enumerate(lines):
            if labels[i] == HEAD:
                add(row, "head", i)
                continue
            body = line.strip()
            if i in over:
                j, a, b, mark = over[i]
                body = line.lstrip()
                body = body[: len(body) - len(_END_MARK.search(body).group())]
                add(row, "over", i, j, len(a), (a + b).lower(), f"{a}-{b}".lower(), mark)
            if i in skip_first:
                body = body[len(_WORD.match(body).group().split("-")[0]) :]
            for token in _WORD.findall(body):
                if token.isalpha():
                    if len(token) > 1:
                        words.append(token.lower())
                        places.append(i + 1)
                    continue
                for part in {token, *token.split("-")}:
                    if not _LETTERS.search(part):
                        continue
                    if is_misread_number(part):
                        add(row, "number", i, token=part)
                    elif len(part) > 1 or "@" in part:
                        words.append(part.lower())
                        places.append(i + 1)
        add(row, "words", words=words, lines=places)
    kinds = {"line_no": pa.int32(), "line2": pa.int32(), "first": pa.int32(), "words": pa.list_(pa.string()), "lines": pa.list_(pa.int32())}
    return {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}


def line_defects(segments: DataFrame, books: DataFrame, ratio: int = MISREAD_RATIO) -> tuple[DataFrame, DataFrame]:
    """(defects, repairs).

    ``defects``: book_id, id, line_no, defect (``furniture``, ``hyphen``,
    ``misread``). ``repairs``: what is needed to rebuild the text of a segment.

    Needs ``book_id, id, ord, kind, text`` and ``book_id, title, source_format``;
    other columns are ignored. Null or one-line text, other kinds and books that
    aren't scanned give no row, empty tables none; a row delivered twice counts
    once. A word is compared with the vocabulary of all scanned text.
    """
    scanned = cut(scanned_segments(segments, books))
    marked = scanned.join(line_marks(scanned, segments, books), ["book_id", "id"], "left")
    tokens = cut(map_batches(marked, ["book_id", "id", "text", "marks"], _tokens, TOKENS))

    pairs = F.explode(F.arrays_zip(F.col("words").alias("token"), F.col("lines").alias("line_no"))).alias("w")
    words = tokens.where(F.col("what") == "words").select("book_id", "id", pairs).select("book_id", "id", "w.token", "w.line_no")
    plain = ~F.col("token").rlike("[0-9@]")
    keys = F.pandas_udf(lambda x: x.map(fold), StringType())
    # keys are made for the words of the vocabulary, not for every word of the text
    vocabulary = cut(words.groupBy("token").agg(F.count("*").alias("n"))).withColumn("key", keys("token"))
    best = vocabulary.where(plain).groupBy("key").agg(F.max(F.struct("n", "token")).alias("best")).select("key", F.col("best.n").alias("best_n"), F.col("best.token").alias("best_token"))
    best = cut(best)

    # a word over a line's end: one word divided, or a compound with its own hyphen
    over = tokens.where(F.col("what") == "over").withColumn("key", keys("token")).withColumn("second_key", keys("second"))
    as_one = best.select("key", F.col("best_n").alias("n_one"), F.col("best_token").alias("one"))
    as_two = best.select(F.col("key").alias("second_key"), F.col("best_n").alias("n_two"), F.col("best_token").alias("two"))
    over = over.join(as_one, "key", "left").join(as_two, "second_key", "left")
    one, two = F.coalesce("n_one", F.lit(0)), F.coalesce("n_two", F.lit(0))
    over = over.withColumn("divides", F.when((one == 0) & (two == 0), True).otherwise(one >= two))
    hyphens = over.where("divides").select("book_id", "id", "line_no", F.lit("hyphen").alias("defect"))

    times = lambda word: F.when(F.length(word) >= LONG_WORD, max(1, ratio // 3)).otherwise(ratio)
    common = F.col("best_n") >= times("token") * F.col("n")
    odd = ~plain
    misread_words = vocabulary.join(best, "key").where((F.col("token") != F.col("best_token")) & (odd | common)).select("token", F.col("best_token").alias("right"))
    in_line = words.join(misread_words, "token").select("book_id", "id", "line_no", "token", "right")
    # of a divided word the misread half tells the line
    halves = over.withColumn("right", F.when(F.col("divides"), F.col("one")).otherwise(F.col("two"))).withColumn("form", F.when(F.col("divides"), F.col("token")).otherwise(F.col("second")))
    seen = vocabulary.select(F.col("token").alias("form"), F.col("n").alias("n_form"))
    halves = halves.where(F.col("right").isNotNull() & (F.col("right") != F.col("form"))).join(seen, "form", "left")
    best_n = F.when(F.col("divides"), F.col("n_one")).otherwise(F.col("n_two"))
    halves = halves.where(F.col("form").rlike("[0-9@]") | (best_n >= times("form") * (F.coalesce("n_form", F.lit(0)) + 1)))
    same = F.length(F.regexp_extract(F.concat_ws("\n", F.rpad("form", 40, " "), F.rpad("right", 40, " ")), r"^(.*).*\n\1", 1))
    halves = halves.withColumn("at", F.when(same < F.col("first"), F.col("line_no")).otherwise(F.col("line2")))
    numbers = tokens.where(F.col("what") == "number")
    misread = (
        in_line.select("book_id", "id", "line_no")
        .unionByName(halves.select("book_id", "id", F.col("at").alias("line_no")))
        .unionByName(numbers.select("book_id", "id", "line_no"))
        .distinct()
        .withColumn("defect", F.lit("misread"))
    )
    furniture = tokens.where(F.col("what") == "head").select("book_id", "id", "line_no", F.lit("furniture").alias("defect"))
    defects = furniture.unionByName(hyphens).unionByName(misread).distinct()

    fixes = in_line.select("book_id", "id", F.struct("line_no", "token", F.col("right").alias("to")).alias("fix")).unionByName(
        halves.select("book_id", "id", F.struct("line_no", F.col("form").alias("token"), F.col("right").alias("to")).alias("fix"))
    )
    keeps = over.where(~F.col("divides")).select("book_id", "id", F.struct("line_no", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("to")).alias("fix"))
    by_segment = fixes.unionByName(keeps).groupBy("book_id", "id").agg(F.collect_set("fix").alias("fixes"))
    return defects, marked.join(by_segment, ["book_id", "id"], "left")


REPAIRED = "book_id string, id string, text string, n_head_lines int, n_joined int, n_corrected int"


def rebuild(lines: list[str], labels: list[int], keep: set[int], fixes: dict[tuple[int, str], str]) -> tuple[str, int, int]:
    """The segment's paragraphs; (text, words joined, words corrected)."""
    joined = corrected = 0
    over = {i: (j, a, b) for i, j, a, b, _ in divided(lines, labels)}
    out = ""
    glue = ""

    def correct(line: int, text: str) -> str:
        nonlocal corrected

        def one(m: re.Match) -> str:
            nonlocal corrected
            to = fixes.get((line, m.group().lower()))
            if to is None:
                return m.group().translate(_DIGIT_FOR) if is_misread_number(m.group()) else m.group()
            corrected += 1
            return to.capitalize() if m.group()[:1].isupper() else to

        return re.sub(r"[\w@]+", one, text)

    carry: tuple[int, str] | None = None  # line and first half of a divided word
    for i, line in enumerate(lines):
        if labels[i] == HEAD:
            continue
        text = line.strip()
        if carry is not None:
            first_line, half = carry
            second = _WORD.match(text).group().split("-")[0]
            text = text[len(second) :]
            whole = half + second if first_line not in keep else f"{half}-{second}"
            at = next((n for n in (first_line, i) if (n, whole.lower()) in fixes), None)
            if at is not None:
                to = fixes[at, whole.lower()]
                whole = to.capitalize() if whole[:1].isupper() else to
                corrected += 1
            out += whole
            joined += first_line not in keep
            carry = None
            glue = ""
        if i in over:
            m = _END_MARK.search(line)
            head = text[: len(text) - len(m.group().rstrip())]
            out += glue + correct(i, head)
            glue = ""
            carry = (i, over[i][1])
            continue
        out += glue + correct(i, text)
        glue = "\n" if labels[i] == BREAK else " "
    if carry is not None:
        out += carry[1]
    return out, joined, corrected


def repair_scanned(segments: DataFrame, books: DataFrame, ratio: int = MISREAD_RATIO) -> DataFrame:
    """Every scanned segment as continuous paragraphs."""
    _, work = line_defects(segments, books, ratio)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("book_id", "id", "text", "n_head_lines", "n_joined", "n_corrected")}
        for row in batch.to_pylist():
            lines = row["text"].split("\n")
            labels = label(lines, _marks_of(row))
            keep = {f["line_no"] - 1 for f in row["fixes"] or () if f["token"] is None}
            fixes = {(f["line_no"] - 1, f["token"]): f["to"] for f in row["fixes"] or () if f["token"] is not None}
            text, joined, corrected = rebuild(lines, labels, keep, fixes)
            for column, value in zip(out.values(), (row["book_id"], row["id"], text, labels.count(HEAD), joined, corrected), strict=True):
                column.append(value)
        return {k: pa.array(v, pa.int32() if k.startswith("n_") else pa.string()) for k, v in out.items()}

    return map_batches(work, ["book_id", "id", "text", "marks", "fixes"], run, REPAIRED)
