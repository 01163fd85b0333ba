"""Problem 2: text decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding; an automaton over
byte classes finds the maximal well-formed multibyte spans and only those are
decoded again. Text that went from one legacy encoding to another has no UTF-8
structure: there the bytes are read as the other encoding's two-byte or
one-byte letters and kept only where the result reads as text and the source
does not. A replacement character is damage that can't be undone.

A batch is screened with table gathers; only rows that a screen marks are
taken one by one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.arrow import code_points, map_batches, row_counts

TOP = 0x110000
#: Encodings that UTF-8 bytes may have been read with, one byte a character.
CYRILLIC_LETTERS = ("cp1251", "koi8_r", "cp866")
SINGLE = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "cp1250", "cp1253", "iso8859_15")
#: Classes of bytes in the automaton: three of continuation bytes, and leads by what may follow them first.
CONT_LOW, CONT_MID, CONT_HIGH, LEAD2, LEAD3, LEAD3_HIGH, LEAD3_LOW, LEAD4, LEAD4_HIGH, LEAD4_LOW = range(1, 11)
#: Lead -> length of its sequence, least and greatest class of the next byte: no overlong forms, surrogates or values beyond Unicode.
STEPS = {
    LEAD2: (2, CONT_LOW, CONT_HIGH), LEAD3: (3, CONT_LOW, CONT_HIGH), LEAD3_HIGH: (3, CONT_HIGH, CONT_HIGH), LEAD3_LOW: (3, CONT_LOW, CONT_MID),
    LEAD4: (4, CONT_LOW, CONT_HIGH), LEAD4_HIGH: (4, CONT_MID, CONT_HIGH), LEAD4_LOW: (4, CONT_LOW, CONT_LOW),
}


@lru_cache(None)
def byte_of(codec: str) -> np.ndarray:
    """Code point -> byte, or 256. Bytes that the codec leaves out are the C1 controls."""
    table = np.full(TOP, 256, np.uint16)
    table[:128] = np.arange(128)
    for b in range(128, 256):
        c = bytes([b]).decode(codec, "ignore")
        if c:
            table[ord(c)] = b
    for b in range(128, 160):
        if table[b] == 256 and codec in ("cp1252", "cp1251", "cp1250", "cp1253", "iso8859_15"):
            table[b] = b
    return table


@lru_cache(1)
def byte_classes() -> np.ndarray:
    """Byte -> its class in the automaton; 256 stands for no byte."""
    classes = np.zeros(257, np.uint8)
    for low, high, c in (
        (0x80, 0x90, CONT_LOW), (0x90, 0xA0, CONT_MID), (0xA0, 0xC0, CONT_HIGH), (0xC2, 0xE0, LEAD2), (0xE0, 0xE1, LEAD3_HIGH), (0xE1, 0xF0, LEAD3), (0xED, 0xEE, LEAD3_LOW),
        (0xF0, 0xF1, LEAD4_HIGH), (0xF1, 0xF4, LEAD4), (0xF4, 0xF5, LEAD4_LOW),
    ):
        classes[low:high] = c
    return classes


@lru_cache(None)
def class_of(codec: str) -> np.ndarray:
    """Code point -> class of its byte in the automaton."""
    return byte_classes()[byte_of(codec)]


def sequences(classes: np.ndarray) -> np.ndarray:
    """Length of the well-formed sequence that starts at each place, 0 where none does."""
    n = len(classes)
    out = np.zeros(n, np.uint8)
    leads = np.flatnonzero(classes >= LEAD2)
    if not len(leads):
        return out
    room = np.zeros(n + 3, np.uint8)
    room[:n] = classes
    lead, second = classes[leads], room[leads + 1]
    third, fourth = room[leads + 2], room[leads + 3]
    third, fourth = (third > 0) & (third <= CONT_HIGH), (fourth > 0) & (fourth <= CONT_HIGH)
    length, least, most = (np.zeros(LEAD4_LOW + 1, np.uint8) for _ in range(3))
    for c, step in STEPS.items():
        length[c], least[c], most[c] = step
    size = length[lead]
    good = (second >= least[lead]) & (second <= most[lead]) & ((size < 3) | third) & ((size < 4) | fourth)
    out[leads[good]] = size[good]
    return out


@lru_cache(1)
def common_han() -> np.ndarray:
    """The ideographs of level 1 of GB 2312, ordered there by use."""
    table = np.zeros(TOP, bool)
    for lead in range(0xB0, 0xD8):
        for trail in range(0xA1, 0xFF):
            c = bytes([lead, trail]).decode("gb2312", "ignore")
            if c:
                table[ord(c)] = True
    return table


_HAN = re.compile("[㐀-鿿]")
_PLAUSIBLE = re.compile("[\u0080-\u017f\u0192\u02c6\u02dc\u0300-\u036f\u0386-\u03ce\u0400-\u045f\u0490\u0491\u2010-\u2044\u20ac\u2100-\u22ff\u3000-\u30ff\u4e00-\u9fff\ufb01\ufb02\uff01-\uff5e\ufffd\U0001f000-\U0001faff]*")
_VOWELS = frozenset("аеёиоуыэюя")
_FREQUENT = frozenset("оеаинтсрвлкмдпуяыьгзбчй")


def _han_share(text: str) -> float:
    han = _HAN.findall(text)
    table = common_han()
    return sum(bool(table[ord(c)]) for c in han) / len(han) if han else 0.0


def decode_spans(text: str, codec: str) -> tuple[str, int]:
    """Decode the maximal well-formed spans of ``text`` read back as ``codec``; (text, characters decoded)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = sequences(class_of(codec)[points])
    starts = np.flatnonzero(length)
    if not len(starts):
        return text, 0
    data = byte_of(codec)[points]
    found: list[tuple[int, int, str]] = []
    doubtful: list[tuple[int, int, str]] = []
    i = 0
    while i < len(starts):
        a = b = int(starts[i])
        while b < len(text) and length[b]:
            b += int(length[b])
        while i < len(starts) and starts[i] < b:
            i += 1
        new = data[a:b].astype(np.uint8).tobytes().decode("utf-8")
        left, right = a, b
        while left and points[left - 1] >= 0x80:
            left -= 1
        while right < len(points) and points[right] >= 0x80:
            right += 1
        if (b - a) < 0.6 * (right - left) and sum(int(x) for x in length[left:right]) < 0.6 * (right - left):
            continue
        if len(new) == 1 and a and text[a - 1].isalpha() and ord(text[a - 1]) >= 0x80 and a == left + 1:
            continue
        (found if _plausible(new, text[a:b], codec, a == left and b == right) and _reads(text, a, b, new, codec) else doubtful).append((a, b, new))
    # short spans of a script that longer ones of this text are in
    sure = {x for _, _, new in found for c in new if (x := _script(c)) and (x not in ("LATIN", "CYRILLIC", "GREEK", "HAN") or "\u1e00" <= c <= "\u1eff")}
    if sure:
        found = sorted(found + [x for x in doubtful if {_script(c) for c in x[2]} - {""} <= sure])
    out, done = [], 0
    for a, b, new in found:
        out.append(text[done:a] + new)
        done = b
    return "".join(out) + text[done:], sum(b - a for a, b, _ in found)


@lru_cache(1 << 12)
def _script(c: str) -> str:
    """The script of a letter by its name; empty for marks, digits and signs, ``?`` for what is no character of text."""
    category = unicodedata.category(c)
    if category in ("Cn", "Co", "Cs", "Cc"):
        return "?"
    name = unicodedata.name(c, "")
    return "" if category[0] != "L" else "HAN" if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "FULLWIDTH", "HALFWIDTH", "KATAKANA-HIRAGANA")) else name.split(" ")[0].split("-")[0]


def _plausible(new: str, old: str, codec: str, whole: bool) -> bool:
    """Whether what well-formed bytes give is text: usual signs, or any script where the span is too long for chance and a ``whole`` run outside ASCII."""
    if _PLAUSIBLE.fullmatch(new):
        return True
    if not whole:
        return False
    scripts = {_script(c) for c in new}
    if "?" in scripts or len(scripts - {"", "LATIN"}) > 1:
        return False
    if codec in CYRILLIC_LETTERS and scripts != {"LATIN"}:
        # bytes of usual Russian letters may be well-formed by chance
        return len(new) >= 4 or len(new) == 3 and bool(re.search("[^\u0410-\u044f]", old))
    return len(new) >= 3 or len(old) >= 3 * len(new)


def _reads(text: str, a: int, b: int, new: str, codec: str) -> bool:
    """Whether a span of few characters is more than a chance neighbourhood."""
    old = text[a:b]
    if len(new) > 2:
        return True
    before, after = text[a - 1 : a], text[b : b + 1]
    if codec in ("cp1252", "cp1250", "iso8859_15", "cp1253"):
        if len(new) == 1 and len(old) == 2 and old[0] not in "ÂÃÄÅÐÑÎÏ":
            return False
        # a word in capitals before a closing quote or a dash is text as it should be
        return not (len(old) == 2 and old[1] in "’”»“‘–—…" and before.isupper())
    if codec in ("cp1251", "koi8_r", "cp866"):
        return not ("а" <= before.lower() <= "я" or "а" <= after.lower() <= "я" and not ("Ѐ" <= new[0] <= "ӿ"))
    return True


def _decode_gbk(text: str) -> tuple[str, int]:
    """UTF-8 that was read as GBK: two bytes a character, the last of which may be plain."""
    out, spans = [], 0
    cyrillic = False  # whether a longer span of the text was Cyrillic
    latin = sum(c.isascii() and c.isalpha() for c in text) > len(_HAN.findall(text))
    for m in sorted(re.finditer(r"[^\x00-\x7f�]+", text), key=lambda m: m.start() - m.end()):
        if not _HAN.search(m.group()):
            continue
        try:
            raw = m.group().encode("gbk")
        except UnicodeEncodeError:
            raw = m.group().encode("gb18030", "ignore")
        data = np.frombuffer(raw, np.uint8)
        length = sequences(byte_classes()[data])
        high = int((data >= 0x80).sum())
        covered = int(length.sum())
        if not covered or covered < 0.75 * high:
            continue
        new = raw.decode("utf-8", "replace")
        inner = "".join(c for c in new if ord(c) >= 0x80 and c != "�")
        if not inner or not _PLAUSIBLE.fullmatch(inner):
            continue
        han = len(_HAN.findall(inner))
        if han:
            good = _han_share(inner) >= 0.7 and (han > 1 or latin) and _han_share(m.group()) < 0.9
        else:
            good = covered == high and (latin or cyrillic or len(inner) >= 3)
            if len(inner) == 1 and inner.isalpha() and text[m.end() : m.end() + 1].isdigit():
                good = False  # a letter stands in or for a word, not before a number
            cyrillic |= good and "а" <= inner[0].lower() <= "я"
        if good:
            out.append((m.start(), m.end(), new))
            spans += 1
    for start, end, new in sorted(out, reverse=True):
        text = text[:start] + new + text[end:]
    return text, spans


_HIGH = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+")
_SENTENCE = re.compile(r"[^。！？\n]*[。！？\n]?")


def _decode_legacy(text: str) -> tuple[str, int]:
    """One legacy encoding read as another."""
    spans = 0
    table = byte_of("cp1252")
    # GBK or a Cyrillic encoding read as Latin
    runs = [m for m in _HIGH.finditer(text)]
    if any(len(m.group()) >= 4 for m in runs):
        as_han, as_cyrillic = [], []
        for m in runs:
            raw = bytes(int(table[ord(c)]) for c in m.group() if table[ord(c)] < 256)
            as_han.append(raw.decode("gb18030", "ignore"))
            as_cyrillic.append(raw.decode("cp1251", "ignore"))
        long_enough = [i for i, m in enumerate(runs) if len(m.group()) >= 4]
        han = "".join(as_han[i] for i in long_enough)
        cyrillic = "".join(as_cyrillic[i] for i in long_enough).lower()
        found = _HAN.findall(han)
        if len(found) >= 2 and _han_share(han) >= 0.8 and len(found) >= 0.6 * len(han):
            choice = as_han
        elif sum(c in _FREQUENT for c in cyrillic) >= 0.85 * len(cyrillic) and sum(c in _VOWELS for c in cyrillic) >= 0.25 * len(cyrillic):
            choice = as_cyrillic
        else:
            choice = None
        if choice:
            out, done = [], 0
            for m, new in zip(runs, choice, strict=True):
                if all(ord(c) < 0x2000 for c in m.group()):
                    out.append(text[done : m.start()] + new)
                    done = m.end()
                    spans += 1
            text = "".join(out) + text[done:]
    # one Cyrillic encoding read as another: the letters are rare ones, or the case is turned round
    if _CYRILLIC.search(text):
        def cyrillic(m: re.Match) -> str:
            nonlocal spans
            part = m.group()
            now = _russian(part)
            if now >= READS_WELL:
                return part
            least, best = max(READS_WELL, now + 0.15), part
            high = sum(c >= "\x80" for c in part)
            for source, target in CYRILLIC_PAIRS:
                new = _swapped(part, source, target)
                if new and len(_RU_LETTER.findall(new)) >= 0.85 * high and _russian(new) > least:
                    least, best = _russian(new), new
            spans += best != part
            return best

        text = _CLAUSE.sub(cyrillic, text)
    # GBK read as Big5
    if _HAN.search(text) and _han_share(text) < 0.97:
        def chinese(m: re.Match) -> str:
            nonlocal spans
            part = m.group()
            if len(_HAN.findall(part)) < 3 or _han_share(part) >= 0.75:
                return part
            new = "".join(_big5(c) for c in part)
            if _han_share(new) >= 0.8 and len(_HAN.findall(new)) >= 0.6 * len(_HAN.findall(part)):
                spans += 1
                return new
            return part

        text = _SENTENCE.sub(chinese, text)
    # Latin text of one platform read on another, a sentence at a time
    if _ODD_LATIN.search(text) or _CENTRAL.search(text):
        def latin(m: re.Match) -> str:
            nonlocal spans
            part = m.group()
            pairs = LATIN_PAIRS if _ODD_LATIN.search(part) else CENTRAL_PAIRS if _CENTRAL.search(part) and len(_WESTERN.findall(part)) >= 2 else ()
            for source, target in pairs:
                new = "".join(_swap(c, source, target) for c in part)
                if new != part and not _ODD_LATIN.search(new) and not _CENTRAL.search(new) and all(_fits(new, i) for i, c in enumerate(new) if c != part[i]):
                    spans += 1
                    return new
            return part

        text = re.sub(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|[.!?](?=\S)[^.!?\n]*)*[.!?]*", latin, text)
    return text, spans


#: Encodings of Cyrillic and of Latin text: what the bytes were, what they were read as.
CYRILLIC_PAIRS = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"))
LATIN_PAIRS = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"))
CENTRAL_PAIRS = (("iso8859_2", "latin-1"), ("cp1250", "cp1252"), ("cp1257", "cp1252"), ("cp1254", "cp1252"))

_CYRILLIC = re.compile("[\u0400-\u045f]")
_CLAUSE = re.compile(r"[^.!?\n]*[\u0400-\u045f][^.!?\n]*[.!?]?")
#: Letters of Central European encodings that stand where Western ones have other letters.
_CENTRAL = re.compile("[\u0143\u0144\u0154\u0155\u010c\u010d\u0118\u0119\u0170\u0171\u016e\u016f\u010e\u010f\u0158\u0159\u0147\u0148\u0150\u0151\u0102\u0103\u0110\u0111\u0162\u0163\u02c7\u017b\u017c\u0112\u0113\u0116\u0117\u0122\u0123]")
# Small words of languages that are not written with those letters.
_WESTERN = re.compile(r"(?i)\b(?:la|le|les|des|du|de|el|los|las|una|un|que|por|para|pour|dans|del|con|en|et|sur|der|die|das|und|the|of|and)\b")


_RU_LETTER = re.compile("[\u0410-\u044f\u0401\u0451]")
_RU_USUAL = re.compile("[\u043e\u0435\u0430\u0438\u043d\u0442\u0441\u0440\u0432\u043b\u041e\u0415\u0410\u0418\u041d\u0422\u0421\u0420\u0412\u041b]")
_RU_CASED = re.compile("(?<![\u0400-\u045f])[\u0410-\u042f\u0401]?[\u0430-\u044f\u0451]+(?![\u0400-\u045f])|(?<![\u0400-\u045f])[\u0410-\u042f](?![\u0400-\u045f])")
_RU_OTHER = re.compile("[^\u0000-\u007f\u0410-\u044f\u0401\u0451\u2014\u2013\u00ab\u00bb\u2026\u201e\u201c\u201d\u2019\u2018\u2116]")
#: Text that reads as Russian by so much is left alone.
READS_WELL = 0.5


def _russian(text: str) -> float:
    """How much a text reads as Russian: its usual letters, in words of usual case, and nothing else outside ASCII."""
    letters = len(_RU_LETTER.findall(text))
    if not letters:
        return 0.0
    cased = sum(map(len, _RU_CASED.findall(text)))
    return len(_RU_USUAL.findall(text)) / letters * cased / letters * letters / (letters + len(_RU_OTHER.findall(text)))


def _swapped(text: str, source: str, target: str) -> str | None:
    try:
        return text.encode(source).decode(target)
    except UnicodeError:
        return None


def _big5(c: str) -> str:
    if ord(c) < 0x80:
        return c
    try:
        return c.encode("cp950").decode("gbk")
    except UnicodeError:
        return "�" if c == "�" else c


def _swap(c: str, source: str, target: str) -> str:
    if ord(c) < 0x80:
        return c
    try:
        return c.encode(source).decode(target)
    except UnicodeError:
        return c


def _fits(text: str, i: int) -> bool:
    """Whether a changed character stands where text would have it."""
    c = text[i]
    if c.islower():
        return True
    if c.isupper():
        return not text[i - 1 : i].isalpha() if i else True
    between = i and text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha()
    return c in "’" or not between and c in "“”‘–—…«»¡¿£€°§©®™•„‚ºª×÷±½¼¾²³¹·´¨¸\u00a0"


#: A capital with an accent, or a sign, inside a word of small letters.
_ODD_LATIN = re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-ÞŠŒŽŸ¢£¤¥§©®°±²³µ¶¸¹º»¼½¾¿¡¨¬¯´≈∞≤≥∂∑∏π∫Ωƒ√◊˘˙˚˝˛ˇˆ˜ı‚„‰‡†•‹›⁄€∆](?=[a-zß-öø-ÿ])|(?<=[A-Z])[¸‰ˆ‡·‚„˘˙˚¯√≈∞≤≥∂∑∏∫](?=[a-z])|(?<=[a-z])[ÁÈÉÒÙ](?=[\\W_])(?<=[a-z].)")


def repair(text: str) -> tuple[str, bool]:
    """(restored text, whether any of it had been decoded wrongly)."""
    if _CYRILLIC.search(text) and not _RU_OTHER.search(text) and all(_russian(m.group()) >= READS_WELL for m in _CLAUSE.finditer(text)):
        return text, False
    before = text
    damaged = "�" in text or any("\x80" <= c <= "\x9f" and c != "\x85" for c in text)
    seen = set()
    while text not in seen:
        seen.add(text)
        best, spans = text, 0
        for codec in SINGLE:
            new, n = decode_spans(text, codec)
            if n > spans:
                best, spans = new, n
        if not spans:
            best, spans = _decode_gbk(text)
        if not spans:
            best, spans = _decode_legacy(text)
        if not spans:
            break
        text = best
    return text, damaged or text != before


@lru_cache(1)
def _screens() -> dict[str, np.ndarray]:
    kinds = np.zeros(TOP, np.uint8)
    kinds[0x430:0x460] = 1  # small Cyrillic
    kinds[0x400:0x430] = 2
    latin = np.zeros(TOP, bool)
    latin[0x41:0x5B] = latin[0x61:0x7B] = True
    han = np.zeros(TOP, bool)
    han[0x3400:0xA000] = True
    han[0xE000:0xF900] = True
    broken = np.zeros(TOP, bool)
    broken[0xFFFD] = True
    broken[0x80:0xA0] = True
    high = np.zeros(TOP, bool)
    high[0xA0:0x100] = True
    small = np.zeros(TOP, bool)
    small[0x61:0x7B] = True
    after = small.copy()
    after[0xDF:0x100] = True
    odd, capital = np.zeros(TOP, bool), np.zeros(TOP, bool)
    for c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŠŒŽŸ¢£¤¥§©®°±²³µ¶¸¹º»¼½¾¿¡¨¬¯´≈∞≤≥∂∑∏π∫Ωƒ√◊˘˙˚˝˛ˇˆ˜ı‚„‰‡†•‹›⁄€∆":
        (capital if c.isupper() else odd)[ord(c)] = True
    boxes = np.zeros(TOP, bool)
    boxes[0x2500:0x2600] = True
    boxes[[0x221A, 0x2219, 0x2116]] = True
    central = np.zeros(TOP, bool)
    for p in range(0x80, 0x300):
        central[p] = bool(_CENTRAL.match(chr(p)))
    return {"boxes": boxes, "central": central, "kinds": kinds, "latin": latin, "han": han, "broken": broken, "rare": han & ~common_han(), "high": high, "small": small, "after": after, "odd": odd, "capital": capital}


def screen(array: pa.Array) -> np.ndarray:
    """Rows that may hold wrongly decoded text."""
    points, offsets = code_points(array)
    n = len(points)
    s = _screens()
    flags = s["broken"][points]
    if n > 1:
        for codec in SINGLE:
            flags |= sequences(class_of(codec)[points]) > 0
        kinds = s["kinds"][points]
        flags[1:] |= (kinds[1:] == 2) & (kinds[:-1] == 1)
        han, latin = s["han"][points], s["latin"][points]
        flags |= s["rare"][points]
        flags[1:] |= (han[1:] & latin[:-1]) | (latin[1:] & han[:-1])
        high = s["high"][points]
        if n > 3:
            flags[3:] |= high[3:] & high[2:-1] & high[1:-2] & high[:-3]
        ends = s["after"][points[2:]]
        flags[1:-1] |= (s["odd"][points[1:-1]] & latin[:-2] | s["capital"][points[1:-1]] & s["small"][points[:-2]]) & ends
        flags[1:] |= s["capital"][points[1:]] & s["small"][points[:-1]] & ~np.append(latin[2:], False)
        flags |= s["central"][points]
    marked = row_counts(flags, offsets) > 0
    if n:
        capitals, small_ones = row_counts(s["kinds"][points] == 2, offsets), row_counts(s["kinds"][points] == 1, offsets)
        marked |= (capitals >= 6) & (capitals > 0.3 * small_ones)
        marked |= (capitals + small_ones > 0) & (row_counts(s["boxes"][points], offsets) > 0)
    # ideographs among more Latin letters
    if n:
        h = row_counts(s["han"][points], offsets)
        marked |= (h > 0) & (h < row_counts(s["latin"][points], offsets))
    return marked


REPAIRED = "book_id string, id string, text string, title string, affected boolean, title_affected boolean, restored boolean"


def repair_segments(segments: DataFrame, only_affected: bool = False) -> DataFrame:
    """Restore ``text`` and ``title`` of segments decoded with the wrong encoding.

    Needs ``book_id, id, text, title``; other columns are ignored. ``affected``
    is about ``text``, ``title_affected`` about ``title``; ``restored`` says
    whether the text differs now and holds no replacement character. Null stays
    null and is no case; empty text and plain ASCII are no cases. With
    ``only_affected`` rows of which neither is affected are left out, and plain
    ones never leave the JVM. A row delivered twice gives equal rows. There is
    no shuffle.
    """
    rows = segments.select(F.col("book_id").cast("string"), F.col("id").cast("string"), F.col("text").cast("string"), F.col("title").cast("string"))
    if only_affected:
        wide = [F.coalesce(F.octet_length(c) > F.char_length(c), F.lit(False)) for c in ("text", "title")]
        rows = rows.where(wide[0] | wide[1])

    def run(batch: pa.RecordBatch) -> dict:
        text, affected = repair_array(batch.column("text"))
        title, title_affected = repair_array(batch.column("title"))
        columns = {"book_id": batch.column("book_id"), "id": batch.column("id"), "text": text, "title": title, "affected": pa.array(affected), "title_affected": pa.array(title_affected), "restored": _differs(text, batch.column("text"))}
        keep = pa.array(affected | title_affected)
        return {k: v.filter(keep) for k, v in columns.items()} if only_affected else columns

    return map_batches(rows, ["book_id", "id", "text", "title"], run, REPAIRED)


def _differs(new: pa.Array, old: pa.Array) -> pa.Array:
    changed = pc.fill_null(pc.not_equal(new, old), False)
    return pc.and_(changed, pc.invert(pc.fill_null(pc.match_substring(new, "�"), False)))


def repair_array(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Repair the marked rows of an array; (texts, which rows were affected)."""
    affected = np.zeros(len(array), bool)
    marked = np.flatnonzero(screen(array))
    if not len(marked):
        return array, affected
    new: dict[int, str] = {}
    for i, text in zip(marked, array.take(pa.array(marked)).to_pylist(), strict=True):
        if text:
            fixed, affected[i] = repair(text)
            if fixed != text:
                new[int(i)] = fixed
    if not new:
        return array, affected
    mask = np.zeros(len(array), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(array, pa.array(mask), pa.array([new[i] for i in sorted(new)], array.type)), affected
