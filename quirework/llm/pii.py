"""Problem 9: personal information in free text, replaced by typed placeholders.

Recognisers find mentions; each is replaced by ``[KIND:pseudonym]``, where the
pseudonym is a keyed permutation of the mention within its own format, made by
a balanced Feistel network over the alphabet of every stretch. Equal values get
equal pseudonyms in all documents and the key's owner can turn them back.
Separators and country codes stay; dates in identity numbers stay dates, and a
check digit that was right is made right again.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.arrow import map_batches

# Common given names of many countries. The corpus's own are learnt, see ``learnt_names``.
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Laura Rebecca Helen Anna Emma Julia Alice Jane Katherine "
    "Hans Karl Heinrich Wolfgang Jürgen Klaus Günther Stefan Andreas Ursula Ingrid Sabine Monika Claudia Jean Pierre François Jacques Philippe Nicolas Isabelle Sophie Camille "
    "José Juan Carlos Luis Miguel Antonio Francisco Manuel Pedro María Carmen Ana Lucía Giovanni Giuseppe Marco Paolo Giulia Francesca João Paulo Ivan Dmitri Sergei Olga Natalia Tatiana Svetlana "
    "Wei Ming Hiroshi Kenji Yuki Haruto Sakura Min-jun Ji-woo Mohammed Muhammad Ahmed Ali Omar Hassan Fatima Aisha Layla Yusuf Ibrahim Raj Amit Sanjay Priya Anjali Deepak Sunita Kofi Amara Chidi "
    "Lars Erik Anders Björn Astrid Ingeborg Sven Piotr Krzysztof Agnieszka Katarzyna Dimitris Eleni Mehmet Ayşe Nguyen Thanh"
).split()
#: A name learnt from addresses or titles alone needs so many different surnames; more names than these aren't sent out whole, but joined.
LEAST_SURNAMES, MOST_NAMES = 3, 20_000


class Mention(NamedTuple):
    start: int
    end: int
    kind: str


# --- recognisers ----------------------------------------------------------------

_EMAIL_BEFORE = re.compile(r"[A-Za-z0-9](?:[\w+-]|\.(?=[\w+-]))*$", re.A)
_EMAIL_AFTER = re.compile(r"[A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z][A-Za-z0-9-]*)+", re.A)
_DOT = r"(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)"
_EMAIL_SPOKEN = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9][\w+-]*(?:{_DOT}[\w+-]+){{0,3}}(?: ?\[at\] ?| ?\(at\) ?| at (?=[\w-]+ dot ))[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+", re.A | re.I
)
_TOP = re.compile(r"[a-z]{2,}$", re.I)

#: A stretch of digits with separators, as wide as it goes.
_DIGITS = re.compile(r"\d(?:\d|[./-](?=\d)|[ ](?=\d)| ?\(0\) ?(?=\d)|[)）] ?(?=\d))*(?:(?<=\d{17})[xX])?", re.A)
_PHONES = re.compile(
    r"\+\d{1,3}[ ]?(?:\(0\)[ ]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}|00\d{2}[ ]\d{2,4}(?:[ ]?\d{3,9})+|[(（]\d{3,4}[)）][ ]?\d{3,4}[- ]?\d{4}|0\d{1,4}[ /]\d{3,8}(?:[- ]\d{1,5})?|0\d(?: \d\d){4}"
    r"|\d{3}-\d{4}-\d{3,4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|1[3-9]\d{9}|0\d{2} \d{4} \d{4}",
    re.A,
)
_IDS = re.compile(r"\d{3}([ -])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{17}[\dXx]", re.A)
_LETTER_IDS = re.compile(r"[A-Z0-9](?:(?<=[A-Z])(?:[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8})|(?<=\d)\d{7}-?[A-HJ-NP-TV-Z])(?![A-Za-z0-9-])", re.A)

#: Numbers whose check digits must be right: payment cards and international account numbers.
_CARD = re.compile(r"(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6011|65\d\d)(?:([ -]?)\d{4})(?:\1\d{4}){2}|3[47]\d\d([ -]?)\d{6}\2\d{5}", re.A)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)

_STREET = "Rd|Road|St|Street|Lane|Ln|Ave|Avenue|Terrace|Close|Drive|Court|Crescent|Square|Row|Walk|Way|Hill|Place"
#: From the house number on; a flat before it is looked for behind.
_ADDRESS_EN = re.compile(
    rf"\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’]+ ){{1,4}}(?:{_STREET})\b\.?(?: (?:[NS][EW]?|[EW])\b\.?)?"
    r"(?:,\s+[A-Z][\w'’]+(?: [A-Z][a-z'’]+)?(?:,? [A-Z]{2}(?= \d{5}))?(?:[ ,]+(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|\d{5}(?:-\d{4})?\b))?)?"
)
_FLAT_END = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \d{1,4}[A-Za-z]?,\s*$")
#: From the end of the street's name on; its beginning is looked for behind.
_ADDRESS_DE = re.compile(r"(?:str\.|stra(?:ß|ss)e|allee|gasse|weg|platz|ufer|damm|ring)\s+\d{1,4} ?[a-z]?\b(?:,\s+\d{5} [A-ZÄÖÜ][\w-]+)?")
_STREET_DE_BEGIN = re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß-]*$")
_FR = "rue|quai|impasse|avenue|boulevard|place|allée|chemin|cours"
_FR_HINT = re.compile(rf"[\drs],? (?:{_FR}) ")
_ADDRESS_FR = re.compile(rf"\b\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{_FR}) [^,;.\n]{{3,60}}?(?:,\s+\d{{5}} [A-ZÀ-Þ][\w-]+|(?=[,;.\n]|$))")
_ADDRESS_ZH = re.compile(r"(?:[一-鿿]{2,6}?(?:省|自治区))?(?:(?<=[到在至往址：:，。])|(?<![一-鿿]))[一-鿿]{2,6}?(?:市|县)(?:[一-鿿]{1,6}?区)?[一-鿿]{1,8}?(?:路|街|巷|大道|胡同|弄)\d+号(?:\d+(?:栋|幢|号楼))?(?:\d+单元)?(?:\d+室)?")

_SURNAME = r"[A-ZÀ-Þ][\w’']+(?:-[A-ZÀ-Þ][\w’']+)?"
_AFTER_GIVEN = re.compile(rf"(?: [A-Z]\.)?[ \n]({_SURNAME})")
_BEFORE_GIVEN = re.compile(rf"(?<![\w.@-])({_SURNAME}),[ \n]$")
_MIDDLE = re.compile(r" [A-Z]\.(?=\W|$)")
_INITIAL = re.compile(rf"[A-Z]\.(?: ?[A-Z]\.)?[ \n]?({_SURNAME})")
_ANY_INITIAL = re.compile(r"[A-Z]\.[ \n]?(?=[A-ZÀ-Þ])")
# Titles, labels and closing words that a person's whole name follows.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Signor|Signora"
LABELS = "Full name|Name|Signed|Signed by|Contact|Attn|Translator|Author|Nombre|Contacto|Nom|Kontakt|Ansprechpartner|Ansprechpartnerin"
CLOSINGS = "regards|wishes|sincerely|faithfully|truly|Grüßen|Gruß|Grüße|cordialement|salutations|saludo|saludos|atentamente|saluti"
#: What stands before a whole name where no list is needed to know it.
CUES = rf"(?<![\w.-])(?:{TITLES})\b\.? +(?:Dr\.? |Prof\.? )?|(?<!\w)(?:{LABELS}): *|(?<!\w)(?i:{CLOSINGS}),?[ \t]*\n"
_CUE_END = re.compile(rf"(?:{CUES})$")
_PAIR = re.compile(r"[A-ZÀ-ÞĀ-Ž](?=[a-zß-ÿā-ž]{2,}(?: [A-Z]\.)? [A-ZÀ-ÞĀ-Ž])")
_MID_SENTENCE = re.compile(r"[a-zß-ÿ,;:)] $")
#: No cue is longer.
_CUE_CHARS = 40
_WHOLE_NAME = re.compile(rf"([A-ZÀ-Þ]\w+(?:-[A-ZÀ-Þ]\w+)?)(?: [A-Z]\.)? ({_SURNAME})")
_NAME_RU = re.compile(r"[А-ЯЁ](?:[а-яё]+|\.) (?:[А-ЯЁ]\. ?)?[А-ЯЁ][а-яё]{2,}(?:-[А-ЯЁ][а-яё]+)?(?![а-яё])")
_NAME_ZH = re.compile(r"(?:联系人?|译者|作者|编辑|收件人|寄给|姓名[:：]?|签名[:：]?)([一-鿿]{2,4}?)(?=，|。|、|；|的身份证|的电话|先生|女士|住在|电话|\s|$)|(?:^|(?<=[^一-鿿]))([一-鿿]{2,4})(?=住在)")
#: Words that follow a given name without being a surname, or begin a sentence after an initial.
_NO_SURNAME = frozenset(
    "The A An This That These Those Each Every Another One Some Any No Neither When While Because Since Although If Unless Once After Before In On At From Of By For With Without Is Was Were "
    "There It He She They We You I My Our Your His Her Its Readers What Why Who Whose Where Whether Phone Tel Tél Email Mail Flat Street Road and or und et y Bridge Process Star Kind Regards "
    "Der Die Das Ein Eine Im Am Zwei Von Wie Wer La Le Les El Los Las Un Une January February March April May June July August September October November December Figure Table Chapter Page Shelf "
    "See Siehe Write Order Version Use Keep Render Send Ask Deliver Contact Translator Clause Plate Copies According Nobody Has Could Thank Please Order Prof Ms Mr Mrs Dr Herr Frau".split()
)


_WORD = re.compile(r"[A-ZÀ-Þ]\w*")


@lru_cache(8)
def _given(names: tuple[str, ...]) -> tuple[frozenset[str], re.Pattern | None]:
    """The names that are one capitalised word, and a pattern of the others."""
    forms = {f for n in names for f in (n, n.upper())}
    words = frozenset(f for f in forms if _WORD.fullmatch(f))
    rest = sorted(forms - words - {""}, key=len, reverse=True)
    return words, re.compile("(?:" + "|".join(map(re.escape, rest)) + r")(?!\w)") if rest else None


def _given_places(text: str, names: tuple[str, ...], own: frozenset[str]) -> list[tuple[int, int]]:
    words, rest = _given(names)
    out = [m.span() for m in _WORD.finditer(text) if m.group() in words or m.group() in own]
    return sorted(out + [m.span() for m in rest.finditer(text)]) if rest else out


def _emails(text: str, out: list[Mention]) -> None:
    at = text.find("@")
    while at >= 0:
        before = _EMAIL_BEFORE.search(text[max(0, at - 80) : at])
        after = _EMAIL_AFTER.match(text, at + 1)
        if before and after and _TOP.search(after.group()):
            out.append(Mention(at - len(before.group()), after.end(), "email"))
        at = text.find("@", at + 1)
    lower = text.lower()
    if "[at]" in lower or "(at)" in lower or " dot " in lower:
        m = _EMAIL_SPOKEN.search(text)
        while m:
            if re.match(r" at [\w-]+ dot ", text[m.end() : m.end() + 60], re.I):
                m = _EMAIL_SPOKEN.search(text, m.start() + 3)  # an "at" of the sentence stands before the address
                continue
            out.append(Mention(m.start(), m.end(), "email"))
            m = _EMAIL_SPOKEN.search(text, m.end())


def _numbers(text: str, out: list[Mention]) -> None:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        start, end = m.start(), m.end()
        value = m.group().rstrip(".-/ ")
        end = start + len(value)
        before = text[start - 1 : start]
        if before == "+" or before in "(（" and before:
            start -= 1
        elif before.isalnum() and (before.isascii() or before.isdigit()):
            continue
        if end < len(text) and text[end].isalpha() and text[end].isascii():
            continue
        value = text[start:end]
        if before in "(（" and before and ")" not in value and "）" not in value:
            start, value = start + 1, value[1:]
        if _IDS.fullmatch(value) or _CARD.fullmatch(value) and _luhn(value):
            out.append(Mention(start, end, "id"))
            continue
        while " " in value and not _PHONES.fullmatch(value):
            cut = value.index(" ") + 1  # a number before it, such as that of a page, is none of its own
            if not any(sum(map(str.isdigit, value[i:])) >= 9 and _PHONES.fullmatch(value[i + 1 :]) for i, c in enumerate(value) if c == " "):
                break
            start, value = start + cut, value[cut:]
        digits = sum(c.isdigit() for c in value)
        if not 7 <= digits <= 15:
            continue
        if _PHONES.fullmatch(value):
            if value.startswith("1") and len(value) == 11 and not (text[max(0, start - 8) : start].strip() and re.search("[一-鿿]", text[max(0, start - 8) : start])):
                continue
            out.append(Mention(start, end, "phone"))
    for m in _LETTER_IDS.finditer(text):
        if (c := text[m.start() - 1 : m.start()]).isalnum() and c.isascii():
            continue
        out.append(Mention(m.start(), m.end(), "id"))
    for m in _IBAN.finditer(text):
        if not text[m.start() - 1 : m.start()].isalnum() and _mod_97(m.group()) == 1:
            out.append(Mention(m.start(), m.end(), "id"))


def _luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _mod_97(value: str) -> int:
    """The remainder of an account number, its country and check digits put last and letters as numbers; 1 if they are right."""
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def _addresses(text: str, han: bool, out: list[Mention]) -> None:
    for m in _ADDRESS_EN.finditer(text):
        flat = _FLAT_END.search(text, max(0, m.start() - 40), m.start())
        start = flat.start() if flat else m.start()
        if text[max(0, start - 4) : start] == "The " and re.match(r" [a-z]", text[m.end() : m.end() + 2]):
            continue  # a house named in a title, not a place of delivery
        out.append(Mention(start, m.end(), "address"))
    for m in _ADDRESS_DE.finditer(text):
        begin = _STREET_DE_BEGIN.search(text, max(0, m.start() - 60), m.start())
        if begin:
            out.append(Mention(begin.start(), m.end(), "address"))
    if _FR_HINT.search(text):
        for m in _ADDRESS_FR.finditer(text):
            out.append(Mention(m.start(), m.end(), "address"))
    if han:
        for m in _ADDRESS_ZH.finditer(text):
            out.append(Mention(m.start(), m.end(), "address"))


def _is_surname(word: str) -> bool:
    parts = word.split("-")
    return all(len(p) > 1 and p not in _NO_SURNAME and p.capitalize() not in _NO_SURNAME for p in parts)


def _cued(text: str) -> Iterator[tuple[int, re.Match]]:
    """Whole names that a title, a label, closing words or an initial in their middle give away."""
    for m in _PAIR.finditer(text):
        start = m.start()
        before = text[max(0, start - _CUE_CHARS) : start]
        if before and (before[-1].isalnum() or before[-1] in "_.@&+-’'"):
            continue
        whole = _WHOLE_NAME.match(text, start)
        if whole and (_CUE_END.search(before) or whole.start(2) - whole.end(1) > 1 and _MID_SENTENCE.search(before)) and _is_surname(whole.group(1)) and _is_surname(_bare(whole.group(2))):
            yield start, whole


def _names(text: str, names: tuple[str, ...], own: frozenset[str], han: bool, cyrillic: bool, out: list[Mention]) -> None:
    done = -1
    for start, end in _given_places(text, names, own):
        if start < done or start and (text[start - 1].isalnum() or text[start - 1] in "_.@+-"):
            continue
        if text[end : end + 1] in "@_" and end < len(text) or text[end : end + 1] == "." and text[end + 1 : end + 2].isalpha():
            continue
        after = _AFTER_GIVEN.match(text, end)
        if after and _is_surname(_bare(after.group(1))) and not text.startswith(",", after.end()) | (text[after.end() : after.end() + 1] in "@"  and after.end() < len(text)):
            stop = after.start(1) + len(_bare(after.group(1)))
            if text[end] != "\n" or not _BEFORE_GIVEN.search(text[max(0, start - 60) : start]):
                out.append(Mention(start, stop, "name"))
                done = stop
                continue
        before = _BEFORE_GIVEN.search(text[max(0, start - 60) : start])
        if before and _is_surname(before.group(1)):
            middle = _MIDDLE.match(text, end)
            done = middle.end() if middle else end
            out.append(Mention(start - len(before.group()), done, "name"))
            continue
        if after and _is_surname(_bare(after.group(1))):
            done = after.start(1) + len(_bare(after.group(1)))
            out.append(Mention(start, done, "name"))
    for start, whole in _cued(text):
        out.append(Mention(start, whole.start(2) + len(_bare(whole.group(2))), "name"))
    taken = {i for mention in out if mention.kind == "name" for i in range(mention.start, mention.end)} if out else set()
    for m in _ANY_INITIAL.finditer(text):
        start = m.start()
        if start in taken or start and (text[start - 1].isalnum() or text[start - 1] in "_.@&+-’'"):
            continue
        if start > 1 and text[start - 1] == " " and text[start - 2] == ".":
            earlier = text[max(0, start - 4) : start - 1]
            if re.fullmatch(r"(?:.*\W)?[A-Z]\.", earlier):
                continue
        whole = _INITIAL.match(text, start)
        if whole and _is_surname(_bare(whole.group(1))):
            stop = whole.start(1) + len(_bare(whole.group(1)))
            if text[stop : stop + 1] == "." and text[stop + 1 : stop + 2].isalpha():
                continue
            out.append(Mention(start, stop, "name"))
    if cyrillic:
        for m in _NAME_RU.finditer(text):
            lead = text[max(0, m.start() - 2) : m.start()]
            if lead and lead[-1] in "\n" or len(lead) == 2 and lead[1] == " " and lead[0] not in ".!?…":
                out.append(Mention(m.start(), m.end(), "name"))
    if han:
        for m in _NAME_ZH.finditer(text):
            group = 1 if m.group(1) else 2
            out.append(Mention(m.start(group), m.end(group), "name"))


def _bare(word: str) -> str:
    """A surname without a possessive ending."""
    return re.sub(r"(?:['’]s|['’])$", "", word)


_RANK = {"email": 0, "id": 1, "phone": 2, "address": 3, "name": 4}
_HAN = re.compile("[一-鿿]")
_CYRILLIC = re.compile("[А-Яа-я]")


def mentions(text: str, names: tuple[str, ...] = tuple(GIVEN_NAMES), own: frozenset[str] = frozenset()) -> list[Mention]:
    """All mentions in ``text``, in order and apart; of two that overlap the surer kind stays. ``own`` are given names as this text writes them."""
    out: list[Mention] = []
    han, cyrillic = bool(_HAN.search(text)), bool(_CYRILLIC.search(text))
    _emails(text, out)
    _numbers(text, out)
    _addresses(text, han, out)
    _names(text, names, own, han, cyrillic, out)
    kept: list[Mention] = []  # in order and apart, so that only the neighbours of a place can overlap
    for m in sorted(out, key=lambda m: (_RANK[m.kind], m.start, -m.end)):
        i = bisect_left(kept, m)
        if (not i or kept[i - 1].end <= m.start) and (i == len(kept) or m.end <= kept[i].start):
            kept.insert(i, m)
    return kept


# --- pseudonyms -----------------------------------------------------------------

_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
)
_WHERE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_ROUNDS = 8


class Feistel:
    """A keyed permutation of words over an alphabet, by length."""

    def __init__(self, key: str) -> None:
        self.keyed = hashlib.blake2b(key=hashlib.blake2b(key.encode(), digest_size=32).digest(), digest_size=16)

    def _round(self, tweak: str, i: int, value: int, modulus: int) -> int:
        state = self.keyed.copy()
        state.update(b"%b|%d|%x|%x" % (tweak.encode(), i, value, modulus))
        return int.from_bytes(state.digest(), "big") % modulus

    def permute(self, digits: list[int], radix: int, tweak: str = "", back: bool = False) -> list[int]:
        """A word of numbers below ``radix`` becomes another of the same length."""
        n = len(digits)
        if n == 0:
            return []
        if n == 1:
            shift = self._round(tweak, 0, radix, radix)
            return [(digits[0] + (-shift if back else shift)) % radix]
        u = n // 2
        sizes = (radix**u, radix ** (n - u))
        a, b = 0, 0
        for d in digits[:u]:
            a = a * radix + d
        for d in digits[u:]:
            b = b * radix + d
        order = range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS)
        sign = -1 if back else 1
        for i in order:
            if i % 2 == 0:
                a = (a + sign * self._round(tweak, i, b, sizes[0])) % sizes[0]
            else:
                b = (b + sign * self._round(tweak, i, a, sizes[1])) % sizes[1]
        out = []
        for value, length in ((b, n - u), (a, u)):
            part = []
            for _ in range(length):
                value, d = divmod(value, radix)
                part.append(d)
            out = part[::-1] + out
        return out

    def within(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A number below ``size`` becomes another, by walking the cycle of a wider permutation."""
        n = max(2, len(str(size - 1)))
        while True:
            digits = self.permute([int(c) for c in str(value).zfill(n)], 10, tweak, back)
            value = int("".join(map(str, digits)))
            if value < size:
                return value

    def text(self, value: str, tweak: str = "", back: bool = False) -> str:
        """Permute letters and digits of ``value`` within their alphabets; anything else stays in place."""
        out = list(value)
        groups: dict[str, list[int]] = {}
        for i, c in enumerate(value):
            if c in _WHERE:
                groups.setdefault(_WHERE[c][0], []).append(i)
            elif "一" <= c <= "龥":
                groups.setdefault("han", []).append(i)
        for alphabet, places in groups.items():
            if alphabet == "han":
                new = self.permute([ord(value[i]) - 0x4E00 for i in places], 0x9FA6 - 0x4E00, tweak + "han", back)
                for i, d in zip(places, new, strict=True):
                    out[i] = chr(d + 0x4E00)
            else:
                new = self.permute([_WHERE[value[i]][1] for i in places], len(alphabet), tweak + alphabet[0], back)
                for i, d in zip(places, new, strict=True):
                    out[i] = alphabet[d]
        return "".join(out)


_EPOCH = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _EPOCH).days


def _check_cn(digits: str) -> str:
    return "10X98765432"[sum(int(a) * b for a, b in zip(digits, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), strict=True)) % 11]


def _check_dni(digits: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]


@lru_cache(2)
def _network(key: str) -> Feistel:
    return Feistel(key)


@lru_cache(1 << 15)
def pseudonym(value: str, kind: str, key: str, back: bool = False) -> str:
    """``value`` permuted within its format, or turned ``back``."""
    f = _network(key)
    if kind == "phone":
        lead = re.match(r"\+\d{1,2}|00\d\d|\+", value)
        n = len(lead.group()) if lead else 0
        return value[:n] + f.text(value[n:], "phone", back)
    if kind == "id":
        if re.fullmatch(r"\d{17}[\dXx]", value):
            return _identity(value, f, back)
        if re.fullmatch(r"\d{8}-?[A-Z]", value):
            right = _check_dni(value[:8]) == value[-1]
            number = f.text(value[:8], "id", back)
            return number + value[8:-1] + (_check_dni(number) if right else value[-1])
        if re.match(r"[A-Z]{2} ?\d", value):
            return value[:2] + f.text(value[2:-1], "id", back) + value[-1]
        return f.text(value, "id", back)
    if kind == "email":
        at = re.search(r"@| ?[\[(]at[\])] ?| at ", value, re.I)
        return f.text(value[: at.start()], "email", back) + value[at.start() :] if at else f.text(value, "email", back)
    return f.text(value, kind, back)


def _identity(value: str, f: Feistel, back: bool) -> str:
    """Region, date and serial of an 18-digit number each keep their own format."""
    body, check = value[:17], value[17].upper()
    try:
        day = (datetime.date(int(body[6:10]), int(body[10:12]), int(body[12:14])) - _EPOCH).days
        if not 0 <= day < _DAYS:
            raise ValueError
    except ValueError:
        return f.text(value, "id", back)
    date = _EPOCH + datetime.timedelta(f.within(day, _DAYS, "date", back))
    new = f.text(body[:6], "region", back) + date.strftime("%Y%m%d") + f.text(body[14:], "serial", back)
    return new + (_check_cn(new) if _check_cn(body) == check else value[17])


def redact(text: str, found: list[Mention], key: str) -> str:
    """``text`` with each mention replaced; all else is unchanged."""
    out, at = [], 0
    for m in found:
        out += [text[at : m.start], f"[{m.kind.upper()}:{pseudonym(text[m.start : m.end], m.kind, key)}]"]
        at = m.end
    return "".join(out) + text[at:]


# --- operator -------------------------------------------------------------------

REDACTED = "doc_id bigint, text string, n_mentions int"
MENTIONS = "doc_id bigint, start_at int, length int, pii_kind string, placeholder string"


def session_key(spark: SparkSession) -> str:
    """The key of the pseudonyms, from ``spark.quirework.pii.key``; without it a new one that nobody knows."""
    return spark.conf.get("spark.quirework.pii.key", None) or secrets.token_hex(32)


EVIDENCE = "given string, surname string, written boolean, counts boolean"
_LOCAL = re.compile(r"([A-Za-z]{3,})[._]([A-Za-z]{3,})@")


def _evidence(batch: pa.RecordBatch) -> dict:
    """Given names and surnames of each text's addresses and cues; whether an address and the name beside it agree, and whether it counts at all."""
    out: set[tuple[str, str, bool, bool]] = set()
    for text in batch.column("text").to_pylist():
        for m in _LOCAL.finditer(text) if "@" in text else ():
            if re.match(r"[\w.+-]", text[m.start() - 1 : m.start()], re.A):
                continue
            given, surname = m.group(1).capitalize(), m.group(2).capitalize()
            usual = given in _NO_SURNAME or surname in _NO_SURNAME
            written = not usual and any(f"{g} {n}" in text or f"{n}, {g}" in text for g, n in ((given, surname), (given.upper(), surname.upper())))
            out.add((given, surname, written, m.group().islower()))
        for _, whole in _cued(text):
            out.add((whole.group(1), _bare(whole.group(2)), False, True))
    given, surname, written, counts = zip(*out, strict=True) if out else ((),) * 4
    return {"given": pa.array(given, pa.string()), "surname": pa.array(surname, pa.string()), "written": pa.array(written, pa.bool_()), "counts": pa.array(counts, pa.bool_())}


def learnt_names(documents: DataFrame, least: int = LEAST_SURNAMES) -> DataFrame:
    """``given``: given names the corpus itself tells, each once and all of them.

    Evidence are mail addresses of the form given.surname@, names after a title,
    a label or the closing words of a letter, and names with an initial in their
    middle. One address is enough where its document also writes that name and
    surname next to one another, in either order, so what is found in a document
    by its own address doesn't depend on the size of the corpus. A name without
    that needs ``least`` different surnames, counted exactly.
    """
    rows = map_batches(documents.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0), ["text"], _evidence, EVIDENCE)
    rows = rows.groupBy("given", "surname").agg(F.max("written").alias("written"), F.max("counts").alias("small"))
    found = rows.groupBy("given").agg(F.max("written").alias("written"), F.sum(F.col("small").cast("int")).alias("n"))
    return found.where(F.col("written") | (F.col("n") >= least)).select("given")


def learn_given_names(documents: DataFrame, least: int = LEAST_SURNAMES) -> tuple[str, ...]:
    """The stated names and all that ``learnt_names`` finds, here at the driver."""
    return tuple(sorted(set(GIVEN_NAMES) | {r.given for r in learnt_names(documents, least).toLocalIterator()}))


def known_names(documents: DataFrame, least: int = LEAST_SURNAMES, most: int = MOST_NAMES) -> tuple[str, ...] | DataFrame:
    """The stated and the learnt names to send out, or the table of the learnt where they are more than ``most``."""
    table = learnt_names(documents, least)
    sent = table.limit(most + 1).collect()
    if len(sent) > most:
        return table
    return tuple(sorted(set(GIVEN_NAMES) | {r.given for r in sent}))


def _with_own(documents: DataFrame, names: tuple[str, ...] | DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``doc_id, text, own``: the names of a table that each text holds, joined by its words; nothing of the table is sent out whole."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not isinstance(names, DataFrame):
        return rows.withColumn("own", F.array().cast("array<string>")), names
    rows = rows.withColumn("_key", F.xxhash64("text"))
    words = rows.select("_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(?<!\w)(\p{Lu}\w*)"), F.lit(1)))).alias("word")).distinct()
    forms = names.select(F.explode(F.array("given", F.upper("given"))).alias("word")).distinct()
    own = words.join(forms, "word").groupBy("_key").agg(F.collect_set("word").alias("own"))
    return rows.join(own, "_key", "left").select("doc_id", "text", F.coalesce("own", F.array().cast("array<string>")).alias("own")), tuple(GIVEN_NAMES)


def find_mentions(documents: DataFrame, key: str, names: tuple[str, ...] | DataFrame | None = None) -> DataFrame:
    """One row per mention with its place, kind and placeholder.

    Needs ``doc_id, text``; other columns are ignored. Null and empty texts give
    no row; a document without mentions gives none; a row delivered twice gives
    equal rows. Texts go through once, whole, and nothing is shuffled unless the
    names are a table (``known_names``).
    """
    rows, names = _with_own(documents, tuple(GIVEN_NAMES) if names is None else names)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "start_at", "length", "pii_kind", "placeholder")}
        for doc, text, own in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "own")), strict=True):
            for m in mentions(text, names, frozenset(own)) if text else ():
                values = (doc, m.start, m.end - m.start, m.kind, f"[{m.kind.upper()}:{pseudonym(text[m.start : m.end], m.kind, key)}]")
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        kinds = {"doc_id": pa.int64(), "start_at": pa.int32(), "length": pa.int32()}
        return {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}

    return map_batches(rows.where(F.length("text") > 0), ["doc_id", "text", "own"], run, MENTIONS)


def redact_documents(documents: DataFrame, key: str, names: tuple[str, ...] | DataFrame | None = None) -> DataFrame:
    """Every document with its mentions replaced by typed placeholders.

    Null stays null and empty stays empty, each with 0 mentions; other columns
    are ignored; a row delivered twice gives equal rows.
    """
    rows, names = _with_own(documents, tuple(GIVEN_NAMES) if names is None else names)

    def run(batch: pa.RecordBatch) -> dict:
        texts, counts = [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
            found = mentions(text, names, frozenset(own)) if text else []
            texts.append(redact(text, found, key) if found else text)
            counts.append(len(found))
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_mentions": pa.array(counts, pa.int32())}

    return map_batches(rows, ["doc_id", "text", "own"], run, REDACTED)
