"""Problem 6: personal data in free text, found by boosted trees over candidate spans and replaced.

Generators propose overlapping spans of five types with high recall. Boosted trees score each span from its
format and its context; a logistic curve calibrates the score, and a threshold of each type, set on held-out
examples, selects. Of overlapping spans the most probable one is redacted. The trees are fitted on sentences
that a seeded writer makes of its own words, so the fit does not depend on the rows and is the same at every size.
Context is read to the words beside a span, however far they are.

Names are proposed by their capitals in every script that has case. In scripts without it (Chinese, Japanese, Korean,
Arabic, Hebrew, Devanagari, Thai) they are proposed beside a title, a form of address or a label only.

Defined cases: null and empty texts hold nothing and stay as they are; repeated rows count once in the
findings; long texts are read whole; all text outside the selected spans is unchanged.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.boosting import Boosted, best_threshold, calibrate
from quirework.llm.common import pages_and_chunks

TYPES = ["email", "phone", "id", "address", "name"]
#: Written examples for fitting, and held-out ones for calibration and thresholds.
FIT_EXAMPLES, HELD_OUT = 8000, 3000

# Given names of many countries.
GIVEN = set(
    "anna ivo ines theo oskar agnes selma milan sofia edith clara paula petra greta ayumi samir dora jonas lukas pavel viktor hugo felix karim noor mateo tomas peter anton marek leila irene vera nadia bruno mira rosa emil yara "
    "maria jose juan luis carlos ana laura marta pedro pablo diego elena lucia carmen jorge miguel john james robert michael william david richard thomas mary linda susan karen sarah jennifer elizabeth emma olivia jack harry george oliver charles henry alice "
    "paul jean pierre marie luc louis camille julie nicolas claire sophie antoine hans klaus karl heinz fritz max moritz ursula monika sabine stefan andreas martin michaela julia lena ivan olga igor boris dmitri natalia tatiana sergei alexei anja katarina "
    "giovanni marco luca giulia francesca alessandro chiara sven lars erik ingrid astrid nils bjorn ali omar fatima ahmed mohammed hassan aisha yusuf amir wei li ming chen yuki kenji hiro sakura raj priya anil sunita kofi amara lea nina eva adam jakub jan piotr ewa"
    .split()
)
# Words around spans, by what they speak for.
CONTEXT = {
    "title": "mr mrs ms dr prof herr frau mme mlle sr sra ing inspector engineer sir madam monsieur madame señor señora doctor officer witness témoin zeuge testigo operator patient landlord tenant coach captain goalkeeper applicant caretaker neighbour nurse teacher director president chairman secretary treasurer author editor judge lawyer driver uncle aunt signor signora senhor senhora heer mevrouw fru pan pani anh chị bay bayan господин госпожа доктор докладчик автор директор",
    "person": "by name named signed contact ask notified notify avisar rückfragen an for according employee applicant tenant claimant owner pedestrian caller meet dear hello to",
    "phone": "tel telephone phone call ring mobile cell fax dial reached under telefon téléphone teléfono handy contact al or night day",
    "id": "ssn passport id identity personnel insurance tax licence license payroll national ausweis dni fiscale cpf pan pesel nir nhs nif nie social steuer number shows permit iban",
    "thing": "part kit bid order route station firmware version page sheet fig table section no code entry leaf serial model memo invoice item lot batch ref file note vol art ticket pump unit drawing isbn model feuille hoja blatt seite pièce pieza",
    "address": "of lives deliver samples resident residing living address wohnt habite vive adresse rue to",
    "act": "said says wrote writes joined won wants lives lived has had owes spells asked asks called calls thinks knows knew married moved sang saved plays lectures works worked agreed thanked retired gave took signed wohnt sagte hat schrieb habite travaille dijo vive trabaja bor sa heeft zei ha a сказал пишет живёт",
    "place": "at in near à en bei près cerca um dans between zwischen entre from",
}
TITLE_WORDS = set(CONTEXT["title"].split())
_CONTEXT = {w: k + 1 for k, ws in enumerate(CONTEXT.values()) for w in ws.split()}
# What follows two capitalised words that are no person, and first words that are no given name.
THING_AFTER = set("memo reprint report ltd gmbh corp inc sa ag board office agency survey works group team plan council committee depot bridge survey notes station river valley road street bid file handbook manual guide".split())
NOT_FIRST = set(
    "the a an at in on by of for from to with near between where when if after before while two three one none loads readings entry sheet water crews according call part route station page revised firmware bid deliver please questions signed night operator passport witness mail notified inspector letter section chapter "
    "der die das den bei im am zwischen laut falls und ein eine von vom nach le la les un une des du entre selon si à au en el los las una unos según sobre del al para por y both and or this that these those its their his her"
    .split()
)

def _letters(*categories: str) -> str:
    """The letters of Unicode categories as ranges of a character class; of those beyond the first plane only
    such as have both cases, which leaves out mathematical signs."""
    points = [p for p in range(0x20000) if unicodedata.category(c := chr(p)) in categories and (p < 0x10000 or c.swapcase() != c)]
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


MARK = "\u0300-\u036f"  # the marks of decomposed letters
UP = _letters("Lu", "Lt")
LOW = _letters("Ll") + MARK + "-"
CAP = rf"(?:[OD]['’]|Mc|Mac)?[{UP}][{LOW[:-1]}'’ʼʻ]+"
GIV = rf"{CAP}(?:-{CAP})?"
INI = rf"[{UP}][{MARK}]*\."
UPP = rf"[{UP}][{UP}{MARK}]+(?:-[{UP}][{UP}{MARK}]+)?"
PAR = r"(?:van der|van den|van|von der|von|de la|de|del|della|di|da|dos|das|du|le|ten|ter|zu|af|av|bin|binti|ibn|al|el)"
S = r"\s{1,4}"
STREET = "Street|Avenue|Road|Lane|Court|Close|Drive|Boulevard|Place|Square|Way|Terrace|Crescent|Alley|Row|St\\.?|Ave\\.?|Rd\\.?|Ln\\.?|Ct\\.?|Cl\\.?|Dr\\.?|Blvd\\.?|Pl\\.?|Sq\\.?|Ter\\.?"
UNIT = r"(?:Flat|Apt\.?|Apartment|Suite|Ste\.?|Unit|Room|Floor|#)"
NUM = r"\d{1,5}(?:\s?-\s?\d{1,4})?(?:\s?-?[A-Za-z])?(?![\w])"

# Frequent family names of one sign, and what stands before a name in scripts without case.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
SURNAMES_KO = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민"
LABELS = "姓名|联系人|签名|签字|申请人|负责人|患者|收件人|氏名|名前|担当者|署名|성명|이름|담당자|작성자"
TITLES = "السيد|السيدة|الدكتور|الدكتورة|الأستاذ|الأستاذة|المهندس|المهندسة|الاسم|מר|גברת|ד״ר|שם|श्री|श्रीमती|सुश्री|डॉ\\.|नाम|นางสาว|นาย|นาง|คุณ|ดร\\.|ชื่อ"
#: Signs of scripts without case, which the generators for them need.
CASELESS = re.compile(r"[\u0590-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
#: What a text must hold (any of it) for a generator to be worth running; what holds another entry is left out.
NEEDS = {
    3: "Street Avenue Road Lane Court Close Drive Boulevard Place Square Way Terrace Crescent Alley Row St Ave Rd Ln Ct Cl Dr Blvd Pl Sq Ter".split(),
    5: "Calle Avenida Avda Paseo Plaza Camino Via Piazza Rua C/".split(), 6: "rue avenue boulevard bd place chemin impasse allée quai route cours".split(), 15: "ul. al. pl. ulica улица ул. проспект пр-т переулок пер. площадь пл. вул. οδός".split(),
}
NEEDS = {g: [w for w in words if not any(v != w and v in w for v in words)] for g, words in NEEDS.items()}
#: The ends of the streets of generator 4, which stand right before a number.
STREET_ENDS = tuple("straße strasse str. gasse weg platz allee ring damm ufer steig straat laan plein gracht kade singel dreef gata gaten gatan gate veien vegen vägen torget gränd gade vej allé katu kuja utca Straße Strasse Gasse Weg Platz Allee".split())
NUMBER_AFTER = re.compile(r"\s{1,3}(?=\d)")
#: Generators of names by capitals; they are tried where a capital word stands before another or before a particle. Those of
#: the second group need capitals in a row.
BY_CAPITALS, IN_CAPITALS = {7, 8, 9, 10, 11, 12, 13}, {10, 11, 12}
ANCHOR, ANCHOR_ASCII = (
    re.compile(rf"\b(?:{PAR}{S})?[{up}][^\s,]*,?\s{{1,4}}(?=[{up}]|{PAR}\s|VAN|VON|DE|DI|DA|DU)|(?<![\w.])[{up}]{marks}\.(?=[{up}])") for up, marks in ((UP, f"[{MARK}]*"), ("A-Z", ""))
)
UPPER_RUN, UPPER_ASCII = re.compile(rf"[{UP}][{UP}{MARK}]{{3}}"), re.compile("[A-Z]{4}")

#: Type and pattern of each generator; the order numbers them.
GENERATORS = [
    ("email", re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\sat\s(?=[\w\-.]+\s?(?:[(\[{<]|\s)dot[)\]}>\s])", re.I)),
    ("phone", re.compile(r"(?<![\w.])(?:\+|\(|\+\()?\d[\d]*\)?(?:[\s.\-/]{0,2}\(?\d+\)?){1,8}")),
    ("id", re.compile(r"(?=[A-Z\d][A-Z\d\- ]{2})(?<![\w.\-+/])(?:\d{3}[\- ]\d{2}[\- ]\d{4}|\d{6,8}[\-+ ]\d{3,5}|[A-Z]{2}(?:\s?\d{2}){3}\s?[A-Z]|[A-Z]{1,2}\d{2}[A-Z]\d{5,8}[A-Z]?|\d{8}\s?-?[A-Z]|[A-Z]\s?-?\d{7}\s?-?[A-Z]|[A-Z]{1,3}\d{6,9}|\d{9,12}|\d{17}[\dXx]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{4} \d{4} \d{4}|\d{3} \d{3} \d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2})(?![\w/]|[\-.]\d)")),
    ("address", re.compile(rf"(?<![\w\-.])(?:{UNIT}\s?\d+\w?,{S})?{NUM}{S}(?:[NSEW]\.{S})?(?:{CAP}{S}){{1,3}}(?:{STREET})(?!\w)(?:,{S}{UNIT}\s?\d+\w?)?")),
    ("address", re.compile(rf"\b{CAP}(?:{S}|-)?(?:(?<=[{LOW[:-1]}])(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|straat|laan|plein|gracht|kade|singel|dreef|gata|gaten|gatan|gate|veien|vegen|vägen|torget|gränd|gade|vej|allé|katu|kuja|utca)|(?<=\s)(?:Straße|Strasse|Gasse|Weg|Platz|Allee))\s{{1,3}}\d{{1,4}}(?:[a-z]|\s[a-d](?=[,.;)]|$))?(?!\w)(?:,{S}(?:Wohnung|Whg\.)\s?\d+)?")),
    ("address", re.compile(rf"\b(?:Calle|Avenida|Avda?\.|Paseo|Plaza|Camino|Via|Viale|Piazza|Rua|C/){S}(?:(?:de|del|la|las|los|di|da|do){S}){{0,2}}{CAP}(?:{S}{CAP})?,?{S}(?:n\.?º?{S})?\d{{1,4}}\s?[a-z]?(?!\w)(?:,{S}(?:piso|apto\.?|int\.)\s?\d+\w?)?")),
    ("address", re.compile(rf"(?<![\w\-.])\d{{1,4}}(?:\s?(?:bis|ter|[a-z]))?,?{S}(?:rue|avenue|boulevard|bd\.?|place|chemin|impasse|allée|quai|route|cours){S}(?:(?:de la|de l['’]|de|du|des){S}|d['’]|de l['’])?{CAP}(?:[\s-]{CAP})?(?:,{S}(?:appt\.?|apt\.?|appartement)\s?\d+)?")),
    ("name", re.compile(rf"\b{GIV}{S}(?:{INI}{S}?)?(?:{PAR}{S})?{CAP}(?:-{CAP})?\b")),
    ("name", re.compile(rf"(?<![\w.])(?:{INI}{S}?){{1,3}}(?:{PAR}{S})?{CAP}(?:-{CAP})?\b")),
    ("name", re.compile(rf"\b(?:{PAR}{S})?{CAP}(?:-{CAP})?,{S}(?:{GIV}\b(?:{S}{INI})?|{INI}(?:\s?{INI})*)")),
    ("name", re.compile(rf"\b{UPP}{S}(?:{INI}{S}?)?(?:(?:VAN DER|VAN|VON|DE LA|DE|DEL|DI|DA|DU){S})?[{UP}][{UP}{MARK}]{{3,}}(?:-[{UP}][{UP}{MARK}]{{2,}})?\b")),
    ("name", re.compile(rf"\b[{UP}][{UP}{MARK}]{{3,}},{S}(?:{UPP}\b|{INI})")),
    ("name", re.compile(rf"(?<![\w.])(?:{INI}{S}?){{1,3}}(?:(?:VAN|VON|DE){S})?[{UP}][{UP}{MARK}]{{3,}}\b")),
    ("name", re.compile(rf"\b{GIV}(?:{S}(?:{PAR}{S})?{CAP}(?:-{CAP})?){{2,3}}\b")),
    ("name", re.compile(
        rf"([{SURNAMES}][一-鿿]{{1,2}}?)(?=先生|女士|小姐|老师|医生|医師|经理|主任|工程师|教授|さん|様|さま|氏)|(?:{LABELS})[:：]?\s?(?!{LABELS})([一-鿿]{{2,4}}|[가-힣]{{2,4}})(?![一-鿿가-힣])"
        rf"|(?<![가-힣])([{SURNAMES_KO}][가-힣]{{1,2}})(?=\s?(?:씨|님|선생|과장|부장|대리|교수|박사|기자|의원))"
        rf"|(?:{TITLES})\s?:?\s?([\u0600-\u06ff]+(?:\s[\u0600-\u06ff]+)?|[\u0590-\u05ff]+(?:\s[\u0590-\u05ff]+)?|[\u0900-\u097f]+(?:\s[\u0900-\u097f]+)?|[\u0e01-\u0e4e]{{2,24}}(?:\s[\u0e01-\u0e4e]{{2,24}})?)"
    )),
    ("address", re.compile(rf"(?<!\w)(?:ul\.|al\.|pl\.|ulica|улица|ул\.|проспект|пр-т|переулок|пер\.|площадь|пл\.|вул\.|οδός){S}{CAP}(?:[\s-]{CAP})?,?{S}(?:д\.{S}?|дом{S})?\d{{1,4}}\s?[{LOW[:-1]}]?(?!\w)(?:[,/]{S}?(?:m\.|кв\.|корп\.)?\s?\d+)?")),
    ("address", re.compile(r"(?:(?<=[是在于住址到])|(?<![一-鿿]))(?![是在于住址到])[一-鿿]{1,6}?(?:路|街|大道|巷|弄)\d{1,5}(?:号|號|弄)(?:\d{1,4}(?:室|楼|栋|单元))*|(?<![一-鿿])[一-鿿]{1,6}?(?:町|丁目|番地)\s?\d{1,3}(?:[-－]\d{1,3}){1,2}")),
]
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: An address is read to both sides of its sign; the first generator finds the sign only.
SKIPPED = NOT_FIRST | TITLE_WORDS
USER_SIGNS = frozenset(".+%-_")
HOST = re.compile(r"\s?\w[\w\-]*(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)\w[\w\-]*)+", re.I)
RUN = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
ENDED, CLOSED = re.compile(r"[.!?]\s+$|\n\s*$"), re.compile(r"[.!?:]\s*$")
LABEL_ENDS = ("no", "nr", "num", "number", "id", "ssn", "tel")
OVERLAPPING = {7, 10, 13}
INITIAL = re.compile(rf"\b[{UP}][{MARK}]*\.")
MARKS = re.compile(rf"[{MARK}]+")


def user_start(text: str, at: int) -> int:
    """Where the user part of an address begins whose sign is at ``at``; ``at`` if there is none. Read to its end."""
    k = at - 1 if at and text[at - 1].isspace() else at
    if not k or not (text[k - 1].isalnum() or text[k - 1] == "_"):
        return at
    while k and (text[k - 1].isalnum() or text[k - 1] in USER_SIGNS):
        k -= 1
    return k


def _worth(text: str) -> list[int]:
    """The generators that can find something in ``text``, but for those of names by capitals."""
    skip = set(BY_CAPITALS)
    for g, words in NEEDS.items():
        for w in words:
            if w in text:
                break
        else:
            skip.add(g)
    for m in NUMBER_AFTER.finditer(text):
        if text.endswith(STREET_ENDS, 0, m.start()):
            break
    else:
        skip.add(4)
    low = text.lower()
    if "@" not in low and "dot" not in low and not any(f"at{blank}{close}" in low for blank in ("", " ") for close in ")]}>"):
        skip.add(0)
    if text.isascii() or not CASELESS.search(text):
        skip |= {14, 16}
    return [g for g in range(len(GENERATORS)) if g not in skip]


def _starts(text: str) -> tuple[list[int], bool]:
    """Where a name by capitals may begin, and whether capitals stand in a row."""
    anchor, upper = (ANCHOR_ASCII, UPPER_ASCII) if text.isascii() else (ANCHOR, UPPER_RUN)
    return [m.start() for m in anchor.finditer(text)], bool(upper.search(text))


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """``(generator, start, end)`` of every proposed span."""
    for g in _worth(text):
        kind, pattern = GENERATORS[g]
        if kind == "phone":
            yield from _phones(text, g, pattern)
            continue
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span(m.lastindex or 0)
            at = b if b > a else b + 1
            if kind == "email":
                start, host = user_start(text, a), HOST.match(text, b)
                if start == a or not host:
                    continue
                a, b = start, host.end()
                at = b
            yield from _whole(text, g, a, b)
    starts, upper = _starts(text)
    free = dict.fromkeys(sorted(BY_CAPITALS if upper else BY_CAPITALS - IN_CAPITALS), 0)  # where each may go on
    for at in starts:
        for g, since in free.items():
            if at < since or not (m := GENERATORS[g][1].match(text, at)):
                continue
            free[g] = m.end()
            if g in OVERLAPPING:
                first = WORD.match(text, at)
                free[g] = first.end() if first else at + 1
                if first and first.group().split("-")[0].lower() in SKIPPED:
                    continue
            yield from _whole(text, g, at, m.end())


def _phones(text: str, g: int, pattern: re.Pattern) -> Iterator[tuple[int, int, int]]:
    for m in pattern.finditer(text):
        a, b = m.span()
        if b - a < 7 or not 7 <= sum(map(str.isdigit, m.group())) <= 16:
            continue
        if text[a] == "(" and ")" not in m.group():
            a += 1
        while not text[b - 1].isdigit():
            b -= 1
        yield from _whole(text, g, a, b)


def _whole(text: str, g: int, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """A span with the mark of a decomposed last letter; none that crosses a blank line."""
    if m := MARKS.match(text, b):
        b = m.end()
    if text.count("\n", a, b) < 2:
        yield g, a, b


def _word_class(word: str) -> int:
    return _CONTEXT.get(word.lower(), 0)


NAMES = (
    " ".join(f"g{k}" for k in range(len(GENERATORS))) + " digits groups plus zero paren seps letters length given_first given_last given_any tokens short "
    "prev prev2 next after before_char start thing_after sur_len initial hyphen same_len upper unit9 fmt3 fmt4 tail prev_cap next_cap given_prev label sur_end pairs like_first like_last"
).split()
# How family names end in many languages.
SURNAME_ENDS = tuple("ski ska cki cka wicz sen son ová ov ova ev eva enko chuk ez es ini elli etti mann berg stein dottir poulos yan dze oğlu ић ов ова ев ева ин ина ский ская енко чук ko nen quist lund strom dahl vik stad ema stra".split())


@lru_cache(maxsize=1)
def _pair_odds() -> dict[str, float]:
    """How much more often two letters follow each other in names than in words, as a logarithm."""
    names = [w.lower() for w in GIVEN] + [w.lower() for c in CULTURES for part in c.split("|") for w in part.split()]
    words = [w for ws in CONTEXT.values() for w in ws.split()] + [w.lower() for w in TITLED] + sorted(NOT_FIRST | THING_AFTER) + [w for p in PLAIN + FOREIGN for w in p.lower().split()]
    counts: list[dict[str, int]] = [{}, {}]
    for k, group in enumerate((names, words)):
        for w in group:
            for pair in zip(f"^{w}", f"{w}$"):
                counts[k]["".join(pair)] = counts[k].get("".join(pair), 0) + 1
    total = [sum(c.values()) for c in counts]
    return {pair: float(np.log((counts[0].get(pair, 0) + 0.5) / total[0] * total[1] / (counts[1].get(pair, 0) + 0.5))) for pair in {*counts[0], *counts[1]}}


@lru_cache(maxsize=100_000)
def likeness(word: str) -> int:
    """How much a word looks like a name by its pairs of letters, from 1 to 15."""
    odds = _pair_odds()
    mean = sum(odds.get(a + b, 0.0) for a, b in zip(f"^{word}", f"{word}$")) / (len(word) + 1)
    return int(min(15, max(1, round(8 + 5 * mean))))


class Context:
    """Finds the words beside a span of a text, runs of letters and digits that do not reach into it."""

    def __init__(self, text: str):
        self.text = text

    def _inside(self, at: int) -> bool:
        return 0 < at < len(self.text) and self.text[at - 1].isalnum() and self.text[at].isalnum()

    def _word(self, at: int) -> tuple[int, int]:
        """Start and end of the last word up to ``at``."""
        text, end = self.text, at
        while end and not text[end - 1].isalnum():
            end -= 1
        start = end
        while start and text[start - 1].isalnum():
            start -= 1
        return start, end

    def before(self, at: int) -> tuple[str, str, str]:
        """The word that ends before ``at``, the word before it, and what lies between the first and ``at``."""
        start, end = self._word(self._word(at)[0] if self._inside(at) else at)
        if not end:
            return "", "", self.text[:at]
        return self.text[start:end], self.text[slice(*self._word(start))], self.text[end:at]

    def after(self, at: int) -> str:
        if self._inside(at):
            at = RUN.match(self.text, at).end()
        found = RUN.search(self.text, at)
        return found.group() if found else ""


def features(context: Context, g: int, a: int, b: int) -> list[int]:
    """Format and context of a span as small integers."""
    text = context.text
    span, kind = text[a:b], GENERATORS[g][0]
    f = [0] * len(GENERATORS)
    f[g] = 1
    digits = sum(map(str.isdigit, span))
    sizes = [len(x) for x in DIGITS.findall(span)]
    words = WORD.findall(span)
    lowered = [w.lower().split("-")[0] for w in words]
    prev, prev2, gap = context.before(a)
    nxt = context.after(b)
    long_word = max(map(len, words), default=0)
    given = [w in GIVEN for w in lowered]
    char = text[b : b + 1]
    blank = not gap or gap.isspace()
    first = not prev and blank  # nothing but white space before the span
    f += [
        min(digits, 15), min(len(sizes), 15), "+" in span, span.startswith("00") and 2 or span.startswith("0") and 1 or 0, "(" in span,
        ("-" in span) + 2 * ("." in span) + 4 * (" " in span) + 8 * ("/" in span), min(sum(map(str.isalpha, span)), 15), min((b - a) // 3, 15),
        bool(given) and given[0], bool(given) and given[-1], any(given), min(len(words), 15), min(min(map(len, words), default=0), 15),
        _word_class(prev), _word_class(prev2), _word_class(nxt),
        0 if not char else 1 if char == "," else 2 if char in ".!?" else 3 if char == ";" else 4 if char in "()" else 5 if char == "-" else 6 if char.isspace() else 7,
        0 if first else 1 if gap.endswith("(") else 2 if CLOSED.search(gap) else 3 if gap.endswith("-") else 4 if "," in gap else 5 if blank else 6,
        first or bool(ENDED.search(gap)), nxt.lower() in THING_AFTER or (len(words) > 1 and (lowered[-1] in THING_AFTER or lowered[0] in THING_AFTER)), min(long_word, 15), bool(INITIAL.search(span)), "-" in span,
        len(words) > 1 and abs(len(words[0]) - len(words[-1])) <= 1, span.isupper(), sizes[:1] == [9], sizes == [3, 2, 4] or sizes == [8, 4], sizes[-3:] == [3, 3, 4] or sizes[-2:] == [3, 4] or sizes[-1:] == [7],
        min(sizes[-1], 15) if sizes else 0, prev[:1].isupper() + (len(prev) > 1 and prev.isupper()), nxt[:1].isupper() + (len(nxt) > 1 and nxt.isupper()), prev.lower() in GIVEN, prev.lower().endswith(LABEL_ENDS),
        any(w.endswith(SURNAME_ENDS) for w in lowered), len(sizes) > 2 and set(sizes[-3:]) == {2},
        likeness(lowered[0]) if kind == "name" and lowered else 0, likeness(lowered[-1]) if kind == "name" and lowered else 0,
    ]
    return [int(v) for v in f]


# --- written examples -------------------------------------------------------------------------------------


# Given and family names of languages with letters beyond ASCII, a few of each; middle names follow a third bar.
CULTURES = [
    "Łukasz Małgorzata Paweł Zofia|Wiśniewski Dąbrowska Żurek Kowalczyk", "Jiří Božena Tomáš Věra|Dvořák Černá Říha Novák", "Bjørn Åse Øyvind Söndre|Østby Håland Sjöberg Åkesson", "Ayşe Gökhan İbrahim Çiğdem|Yılmaz Şahin Öztürk Kılıç",
    "Milica Đorđe Željko Nenad|Petrović Đurić Šimić Kovač", "Ștefan Ioana Răzvan Mădălina|Popescu Ionescu Țurcanu Văduva", "Zoltán Ágnes László Réka|Nagy Szabó Kovács Tóth", "Gonçalo João Inês Conceição|Araújo Simões Gonçalves Conceição",
    "Сергей Анна Дмитрий Ольга Мария Павел|Иванов Петрова Кузнецов Смирнова Орлов Соколова|Петрович Сергеевна Иванович Павловна", "Олексій Тарас Оксана|Шевченко Бойко Коваль", "Γιώργος Ελένη Νίκος|Παπαδόπουλος Νικολάου Γεωργίου",
]
# Names in scripts without case, in the frames that show them.
FRAMES_WITHOUT_CASE = [
    ("联系人：", "张伟 李娜 王建国 欧阳 陈晓", "，电话 "), ("请找", "赵敏 周杰 刘洋 孙丽", "先生。"), ("患者姓名：", "黄晓明 林芳 高强", " 年龄 "), ("担当者：", "佐藤健 鈴木花 高橋誠", "\n"), ("昨日", "高林 石原 金子 武田", "さんが来た。"),
    ("담당자: ", "김민수 이서연 박지훈", " "), ("어제 ", "최유진 정하늘 강민호", " 씨가 왔다."), ("حضر السيد ", "محمد علي|أحمد حسن|خالد يوسف", " إلى الاجتماع."), ("الدكتورة ", "فاطمة سالم|ليلى حداد", "، هاتف "), ("גברת ", "רחל כהן|שרה לוי", " הגיעה."),
    ("श्री ", "राजेश कुमार|अनिल शर्मा|सुरेश वर्मा", " ने कहा।"), ("डॉ. ", "सुनीता शर्मा|मीना गुप्ता", " से मिलें।"), ("นาย", "สมชาย ใจดี|ประเสริฐ แสงทอง", " ได้ลงนาม"), ("คุณ", "วิภา ศรีสุข|มานี มีสุข", " โทร "),
]
# Words of the writer's headings and titles, and of its plain sentences.
TITLED = "Annual Budget Winter Harbour Garden Concert School Museum Library Market Season Training Summer Health Energy Safety Review Guide Programme Travel Kitchen Music History Science General Quality Weekly Central Royal Public Digital".split()
PLAIN = "the choir met again and nobody minded|lunch was late|prices rose a little last week|our bus left without us|two guests stayed for dinner|it rained all afternoon|the lecture was moved to another hall|a cat slept on the piano|they sold more bread than cake|the match ended in a draw|tickets are still to be had|the bakery opens earlier now|prices fell by more than half|they won by less than a minute|nobody came with more than one bag|it was sold for twice as much as before".split("|")
FOREIGN = "das Konzert fiel leider aus|wir trafen uns vor dem Kino|il faisait déjà nuit|le marché ouvre plus tôt|la clase empieza tarde|compramos pan y queso|il treno era in ritardo|a feira fecha cedo|de winkel is dicht|festen varade länge|je Stunde fast vierzig Gäste|au moins dix par heure|unas diez por hora".split("|")


class Writer:
    """Writes sentences with marked personal data and with things that look like it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = sorted(GIVEN)
        self.groups = [[part.split() for part in c.split("|")] for c in CULTURES]

    def syllables(self, low: int = 3, high: int = 4) -> str:
        return "".join(self.r.choice("bdfgklmnprstv") + self.r.choice("aeiou") for _ in range(self.r.randint(low, high)))

    def word(self) -> str:
        return (self.syllables() + self.r.choice(["x", "rk", "st", "nd", "ck", "lm", "r", "s", "th", "ft", "mp", "n"])).capitalize()

    def surname(self) -> str:
        return (self.syllables(2, 4) + self.r.choice(["nas", "mir", "tov", "ski", "bek", "lund", "quin", "gar", "zik", "rian", "lez", "hart", "lli", "son", "man", "er", "ini", "ez", "elen", "rud", "dez"])).capitalize()

    def first(self) -> str:
        name = self.r.choice(self.given).capitalize() if self.r.random() < 0.75 else self.r.choice(self.r.choice(self.groups[:8])[0]) if self.r.random() < 0.5 else self.syllables(2, 3).capitalize()
        return f"{name}-{self.r.choice(self.given).capitalize()}" if self.r.random() < 0.1 else name

    def name(self) -> str:
        r, f, s = self.r, self.first(), self.surname()
        kind = r.randrange(15)
        if kind >= 12:
            return self.name_of(r.choice(self.groups))
        if kind == 11:
            return r.choice([f"{f} {self.first()} {s}", f"{s} {self.first()} {f}", f"{f} {s} {self.surname()}", f"{f} {r.choice(['van der', 'de la', 'von', 'dos'])} {s}", "Nguyễn Văn " + f, f"{r.choice(['Trần', 'Phạm', 'Lê'])} Thị {f}"])
        text = [f"{f} {s}", f"{f} {s}", f"{f} {r.choice('ABCDEKLMRSV')}. {s}", f"{r.choice('ABCEKLMRSV')}. {s}", f"{s}, {f}", f"{s}, {r.choice('ABCDEKLM')}.", f"{f} {r.choice(['van', 'von', 'de'])} {s}", f"{r.choice('ABK')}. {r.choice('LMN')}. {s}", f"{f} {s}", f"{f} {s}", f"{s}, {f}"][kind]
        return text.upper() if kind in (0, 4, 8) and r.random() < 0.2 else text

    def name_of(self, group: list[list[str]]) -> str:
        r, f, s = self.r, self.r.choice(group[0]), self.r.choice(group[1])
        forms = [f"{f} {s}", f"{f} {s}", f"{s}, {f}", f"{f[0]}. {s}", f"{s} {f}"]
        if len(group) > 2:
            forms += [f"{s} {f} {r.choice(group[2])}", f"{f} {r.choice(group[2])} {s}", f"{s} {f[0]}. {r.choice(group[2])[0]}."]
        return r.choice(forms)

    def number(self, low: int = 1, high: int = 480) -> str:
        return str(self.r.randint(low, high))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, k = self.digits, self.r.randrange(23)
        return [
            f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(7)}", f"+{d(3)} {d(2)} {d(7)}", f"00{d(3)} {d(3)} {d(2)} {d(2)} {d(3)}", f"+44 {d(4)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 ({d(3)}) {d(3)} {d(4)}",
            f"+86 1{d(2)} {d(4)} {d(4)}", f"1{d(10)}", f"0{d(3)} {d(3)} {d(4)}", f"+{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}-{d(4)}-{d(4)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+91 {d(5)} {d(5)}", f"06-{d(8)}", f"({d(2)}) 9{d(4)}-{d(4)}", f"0{d(2)} {d(6)}", f"1{d(2)} {d(4)} {d(4)}", f"0{d(1)}-{d(3)} {d(3)} {d(2)}",
        ][k]

    def ident(self) -> str:
        d, k = self.digits, self.r.randrange(15)
        letter = lambda n=1: "".join(self.r.choice("ABCDEHKLMPQRTXYZ") for _ in range(n))
        return [
            f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"19{d(6)}-{d(4)}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter()}", f"{letter()}{d(2)}{letter()}{d(7)}{letter()}", f"{d(8)}{letter()}", f"{letter(2)}{d(7)}",
            f"{d(17)}{self.r.choice('0123X')}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(11)}", f"{letter(5)}{d(4)}{letter()}", f"{letter()}-{d(7)}-{letter()}", f"{d(6)}-{d(4)}", f"{letter(6)}{d(2)}{letter()}{d(2)}{letter()}{d(3)}{letter()}",
        ][k]

    def email(self) -> str:
        r = self.r
        user = r.choice([f"{self.first().lower()}.{self.surname().lower()}", f"{self.first().lower()}{self.number()}", f"{r.choice('abkm')}_{self.surname().lower()}+{r.choice(['home', 'list', 'shop'])}", self.surname().lower()])
        host = f"{self.syllables()}{r.choice(['', '-shop', '.mail'])}"
        tail = r.choice(["example", "invalid", "test", "com", "org", "de"])
        text = r.choice([f"{user}@{host}.{tail}", f"{user}@{host}.{tail}", f"{user}(at){host}.{tail}", f"{user} [at] {host} [dot] {tail}", f"{user} at {host} dot {tail}", f"{user}[at]{host}[dot]{tail}"])
        return text.upper() if "@" in text and r.random() < 0.2 else text

    def address(self) -> str:
        r, n, w = self.r, self.number, self.word()
        kind = r.randrange(12)
        street = r.choice(["Street", "Avenue", "Road", "Lane", "Court", "Close", "Drive", "Way"])
        return [
            f"{n()} {w} {street}", f"{n()} {w} {street}", f"{n()}-{r.choice('ABC')} {w} Avenue, Apt {n(1, 40)}", f"Flat {n(1, 50)}, {n()} {w} Close", f"{n()} Old {w} {r.choice(['Rd.', 'Blvd.', 'St.', 'Ave.'])}",
            f"{n()} {r.choice('NSEW')}. {w} Blvd., Suite {n(1, 99)}", f"{w}{r.choice(['straße', 'gasse', 'weg', 'allee'])} {n()}{r.choice(['', '', 'a', 'b'])}", f"{r.choice(['Calle', 'Avenida'])} {w} {n()}", f"{n()}, {r.choice(['rue', 'avenue'])} de {w}",
            f"{w}{r.choice(['straat', 'gata', 'laan', 'veien', 'gatan', 'vej'])} {n()}", f"{r.choice(['ul.', 'ulica'])} {w} {n()}", f"ул. {r.choice(['Ленина', 'Садовая', 'Мира'])}, д. {n(1, 90)}",
        ][kind]

    def company(self) -> str:
        return (self.syllables(3, 5) + self.r.choice(["ways", "plan", "tron", "mark", "dat", "line", "works", "net", "gen", "form", "lab", "co", "dor", "via", "tec", "con"])).capitalize()

    def code(self) -> str:
        signs = "0123456789" if self.r.random() < 0.25 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return self.r.choice("KTC") + "".join(self.r.choice(signs) for _ in range(6))

    def of(self, kind: str, capital: bool = False) -> str:
        """A word of a class of ``CONTEXT``."""
        found = self.r.choice(CONTEXT[kind].split())
        return found.capitalize() if capital else found

    def filler(self) -> list:
        r, w, c, n, d = self.r, self.word, self.company, self.number, self.digits
        q, many = f"{n()}.{d(2)}", f"{n(1, 90)},{d(3)}"
        titled = lambda k: " ".join(r.sample(TITLED, k))
        table = f"{r.choice(TITLED)} | size | Price\n{w()} | {q} | {q} kg | {self.code()}\n{w()} | {q} | {q} l | {self.code()}"
        return [r.choice([
            f"{r.choice(PLAIN).capitalize()}.", f"{r.choice(FOREIGN).capitalize()}.", f"{r.choice(PLAIN).capitalize()}, {r.choice(PLAIN)}.", f"{c()} sold {q} kg {self.of('place')} {w()}.", f"{self.of('place', True)} {w()}, {c()} {r.choice(['earned', 'verdiente', 'gagnait', 'ganaba'])} {n()} a day.",
            f"{self.of('place', True)} {w()} {r.choice(['and', 'und', 'et', 'y'])} {w()} {r.choice(PLAIN)}.", f"{self.of('place', True)} {w()} {r.choice(['and', 'und', 'et', 'y'])} {w()}, {c()} {self.of('act')} {r.choice(PLAIN + FOREIGN)}.", f"{self.of('thing', True)} {self.code()} {r.choice(PLAIN)} {self.of('place')} {w()}.", f"{titled(2)}: {many} visitors.", f"{titled(1)} {n()}\n\n{w()} {w()}", f"{titled(1)} {n()} {w()}\n",
            f"\n{titled(r.randint(2, 4)).upper()}\n", f"\n{w().upper()} {titled(1).upper()}\n", f"\n{w()} {titled(1)}\n", f"\n{titled(r.randint(2, 4))}\n", f"\n{w()}\n", f"{w()}, {w()}", f"{c()} {r.choice(TITLED).lower()}.", f"{self.of('place', True)} {w()}, {c()} {r.choice(FOREIGN)}.", table,
            f"{r.choice(PLAIN).upper()} {q} {r.choice('SMGVHLW')}. {r.choice([w, c])()} {r.choice(PLAIN)}.", f"{r.choice(PLAIN)} {q} {r.choice('smgvhlw')}/{r.choice('smh')}.".upper() + f" {r.choice(TITLED)} {self.code()} {r.choice(PLAIN)}.", f"{many} of {many} at {n(0, 23)}:{d(2)}", f"{c()}, {w()} {r.choice(['and', 'und', 'et'])} {c()} {r.choice(PLAIN)}.",
        ])]

    def decoy(self) -> list:
        r, w, c, d, n, thing = self.r, self.word, self.company, self.digits, self.number, self.of("thing", self.r.random() < 0.6)
        street = r.choice(["Street", "Avenue", "Lane", "Road"])
        firm = r.choice(["Ltd", "GmbH", "Corp", "Inc", "Office", "Agency", "Council", "Board", "Team"])
        after = sorted(THING_AFTER)
        return [r.choice([
            f"{thing} {d(3)}-{d(3)}-{d(5)}-{r.choice('ABC')} {r.choice(PLAIN)}.", f"{thing} {d(2)}-{d(2)}-{d(3)} {r.choice(PLAIN)}.", f"{thing} {n()}-{d(3)}-{d(3)} {self.of('place')} {w()} {street}.", f"{w()} {street} {r.choice(PLAIN)}.", f"{thing} {n(1, 90)} {w()} {r.choice(PLAIN)}.",
            f"The {w()} {c()} {r.choice(after)} says {n()} of {n()}.", f"{thing} {n(1, 20)}.{d(2)}.{d(3)}.{d(1)} {self.of('place')} {c()}.", f"{thing} {d(4)}+{d(2)}.{d(2)} @ {thing} {n()}.", f"{thing} {n()} of {n()}.", f"{thing} {d(3)}-{d(2)}-{d(4)} {r.choice(PLAIN)}.", f"{thing} {r.choice(['no.', 'number', 'Nr.', ''])} {d(4)}-{d(4)}-{d(4)} {self.of('place')} {w()}.",
            f"{w()} {c()} {self.code()} {w()} {c()} {self.code()}", f"The {w()} {w()} {r.choice(after)} {r.choice(PLAIN)}.", f"{c()} {firm} {r.choice(PLAIN)}, {d(2)}.{d(2)}.20{d(2)}.", f"{thing} {n(1, 9)}.{d(2)} {d(4)}/{d(4)} {d(2)}:{d(2)}.", f"{w()}, {w()} and {w()} {d(3)} {d(3)} {d(3)}.", f"{self.of('title', True)} {self.surname()} {r.choice(PLAIN)}.",
            f"{thing} {d(8)}, {d(3)} x {thing} {d(3)}-{d(2)}-{d(4)}.", f"{thing} {self.code()} {self.of('place')} {w()} {w()}.", f"{w()}, {w()} and {w()} {r.choice(PLAIN)}.", f"{self.of('place', True)} {w()} {w()} {street} {r.choice(PLAIN)}.", f"{d(3)} {d(3)} {d(4)} {r.choice(['cycles', 'turns', 'units', 'visits'])}.", f"{thing} {d(3)}-{d(3)}-{d(4)} {r.choice(PLAIN)}.",
            f"{' '.join(r.sample(TITLED, r.randint(2, 4)))} {r.choice(PLAIN)}.", f"{w()} {w()} {c()} {r.choice(PLAIN)}.", f"{r.choice(TITLED)} {w()} {firm} {r.choice(PLAIN)}.", f"{thing} {d(11)}; {thing} {d(10)}.", f"{r.choice(PLAIN).capitalize()}, {thing} {r.choice(['is ', '', ''])}97{r.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}.", f"{r.choice(PLAIN).capitalize()} {d(3)}-{d(1)}-{d(3)}-{d(5)}-{d(1)}.",
        ])]

    def personal(self) -> list:
        r = self.r
        N, P, I, E, A = (lambda k=k, fn=fn: (k, fn()) for k, fn in (("name", self.name), ("phone", self.phone), ("id", self.ident), ("email", self.email), ("address", self.address)))
        near = lambda kind: self.of(kind, r.random() < 0.5) + r.choice([" ", " ", ": "])
        end = lambda: r.choice([".", ".", ", ", "; ", "\n", f" {r.choice(PLAIN)}.", f", {r.choice(PLAIN)}.", f" {r.choice(FOREIGN)}."])
        title = lambda: r.choice(["Mr. ", "Ms. ", "Dr. ", "Herr ", "Mme ", "Sr. ", "Prof. ", "Mrs "])
        if r.random() < 0.1:
            before, names, after = r.choice(FRAMES_WITHOUT_CASE)
            return [before, ("name", r.choice(names.split("|") if "|" in names else names.split())), after, *([P(), "\n"] if after.endswith((" ", "电话 ")) else [])]
        forms = [
            lambda: [near("person"), N(), end()], lambda: [near("person"), r.choice(["", "a ", "an ", "to ", "by "]), N(), end()], lambda: [title(), N(), end()], lambda: [N(), f" {r.choice(PLAIN)}."], lambda: [N(), r.choice([" sang for us", " baked it", " hat gewonnen", " a chanté", " ha llamado", " won the prize", " will be away"]), end()],
            lambda: [near("address"), A(), end()], lambda: [near("person"), N(), r.choice([", ", " of ", " at ", " from "]), A(), end()], lambda: [A(), r.choice([", first floor", ", please ring twice", " is their home", ""]), end()], lambda: [near("phone"), P(), end()], lambda: [near("phone"), P(), r.choice([" (home)", " (office)", " after six", ""]), r.choice([" or ", ", ", " / "]), P(), end()],
            lambda: [near("id"), I(), end()], lambda: [self.of("thing", r.random() < 0.5), " ", near("id"), I(), end()], lambda: [self.of("id"), r.choice([" is ", " es ", " ist ", " est ", " è "]), I(), end()], lambda: [near("id"), r.choice(["no. ", "number ", "", ""]), I(), r.choice([" belongs to ", " of ", ", ", " - "]), N(), end()], lambda: [N(), " (", near("id"), I(), ")", end()], lambda: [near("person"), N(), " (", E(), ")", end()], lambda: [r.choice(["write to ", "Email: ", "mailto ", "or ", "an ", "à ", "a "]), E(), end()],
            lambda: [E(), ", ", E(), end()], lambda: [E(), " | ", P(), "\n"], lambda: [N(), ", ", P(), end()], lambda: [N(), "\n", A(), "\n", r.choice(["Tel. ", "Phone ", ""]), P(), "\n", E(), "\n"], lambda: [title(), N(), r.choice([" and ", " und ", " et ", " y "]), title(), N(), end()], lambda: [r.choice(PLAIN).capitalize(), ", said ", N(), end()],
            lambda: [near("person"), N(), r.choice([", ", " und ", " and "]), N(), end()], lambda: ["Best wishes,\n", N(), "\n"], lambda: [near("title"), N(), ", ", near("phone"), P(), "; ", near("id"), I(), end()], lambda: [r.choice(["Author: ", "Coach: ", "Patient: ", "Gast: ", "Élève : ", "Alumno: "]), N(), "\n"],
            lambda: [r.choice(FOREIGN).capitalize(), r.choice([", sagte ", ", a dit ", ", dijo ", ", disse "]), N(), end()], lambda: [r.choice(["Звонил ", "Подписал ", "Автор: "]), ("name", self.name_of(self.groups[r.choice((8, 9))])), end()], lambda: [N(), " ", self.of("act"), " ", r.choice(PLAIN), end()], lambda: [N(), " ", self.of("act"), " ", r.choice(FOREIGN), end()], lambda: [N(), " ", self.of("act"), " ", near("address"), A(), end()],
            lambda: [r.choice(PLAIN + FOREIGN), " ", r.choice(["a ", "to ", "from ", "by ", "for ", "an ", "de ", "von ", "with "]), N(), r.choice(["", " please", f" {r.choice(FOREIGN)}", f" {r.choice(PLAIN)}"]), end()],
            lambda: [r.choice(PLAIN).capitalize(), " ", r.choice(["from ", "to ", "by "]), N(), r.choice([" of ", " at ", ", "]), A(), end()], lambda: [r.choice(FOREIGN), " ", r.choice(["a ", "an ", "à ", "to "]), N(), r.choice([" al ", " at ", " au ", " unter "]), P(), end()], lambda: [r.choice(PLAIN), " to ", N(), " (", E(), ")", end()],
            lambda: [r.choice(["Tel: ", "Fax ", "☎ ", "M "]), P(), "\n"],
        ]
        return r.choice(forms)()

    def example(self) -> tuple[str, list[tuple[str, int, int]]]:
        parts: list = []
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.random()
            own = self.personal() if kind < 0.55 else self.decoy() if kind < 0.8 else self.filler()
            if kind >= 0.55 and self.r.random() < 0.2:
                own = [own[0].upper()]
            parts += [*own, self.r.choice([" ", " ", "\n", "\n\n"])]
        text, marks = "", []
        for p in parts:
            if isinstance(p, tuple):
                marks.append((p[0], len(text), len(text) + len(p[1])))
                text += p[1]
            else:
                text += p
        return text, marks


def _written(seed: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and type numbers of the candidates of written examples."""
    writer = Writer(seed)
    x, y, kinds = [], [], []
    for _ in range(count):
        text, marks = writer.example()
        true, context = set(marks), Context(text)
        for g, a, b in candidates(text):
            kind = GENERATORS[g][0]
            x.append(features(context, g, a, b))
            y.append((kind, a, b) in true)
            kinds.append(TYPES.index(kind))
    return np.array(x), np.array(y, float), np.array(kinds)


class Detector:
    """Fitted trees with calibration and thresholds."""

    def __init__(self, fit: int = FIT_EXAMPLES, held_out: int = HELD_OUT):
        x, y, _ = _written(1, fit)
        self.trees = Boosted(rounds=90).fit(x, y)
        x, y, kinds = _written(2, held_out)
        margin = self.trees.margin(x)
        self.curve = calibrate(margin, y)
        p = self.probability(margin)
        self.thresholds = np.array([min(0.9, max(0.1, best_threshold(p[kinds == k], y[kinds == k]))) for k in range(len(TYPES))])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * margin + b)))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The selected spans of each text, in order, without overlap."""
        owner, spans, rows = [], [], []
        for k, text in enumerate(texts):
            context = None
            for g, a, b in candidates(text) if text else ():
                context = context or Context(text)
                owner.append(k)
                spans.append((a, b, g))
                rows.append(features(context, g, a, b))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not rows:
            return out
        p = self.probability(self.trees.margin(np.array(rows)))
        good = p >= self.thresholds[[TYPES.index(GENERATORS[g][0]) for _, _, g in spans]]
        by: dict[int, list[tuple[float, int, int, str]]] = {}
        for j in np.flatnonzero(good):
            a, b, g = spans[j]
            by.setdefault(owner[j], []).append((-round(float(p[j]), 2) - 0.004 * min(b - a, 60) / 60, a, b, GENERATORS[g][0]))
        for k, found in by.items():
            taken: list[tuple[int, int, str]] = []
            for _, a, b, kind in sorted(found):
                if all(b <= c or d <= a for c, d, _ in taken):
                    taken.append((a, b, kind))
            out[k] = sorted(taken)
        return out


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, pii_type, pii_text``: every distinct selected piece of each row. A narrow stage but for the final
    distinct over the findings."""
    sent = df.sparkSession.sparkContext.broadcast(detector())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            at, kinds, pieces = [], [], []
            for k, spans in enumerate(sent.value.find(texts)):
                for a, b, kind in spans:
                    at.append(k)
                    kinds.append(kind)
                    pieces.append(texts[k][a:b])
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(len(keys))), pa.array(kinds, pa.string()), pa.array(pieces, pa.string())], [*keys, "pii_type", "pii_text"])

    types = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(find, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", pii_type string, pii_text string").distinct()


def redact_personal(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, text`` with typed placeholders instead of the selected pieces; one row for each row."""
    sent = df.sparkSession.sparkContext.broadcast(detector())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            done = [t if t is None else redact(t, s) for t, s in zip(texts, sent.value.find(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keys))), pa.array(done, pa.string())], [*keys, text])

    types = dict(df.dtypes)
    return df.select(*keys, text).mapInArrow(clean, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{text}` string")


def p6_found(spark, sf_dir: str) -> DataFrame:
    return find_personal(pages_and_chunks(spark, sf_dir), ["item_kind", "item_id"])


def p6_check(spark, sf_dir: str) -> DataFrame:
    """``item_kind, item_id, kept``: whether the text between the placeholders of each redacted item stands in its text, in order, with
    nothing but the redacted pieces left out. One row for each item with a text."""
    keys = ["item_kind", "item_id"]
    items = pages_and_chunks(spark, sf_dir).where("text IS NOT NULL").dropDuplicates(keys)
    found = find_personal(items, keys).groupBy(*keys).agg(F.sort_array(F.collect_set(F.length("pii_text"))).alias("sizes"))
    both = redact_personal(items.withColumn("whole", F.col("text")), [*keys, "whole"]).join(found, keys, "left")
    mark = r"\[(?:EMAIL|PHONE|ID|ADDRESS|NAME)\]"
    kinds = F.coalesce(F.size("sizes"), F.lit(0))
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace("text", mark, "\\\\E(?s:.+?)\\\\Q"), F.lit("\\E"))
    kept = F.when(kinds <= 0, F.col("text") == F.col("whole")).otherwise(F.expr("whole RLIKE concat('^', q, '$')"))
    return both.withColumn("q", quoted).select(*keys, kept.alias("kept"))


P6_CHECK_SQL = """
SELECT DISTINCT item_kind, item_id, true AS kept FROM (
  SELECT 'page' AS item_kind, page_seq AS item_id, text FROM pdf_pages
  UNION ALL SELECT 'chunk', chunk_seq, text FROM chunks) t WHERE text IS NOT NULL
"""


def p6_redacted(spark, sf_dir: str) -> DataFrame:
    return redact_personal(pages_and_chunks(spark, sf_dir), ["item_kind", "item_id"]).distinct()
