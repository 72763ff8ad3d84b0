"""Problem 9: sentences of every document, across languages and scripts.

A text is cut into blocks at blank lines, and blocks into units: headings and list items by themselves, runs
of prose lines together. In spaced scripts the possible terminators of a run form a lattice; an arc from one
sentence end to the next is scored from the terminator, the word before it (abbreviations, initials, ordinals),
the word after it, quotation marks and how the sentence began, and the best path gives the sentences. In
scripts without spaces, text between gaps is segmented by the cheapest path through a lattice of dictionary
words; whether a gap ends a sentence is decided by a logistic rule over the final particle or linking word before it,
the opening or linking word after it, the verbs on both sides and the length of both stretches. Its weights are fitted
to sentences of general prose. Stretches are segmented whole, and once. In Chinese and Japanese a gap within a line is an end
only where a final word before it says so, alone or with an opening word after it.

Defined cases: null, empty and blank texts have no sentence; a text without terminator is one sentence; white
space around a sentence belongs to none; repeated documents count once; very long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations that a name, number or further word follows, without their last dot.
GOES_ON = set(
    "dr prof mr mrs ms mx st ste sgt capt col gen lt maj rev hon gov sen rep pres fr hr hrn frl dipl ing messrs fig figs eq eqs sec secs ch chap vol vols pp p no nos nr nrn art arts tab tbl app ex cf viz vs v resp approx appr ca circa c i.e e.g "
    "ie eg abb bd bsp bzgl bzw d.h z.b u.a s.o s.u vgl evtl ggf inkl exkl max min mind mio mrd kap abs abt tel str hl z.t u.u i.d.r v.a gem geb lfd sog allg "
    "m mm mme mlle mgr env p.ex par.ex éd vers av boul bld réf cit n sr sra srta srs dra dn da ud uds vd núm num pág págs aprox p.ej ej cap caps máx mín edo avda dpto "
    "рис табл см ср стр гл разд п пп ст ул пр-т д кв им т.е т.ч т.к т.н напр акад проф др-а г-н г-жа тыс млн млрд руб коп долл в.т.ч e.t.c د أ م ص رقم डॉ श्री प्रो क्र पृ सं jan feb febr mär apr jun jul aug sept sep okt oct nov dez dec".split()
)
# Abbreviations that may end a sentence, which then shows by a capital after them.
MAY_END = set("etc usw usf u.s.w u.v.m a.m p.m am pm corp inc ltd co llc plc gmbh al u.s u.k u.s.a e.u ft in lb oz hrs min h jr sr esq ph.d m.d b.c a.d u.a.m г гг др пр т.д т.п и.т.д и.т.п ud uds vds s.a ee.uu bros dept est".split())
# Months and the like that follow an ordinal.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jh janvier enero tag stock etage kapitel klasse mal".split())
# Capitalised words that begin a sentence far more often than they go on with one.
OPENERS = set("the a an this that these those it he she they we you i there in on at by for from with when where while if as after before because since although but and or so no not who what why how is are was were do does did none two three one late each every all some many most der die das ein eine es er sie wir man im am bei zwischen falls laut vgl nach für mit wenn weil aber und le la les l un une il elle on nous ce cette ces si dans à au en entre selon pour avec el los las lo unos según si por para con y pero в на по у и но он она они это как при с за из от для если".split())

OPEN_CLOSE = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "〈": "〉", "《": "》", "‘": "’", '"': '"', "＂": "＂"}
BRACKETS = set("([（【")
QUOTES = re.compile("[" + re.escape("".join(sorted({*OPEN_CLOSE, *"".join(OPEN_CLOSE.values())}))) + "]")
CLOSERS = "\"'”’»›」』)]）】〉》“"
ONLY_CLOSERS = re.compile(r"[\s" + re.escape(CLOSERS) + "]*")
SAYS_ON = re.compile(r"\s*(?:と|って|の|は|が|を|に|で|も|的|地|得)")
TERMINATOR = re.compile(r"[.!?…؟۔।॥。！？｡．]+")
WIDE = set("。！？｡")
WIDE_SCRIPT = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
NO_CASE = re.compile(r"[֐-ࣿऀ-෿฀-࿿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")
SPACELESS = re.compile(r"[฀-໿က-႟ក-៿]")

LINE = re.compile(r"[^\r\n\u0085  ]*(?:\r\n|[\r\n\u0085  ]|$)")
MARK = re.compile(r"\s*(?:[-–—*•‣▪●◦·・＊]\s+|[•‣▪●・]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5}|[०-९]{1,3}|[٠-٩]{1,3}|[๐-๙]{1,3}|[一二三四五六七八九十]{1,3})[.)、）]\s*(?=\S))")
SAFE_MARK = re.compile(r"\s*(?:[-–—*]\s+|[•‣▪●◦・]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[)）]\s+|\d{1,3}[.、]\s+(?=\D))")
LETTER_MARK = re.compile(r"\s*(?:[a-zA-Z]|[ivxIVX]{2,5})\.\s")
HEADING = re.compile(
    r"\s*(?:#{1,6}\s+\S.*|(?:chapter|section|part|appendix|annex|kapitel|abschnitt|teil|anhang|chapitre|section|partie|annexe|cap[ií]tulo|secci[oó]n|parte|anexo|глава|раздел|часть|приложение|الفصل|القسم|अध्याय|भाग|บทที่|ส่วนที่)\s+[\dIVXivx०-९٠-٩๐-๙]+(?:\.\d+)*\s*(?:[:.–—-]?\s*.{0,70})?|第\s*[\d一二三四五六七八九十百]+\s*[章节節部].{0,40}|\d+(?:\.\d+)+\.?\s+\S.{0,80}|\d+\s+[^\W\d_].{0,60})\s*$",
    re.I,
)
TOKEN = re.compile(r"[^\W_][\w’'\-]*")


# --- blocks and units ----------------------------------------------------------------------------------------


def lines_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each line, line break excluded."""
    out, at = [], 0
    while at < len(text):
        m = LINE.match(text, at)
        end = m.end()
        stop = end
        while stop > at and text[stop - 1] in "\r\n\u0085  ":
            stop -= 1
        out.append((at, stop))
        if end == at:
            break
        at = end
    return out


def _ends_well(line: str) -> bool:
    return bool(re.search(r"[.!?…؟۔।॥。！？:：;；]+[\"'”’»›」』)\]）】]*\s*$", line))


def _upper_start(line: str) -> bool:
    m = re.search(r"[^\W_]", line)
    return bool(m) and (m.group().isupper() or m.group().isdigit() or not m.group().islower())


def _is_heading(line: str, before: str | None, after: str | None) -> bool:
    """Whether a line of a block is a heading, given its neighbours in the block."""
    bare = line.strip()
    if not bare or len(bare) > 90 or re.search(r"[.!?…。！？,;；，、]$", bare):
        return False
    if before is not None and not _ends_well(before) and not HEADING.match(before):
        return False
    if after is not None and not (_upper_start(after) or SAFE_MARK.match(after)):
        return False
    letters = [c for c in bare if c.isalpha()]
    if HEADING.match(line):
        return True
    if len(letters) >= 4 and bare.isupper() and len(bare) <= 60 and not NO_CASE.search(bare):
        return after is None or not after.strip().isupper()
    return before is None and after is not None and len(bare) <= 50 and 2 <= len(bare.split()) <= 8 and not NO_CASE.search(bare) and len(after.strip()) > len(bare)


def units_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, whole)`` of the units: headings and list items are whole, runs of prose are not."""
    block: list[tuple[int, int]] = []
    for a, b in [*lines_of(text), (len(text), len(text))]:
        if text[a:b].strip():
            block.append((a, b))
            continue
        if block:
            yield from _units_of_block(text, block)
            block = []


def _units_of_block(text: str, block: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    body = [text[a:b] for a, b in block]
    start, whole = None, False
    lettered = bool(LETTER_MARK.match(body[0]))  # may be an initial, so further lines have to be marked as well
    listed = bool(MARK.match(body[0])) and (not lettered or any(LETTER_MARK.match(x) for x in body[1:]))
    in_list = False
    for k, (a, b) in enumerate(block):
        line = body[k]
        before, after = body[k - 1] if k else None, body[k + 1] if k + 1 < len(body) else None
        mark = bool(MARK.match(line) if listed and (lettered or not LETTER_MARK.match(line)) else SAFE_MARK.match(line))
        item = mark and (k == 0 and listed or in_list or k > 0 and _ends_well(before))
        if not item and mark and k > 0 and after is not None and SAFE_MARK.match(after):
            item = True
        if item or _is_heading(line, before, after) and not in_list:
            if start is not None:
                yield start, block[k - 1][1], whole
            if item:
                start, whole, in_list = a, True, True
            else:
                yield a, b, True
                start, whole = None, False
        elif start is None:
            start, whole, in_list = a, False, False
        elif whole and in_list and _ends_well(before) and _upper_start(line) and not line.startswith((" ", "\t")):
            yield start, block[k - 1][1], whole
            start, whole, in_list = a, False, False
    if start is not None:
        yield start, block[-1][1], whole


# --- spaced scripts: a lattice of terminators ---------------------------------------------------------------


def quoted(text: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotation marks or brackets, as ``(open, close)``."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    straight = 0  # open straight quotation marks

    def close(k: int) -> None:
        at, _ = stack.pop()
        while out and out[-1][0] > at:  # what it encloses
            out.pop()
        out.append((at, k))

    for m in QUOTES.finditer(text):
        k, c = m.start(), m.group()
        if stack and c in OPEN_CLOSE[stack[-1][1]] and not (c == '"' and stack[-1][1] != '"'):
            straight -= stack[-1][1] == '"'
            close(k)
        elif c == '"' and straight:
            while stack[-1][1] != '"':
                stack.pop()
            straight -= 1
            close(k)
        elif c in OPEN_CLOSE:
            if c == "‘" or (c in "“" and stack and stack[-1][1] == "„"):
                continue
            if c == '"' and k and text[k - 1].isdigit() and not (k + 1 < len(text) and text[k + 1].isalnum()):
                continue
            straight += c == '"'
            stack.append((k, c))
    return out


def _next_token(text: str, at: int) -> tuple[str, str]:
    """The first sign after white space, and the word that begins there."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at == len(text):
        return "", ""
    m = TOKEN.match(text, at) or TOKEN.match(text, at + 1)
    return text[at], m.group() if m else ""


LETTER = re.compile(r"[^\W_]")
ITEM_START = re.compile(r"\s*[\w.)]{1,4}[.)]\s")
LEAST, MOST, PASSED = -5.0, 5.0, 0.5


class Cut:
    """A place where a sentence may end, with what does not depend on where the sentence began."""

    __slots__ = ("end", "score", "needs_lower", "quote_open", "sure")

    def __init__(self, end: int, score: float, needs_lower: bool = False, quote_open: int = -1):
        self.end, self.score, self.needs_lower, self.quote_open = end, score, needs_lower, quote_open
        self.sure = score >= 3 and not needs_lower and quote_open < 0


def _word_start(text: str, at: int) -> int:
    """Where the run without white space and wide signs begins that ends at ``at``."""
    while at and not text[at - 1].isspace() and not WIDE_SCRIPT.match(text[at - 1]):
        at -= 1
    return at


def dot_score(text: str, at: int, end: int, sign: str, word: str) -> tuple[float, bool]:
    """Score of a single dot at ``at`` whose closers end at ``end``; whether it only holds where the sentence
    began in lower case. ``sign`` and ``word`` follow it."""
    start = _word_start(text, at)
    last = text[start:at].lstrip(CLOSERS + "([{«„“‘¿¡")
    stop = start
    while stop and text[stop - 1].isspace():
        stop -= 1
    previous = text[_word_start(text, stop) : stop]
    compact = last.lower()
    if previous.endswith(".") and len(previous) <= 4 and len(last) <= 2:
        compact = (previous.lstrip("([{«„“") + last).lower()
    last = re.split(r"[.\-–—/]", last)[-1]
    upper = sign.isupper() or (sign.isalpha() and not sign.islower()) or sign in "¿¡«„“\"‘(["
    lower = sign.islower()
    short = last.lower() if len(last) > 1 or NO_CASE.match(last) or previous[-1:].isdigit() is False else ""
    unit = len(last) == 1 and previous[-1:].isdigit() and last.islower()
    known = not unit and (compact in GOES_ON or short in GOES_ON)
    may = (compact in MAY_END or last.lower() in MAY_END) and not (len(last) == 1 and last.isupper())
    if last.lower() == "no" and not sign.isdigit():
        known = last == "No"
    if last.lower() in ("in", "min", "co", "est", "am", "pm", "max", "sec", "ch", "art", "ex", "app", "m", "n", "v", "c", "ca", "da", "ing", "gen", "par", "str", "tab", "mal") and len(last) > 1 and compact == last.lower():
        known = known and (sign.isdigit() or last[0].isupper() and last.lower() not in ("in", "am", "da"))
        may = may and last.lower() not in ("in", "am", "est", "min", "co")
    if may:
        if upper:
            return (2.5 if word.lower() in OPENERS or not known else -2.0), False
        return (-3.0 if lower else 0.5 if sign.isdigit() else 1.0), False
    if known:
        return -4.0, False
    if len(last) == 1 and last.isalpha() and not NO_CASE.match(last):
        if last.isupper() or not previous[-1:].isdigit():  # an initial or half an abbreviation; after a number, a unit
            return -3.0, False
    if last.isdigit() and len(last) <= 2 and word.lower() in MONTHS:
        return -3.0, False
    if lower:
        return 1.5, True
    return (4.0 if upper or sign.isdigit() or not sign.isalnum() else 3.0), False


def cuts_of(text: str) -> list[Cut]:
    """The possible sentence ends of a run, in order; the end of the run is not among them."""
    pairs = quoted(text)
    opens = [a for a, _ in pairs]
    opening = set(opens)
    cuts: list[Cut] = []
    caseless = bool(NO_CASE.search(text))
    last = len(text.rstrip())
    for m in TERMINATOR.finditer(text):
        a, b = m.span()
        k = bisect_right(opens, a) - 1
        inside = k >= 0 and a < pairs[k][1]
        end = b
        if inside:
            close = pairs[k][1]
            if ONLY_CLOSERS.match(text, b, close).end() < close:
                continue
            end = close + 1
        while end < len(text) and text[end] in CLOSERS and not (text[end] in '"' and end in opening) and text[end] not in "“(":
            end += 1
        if end >= last:
            continue
        wide = bool(WIDE & set(m.group()))
        follows = text[end]
        if not wide and not follows.isspace() and not inside and not WIDE_SCRIPT.match(follows):
            continue
        if not wide and not follows.isspace() and not (inside and caseless) and not WIDE_SCRIPT.match(follows):
            continue
        sign, word = _next_token(text, end)
        signs = m.group()
        if inside:
            bracket = text[pairs[k][0]] in BRACKETS
            if sign.islower() or sign in ",;:、，；：–—-)）" or SAYS_ON.match(text, end):
                continue
            if bracket:
                inner = text[pairs[k][0] + 1 : pairs[k][0] + 2]
                if signs == "." and not (inner.isupper() or caseless):
                    continue
                cuts.append(Cut(end, 3.0, quote_open=pairs[k][0]))
            else:
                cuts.append(Cut(end, 3.0, quote_open=pairs[k][0]))
            continue
        if wide:
            cuts.append(Cut(end, 5.0))
        elif "…" in signs or signs.startswith(".."):
            if WIDE_SCRIPT.match(sign or " ") or sign.islower() or not (sign.isupper() or NO_CASE.match(sign or " ")):
                continue
            cuts.append(Cut(end, 1.0 if a and not text[a - 1].isspace() else 0.5))
        elif signs == ".":
            score, needs_lower = dot_score(text, a, end, sign, word)
            if score > 0:
                cuts.append(Cut(end, score, needs_lower))
        elif sign.islower():
            cuts.append(Cut(end, 1.5, True))
        else:
            cuts.append(Cut(end, 4.0))
    if caseless and WIDE_SCRIPT.search(text):
        for m in WIDE_GAP.finditer(text):
            a, b = m.span()
            k = bisect_right(opens, a) - 1
            if not (k >= 0 and a < pairs[k][1]) and wide_gap_ends(text[max(0, a - 12) : a], text[b : b + 12]):
                cuts.append(Cut(a, 2.5))
        cuts.sort(key=lambda c: c.end)
    return cuts


class Start:
    """A place where a sentence may begin, with what every arc from it needs."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        first = LETTER.search(text, at)
        self.first = first.start() if first else len(text)
        self.lower = bool(first) and first.group().islower() and not ITEM_START.match(text, at)
        token = TOKEN.search(text, at)
        token = TOKEN.search(text, token.end()) if token else None
        self.second = token.start() if token else len(text)

    def arc(self, cut: Cut, caseless: bool) -> float:
        """Score of a sentence from here to ``cut``."""
        text = self.text
        if self.first >= cut.end:
            return -5.0
        if cut.needs_lower and not self.lower:
            return -1.0
        if cut.quote_open >= 0:
            bare = text[self.at : cut.quote_open].isspace() or self.at == cut.quote_open if self.first > cut.quote_open else False
            if text[cut.quote_open] in BRACKETS:
                return cut.score if bare else -1.0
            if bare:  # a quotation that opens the sentence is followed by who said it
                sign, _ = _next_token(text, cut.end)
                return -1.0 if caseless or not sign.isupper() and not sign.isdigit() else 0.5
            return cut.score
        if self.second >= cut.end and cut.score < 4:
            return cut.score - 1.0
        return cut.score


def best_path(text: str) -> list[int]:
    """Sentence ends of a run of a spaced script: the best path through the lattice of its terminators.

    A start is given up as soon as no arc from it can win any more: arcs score between ``LEAST`` and ``MOST``, and each
    end that an arc passes over though it would have done costs ``PASSED``.
    """
    cuts = cuts_of(text)
    caseless = bool(NO_CASE.search(text))
    ends: list[int] = []
    base, k = 0, 0
    while k < len(cuts):
        stop = k
        while stop < len(cuts) - 1 and not cuts[stop].sure:
            stop += 1
        nodes = [base, *(c.end for c in cuts[k : stop + 1])]
        best: list[tuple[float, int]] = [(0.0, -1)]
        open_: list[list] = [[0, Start(text, base), 0]]  # node, start, ends passed over
        for j in range(1, len(nodes)):
            cut, found = cuts[k + j - 1], None
            for o in open_:
                arc = o[1].arc(cut, caseless)
                value = best[o[0]][0] + arc - PASSED * o[2]
                if found is None or (value, o[0]) > found:
                    found = (value, o[0])
                o[2] += arc > 0
            best.append(found)
            if j + 1 < len(nodes):
                open_.append([j, Start(text, nodes[j]), 0])
                least = max(best[o[0]][0] - PASSED * o[2] for o in open_) + LEAST
                open_ = [o for o in open_ if best[o[0]][0] - PASSED * o[2] + MOST >= least]
        reached = [j for j in range(len(nodes)) if j == 0 or best[j][0] >= 0]
        at = max(reached, key=lambda j: (best[j][0], j))
        path = []
        while at > 0:
            path.append(nodes[at])
            at = best[at][1]
        ends += sorted(path)
        if path:
            base = max(path)
        k = stop + 1
    return ends


# --- scripts without spaces: a lattice of dictionary words ----------------------------------------------------

# Words of Thai, Lao, Khmer and Burmese that tell whether a sentence goes on over a gap. What is polite
# or asks ends a sentence whatever follows; the other final words may also stand within one.
POLITE = "ครับ ค่ะ คะ นะ หรือไม่ ไหม มั้ย จ้ะ สิ ล่ะ ເດີ ទេ တယ် ပါ".split()
FINAL = [*POLITE, *"แล้ว ทันที ด้วย เลย ไป มา อยู่ ได้ ไว้ เท่านั้น กัน เอง อีก ແລ້ວ ໄດ້ ហើយ သည်".split()]
LINKS_ON = "และ หรือ กับ ของ ที่ ใน จาก ถึง โดย เพื่อ ใกล้ แห่ง ต่อ ตาม ระหว่าง คือ เป็น ว่า จะ ไม่ ซึ่ง ให้ แต่ เพราะ เนื่องจาก ต้อง กำลัง เคย ราว ประมาณ เกือบ ແລະ ຫຼື ຂອງ ທີ່ ໃນ និង ឬ នៅ ដែល နှင့်".split()
GOES_ON_WITH = "และ หรือ ซึ่ง ที่ เพื่อ โดย เพราะ แต่ จึง ก็ ว่า ของ กับ คัน เมตร ครั้ง บาท คน ตัว ใบ ชิ้น กิโลเมตร เซนติเมตร มิลลิเมตร องศา เปอร์เซ็นต์ ปี วัน ชั่วโมง นาที เมื่อ หลัง ระหว่าง ทันที ແລະ ຫຼື ທີ່ និង ដែល".split()
# Words that open a sentence only where what they begin is as long as a clause; else they may name an item of a list.
THINGS = "หัวหน้า แผ่น งาน ราว ทาง ท่อ ป้าย สัญญาณ รอยต่อ ไหล่ ใน จาก ตาม การ ความ ผู้ คณะ บริษัท".split()
OPENING = [*THINGS, *"มี เขา เธอ เรา ผม ฉัน คุณ นาย นาง นี่ นั่น นี้ วันนี้ เมื่อวาน ถ้า หาก ดังนั้น อย่างไรก็ตาม นอกจาก ທ່ານ ຂ້ອຍ".split()]
# Words that end like a final particle.
NOT_FINAL = "ชนะ".split()
# Everyday verbs, nouns and titles of Thai, and words before numbers and units.
VERBS = "ทำ กิน ดื่ม นอน เดิน วิ่ง นั่ง ยืน พูด บอก กล่าว ถาม ตอบ อ่าน เขียน ฟัง ดู เห็น มอง คิด รู้ เข้าใจ จำ ลืม รัก ชอบ เกลียด กลัว อยาก ต้องการ ซื้อ ขาย จ่าย รับ ส่ง เปิด ปิด เริ่ม หยุด เรียน สอน ทำงาน เล่น ช่วย ใช้ สร้าง ซ่อม วัด ตรวจ พบ หา เจอ ออก เข้า กลับ ขึ้น ลง ผ่าน ตก เกิด ตาย อาศัย เดินทาง ประกาศ รายงาน สั่ง ขอ ยืม คืน เก็บ ล้าง ตัด ปลูก เลี้ยง ชนะ แพ้ เปลี่ยน เพิ่ม ลด ติดตั้ง เสนอ แนะนำ ตัดสินใจ ได้รับ แสดง ขายดี ขับ จอด ชวน เชิญ".split()
NOUNS = "บ้าน วัด โรงเรียน โรงพยาบาล ตลาด ร้าน ถนน รถ รถไฟ รถเมล์ เรือ น้ำ ข้าว อาหาร ผลไม้ ผัก ปลา หมู ไก่ หมา แมว นก ต้นไม้ ดอกไม้ ภูเขา ทะเล แม่น้ำ ฝน ลม แดด หนังสือ กระดาษ ปากกา โต๊ะ เก้าอี้ ประตู หน้าต่าง เสื้อ กางเกง รองเท้า เงิน ราคา สินค้า บริษัท ครู นักเรียน หมอ ตำรวจ พ่อ แม่ ลูก พี่ น้อง เพื่อน เด็ก ผู้ชาย ผู้หญิง ประเทศ เมือง หมู่บ้าน จังหวัด เวลา เช้า เย็น กลางคืน เดือน สัปดาห์ ปัญหา ข่าว ภาษา เพลง ภาพ".split()
TITLES = "นาย นาง นางสาว คุณ ดร. เด็กชาย เด็กหญิง พระ อาจารย์ ท้าว ນາຍ ນາງ ທ່ານ".split()
KINDS = [POLITE, FINAL, LINKS_ON, GOES_ON_WITH, OPENING, VERBS, NOUNS, TITLES]
COSTS = {**{w: 0.9 for w in NOUNS}, **{w: 0.9 for w in VERBS}, **{w: 0.9 for w in OPENING}, **{w: 0.85 for w in TITLES}, **{w: 0.8 for w in GOES_ON_WITH}, **{w: 0.8 for w in LINKS_ON}, **{w: 0.7 for w in FINAL}, **{w: 0.6 for w in NOT_FINAL}}
_SETS = [frozenset(k) for k in (POLITE, FINAL, LINKS_ON, GOES_ON_WITH, OPENING, VERBS, TITLES, THINGS)]
#: Signs that never begin a word, since they are written on the sign before, and signs that never end one.
LEANS, LEADS = re.compile(r"[\u0e30-\u0e3a\u0e45-\u0e4e\u0eb0-\u0ebc\u0ec6-\u0ecd]"), re.compile(r"[\u0e40-\u0e44\u0ec0-\u0ec4]")
#: Signs from which a stretch may be a clause.
CLAUSE_SIGNS = 16
# General prose, by which gaps are told: ``|`` is a gap that ends a sentence, ``_`` one that does not.
GAPS = [
    "เมื่อเช้าฝนตกหนักมาก|เด็กๆจึงเล่นอยู่ในบ้าน", "แม่ไปตลาดตั้งแต่เช้า|พ่อนั่งอ่านหนังสือพิมพ์อยู่หน้าบ้าน", "นาย_สมศักดิ์_รักไทย_บอกว่าปีนี้ข้าวราคาดี", "ราคา_250_บาท", "เขาซื้อปลา_ไก่_และผักมาทำอาหารเย็น", "ร้านนี้เปิด_8_โมงเช้า|ปิดตอนสามทุ่ม",
    "ครูถามนักเรียนว่า_ใครทำการบ้านเสร็จแล้ว", "ขอบคุณมากครับ|แต่วันนี้ผมไม่ว่าง", "วันนี้อากาศดี|เราควรออกไปเดินเล่นกัน", "พี่ชายของฉันทำงานที่โรงพยาบาล|ส่วนน้องสาวยังเรียนอยู่", "ถ้าฝนตก_เราจะเลื่อนการแข่งขันออกไป", "ประเทศไทยมี_77_จังหวัด|กรุงเทพมหานครเป็นเมืองหลวง",
    "หนังสือเล่มนี้ราคา_120_บาท|ฉันซื้อมาจากร้านใกล้วัด", "เธอชอบดนตรี_กีฬา_ภาพยนตร์_และการเดินทาง", "ดร.สุภา_แสงทอง_กล่าวว่า_ปัญหานี้แก้ได้ไม่ยาก", "รถไฟออกเวลา_9.30_น.|ผู้โดยสารต้องมาถึงก่อนครึ่งชั่วโมง", "แมวนอนอยู่บนเก้าอี้|มันไม่ยอมลงมากินข้าว", "คุณพ่อชอบปลูกต้นไม้|หลังบ้านจึงมีดอกไม้เต็มไปหมด",
    "เมื่อวานฉันไปทะเลกับเพื่อน|เราเห็นปลาตัวใหญ่มาก", "นักเรียนทั้งหมด_35_คน_เดินทางไปพิพิธภัณฑ์", "ตำรวจประกาศให้ปิดถนน_เพราะน้ำท่วมสูง", "คุณจะไปไหนคะ|ฉันจะไปตลาดค่ะ", "สินค้าใหม่_ราคา_99_บาท_ขายดีมาก", "เขาตอบว่า_ยังไม่รู้_แต่จะลองถามหมอดู",
    "นางสาว_วิไล_ใจงาม_ได้รับรางวัลครูดีเด่น", "หมู่บ้านนี้อยู่ใกล้แม่น้ำ|ชาวบ้านส่วนใหญ่เลี้ยงปลา", "ฉันไม่ชอบกาแฟ|ฉันชอบชามากกว่า", "ประตูเปิดออก|มีผู้ชายคนหนึ่งเดินเข้ามา", "เพื่อนของผม_ซึ่งเป็นหมอ_ย้ายไปอยู่ต่างประเทศ", "เดือนหน้าบริษัทจะเพิ่มเงินเดือน|พนักงานทุกคนดีใจมาก",
    "วัดแห่งนี้สร้างเมื่อ_พ.ศ._2310_โดยชาวบ้าน", "ลมแรงมาก|เรือออกจากท่าไม่ได้", "ข่าววันนี้_รัฐบาลเสนอให้ลดภาษี", "เด็กหญิง_มะลิ_เขียนจดหมายถึงแม่|แม่อ่านแล้วร้องไห้", "กรุณารอสักครู่ค่ะ|พนักงานกำลังมา", "โรงเรียนหยุดสามวัน|นักเรียนกลับบ้านต่างจังหวัด", "ผมซ่อมรถเสร็จแล้ว|พรุ่งนี้ขับไปทำงานได้เลย",
    "ไปก่อนนะครับ|ลาก่อน", "กินข้าวค่ะ|ล้างมือ", "นอนเถอะครับ|ดึกแล้ว", "แดดออก|เราเล่น", "น้ำขึ้น|เขากลับ", "ไฟดับ|ผมกลัว", "หมาเห่า|เธอตื่น", "ลมพัด_ใบไม้ร่วง", "ข้าวสวย_แกงไก่", "ฟ้าร้อง_ฟ้าผ่า", "เงินหมด|ฉันกลับ", "ຝົນຢຸດ|ຂ້ອຍກັບ", "ໄຟດັບ|ທ່ານນອນ", "ລົມພັດ_ໃບໄມ້ລົ່ນ",
    "ມື້ນີ້ຝົນຕົກແຮງຫຼາຍ|ພວກເຮົາຈຶ່ງຢູ່ເຮືອນ", "ລາຄາ_500_ກີບ", "ລາວຊື້ປາ_ຜັກ_ແລະ_ໝາກໄມ້",
]
#: Sentence marks of Khmer and Burmese; a text that has them ends its sentences with them.
MARKED = re.compile(r"[។៕။]")
# How Chinese and Japanese sentences end, surely or perhaps, and how they open or go on.
WIDE_FINAL = tuple("です ます でした ました ません ませんでした でしょう ましょう ください ですか ますか 吗 呢 吧".split())
WIDE_MAYBE = tuple("た だ る よ ね か 了".split())
WIDE_OPENING = tuple("しかし そして また では それでは 次に 続いて この その あの これ それ ここ 私 彼 今日 昨日 明日 但是 然而 因此 所以 另外 首先 其次 最后 我 你 他 她 这 那 今天 昨天 明天".split())
WIDE_GOES_ON = tuple("が けど けれど から ので のに と って は を に で も や の へ 的 地 得 和 与 或 及 而".split())
WIDE_GAP = re.compile(rf"(?<={WIDE_SCRIPT.pattern})[ \t\u00a0\u3000]+(?={WIDE_SCRIPT.pattern})")
LONGEST = max(map(len, COSTS))


def segment(text: str) -> list[str]:
    """The cheapest path through the lattice of dictionary words; what no word covers costs 1 a sign. No word begins
    with a sign that leans on the one before, or ends with one that leads the next."""
    n = len(text)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
    for k in range(n):
        cost = best[k][0]
        if cost + 1 < best[k + 1][0]:
            best[k + 1] = (cost + 1, k)
        if LEANS.match(text, k) or k and LEADS.match(text, k - 1):
            continue
        for size in range(2, min(LONGEST, n - k) + 1):
            word = text[k : k + size]
            if word in COSTS and cost + COSTS[word] < best[k + size][0] and not LEANS.match(text, k + size):
                best[k + size] = (cost + COSTS[word], k)
    words, at = [], n
    while at:
        words.append(text[best[at][1] : at])
        at = best[at][1]
    return words[::-1]


class Stretch:
    """A stretch between two gaps: its words, and what the rule asks of them."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.thai = bool(SPACELESS.search(text))
        words = segment(text) if self.thai else [text]
        self.first, self.last = (words[0], words[-1]) if words else ("", "")
        self.verbs = sum(w in _SETS[5] for w in words)
        self.links = sum(w in _SETS[2] for w in words)
        self.title = any(text.startswith(t) for t in TITLES)


def gap_features(left: Stretch, right: Stretch, said: int, verbs: int) -> list[float]:
    """What decides a gap; ``said`` signs and ``verbs`` have come since the sentence began."""
    polite, final, links_on, goes_on, opening, verb, _, things = _SETS
    long = right.size >= CLAUSE_SIGNS
    return [
        1.0, left.last in polite, left.last in final, left.last in links_on, right.first in goes_on, right.first in opening and (long or right.first not in things), min(said, 48) / 16, min(right.size, 48) / 16,
        verbs > 0, right.verbs > 0, right.first in verb, left.title and not left.verbs, left.text[-1].isdigit() or right.text[0].isdigit(), not left.thai, not right.thai, left.size < 8, right.size < 8, long and said >= CLAUSE_SIGNS, long and said >= CLAUSE_SIGNS and right.verbs + right.links > 0, left.links + left.verbs > 0,
    ]


@lru_cache(maxsize=1)
def gap_weights() -> np.ndarray:
    """The weights of the rule: logistic regression on ``GAPS``, with a ridge."""
    x, y = [], []
    for text in GAPS:
        pieces = re.split(r"([|_])", text)
        said, verbs = 0, 0
        for k in range(1, len(pieces), 2):
            left, right = Stretch(pieces[k - 1]), Stretch(pieces[k + 1])
            said, verbs = said + left.size, verbs + left.verbs
            x.append(gap_features(left, right, said, verbs))
            y.append(pieces[k] == "|")
            if pieces[k] == "|":
                said, verbs = 0, 0
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
    return w


def gap_ends(left: str, right: str) -> bool:
    """Whether the gap between two stretches of a spaceless script ends a sentence, if one began with the left one."""
    a, b = Stretch(left), Stretch(right)
    return ends_at(a, b, a.size, a.verbs)


def ends_at(left: Stretch, right: Stretch, said: int, verbs: int) -> bool:
    """``gap_ends`` where ``said`` signs and ``verbs`` have come since the sentence began."""
    if not left.thai and not right.thai or right.text[0] in "ๆฯ,;:)" or left.text[-1] in ",;:(":
        return False
    return float(np.dot(gap_weights(), gap_features(left, right, said, verbs))) > 0


def wide_gap_ends(left: str, right: str) -> bool:
    """Whether the gap between two stretches of Chinese or Japanese ends a sentence."""
    score = -1.0
    score += 1.5 if left.endswith(WIDE_FINAL) else 0.5 if left.endswith(WIDE_MAYBE) else 0.0
    score += 0.7 if right.startswith(WIDE_OPENING) else -1.5 if right.startswith(WIDE_GOES_ON) else 0.0
    return score > 0


def spaceless_ends(text: str) -> list[int]:
    """Sentence ends of a run in a spaceless script without obligatory terminators."""
    pairs = quoted(text)
    opens = [a for a, _ in pairs]
    ends: list[int] = []
    marked = bool(MARKED.search(text))
    left, stop, said, verbs = None, 0, 0, 0
    for m in re.finditer(r"\S+", text):
        right = Stretch(m.group())
        if left is not None:
            k = bisect_right(opens, stop) - 1
            if not (k >= 0 and stop < pairs[k][1]) and (left.text[-1] in "។៕။" or not marked and ends_at(left, right, said, verbs) or left.text[-1] in ".!?" and not right.text[0].islower()):
                ends.append(stop)
                said, verbs = 0, 0
        left, stop = right, m.end()
        said, verbs = said + right.size, verbs + right.verbs
    return ends


# --- whole texts ---------------------------------------------------------------------------------------------


def sentence_ends(text: str | None) -> list[int]:
    """The offset after the last sign of each sentence."""
    out: list[int] = []
    if not text:
        return out
    for a, b, whole in units_of(text):
        part = text[a:b]
        inner = [] if whole else spaceless_ends(part) if len(SPACELESS.findall(part)) * 4 > len(part) else best_path(part)
        at = 0
        for end in [*inner, len(part)]:
            piece = part[at:end]
            if any(c.isalnum() for c in piece):
                out.append(a + at + len(piece.rstrip()))
            elif piece.strip() and out and at:
                out[-1] = a + at + len(piece.rstrip())
            at = end
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sentence_no, start_pos, end_pos, sentence`` of each text. A narrow stage."""
    kind = dict(df.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, starts, ends, said = [], [], [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                at = 0
                for n, end in enumerate(sentence_ends(body), 1):
                    start = end - len(body[at:end].lstrip())
                    ids.append(k)
                    no.append(n)
                    starts.append(start)
                    ends.append(end)
                    said.append(body[start:end])
                    at = end
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "sentence_no", "start_pos", "end_pos", "sentence"])

    return df.select(key, text).mapInArrow(cut, f"`{key}` {kind}, sentence_no int, start_pos int, end_pos int, sentence string")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return split_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "end_pos").distinct()
