"""Problem 5: broken question and answer pairs.

An answer is cut into clauses. A linear-chain conditional random field tags each clause as answer, refusal,
echo, foreign or unfinished, from its overlap with the question, its language against the question's, its
refusal cues and the way it ends. The share of the answer that each tag covers decides the pair's defect.

The field is fitted at the start of a run on ``TRAIN_ROWS`` rows (chosen by a hash of their id, so the same
rows at every size) that are made into labelled examples: answers as they are, cut at some point, replaced by
their question or by an answer to a question in another language, and refusals from a fixed list. A seeded writer adds
pairs of general knowledge in many languages, with short answers, names, numbers, lists and code, so that the field does
not take the style of the rows for the only sound one. Languages are told by function words and, where these are too few, by
triples of letters.

Defined cases: a null, blank or wordless answer, or a stand-in, is ``empty``; a null question is an empty
question, to which nothing is an echo and no language foreign; each record has at most one defect; rows
delivered twice count once; long answers are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are fetched for fitting; the bound of what the driver holds.
TRAIN_ROWS = 5000
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DIM = 1 << 15
#: Share of an answer that a tag has to cover.
COVER = {ECHO: 0.7, REFUSAL: 0.6, FOREIGN: 0.6}

# Frequent function words of languages in Latin script, by which a clause's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were has have had that this these those with for from by at on as it its be been which who what when where why how does do did not no or if while until after before under over about than there they you we he she their may must should would could can will listed both taken kept entry apply need uses into near",
    "de": "der die das den dem des ein eine einer eines einem einen und oder nicht ist sind war wurde wird werden hat haben mit von vom zum zur zu bei nach für auf aus als auch wenn weil dass durch um im am wie was wer wo welche welchen welcher warum gilt darf nur noch sowie liegt sobald während unter nennt denselben",
    "fr": "le la les un une des du de et ou est sont a été sera avec pour par dans sur au aux ce cette ces qui que quoi quel quelle quelles quels où comment pourquoi selon entre ne pas plus si en il elle son sa ses leur à lors car tandis doit peut même",
    "es": "el la los las un una unos unas del de y o es son fue será con para por en al que qué quién cuál cómo dónde según entre no más si su sus se lo pero como hasta desde sobre mientras porque debe puede cuando esta este cerca",
    "it": "il i e da si lo gli le dalle dai alle un era ha della delle dei degli del nel nella che di è sono una uno per con non più anche questo questa perché quando dove quale come alla dal sul",
    "pt": "o os as um uma da das do dos em no na nos nas que é são foi com para por não mais ao pelo pela como quando onde qual esta este seu sua",
    "nl": "de het een van en of is zijn was werd wordt met voor door op aan bij naar niet dat dit deze die wat wie waar waarom hoe welke als maar ook nog tot onder",
    "sv": "i och att det som en ett är var av på för med till den inte om har från men eller hur när där varför vilken också kan ska efter under mellan",
    "da": "i og at det som en et er var af på for med til den ikke om har fra men eller hvordan hvornår hvor hvorfor hvilken også kan skal efter mellem",
    "no": "i og at det som en et er var av på for med til den ikke om har fra men eller hvordan når hvor hvorfor hvilken også kan skal etter mellom",
    "pl": "i w na z do się nie że to jest są był była było od po przez dla oraz jak kiedy gdzie dlaczego który która które także może lub ale jego jej",
    "cs": "a v na s do se ne že to je jsou byl byla bylo od po pro jak kdy kde proč který která které také může nebo ale jeho její z ve",
    "fi": "ja on ei se että hän oli ovat kun missä miksi miten joka mikä myös voi tai mutta sen niin kuin jos",
    "tr": "ve bir bu da de için ile ne olarak çok daha olan gibi değil mi nasıl neden nerede hangi ama veya en",
    "hu": "a az és hogy nem is egy van volt meg de ha mint mikor hol miért melyik vagy csak már",
    "ro": "și în de la cu nu este sunt a fost pe din care că pentru cum când unde ce sau dar mai un o",
    "id": "dan yang di ke dari untuk dengan tidak ini itu adalah pada dalam akan bisa apa siapa di mana mengapa bagaimana atau tetapi",
    "vi": "và của là có trong không được cho các với một những này đó người khi ở như thế nào tại sao ai",
}

# Plain sentences of these languages, by whose triples of letters a language is told.
SAMPLES = {
    "en": "The children walked along the river every morning and watched the boats. She thought that nothing would change before the summer, although they had already sold the house. Water freezes when it gets cold enough.",
    "de": "Die Kinder gingen jeden Morgen am Fluss entlang und schauten den Schiffen zu. Sie dachte, dass sich vor dem Sommer nichts ändern würde, obwohl das Haus schon verkauft war. Wasser gefriert, sobald es kalt genug ist.",
    "fr": "Les enfants marchaient chaque matin le long de la rivière et regardaient les bateaux. Elle pensait que rien ne changerait avant l'été, bien que la maison soit déjà vendue. L'eau gèle quand il fait assez froid.",
    "es": "Los niños caminaban cada mañana junto al río y miraban los barcos. Ella pensaba que nada cambiaría antes del verano, aunque ya habían vendido la casa. El agua se congela cuando hace bastante frío.",
    "it": "I bambini camminavano ogni mattina lungo il fiume e guardavano le barche. Pensava che niente sarebbe cambiato prima dell'estate, anche se la casa era già venduta. L'acqua gela quando fa abbastanza freddo.",
    "pt": "As crianças caminhavam todas as manhãs ao longo do rio e olhavam os barcos. Ela pensava que nada mudaria antes do verão, embora a casa já estivesse vendida. A água congela quando faz bastante frio.",
    "nl": "De kinderen liepen elke ochtend langs de rivier en keken naar de boten. Zij dacht dat er voor de zomer niets zou veranderen, hoewel het huis al verkocht was. Water bevriest als het koud genoeg wordt.",
    "sv": "Barnen gick varje morgon längs floden och tittade på båtarna. Hon trodde att ingenting skulle förändras före sommaren, fastän huset redan var sålt. Vatten fryser när det blir tillräckligt kallt.",
    "da": "Børnene gik hver morgen langs floden og så på bådene. Hun troede, at intet ville ændre sig før sommeren, selv om huset allerede var solgt. Vand fryser, når det bliver koldt nok.",
    "no": "Barna gikk hver morgen langs elven og så på båtene. Hun trodde at ingenting ville forandre seg før sommeren, selv om huset allerede var solgt. Vann fryser når det blir kaldt nok.",
    "pl": "Dzieci chodziły każdego ranka wzdłuż rzeki i patrzyły na łodzie. Myślała, że przed latem nic się nie zmieni, chociaż dom był już sprzedany. Woda zamarza, kiedy robi się wystarczająco zimno.",
    "cs": "Děti chodily každé ráno podél řeky a dívaly se na lodě. Myslela si, že se před létem nic nezmění, i když byl dům už prodaný. Voda zamrzá, když je dost zima.",
    "fi": "Lapset kävelivät joka aamu joen vartta ja katselivat veneitä. Hän ajatteli, ettei mikään muuttuisi ennen kesää, vaikka talo oli jo myyty. Vesi jäätyy, kun on tarpeeksi kylmä.",
    "tr": "Çocuklar her sabah nehir boyunca yürüdü ve teknelere baktı. Ev çoktan satılmış olsa da yazdan önce hiçbir şeyin değişmeyeceğini düşündü. Su yeterince soğuk olunca donar.",
    "hu": "A gyerekek minden reggel a folyó mentén sétáltak és nézték a hajókat. Azt gondolta, hogy nyár előtt semmi sem változik, bár a házat már eladták. A víz megfagy, ha elég hideg van.",
    "ro": "Copiii mergeau în fiecare dimineață de-a lungul râului și priveau bărcile. Ea credea că nimic nu se va schimba înainte de vară, deși casa era deja vândută. Apa îngheață când este destul de frig.",
    "id": "Anak-anak berjalan setiap pagi di sepanjang sungai dan melihat perahu. Dia berpikir bahwa tidak ada yang akan berubah sebelum musim panas, meskipun rumah itu sudah dijual. Air membeku ketika cukup dingin.",
    "vi": "Trẻ em đi dọc bờ sông mỗi buổi sáng và ngắm những con thuyền. Cô nghĩ rằng sẽ không có gì thay đổi trước mùa hè, mặc dù ngôi nhà đã được bán. Nước đóng băng khi trời đủ lạnh.",
}

# Words by which refusals are told, and words of the first person.
CUES = (
    "sorry apologies apologize apologise unfortunately regret cannot can't won't unable able decline refuse insufficient enough information context know guess share comment assist help access "
    "answer respond reply model assistant language possible impossible provide not no leider leid nicht nichts kann sagen beantworten antworten auskunft möglich unmöglich genügend weiß "
    "désolé désolée malheureusement regrette peux pas répondre assez éléments informations impossible sais siento lamento puedo responder contestar suficientes dispongo datos información sé "
    "lamentablemente desafortunadamente mi dispiace purtroppo posso rispondere infelizmente desculpe desculpa não helaas antwoorden извините простите могу ответить знаю недостаточно жаль сожалению 抱歉 对不起 无法 不能 申し訳 できません わかりません"
).split()
FIRST_PERSON = "i i'm i'd i'll me my we our us ich mir mich mein wir uns je j'ai j' me mon nous yo mi me puedo dispongo tengo sé siento lamento io posso eu ik я мне мы 我 私".split()

# Refusals from which the field learns, in several languages.
REFUSALS = [
    "I'm sorry, but I can't help with that request.", "I cannot answer this question.", "I am not able to provide this information.", "Unfortunately, I am unable to respond to that.",
    "There is not enough information to answer.", "Insufficient context.", "The context does not contain enough information.", "I don't know the answer to that.", "I do not know and will not guess.",
    "As an AI language model, I do not have access to that.", "I must decline to answer.", "Sorry, I can't share this detail.", "No answer is possible from the information given.", "I won't comment on this.",
    "That is not something I can discuss.", "My apologies, I have to refuse this request.", "I am unable to assist here, please ask someone else.", "Not able to say anything about this.", "I have no information on this.",
    "It is not possible for me to answer that.", "I would rather not answer.", "Unable to comment, please contact another person.", "Can't comment on it; please ask around.", "Sorry, that cannot be answered from what I have.",
    "Es tut mir leid, das kann ich nicht beantworten.", "Dazu kann ich leider nichts sagen.", "Leider liegen mir keine ausreichenden Informationen vor.", "Das weiß ich nicht.", "Ich kann diese Frage leider nicht beantworten.", "Dazu darf ich keine Auskunft geben.",
    "Désolé, je ne peux pas répondre.", "Je n'ai pas assez d'informations pour répondre.", "Malheureusement, je ne sais pas.", "Il m'est impossible de répondre à cette question.", "Je regrette, je ne peux pas vous aider.",
    "Lo siento, no puedo responder a eso.", "No tengo suficiente información para contestar.", "Lamentablemente no puedo ayudar con esto.", "No sé la respuesta.", "No me es posible responder a esta pregunta.",
    "Mi dispiace, non posso rispondere.", "Purtroppo non ho abbastanza informazioni.", "Desculpe, não posso responder.", "Infelizmente não tenho informações suficientes.", "Helaas kan ik deze vraag niet beantwoorden.",
    "Извините, я не могу ответить на этот вопрос.", "К сожалению, у меня недостаточно информации.", "抱歉，我无法回答这个问题。", "对不起，信息不足，无法回答。", "申し訳ありませんが、お答えできません。", "عذرا، لا أستطيع الإجابة عن هذا السؤال.", "माफ़ कीजिए, मैं इसका उत्तर नहीं दे सकता।", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้",
]
# Parts of which further refusals are made.
DECLINES = ["I am not able to", "I can't", "Unable to", "Not able to", "I cannot", "I won't", "I'm sorry, I can't", "I am unable to", "I have to decline to", "Sorry, I will not"]
DECLINED = ["answer this", "comment on this", "help with it", "say more", "tell you that", "discuss it", "share that", "give an answer", "respond to this question", "provide this information"]
ADVICE = [".", ".", ", please ask another person.", ", sorry.", " from the given context.", "; try somebody else.", " because I do not know.", ", please contact someone else."]
# Sentences with refusal cues that answer all the same, and sentences in other scripts.
NEAR_REFUSALS = [
    "The choir cannot sing before the organ is repaired, so the concert was moved.", 'A card in the window says "Sorry, closed today", which the baker forgot to remove.', "Rainfall was insufficient last year, hence the poor harvest.",
    "Nobody could answer the riddle until the teacher gave a hint.", "The pilot was unable to land in the storm and flew on to the next town.", "There is not enough flour in the jar for two loaves.", "The guide does not know the path, and the map shows none.", "I know the answer now: it is the moon.",
    "Der Bäcker kann den Ofen nicht öffnen, bevor das Brot fertig ist.", "Le chat ne peut pas sortir, car la porte est fermée.", "El tren no puede salir antes de la tormenta.",
]
OTHER_SCRIPTS = [
    "Длина составила сорок метров, а работы начались весной.", "Откос был осмотрен после ремонта.", "夜间施工期间，附近的隔音墙已被更换。", "流量约为每小时六百辆。", "霧の中で、付近の標識を移設した。", "毎時三百台を数えた。",
    "تم فحص الحاجز بعد الترميم.", "पुल की जाँच रात के काम के दौरान हुई।", "ทางเท้าได้รับการตรวจเมื่อฝนตก", "Η γέφυρα έκλεισε το πρωί.", "הגשר נסגר בבוקר.", "다리는 아침에 폐쇄되었다.",
]
# Sentences by which answers in another language are told where the rows offer none.
OTHER_LATIN = {
    "en": ["The bridge was closed after the flood, and the crew asks for about 40 m beside it.", "The office decides on the limit, while the road stays open until the audit."],
    "de": ["Die Grenze liegt bei 40 m, während der Bahnsteig nach der Sanierung gesperrt bleibt.", "Das Amt verlangt mindestens 30 m neben dem Radweg, weil die Brücke erneuert wird."],
    "fr": ["La limite est de 40 m, tandis que le quai reste fermé après la crue.", "Le bureau demande au moins 30 m le long du fossé, car le pont doit être réparé."],
    "es": ["El límite es de 40 m, mientras que el andén sigue cerrado hasta la revisión.", "La oficina pide unos 30 m junto al talud, porque el puente debe ser reparado."],
    "it": ["Il limite è di 40 m, mentre la strada resta chiusa dopo la piena.", "L'ufficio chiede circa 30 m lungo il ponte, perché deve essere riparato."],
    "pt": ["O limite é de 40 m, enquanto a via fica fechada depois da cheia."],
    "nl": ["De grens ligt op 40 m, terwijl de weg na de vloed gesloten blijft."],
}
# What stands for no answer, without case, blanks and signs.
STAND_INS = set(
    "na none null nil nan answer a ans tbd tba todo empty blank void undefined missing noanswer noresponse notavailable notapplicable nodata nocontent nothing unanswered pending "
    "keine keineantwort kA keineangabe antwort entfällt fehlt aucun aucune aucuneréponse réponse néant sansréponse ninguno ninguna ningunarespuesta respuesta sinrespuesta vacío nessuna risposta нет ответ 无 答案 なし 回答 x xx xxx".lower().split()
)

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=\S)|(?<=[。！？])|[\r\n]+")
FAR_SCRIPT = re.compile(r"[Ͱ-῿Ⰰ-퟿豈-﷿ﹰ-ﾟ]")
PREFIX = re.compile(r"^\W*(?:answer|question|response|q|a|antwort|frage|réponse|question|respuesta|pregunta)\s*:\s*", re.I)
SIGNS, DIGIT = re.compile(r"[\W_]+"), re.compile(r"\d")
CODE = re.compile(r"(?=\w*\d)(?=\w*[A-Z])\w+$")

_LANG: dict[str, list[str]] = {}
for _name, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _LANG.setdefault(_w, []).append(_name)
_CUE, _FIRST = set(CUES), set(FIRST_PERSON)
_INDEX: dict[str, int] = {}


def _feature(name: str) -> int:
    at = _INDEX.get(name)
    if at is None:
        if len(_INDEX) > 200_000:
            _INDEX.clear()
        at = _INDEX[name] = zlib.crc32(name.encode()) % DIM
    return at


#: The first points of blocks of scripts beyond Latin, and their names.
BLOCKS = [(0x370, "el"), (0x400, "cyrillic"), (0x530, "hy"), (0x590, "he"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "th"), (0xE80, "other"), (0x10A0, "ka"), (0x1100, "ko"), (0x1200, "other"), (0x3040, "ja"), (0x3130, "ko"), (0x3190, "han"), (0xAC00, "ko"), (0xD7B0, "han"), (0xFB00, "arabic"), (0xFF00, "ja")]
_FIRST_POINTS = [a for a, _ in BLOCKS]


def far_script(text: str) -> tuple[str, int]:
    """The script beyond Latin that a text has most signs of, and their number. Kana makes it Japanese."""
    count: dict[str, int] = {}
    for c in FAR_SCRIPT.findall(text):
        name = BLOCKS[bisect_right(_FIRST_POINTS, ord(c)) - 1][1]
        count[name] = count.get(name, 0) + 1
    if count.get("ja", 0) * 8 > count.get("han", 0):
        count["ja"] = count.get("ja", 0) + count.pop("han", 0)
    return max(count, key=lambda k: (count[k], k)), sum(count.values())


@lru_cache(maxsize=1)
def _triples() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """Languages, the logarithm of each triple's share in them, and that of a triple they lack."""
    names = sorted(SAMPLES)
    counts: list[dict[str, float]] = []
    for name in names:
        own: dict[str, float] = {}
        for w in [*WORD.findall(SAMPLES[name].lower()), *FUNCTION_WORDS[name].split()]:
            for k in range(len(w)):
                t = f" {w} "[k : k + 3]
                own[t] = own.get(t, 0) + 1
        counts.append(own)
    totals = np.array([sum(c.values()) for c in counts])
    none = np.log(0.2 / totals)
    return names, {t: np.log((np.array([c.get(t, 0) for c in counts]) + 0.2) / totals) for t in {t for c in counts for t in c}}, none


def by_letters(tokens: list[str], own: str | None = None) -> tuple[str | None, int]:
    """The language that the triples of letters speak for, if clearly (against ``own``, if it is given, else against all
    others), and how clearly, from 1 to 4; words with digits say nothing."""
    names, table, none = _triples()
    score, seen = np.zeros(len(names)), 0
    for w in tokens:
        if w.isalpha():
            for k in range(len(w)):
                score += table.get(f" {w} "[k : k + 3], none)
                seen += 1
    if seen < 8:
        return None, 0
    order = np.argsort(score)
    best = names[order[-1]]
    margin = score[order[-1]] - score[names.index(own) if own in names and own != best else order[-2]]
    return (best, min(4, max(1, int(margin / 6)))) if margin > 4 + 0.05 * seen else (None, 0)


def language(tokens: list[str], text: str, own: str | None = None) -> tuple[str | None, int, int]:
    """The language that most function words speak for, their number, and that of the runner-up. Where one word at most
    speaks, letters decide, and count by how clear they are."""
    if FAR_SCRIPT.search(text):
        script, far = far_script(text)
        if 2 * far > sum(map(len, tokens)) or far > 12:
            return script, far, 0
    votes: dict[str, int] = {}
    for w in tokens:
        for name in _LANG.get(w, ()):
            votes[name] = votes.get(name, 0) + 1
    ranked = sorted(votes.items(), key=lambda kv: -kv[1])
    if not ranked or ranked[0][1] < 2:
        name, strength = by_letters(tokens, own)
        return (name, strength, 0) if name else (ranked[0][0], 1, 1) if ranked else (None, 0, 0)
    return ranked[0][0], ranked[0][1], ranked[1][1] if len(ranked) > 1 else 0


def votes_for(tokens: list[str], name: str) -> int:
    return sum(name in _LANG.get(w, ()) for w in tokens)


def shape(word: str) -> str:
    if CODE.match(word) or len(word) > 4 and word.isupper():
        return "C"
    if word[0].isdigit():
        return "9"
    if word[0].isupper():
        return "X" if len(word) > 1 and word.isupper() else "A"
    return "a"


def clauses(answer: str, question: str | None = None) -> list[str]:
    """The clauses of an answer, without a label before it. Where it begins with the question, that part ends
    a clause, whatever sign it ends with."""
    text = PREFIX.sub("", answer, count=1)
    head = question.strip() if question else ""
    if head and len(text) > len(head) and text.startswith(head):
        return [*clauses(head), *clauses(text[len(head) :])]
    return [c for c in (p.strip() for p in CLAUSE.split(text)) if WORD.search(c)]


def last_words(clause: str) -> list[str]:
    """The last words of a clause, two at least if it has them, however many signs follow them."""
    end = len(clause)
    while not clause[end - 1].isalnum():
        end -= 1
    tail = WORD.findall(clause, max(0, end - 60), end)
    return tail if len(tail) > 2 else WORD.findall(clause)


def _worded(tokens: list[str]) -> int:
    """Whether a clause has function words, as sentences do and names do not: 0, 1 or 2 for more."""
    return min(2, sum(w in _LANG for w in tokens))


class Question:
    def __init__(self, text: str | None):
        self.text = text = text or ""
        self.tokens = WORD.findall(text.lower())
        self.words = set(self.tokens)
        self.lang, self.votes, self.second = language(self.tokens, text)
        self.far = self.lang is not None and self.lang not in FUNCTION_WORDS


def features(question: Question, parts: list[str], known: frozenset[str] | set[str] = frozenset()) -> list[list[int]]:
    """The active features of each clause; ``known`` words have been seen within answers."""
    out, n = [], len(parts)
    for k, clause in enumerate(parts):
        lowered = clause.lower()
        tokens = WORD.findall(lowered)
        count = len(tokens)
        common = sum(w in question.words for w in tokens)
        share, novel = common / count, count - common
        held = len(question.words.intersection(tokens)) / len(question.words) if question.words else 0.0
        names = ["1", "e%d" % (share * 5.999), "v%d" % min(novel, 6), "ev%d%d" % (share > 0.85, novel < 3), "q%d%d" % (share > 0.85, held * 4.999)]
        lang, votes, _ = language(tokens, clause, question.lang)
        margin = 0
        if lang is None or question.lang is None:
            relation = "?"
        elif lang not in FUNCTION_WORDS or question.far:
            relation = "=" if lang == question.lang else "far"
            margin = 4 * (relation == "far")
        else:
            own = votes_for(tokens, question.lang)
            relation = "=" if own >= votes else "<" if votes - own < 2 else "!"
            margin = max(0, min(votes - own, 4))
            names.append("lm%d%d" % (min(votes, 4), min(own, 4)))
        names += ["l" + relation, "lx%s%d" % (relation, min(count, 4)), "lz%d" % margin, "lw%d%d" % (margin, count > 5), *("ly%d%d" % (k, margin > 1) for k in range(3))]
        cues = {w for w in tokens if w in _CUE}
        first = any(w in _FIRST for w in tokens)
        entity = DIGIT.search(clause) is not None or len(re.findall(r"(?<=[a-z,;] )[A-Z][a-z]{3,}", clause)) > 0
        names += ["c" + w for w in cues]
        names += ["cn%d%d%d" % (min(len(cues), 4), first, entity), "ce%d%d" % (len(cues) * 3 >= count, entity), "n%d" % min(count.bit_length(), 6)]
        last = k == n - 1
        end = clause[-1]
        kind = "…" if clause.endswith("..") else end if end in ".!?…,;:(-—" else "q" if end in "\"'”’»)]}" else "." if end in "。！？।؟" else "9" if end.isdigit() else "A" if end.isupper() else "w"
        names.append("t%s%d" % (kind, last))
        if last:
            tail = last_words(clause)
            one = tail[-1]
            two = tail[-2] if len(tail) > 1 else "^"
            form = shape(one)
            names += ["s" + form + kind, "f%d%s" % (one.lower() in _LANG, kind), "p" + (two.lower() if shape(two) == "a" else shape(two)) + form + kind[:1]]
            if form == "a":
                names.append("w" + one + kind)
            low = one.lower()
            cut = low not in question.words and any(w.startswith(low) for w in question.words)
            seen = "q" if low in question.words else "k" if low in known else "c" if cut else "9" if form in "9C" else "n"
            size = "0" if n > 1 else str(min(count, 4)) if count < 5 else "8" if count < 9 else "9"
            names += ["o%s%s%s" % (seen, form, kind), "z%s%s%s" % (size, form, kind), "zo%s%s%s" % (size, seen, kind), "zl%s%s" % (size, relation), "b%d%s" % (_worded(tokens), kind)]
            odd = clause.count('"') % 2 + (clause.count("(") > clause.count(")")) + (clause.count("“") + clause.count("„") > clause.count("”") + clause.count("“"))
            names.append("u%d%d" % (odd, n > 1))
            names.append("k%s%d%d" % (kind, n > 1, count > 14))
        else:
            names.append("inner")
        out.append([_feature(x) for x in names])
    return out


class Field:
    """A linear-chain conditional random field over hashed features."""

    def __init__(self):
        size = len(LABELS)
        self.known: set[str] = set()
        self.emit, self.step, self.start = np.zeros((DIM + 1, size)), np.zeros((size, size)), np.zeros(size)

    @staticmethod
    def pack(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all clauses as one padded array (the last row of ``emit`` stays 0), and lengths."""
        flat = [c for s in sequences for c in s]
        width = max(map(len, flat), default=1)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        out = np.full((len(flat), width), DIM, np.int64)
        out[np.arange(width) < sizes[:, None]] = np.fromiter((x for c in flat for x in c), np.int64, int(sizes.sum()))
        return out, np.fromiter(map(len, sequences), np.int64, len(sequences))

    def scores(self, packed: np.ndarray) -> np.ndarray:
        return np.concatenate([self.emit[packed[k : k + 20_000]].sum(1) for k in range(0, len(packed), 20_000)]) if len(packed) else np.zeros((0, len(LABELS)))

    def decode(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """The best tags of each sequence."""
        packed, lengths = self.pack(sequences)
        scores = self.scores(packed)
        starts = np.cumsum(lengths) - lengths
        tags = np.zeros(len(scores), np.int64)
        for size in np.unique(lengths):
            at = starts[lengths == size]
            best = scores[at] + self.start
            back = []
            for t in range(1, size):
                over = best[:, :, None] + self.step[None]
                back.append(over.argmax(1))
                best = over.max(1) + scores[at + t]
            state = best.argmax(1)
            tags[at + size - 1] = state
            for t in range(size - 1, 0, -1):
                state = back[t - 1][np.arange(len(at)), state]
                tags[at + t - 1] = state
        flat = tags.tolist()
        return [flat[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]

    def fit(self, sequences: list[list[list[int]]], gold: list[list[int]], rounds: int = 60, decay: float = 3e-4, rate: float = 0.15) -> Field:
        """Adam on the conditional log-likelihood, by forward and backward sums over sequences of equal length."""
        packed, lengths = self.pack(sequences)
        want = np.concatenate([np.array(g) for g in gold])
        starts = np.cumsum(lengths) - lengths
        size = len(LABELS)
        params = [self.emit, self.step, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        onehot = np.eye(size)[want]
        groups = [(n, starts[lengths == n]) for n in np.unique(lengths)]
        for turn in range(1, rounds + 1):
            scores = self.scores(packed)
            delta = onehot.copy()
            step, start = np.zeros_like(self.step), np.zeros_like(self.start)
            for n, at in groups:
                alpha = [scores[at] + self.start]
                for t in range(1, n):
                    alpha.append(np.logaddexp.reduce(alpha[-1][:, :, None] + self.step[None], axis=1) + scores[at + t])
                total = np.logaddexp.reduce(alpha[-1], axis=1)
                beta = np.zeros((len(at), size))
                for t in range(n - 1, -1, -1):
                    delta[at + t] -= np.exp(alpha[t] + beta - total[:, None])
                    if t:
                        pair = np.exp(alpha[t - 1][:, :, None] + self.step[None] + (scores[at + t] + beta)[:, None, :] - total[:, None, None])
                        step += onehot[at + t - 1].T @ onehot[at + t] - pair.sum(0)
                        beta = np.logaddexp.reduce(self.step[None] + (scores[at + t] + beta)[:, None, :], axis=2)
                start += delta[at].sum(0)
            emit = np.zeros_like(self.emit)
            for label in range(size):
                emit[:, label] = np.bincount(packed.ravel(), np.repeat(delta[:, label], packed.shape[1]), minlength=DIM + 1)
            emit[DIM] = 0
            for k, (p, g) in enumerate(zip(params, (emit, step, start))):
                g = g / len(lengths) - decay * p
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p += rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
        return self


def _plain(question: Question, parts: list[str], answer: str) -> bool:
    """Whether a row may serve as an example of a sound answer: nothing about it hints at a defect."""
    if not parts:
        return False
    tokens = [w for p in parts for w in WORD.findall(p.lower())]
    if sum(w in question.words for w in tokens) > 0.8 * len(tokens):
        return False
    lang, votes, _ = language(tokens, answer)
    if lang and question.lang and lang != question.lang and (lang not in FUNCTION_WORDS or votes > 1 + votes_for(tokens, question.lang)):
        return False
    cues = sum(w in _CUE for w in set(tokens))
    if len(tokens) < 16 and cues >= 2 or len(tokens) < 4 and cues:
        return False
    last = last_words(parts[-1])
    end = answer.rstrip()[-1]
    if shape(last[-1]) == "a" and (end not in ".!?\"')]»”。" or last[-1].lower() in _LANG and len(last[-1]) < 5 and end == "."):
        return False
    return end not in "(,…-"


def _refuses(parts: list[str], question: Question) -> bool:
    """Whether a row may serve as an example of a refusal: short, full of cues, and about nothing."""
    tokens = [w for p in parts for w in WORD.findall(p.lower())]
    cues = sum(w in _CUE for w in set(tokens))
    known = sum(w in question.words and len(w) > 5 for w in tokens)
    return 3 <= len(tokens) < 16 and cues >= 2 and not known and not any(c.isdigit() for p in parts for c in p)


#: Pairs of general knowledge that the writer adds.
WRITTEN = 5000
# What the writer asks (a topic for {}) and how it answers in sentences, by language; and its words.
ASKED = {
    "en": ["What is {}?", "Who found {}?", "How many {} are there?", "Explain {}", "Where does {} come from?", "When was {} built", "Is {} bigger than {}?", "Name three kinds of {}.", "What does {} stand for?", "Write a line of code that prints {}", "Which is older, the {} or the {}?", "Describe {} in one sentence.", "Why do people like {}?", "Print {} in one line", "Use echo to show {} and stop", "Sort the list {}", "Is it the {} or the {} that came first", "Why is the {} so {}?"],
    "de": ["Was ist {}?", "Wer hat {} gefunden?", "Wie viele {} gibt es?", "Erkläre {}", "Woher kommt {}?"], "fr": ["Qu'est-ce que {} ?", "Qui a trouvé {} ?", "Combien de {} y a-t-il ?", "Explique {}"], "es": ["¿Qué es {}?", "¿Quién encontró {}?", "¿Cuántos {} hay?", "Explica {}"],
    "it": ["Che cos'è {}?", "Chi ha trovato {}?"], "pt": ["O que é {}?", "Quem descobriu {}?"], "nl": ["Wat is {}?", "Wie heeft {} gevonden?"], "pl": ["Co to jest {}?", "Kto znalazł {}?"], "sv": ["Vad är {}?", "Vem hittade {}?"], "tr": ["{} nedir?"], "cs": ["Co je {}?"], "fi": ["Mikä on {}?"], "ro": ["Ce este {}?"], "id": ["Apa itu {}?"],
}
SAID = {
    "en": ["{} is a small tool that people use at home when the weather is bad", "It was found by a sailor who had lost his way in the fog", "Most of them live near the coast, but a few have been seen in the hills", "They keep it dry and store it in the dark until it is needed", "Because it is cheap and easy to carry", "Plants turn light into sugar and give off oxygen", "The older one was finished long before the war", "You can tell it by its colour and by the sound it makes"],
    "de": ["{} ist ein kleines Werkzeug, das man zu Hause benutzt", "Es wurde von einem Seemann gefunden, der sich verirrt hatte", "Die meisten leben an der Küste, aber einige kommen auch in den Bergen vor", "Weil es billig und leicht zu tragen ist"], "fr": ["{} est un petit outil que l'on utilise à la maison", "Il a été trouvé par un marin qui s'était perdu dans le brouillard", "La plupart vivent près de la côte, mais certains montent dans les collines"],
    "es": ["{} es una herramienta pequeña que se usa en casa", "Lo encontró un marinero que se había perdido en la niebla", "La mayoría vive cerca de la costa, pero algunos suben a las colinas"], "it": ["{} è un piccolo attrezzo che si usa in casa", "Lo ha trovato un marinaio che si era perso nella nebbia"], "pt": ["{} é uma pequena ferramenta que se usa em casa", "Foi encontrado por um marinheiro que se perdeu no nevoeiro"],
    "nl": ["{} is een klein gereedschap dat men thuis gebruikt", "Het werd gevonden door een zeeman die verdwaald was"], "pl": ["{} to małe narzędzie, którego używa się w domu", "Znalazł go żeglarz, który zabłądził we mgle"], "sv": ["{} är ett litet verktyg som man använder hemma", "Den hittades av en sjöman som hade gått vilse i dimman"], "tr": ["{} evde kullanılan küçük bir alettir", "Onu siste yolunu kaybeden bir denizci buldu"],
    "cs": ["{} je malý nástroj, který se používá doma", "Našel ho námořník, který zabloudil v mlze"], "fi": ["{} on pieni työkalu, jota käytetään kotona", "Sen löysi merimies, joka oli eksynyt sumuun"], "ro": ["{} este o unealtă mică folosită acasă", "A fost găsit de un marinar care se rătăcise în ceață"], "id": ["{} adalah alat kecil yang dipakai di rumah", "Itu ditemukan oleh seorang pelaut yang tersesat dalam kabut"],
}
THINGS = "kettle violin lantern cheese glacier comet beetle harbour recipe planet bridge candle poem tunnel magnet orchard saddle thunder velvet whistle pepper marble ladder feather anchor basket pyramid sculpture rhythm fossil photosynthesis gravity evaporation democracy inflation".split()
CODE_LINES = ["print('{}')", "console.log(\"{}\");", "SELECT * FROM {};", "echo {}", "x = [n for n in {}]", "def f():\n    return '{}'", "git add {}", "<b>{}</b>", "for i in range(3):\n    print(i)", "{} = 4", "{}.sort()"]


def _name(rng: random.Random, words: int) -> str:
    made = lambda: "".join(rng.choice(["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "th", "v", "w", "br", "st", "ch"]) + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice(["", "n", "r", "s", "l", "t", "m", "x", "ng", "ck", "rd", "lle"])
    return " ".join(made().capitalize() for _ in range(words))


def _short(rng: random.Random, things: list[str]) -> str:
    """A short complete answer: a name, number, term, choice, list or line of code."""
    kind, thing = rng.randrange(12), rng.choice(things)
    n = rng.choice([str(rng.randint(0, 99)), str(rng.randint(100, 2100)), f"{rng.randint(1, 99)}.{rng.randint(0, 99)}", f"{rng.randint(1, 9)},{rng.randint(100, 999)}", f"{rng.randint(1, 99)}%"])
    lists = [rng.choice([rng.choice(THINGS), f"{rng.choice(['boil', 'cut', 'wash', 'open', 'paint', 'close'])} the {rng.choice(THINGS)}", _name(rng, rng.randint(1, 2))]) for _ in range(rng.randint(2, 4))]
    return [
        lambda: _name(rng, 1), lambda: _name(rng, 2), lambda: _name(rng, 3), lambda: n, lambda: f"{n} {rng.choice(['km', 'years', 'kg', 'people', 'm', thing])}", lambda: " ".join(w.capitalize() for w in rng.sample(THINGS, rng.randint(2, 4))), lambda: rng.choice(["the ", "a ", "The ", "A ", ""]) + thing,
        lambda: rng.choice(["Yes", "No", "Yes, it is", "No, never", "True", "Both", "Ja", "Oui", "Sí", "Never", "Neither", "In " + n]), lambda: "\n".join(f"{rng.choice(['-', '*'])} {x}" for x in lists), lambda: "\n".join(f"{k}. {x.capitalize()}" for k, x in enumerate(lists, 1)), lambda: ", ".join(lists) + rng.choice(["", f" and {rng.choice(THINGS)}"]), lambda: rng.choice(CODE_LINES).replace("{}", thing),
    ][kind]()


def written(rng: random.Random, count: int) -> Iterator[tuple[str, str, object]]:
    """``question, answer, label`` of pairs of general knowledge; a label for all clauses, or a function of their number."""
    langs = sorted(ASKED)
    broken = lambda n: [ANSWER] * (n - 1) + [UNFINISHED]
    for _ in range(count):
        lang = "en" if rng.random() < 0.5 else rng.choice(langs)
        things = [_name(rng, 1) if rng.random() < 0.2 else rng.choice(THINGS) for _ in range(2)]
        asked = rng.choice(ASKED[lang])
        question = asked.replace("{}", things[0], 1).replace("{}", things[1], 1)
        def said(lang: str, things=things) -> str:
            tail = [f" near the {rng.choice(THINGS)}", f" with {rng.choice(THINGS)}", f" more than {rng.choice(THINGS)}", f" like a {rng.choice(THINGS)}", f" in {_name(rng, 1)}", f" for {rng.randint(2, 900)} years"] if lang == "en" else [f" {_name(rng, 1)}", f", {rng.choice(THINGS)}", f" {rng.randint(2, 900)}"]
            tail += [f" {_name(rng, 1).lower()}"] * 4
            return rng.choice(SAID[lang]).replace("{}", things[0]) + (rng.choice(tail) if rng.random() < 0.75 else "")


        sentences = lambda lang, k: ". ".join(x[:1].upper() + x[1:] for x in (said(lang) for _ in range(k)))  # noqa: E731, B023
        kind = rng.random()
        if rng.random() < 0.06:  # answers that share words with the question
            x, y = things
            yield *rng.choice([(f"Print {x} in one line", f"print('{x}')"), (f"Sort the list {x}", f"{x}.sort()"), (f"Select all rows of {x}", f"SELECT * FROM {x};"), (f"Which is older, the {x} or the {y}?", rng.choice([f"the {x}", f"The {y}.", x.capitalize()])), (f"Is the {x} heavier than the {y}?", rng.choice([f"The {y}", f"the {x} is heavier", f"Yes, the {x} is heavier."])), (f"What is 3 times {len(x)}?", f"3 times {len(x)} is {3 * len(x)}."), (f"Echo {x} twice in the shell", f"echo {x} {x}")]), ANSWER
        elif kind < 0.06:
            yield question, f"{question} {_short(rng, things)}" + rng.choice([".", ""]), lambda n, m=len(clauses(question)): [ECHO] * m + [ANSWER] * (n - m)
        elif kind < 0.4:
            answer = _short(rng, things)
            yield question, answer + ("." if rng.random() < 0.4 and answer[-1].isalnum() else ""), ANSWER
        elif kind < 0.52:
            yield question, sentences(lang, rng.randint(1, 3)) + ("." if rng.random() < 0.85 else ""), ANSWER
        elif kind < 0.68:
            whole = sentences(lang, rng.randint(1, 3))
            cut = whole[: rng.randint(len(whole) * 2 // 5, len(whole) - 3)].rstrip()
            word = re.search(r"\w+$", cut)
            if word and rng.random() < 0.5:  # at the end of a word, if it is one that something follows
                cut = whole[: whole.find(" ", len(cut)) if whole.find(" ", len(cut)) > 0 else len(cut)]
                while " " in cut and re.findall(r"\w+", cut)[-1].lower() not in _LANG:
                    cut = cut.rsplit(" ", 1)[0]
            if not cut.endswith(".") and len(cut) > 10:
                yield question, cut + rng.choice(["", "", "", "", ",", "...", "…", " ...", " (", "."] if re.findall(r"\w+", cut)[-1].lower() in _LANG else ["", "", "", ",", "…", " ..."]), broken
        elif kind < 0.75:
            echo = rng.choice([question, question.lower(), question.rstrip("?. "), f'"{question}"', question + " " + question, "Question: " + question])
            yield question, echo, ECHO
        elif kind < 0.91:
            other = rng.choice([x for x in langs if x != lang])
            yield question, (sentences(other, rng.randint(1, 2)) if rng.random() < 0.7 else rng.choice(["", _name(rng, 1), f"{_name(rng, 1)} "]) + " ".join(rng.sample(OTHER_SCRIPTS, rng.randint(1, 3)))) + rng.choice([".", ".", ""]), FOREIGN
        elif kind < 0.97:
            said = rng.choice(REFUSALS) if rng.random() < 0.65 else f"{rng.choice(DECLINES)} {rng.choice(DECLINED)}{rng.choice(ADVICE)}"
            said = rng.choice([said, said, said.lower(), f'"{said}"']).rstrip("." if rng.random() < 0.4 else "")
            yield question, said, REFUSAL
        else:
            yield question, f"{said(lang)}. {rng.choice(NEAR_REFUSALS)}", ANSWER


def vocabulary(rows: list[tuple[str, str]]) -> set[str]:
    """Words that stand within answers, before another word, at least twice; of the rows and of the writer."""
    count: dict[str, int] = {}
    for _, a in rows:
        for w in WORD.findall(a.lower())[:-1] if a else ():
            count[w] = count.get(w, 0) + 1
    return {w for w, n in count.items() if n > 1} | set(_LANG) | {w for text in SAMPLES.values() for w in WORD.findall(text.lower())}


def examples(rows: list[tuple[str, str]], seed: int = 7, known: set[str] | None = None) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Labelled sequences made from ``(question, answer)`` rows and by the writer."""
    rng = random.Random(seed)
    sequences, gold = [], []
    known = vocabulary(rows) if known is None else known

    def add(question: Question, answer: str, label) -> None:
        parts = clauses(answer, question.text)
        if parts:
            sequences.append(features(question, parts, known))
            gold.append(label(len(parts)) if callable(label) else [label] * len(parts))

    sound = []
    for q, a in rows:
        question = Question(q)
        if a and _plain(question, clauses(a, q), a):
            sound.append((question, q, a))
        elif a and _refuses(clauses(a, q), question):
            add(question, a, REFUSAL)
    for question, answer, label in written(rng, WRITTEN):
        add(Question(question), answer, label)
    by_lang: dict[str | None, list[str]] = {}
    for question, _, a in sound:
        by_lang.setdefault(question.lang, []).append(a)
    langs = [x for x in sorted(by_lang, key=str) if x]

    def restyle(text: str) -> str:
        style = rng.random()
        text = text.lower() if style < 0.2 else text.upper() if style < 0.3 else f'"{text}"' if style < 0.4 else text
        end = rng.random()
        return text.rstrip(".?! ") + ("." if end < 0.1 else "") if end < 0.4 else text

    for k, (question, q, a) in enumerate(sound):
        for _ in range(1 if a.rstrip()[-1] in ".!?。" else 4):  # sound answers without a final stop are few
            add(question, a, ANSWER)
        if k % 2 == 0:
            cut = a[: int(len(a) * rng.uniform(0.12, 0.97))].rstrip()
            ended = not cut or cut[-1] in ".!?\"')" or len(cut) < 8
            if not ended:
                tail = rng.random()
                word = WORD.findall(cut[-20:])
                cut += "…" if tail < 0.08 else " ..." if tail < 0.15 else " (" if tail < 0.23 else "," if tail < 0.3 else "." if word and word[-1].lower() in _LANG and tail < 0.7 else ""
                add(question, cut, lambda n: [ANSWER] * (n - 1) + [UNFINISHED])
                if rng.random() < 0.5:
                    whole = re.sub(r"\s+\S*$", "", a[: len(cut)])
                    while (word := WORD.findall(whole[-20:])) and word[-1].lower() not in _LANG and " " in whole:
                        whole = whole.rsplit(" ", 1)[0]
                    if len(whole) > 8:
                        add(question, whole + rng.choice([".", "", " (", ",", "…", " ..."]), lambda n: [ANSWER] * (n - 1) + [UNFINISHED])
        if k % 5 == 0:
            copied = restyle(q)
            if rng.random() < 0.3:
                copied += " " + copied
            add(question, rng.choice(["", "", "Answer: ", "Q: "]) + copied, ECHO)
            add(question, q + " " + a, lambda n, m=len(clauses(q)): [ECHO] * m + [ANSWER] * (n - m))
        if k % 2 == 1:
            kind, others = rng.random(), [x for x in langs if x != question.lang and x in FUNCTION_WORDS]
            if kind < 0.25:
                other = " ".join(rng.sample(OTHER_SCRIPTS, 2))
            elif kind < 0.4 or not others:
                other = " ".join(rng.sample(pool := OTHER_LATIN[rng.choice([x for x in OTHER_LATIN if x != question.lang])], rng.randint(1, len(pool))))
            else:
                other = rng.choice(by_lang[rng.choice(others)])
            add(question, other, FOREIGN)
        if k % 4 == 2:
            add(question, restyle(rng.choice(REFUSALS)), REFUSAL)
            near = rng.choice(NEAR_REFUSALS)
            if rng.random() < 0.5:
                add(question, f"{a} {near}", ANSWER)
    return sequences, gold


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = SIGNS.sub("", answer.lower())
    return not bare or bare in STAND_INS


def defect_of(parts: list[str], tags: list[int]) -> str | None:
    """The defect that the tags' coverage of the answer amounts to."""
    size = [len(p) for p in parts]
    cover = [0.0] * len(LABELS)
    for n, tag in zip(size, tags):
        cover[tag] += n / sum(size)
    if cover[ECHO] >= COVER[ECHO] and not cover[ANSWER]:
        return "copy"
    if cover[REFUSAL] >= COVER[REFUSAL]:
        return "refusal"
    if cover[FOREIGN] >= COVER[FOREIGN]:
        return "language"
    return "truncated" if tags[-1] == UNFINISHED else None


def judge(field: Field, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
    """The defect of each pair."""
    out: list[str | None] = [None] * len(pairs)
    at, parts, sequences = [], [], []
    for k, (q, a) in enumerate(pairs):
        own = [] if is_empty(a) else clauses(a, q)
        if not own:
            out[k] = "empty"
            continue
        at.append(k)
        parts.append(own)
        sequences.append(features(Question(q), own, field.known))
    if at:
        for k, own, tags in zip(at, parts, field.decode(sequences)):
            out[k] = defect_of(own, tags)
    return out


def train(rows: list[tuple[str, str]]) -> Field:
    """A field for rows ``(question, answer)``, none of them needed."""
    field = Field()
    field.known = vocabulary(rows)
    return field.fit(*examples(rows, known=field.known))


def fit_field(records: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """The field for ``records``, from at most ``rows`` of them: those with the smallest hashes of their id. A bound of the
    hash, from a count of all rows, keeps all but about twice as many from being sorted and sent."""
    chosen = records.where("answer IS NOT NULL AND question IS NOT NULL").select("record_seq", "question", "answer").withColumn("__hash", F.pmod(F.xxhash64("record_seq"), F.lit(1 << 40)))
    total = max(1, chosen.count())
    bound = min(1.0, (2 * rows + 200) / total)
    near = chosen.where(F.col("__hash") < int(bound * (1 << 40)))
    fetched = near.orderBy("__hash", "record_seq").limit(rows).collect()
    return train([(r["question"], r["answer"]) for r in dict.fromkeys(fetched)])


def find_defects(records: DataFrame, field: Field | None = None) -> DataFrame:
    """``record_seq, defect`` of each defective record. A narrow stage; only defects are shuffled."""
    field = field or fit_field(records)
    sent = records.sparkSession.sparkContext.broadcast(field)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(sent.value, list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["record_seq", "defect"])
            yield whole.filter(whole.column(1).is_valid())

    kind = dict(records.dtypes)["record_seq"]
    return records.select("record_seq", "question", "answer").mapInArrow(tag, f"record_seq {kind}, defect string").distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    return find_defects(spark.read.parquet(f"{sf_dir}/validated_records.parquet").select("record_seq", "question", "answer"))
