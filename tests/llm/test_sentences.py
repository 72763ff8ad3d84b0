import time

import pytest

from quirework.llm import sentences


def cut(text):
    out, at = [], 0
    for end in sentences.sentence_ends(text):
        out.append(text[at:end].strip())
        at = end
    return out


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Gumit measured 19.80 m at Fobem, i.e. 52.8 m less than planned.", "See Fig. 91 and Sec. 23.33 before the lane is closed."],
        ["The tender closes at 5 p.m.", "Late bids go to Gisok.", "The order covers cones, lamps, etc.", "Rafitikecon signed it.", "Use bolts of grade 8.8, shims, etc. on the loop."],
        ["J. N. Divobi signed for Nodib, not for the St. Mavex depot.", "Prof. Bapib et al. reported 13,885 trips in Vol. 452, pp. 768-728.", "Really?!", "The yield sign failed."],
        ["The count stopped ... then resumed at Tabog.", "The U.S. style sign fell.", "Version 2.65 of the plan adds it; version 3.0 drops it.", "(The trench was not lowered.)", "A second visit took place."],
        ["The sign reads \"Wait here.\" in both directions.", "Who asked, \"Is the strip safe?\"", "It was Tofagu of Ririm.", "\"Close the lane now!\" the foreman called.", "\"We waited. Nothing moved,\" said the driver."],
        ["„Sofort sperren!“, rief Fevis von Kolas.", "Der Auftrag nennt Kegel usw.", "Nela hat ihn bestätigt.", "Am 3. Mai wurde er verlegt.", "Es waren 1.651 Fahrten, d. h. mehr als zuvor.", "Vgl. Abb. 5 und Nr. 694 zum Weg."],
        ["M. Ladur a relevé 9,5 m à Vasig, p. ex. près du talus.", "« Fermez la voie ! » a crié Kolig.", "Mme Refob note env. 314 passages à 7 h 30.", "Le quai est-il sûr ?", "Personne ne répond."],
        ["El Sr. Bun midió 6,1 m en Doru, p. ej. junto al talud.", "«¡Cierren el carril!», gritó Tibel.", "La Dra. Pig anotó aprox. 3 pasos a las 7.30 h.", "¿Es seguro?", "Nadie responde."],
        ["Инженер А. H. Дусе проверил съезд.", "В 2031 г. здесь прошло 480 машин, в т. ч. 464 автобусов.", "См. рис. 894 и табл. 152, где описан откос.", "«Закройте полосу!» — крикнул мастер Иванов."],
        ["क्या बाड़ सुरक्षित है?", "\"तुरंत रोको!\" Tonem के मुखिया ने कहा।", "डॉ. Viv ने 180 गाड़ियाँ गिनीं।"], ["«أوقفوا السير!» صاح المشرف في Bulob.", "قال د. Demif إن العدد بلغ 2 مركبة.", "هل الكتف آمن؟"],
        ["มีรถผ่านRadovafiskชั่วโมงละ191คันเมื่อหมอกลง", "หัวหน้างานสั่งให้ปิดทางเท้าที่Konesibuckทันที", "แผ่นงานC44290กล่าวถึงราวกั้นและท่อระบายน้ำ"],
    ],
)
def test_spaced(parts):
    assert cut(" ".join(parts)) == parts
    if "ที่" not in "".join(parts):
        assert [p.replace("\n", " ") for p in cut(" ".join(parts).replace(" m ", " m\n").replace(" of ", "\nof "))] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["他说：“先关闭护栏。再等通知。”", "“立即停车！”领班在Bade喊道。", "流量约为每小时638辆……后来又下降了！", "真的吗？！", "护栏为什么没有关闭？"],
        ["「先に点検する。次を待て。」と彼は言った。", "本当ですか。", "「すぐに止めて！」とMomedの班長が叫んだ。", "毎時495台を数えた！"],
    ],
)
def test_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_blocks():
    text = "Section 402: gravel shoulder\nThe lane was\nclosed. It rained.\r\n\r\n1. One item\n2. Two. Still two\n\nNotes on the fence\n\nQ: Is it safe?\n\nA: Yes. It is\n\n\n- a\n- b."
    assert cut(text) == ["Section 402: gravel shoulder", "The lane was\nclosed.", "It rained.", "1. One item", "2. Two. Still two", "Notes on the fence", "Q: Is it safe?", "A: Yes.", "It is", "- a", "- b."]
    assert cut("heft c1 nennt den zaun. heft c2 nennt ihn. Use it, etc. on the loop.") == ["heft c1 nennt den zaun.", "heft c2 nennt ihn.", "Use it, etc. on the loop."]


def test_gap_classes():
    assert sentences.gap_ends("ปิดทางเท้าที่Konesibuckทันที", "มีรถผ่าน") and not sentences.gap_ends("แผ่นงานกล่าวถึงราวกั้นและ", "ท่อระบายน้ำ") and not sentences.gap_ends("ราวกั้น", "และทางแยก")
    assert "".join(sentences.segment("ราวกั้นและท่อ")) == "ราวกั้นและท่อ" and "และ" in sentences.segment("ราวกั้นและท่อ")


@pytest.mark.parametrize(
    "parts",
    [
        ["ขอบคุณครับ", "แต่ถนนยังปิดอยู่"],  # a final particle outweighs a linking word
        ["แผ่นงานC32825กล่าวถึงป้ายรถเมล์ ทางแยก ท่อระบายน้ำ"],  # items of a list
        ["ถนนปิด ฝนตก"], ["ถนนปิดครับ", "ฝนตก"], ["ถนนปิด", "เขารอ"],  # only a final or an opening word makes an end
        ["ทีมของเขาชนะ แต่ถนนยังปิดอยู่"],
        ["ຖະໜົນປິດ ຝົນຕົກ"], ["ຖະໜົນປິດ", "ຂ້ອຍລໍ"],
        ["သူ ကျောင်း သို့ သွားသည်။", "လမ်း ပိတ်ထားသည်။"], ["ផ្លូវ បាន បិទ។", "ភ្លៀង ធ្លាក់។"],
        ["工事は終わりました", "次に進みます"], ["工事は終わった", "しかし雨です"], ["工事は終わった 橋の上"], ["工事は終わりました が、雨です"], ["东京 大阪 名古屋"], ["路关了吗", "桥还开着"],
    ],
)
def test_particles_and_openers_decide(parts):
    assert cut(" ".join(parts)) == parts


PROSE = [
    ["นายสมชาย ใจดี กล่าวว่า สินค้า ราคา 500 บาท ขายดี"], ["คุณยายทำขนมอยู่ในครัว", "หลานๆนั่งรออยู่ที่โต๊ะ"], ["ตลาดนี้ขายผัก ผลไม้ และดอกไม้"], ["ห้องสมุดเปิด 9 โมงเช้า", "เด็กๆชอบมาอ่านหนังสือที่นี่"], ["ถ้าเธอว่าง เราไปดูหนังกันไหม"],
    ["ดร.วิชัย ทองดี ตอบว่า โครงการนี้ใช้เงิน 3 ล้านบาท"], ["ผมไม่สบายครับ", "วันนี้ขอลาหนึ่งวัน"], ["แม่ค้าบอกว่า มะม่วงกิโลกรัมละ 40 บาท"], ["รถเสียกลางทาง", "เราต้องเดินไปโรงเรียนเอง"], ["เพื่อนบ้านเลี้ยงแมวสามตัว", "ทุกตัวชอบนอนใต้ต้นไม้หน้าบ้าน"],
    ["ฉันซื้อกระเป๋า รองเท้า และหมวก ที่ร้านใกล้บ้าน"], ["งานเริ่มเวลา 18.00 น. ที่หอประชุม"],
]


def test_thai_prose():
    """Prose that the gaps were not fitted to: nine of ten gaps right at least."""
    right = total = 0
    for parts in PROSE:
        text = " ".join(parts)
        want, got = {len(" ".join(parts[: k + 1])) for k in range(len(parts))}, set(sentences.sentence_ends(text))
        gaps = [k for k, c in enumerate(text) if c == " "]
        right, total = right + sum((k in want) == (k in got) for k in gaps), total + len(gaps)
    assert right >= 0.9 * total, (right, total)


@pytest.mark.parametrize("unit", ['He said "stop. go on. (well)" and left. "Quote one. Two." ok. ', "one. two. three. ", "กข ", 'x ( y. "', "(a. b) ", "e.g. so "])
def test_time_grows_with_the_text(unit):
    spent = []
    for n in (20_000, 160_000):
        text = (unit * (n // len(unit) + 1))[:n]
        start = time.process_time()
        sentences.sentence_ends(text)
        spent.append(time.process_time() - start)
    assert spent[1] < 8 * 4 * max(spent[0], 0.02)


def test_many_open_ends():
    """More than forty terminators in a row of which none is sure."""
    text = "abc no. " + "def ghi? jkl mno! " * 100 + "pqr"
    assert cut(text) == ["abc no.", *["def ghi?", "jkl mno!"] * 100, "pqr"]


def test_long_words_before_a_dot():
    known = "x" * 60 + ".e.g. and so on"
    assert sentences.dot_score("See Fig. 3", 7, 8, "3", "3") == sentences.dot_score("y" * 500 + " See Fig. 3", 508, 509, "3", "3")
    assert len(cut(known)) == 1


def test_operator_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One. Two!"), (4, "One. Two!"), (None, "One."), (5, "word " * 30_000 + "end. Next one"), (6, "... !!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS sentence")
    got = sentences.split_sentences(df).collect()
    assert {(r.doc_id, r.sentence) for r in got if r.doc_id != 5} == {(4, "One."), (4, "Two!"), (None, "One.")} and [r.end_pos for r in got if r.doc_id == 5] == [150_004, 150_013]
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_query_positions(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in sentences.p9_found(spark, sf_dir).collect():
        assert 0 < r.end_pos <= len(texts[r.doc_id]) and not texts[r.doc_id][r.end_pos - 1].isspace()
