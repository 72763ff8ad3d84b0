"""Letters, notes and forms by another hand than the trees' writer, with personal data marked ``{kind:text}``."""

import re

KINDS = {"n": "name", "p": "phone", "i": "id", "a": "address", "e": "email"}
TEXTS = """
Dear {n:Margaret Oduya}, thank you for your order of 3 March. We have sent the kettle to {a:14 Linden Road} and enclose invoice 20318.
If the parcel does not arrive, call us on {p:020 7946 0958} or write to {e:orders@kettleshop.example}.
{n:Tomasz Wiśniewski} joined the choir last autumn and now lives at {a:ul. Długa 18}.
Patient {n:Helen Marsh}, NHS number {i:943 476 5919}, was seen on 12.04.2021 at 10:40.
Our treasurer, {n:D. K. Adeyemi}, will be away until Tuesday; please use {e:treasurer [at] rowingclub [dot] example}.
The minutes were taken by {n:Aurélie Fontaine} and approved by all members present.
Bitte senden Sie die Unterlagen an {n:Jürgen Brandt}, {a:Lindenallee 7}, 50667 Köln.
Meine neue Nummer ist {p:+49 151 23456789}, die alte gilt nicht mehr.
Herr {n:Matthias Vogel} hat am Montag angerufen und um Rückruf unter {p:030 901820} gebeten.
La carta la firmó {n:Lucía Fernández Ortega} en nombre de la asociación de vecinos.
Vive en la {a:Calle Mayor 25} desde hace diez años, y su DNI es {i:12345678Z}.
Mme {n:Sandrine Leclerc} habite {a:8, rue des Lilas} et répond au {p:06 12 34 56 78}.
Il signor {n:Paolo Bianchi} ha telefonato alle otto; il suo codice fiscale è {i:BNCPLA80A01H501U}.
Marta i {n:Piotr Zieliński} kupili dom przy {a:ul. Ogrodowa 5}.
{n:Bjørn Haugland} bor i {a:Storgata 12} og kan nås på {p:+47 22 12 34 56}.
De heer {n:Willem de Vries}, {a:Kerkstraat 12}, heeft het pakket niet ontvangen.
Min mormor {n:Astrid Lindqvist} bodde på {a:Drottninggatan 44} i hela sitt liv.
Письмо подписал {n:Сергей Иванов}, директор школы.
Докладчик: {n:Петрова Анна Сергеевна}. Вопросы можно задать после доклада.
Бабушка живёт по адресу {a:ул. Садовая, д. 14}, второй подъезд.
联系人：{n:王小明}，电话 {p:138 0013 8000}。
请把合同交给{n:李建国}先生，谢谢。
公司地址是{a:中山路128号}，离地铁站很近。
担当者：{n:山本太郎}までご連絡ください。
담당자: {n:김민지}, 문의는 이메일로 주세요.
حضر السيد {n:خالد منصور} إلى الاجتماع في الموعد.
कल श्री {n:रमेश शर्मा} ने पुस्तकालय का उद्घाटन किया।
เมื่อวานนาย{n:สมชาย ใจดี} ได้รับรางวัลจากโรงเรียน
Anh {n:Nguyễn Văn Thành} đã gọi hai lần hôm qua.
{n:Ayşe Yılmaz} dün akşam konsere geldi.
Coach: {n:Priya Raman}
Goalkeeper {n:Kwame Mensah} saved two penalties, and the crowd sang his name.
From: {n:Siobhán Kelly} ({e:s.kelly@library.example})
The flat at {a:221B Baker Street} is let to {n:John H. Watson}, formerly of the army.
My passport, {i:X1234567}, expires next June.
Her social security number, {i:078-05-1120}, was printed on the envelope by mistake.
Employee {n:Rosa Delgado} (ID {i:E4471203}) asked for unpaid leave.
Emergency contact: {n:Frank Nakamura}, {p:(415) 555-0132}.
Landlord {n:Oluwaseun Bello} wants the keys back by Friday; his office is at {a:77 Harcourt Terrace, Suite 4}.
Reach me at {e:anneke.j@posteo.example} or on {p:06-12345678} after work.
{n:O'Brien, Declan} owes the club two months of dues.
Signed: {n:M. Castellano}
Witness statement of {n:Grace Li}: I saw the van turn left and stop.
Professor {n:Ingrid Solheim} lectures on tides on Thursdays.
We met Carlos once, but {n:Carlos Ibáñez} does not remember it.
The babysitter, {n:Chloe Bennett}, charges ten an hour and lives two doors down.
Tell {n:Ahmed El-Sayed} that the piano has been tuned.
{n:VIKTORIA HOLM} won the raffle; the prize was a ham.
You can find {n:Jean-Luc Moreau} in the greenhouse most mornings.
Our vet, Dr. {n:Amelia Hart}, has moved to {a:5 Mill Lane}.
Invoice to {n:Sofia Rossi}, {a:Via Garibaldi 31}, Torino.
Ring Nils or the caretaker, {n:Henrik Dahl}, at {p:08-123 456 78} if the heating fails.
Applicant {n:Fatima Zahra Benali} gave {e:fz.benali (at) mail (dot) example} as her address for replies.
He spells it {n:Krzysztof Nowak}, with a z after the r.
Cheques payable to {n:Edmund Ashworth} please.
Flight 4471 to Lisbon leaves at 06:45 from gate 12.
The Golden Anchor Hotel on Harbour Street has 48 rooms and a sauna.
Order 4471-220-118 contains two lamps, item 555-0199-2, and a rug.
Chapter 12 of the River Atlas covers the years 1815 to 1848.
Acme Widgets Ltd filed its annual report on 31 December 2019.
Mix 250 g flour, 125 g butter and 2 eggs; bake at 180 for 35 minutes.
The ISBN of the second edition is 978-3-16-148410-0.
Between Oslo and Bergen the train takes about seven hours.
Version 10.4.2.1 fixes the crash on startup.
Lake Victoria is larger than Lake Tanganyika by area.
On Friday The Silver Foxes play at the Blue Note Club.
Das Rathaus am Marktplatz wurde 1907 gebaut.
Le Musée des Beaux Arts ouvre à dix heures.
El Teatro Real presenta una nueva ópera en otoño.
Model ZX-4410 draws 12.5 A at 230 V and weighs 18 kg.
Serial number 8842-1190-3371 is engraved under the lid.
The total came to 1,204.50 with tax, of which 200.75 was refunded.
North Wind Energy and Blue Sky Travel share an office on Queen Street.
See Table 4 and Figure 12 for the rainfall of the last 30 years.
Ticket 100 200 3000 was drawn at random from the drum.
The Old Stone Bridge was painted green last summer.
New York and San Francisco are far apart.
She finished the marathon in 3:42:10, 1204th of 5300 runners.
"""


def marked() -> list[tuple[str, set[tuple[str, str]]]]:
    """``(text, {(kind, piece), ...})`` of each."""
    found = []
    for line in TEXTS.strip().splitlines():
        pieces = {(KINDS[k], p) for k, p in re.findall(r"\{([npiae]):([^}]*)\}", line)}
        found.append((re.sub(r"\{[npiae]:([^}]*)\}", r"\1", line), pieces))
    return found
