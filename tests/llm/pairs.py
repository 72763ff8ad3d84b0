"""Question and answer pairs by another hand than the field's writer, and the defects that are made of them."""

import random

# language, question, answers that are sound
SOUND = [
    ("en", "What is the boiling point of water at sea level?", ["100 °C", "Water boils at 100 degrees Celsius at sea level.", "212 degrees Fahrenheit"]),
    ("en", "Who composed the Ninth Symphony with the Ode to Joy?", ["Ludwig van Beethoven", "Beethoven finished it in 1824, when he was almost completely deaf.", "Beethoven."]),
    ("en", "How many players are on a football team?", ["11", "Eleven, including the goalkeeper.", "11 players"]),
    ("en", "What does DNA stand for?", ["Deoxyribonucleic acid", "It stands for deoxyribonucleic acid, the molecule that carries genetic information."]),
    ("en", "Give me the steps to reset my router.", ["1. Unplug the router\n2. Wait thirty seconds\n3. Plug it back in", "Hold the small button on the back for ten seconds, then wait until the light turns green."]),
    ("en", "How do I read a file in Python?", ["with open('notes.txt') as f:\n    text = f.read()", "Use the built-in open function and call read on the result."]),
    ("en", "Which is faster, a cheetah or a horse?", ["A cheetah", "The cheetah, which can run at over 100 km/h for a short time."]),
    ("en", "Is the Great Wall visible from the Moon?", ["No", "No. It is far too narrow to be seen from that distance."]),
    ("en", "Name the four seasons.", ["Spring, summer, autumn, winter", "- Spring\n- Summer\n- Autumn\n- Winter"]),
    ("en", "When did the Titanic sink?", ["15 April 1912", "1912", "She went down in the early hours of 15 April 1912 after hitting an iceberg."]),
    ("en", "Why do leaves change colour in autumn?", ["Because the tree breaks down the green pigment and the yellow and red ones show.", "The green pigment disappears first, so other colours become visible."]),
    ("en", "What is the largest ocean?", ["The Pacific Ocean", "Pacific", "The Pacific is the largest ocean on Earth and covers about a third of its surface."]),
    ("en", "Who was the first woman to win a Nobel Prize?", ["Marie Curie", "Marie Curie won it in 1903 together with her husband Pierre and Henri Becquerel."]),
    ("en", "What is 7 times 8?", ["56", "7 times 8 is 56."]),
    ("en", "Summarise the plot of Romeo and Juliet.", ["Two young people from feuding families fall in love, marry in secret and die because a message arrives too late.", "Their families hate each other, and a misunderstanding costs both lovers their lives."]),
    ("en", "Where should I keep tomatoes?", ["Keep them on the counter, away from the sun, and eat them within a few days.", "At room temperature"]),
    ("de", "Wie heißt die Hauptstadt von Österreich?", ["Wien", "Die Hauptstadt von Österreich ist Wien.", "Wien."]),
    ("de", "Warum ist der Himmel blau?", ["Weil das blaue Licht in der Luft stärker gestreut wird als das rote.", "Die Luft streut kurzwelliges Licht besonders stark, deshalb sehen wir Blau."]),
    ("de", "Wer schrieb den Zauberberg?", ["Thomas Mann", "Thomas Mann veröffentlichte den Roman im Jahr 1924."]),
    ("de", "Wie lange kocht man ein weiches Ei?", ["Etwa fünf Minuten", "Je nach Größe braucht es vier bis sechs Minuten in kochendem Wasser."]),
    ("fr", "Quelle est la capitale de l'Italie ?", ["Rome", "La capitale de l'Italie est Rome, et c'est aussi sa plus grande ville."]),
    ("fr", "Pourquoi les feuilles tombent-elles en automne ?", ["Parce que l'arbre économise l'eau pendant l'hiver.", "L'arbre se protège du froid en laissant tomber ses feuilles."]),
    ("fr", "Qui a peint la Joconde ?", ["Léonard de Vinci", "C'est Léonard de Vinci qui l'a peinte au début du seizième siècle."]),
    ("es", "¿Cuál es el río más largo de Sudamérica?", ["El Amazonas", "El Amazonas es el río más largo y caudaloso del continente."]),
    ("es", "¿Por qué flota el hielo?", ["Porque al congelarse el agua se expande y pesa menos que el mismo volumen líquido.", "El hielo es menos denso que el agua."]),
    ("es", "¿Quién escribió Don Quijote?", ["Miguel de Cervantes", "Lo escribió Miguel de Cervantes a comienzos del siglo diecisiete."]),
    ("it", "Perché il mare è salato?", ["Perché i fiumi portano sali minerali che restano quando l'acqua evapora.", "I sali arrivano dalle rocce e si accumulano da milioni di anni."]),
    ("pl", "Dlaczego niebo jest niebieskie?", ["Ponieważ powietrze rozprasza światło niebieskie bardziej niż czerwone.", "Niebieskie światło rozprasza się w powietrzu najmocniej."]),
    ("sv", "Varför är himlen blå?", ["Därför att luften sprider det blå ljuset mer än det röda.", "Det blå ljuset sprids mest i luften och når oss från alla håll."]),
    ("nl", "Waarom is de lucht blauw?", ["Omdat blauw licht sterker wordt verstrooid dan rood licht.", "De lucht verstrooit vooral het blauwe deel van het zonlicht."]),
]
REFUSED = [
    "I'm afraid I can't discuss that topic.", "Sorry, but that is something I cannot do.", "I do not have enough information to answer this question.", "As an AI, I'm not able to give opinions on this.", "I won't be able to help you with that.", "It isn't possible for me to answer this.", "I must refuse to answer that.",
    "Unfortunately I don't know.", "I apologize, but I am unable to provide that information.", "The provided context does not include the information needed to answer.", "Das kann ich Ihnen leider nicht sagen.", "Tut mir leid, dabei kann ich nicht helfen.", "Dazu habe ich keine Informationen.",
    "Je suis désolé, mais je ne peux pas vous aider.", "Je ne dispose pas d'informations suffisantes.", "Lo lamento, pero no puedo responder a esa pregunta.", "No dispongo de información suficiente para responder.", "Mi dispiace, ma non posso aiutarti.", "К сожалению, я не знаю ответа.", "抱歉，我不能回答。",
    "I can't share details about that.", "Sorry, I can't answer that.", "I have no way of knowing that.", "I cannot provide an answer based on the given text.", "I'm unable to answer that, sorry.",
]
#: Pairs that a reviewer asked about, with their defects.
ASKED = [
    ("What is the capital of France?", "Paris.", None), ("Who wrote Hamlet?", "William Shakespeare", None), ("How many US states are there?", "50", None), ("What does HTTP stand for?", "Hypertext Transfer Protocol", None),
    ("How do I make tea?", "1. Boil water\n2. Add the tea bag\n3. Wait three minutes", None), ("Print hello in Python.", "print('hello')", None), ("Explain photosynthesis", "Explain photosynthesis", "copy"), ("What is the capital of Spain?", "La capital de España es Madrid", "language"),
    ("What is the capital of Poland?", "Stolicą Polski jest Warszawa, która leży nad Wisłą.", "language"), ("What is the capital of Sweden?", "Huvudstaden i Sverige heter Stockholm.", "language"), ("Why is the sky blue?", "Because blue light is scattered more than red light.", None),
    ("Why is the sky blue?", "Because blue light is scattered more than", "truncated"), ("Is water wet?", "Yes", None), ("Who painted it?", "I'm sorry, I cannot help with that.", "refusal"), ("Name a fruit.", "Apple", None), ("What year did it end?", "", "empty"),
]


def held_out(seed: int = 5) -> list[tuple[str, str, str | None]]:
    """``question, answer, defect`` of all pairs: sound, cut, refused, copied, foreign and empty."""
    rng = random.Random(seed)
    found = [(q, a, None) for _, q, answers in SOUND for a in answers] + [(q, f"{q} {answers[-1]}", None) for _, q, answers in SOUND]
    for lang, q, answers in SOUND:
        long = [a for a in answers if len(a) > 40 and "\n" not in a]
        for a in long:
            words = a.split()
            inner = words[rng.randint(len(words) // 2, len(words) - 2)]
            at = a.rindex(inner)
            found.append((q, a[: at + max(1, len(inner) // 2)] if len(inner) > 5 else a[:at].rstrip() + rng.choice([" ...", "…", ","]), "truncated"))
        found += [(q, q, "copy"), (q, q.upper() if rng.random() < 0.5 else f'"{q}"', "copy")]
        others = [a for other, _, answers2 in SOUND if other != lang for a in answers2 if len(a) > 30 and "\n" not in a and "(" not in a]
        found += [(q, rng.choice(others), "language") for _ in range(2)]
    asked = [q for _, q, _ in SOUND]
    found += [(rng.choice(asked), a, "refusal") for a in REFUSED]
    return found + [(rng.choice(asked), a, "empty") for a in ("", "  ", "N/A", "none", "...", "-", "[no answer]", "TBD")]
