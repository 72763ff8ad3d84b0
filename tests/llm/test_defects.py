import random

import numpy as np
import pytest

from quirework.llm import defects
from tests.llm.pairs import ASKED, held_out


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/validated_records.parquet").select("question", "answer").distinct().collect()
    return sorted((r.question, r.answer) for r in found if r.question and r.answer)


@pytest.fixture(scope="module")
def field(rows):
    return defects.train(rows)


def test_likelihood_by_enumeration():
    """Decoding finds the best of all tag sequences."""
    rng = np.random.default_rng(3)
    field = defects.Field()
    field.emit[: defects.DIM] = rng.normal(size=(defects.DIM, 5))
    field.step, field.start = rng.normal(size=(5, 5)), rng.normal(size=5)
    sequences = [[[1, 2], [3], [4, 5, 6]], [[7]], [[8, 9], [1]]]
    for s, tags in zip(sequences, field.decode(sequences)):
        emit = [field.emit[c].sum(0) for c in s]
        score = lambda y: field.start[y[0]] + sum(emit[t][y[t]] for t in range(len(s))) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(np.ndindex(*[5] * len(s)), key=score)
        assert tuple(tags) == best


def test_held_out_accuracy(rows):
    half = len(rows) // 2
    rng = random.Random(1)
    rng.shuffle(rows := list(rows))
    field = defects.train(rows[:half])
    sequences, gold = defects.examples(rows[half:], seed=11, known=field.known)
    pairs = [(a, b) for y, z in zip(field.decode(sequences), gold) for a, b in zip(y, z)]
    assert sum(a == b for a, b in pairs) > 0.95 * len(pairs)


def test_pairs_by_another_hand(field):
    """Pairs that share nothing with the rows and the writer: at least 0.9 of each type, and 0.9 of the sound ones."""
    pairs, count = held_out(), {}
    assert len(pairs) >= 200
    for (_, _, want), got in zip(pairs, defects.judge(field, [(q, a) for q, a, _ in pairs])):
        right, total = count.get(want, (0, 0))
        count[want] = right + (got == want), total + 1
    assert all(right >= 0.9 * total for right, total in count.values()), count


@pytest.mark.parametrize("question, answer, defect", ASKED)
def test_short_and_foreign_answers(field, question, answer, defect):
    assert defects.judge(field, [(question, answer)]) == [defect]


@pytest.mark.parametrize("text, lang", [("Vattnet är kallt och djupt", "sv"), ("Gdzie jest moja książka", "pl"), ("Wo ist mein Buch geblieben", "de"), ("свежий хлеб", "cyrillic"), ("新鲜的面包", "han"), ("新しいパンです", "ja"), ("빵이 있다", "ko"), ("12 34", None)])
def test_languages(text, lang):
    assert defects.language(defects.WORD.findall(text.lower()), text)[0] == lang


Q = "Which lane taper must Vodikonet keep at Lurabend so that Pasimold meets entry KX12ABC?"
GOOD = "The night crew at Vodikonet decides, and the note TX12ABC says the lane taper could stay in place for 85 days."


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        (Q, GOOD, None), (Q, f"{Q} {GOOD}", None), (Q, None, "empty"), (Q, "", "empty"), (Q, " ​\n", "empty"), (Q, "N/A", "empty"), (Q, "answer:", "empty"), (Q, "[ ]", "empty"),
        (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"Answer: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"),
        (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Es tut mir leid, diese Frage kann ich nicht beantworten.", "refusal"), (Q, "insufficient context.", "refusal"), (Q, "Lo siento, no puedo responder a eso.", "refusal"),
        (Q, GOOD + " The crew cannot close the speed hump before the drawings agrees, so the work waits when crews change shift.", None),
        (Q, "Bei Lurabend liegt die Grenze bei 82,3 m, während Pasimold mehr erlaubt, sobald die Wartung zustimmt.", "language"),
        (Q, "Откос был осмотрен после ремонта. Почему съезд не был осмотрен?", "language"),
        (Q, GOOD + " The slip road has to be cleared within a month, beca", "truncated"), (Q, "At Lurabend the limit is 42.3 kN, while Pasimold may go up to…", "truncated"), (Q, GOOD + " The turn pocket is moved towards the", "truncated"),
    ],
)
def test_cases(field, question, answer, defect):
    assert defects.judge(field, [(question, answer)]) == [defect]


@pytest.mark.parametrize("sign", [".", "_", "-", "–", ". ", "…"])
def test_many_signs_after_the_last_word(spark, field, sign):
    few, many = (f"At Lurabend the limit is 42 m {sign * n}".rstrip() for n in (9, 300))
    question = defects.Question(Q)
    assert defects.features(question, [few]) == defects.features(question, [many])  # dots count as one kind from two on
    defect = defects.judge(field, [(Q, few)])[0]
    rows = [(1, Q, many), (2, Q, "Q" * 90 + sign * 80), (3, Q, "")]
    got = {(r.record_seq, r.defect) for r in defects.find_defects(spark.createDataFrame(rows, "record_seq long, question string, answer string"), field).collect()}
    assert (3, "empty") in got and ((1, defect) in got) == bool(defect)


def test_operator_cases(spark, field):
    rows = [(1, Q, None), (1, Q, None), (2, None, GOOD), (3, None, None), (4, Q, GOOD * 400), (None, Q, ""), (5, "", "")]
    df = spark.createDataFrame(rows, "record_seq long, question string, answer string").selectExpr("*", "'x' AS defect")
    got = {(r.record_seq, r.defect) for r in defects.find_defects(df, field).collect()}
    assert got == {(1, "empty"), (3, "empty"), (None, "empty"), (5, "empty")}
    assert defects.find_defects(df.limit(0)).count() == 0
