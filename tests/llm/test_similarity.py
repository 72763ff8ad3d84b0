import random
from collections import Counter
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quirework.llm import common, neardup, overlaps, setjoin
from quirework.llm.setjoin import Plan


def sets_of(text, k=1):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, plan):
    s = {i: sets_of(t, plan.shingle) for i, t in texts.items()}
    return {(a, b) for a in s for b in s if a < b and s[a] and s[b] and Fraction(len(s[a] & s[b]), len(s[a] | s[b])) >= plan.threshold}


def corpus(seed, longest):
    rng = random.Random(seed)
    common, out = [f"c{k}" for k in range(12)], {}
    for i in range(90):
        if i and rng.random() < 0.6:
            w = out[rng.randrange(i)].split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice([*common, f"n{rng.randrange(400)}"])
            w = w[: rng.randrange(len(w) + 1)] + w if rng.random() < 0.1 else w[rng.randrange(2) :]
        else:
            w = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(60)}" for _ in range(rng.randrange(0, longest))]
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize(
    "plan, longest",
    [
        (neardup.QUESTION, 22), (neardup.CHUNK, 30), (Plan(Fraction(4, 5), combined_up_to=12), 40), (Plan(Fraction(1, 2), depth=2, orders=3), 6), (Plan(Fraction(1, 2), depth=2, combined_up_to=8), 24),
        (replace(neardup.QUESTION, hot=3), 22), (replace(neardup.CHUNK, hot=2), 30), (Plan(Fraction(1, 2), depth=2, orders=3, combined_up_to=5, hot=1), 24),
    ],
)
def test_pairs_equal_brute_force(spark, plan, longest):
    for seed in (1, 2):
        texts = corpus(seed, longest)
        frame = spark.createDataFrame(list(texts.items()), "id long, text string")
        got = {tuple(r) for r in neardup.near_pairs(frame, "id", "text", plan).collect()}
        assert got == brute(texts, plan)


def test_orders_leave_fewer_candidates(spark):
    """Marks of further orders drop pairs in the join, and prefixes drop more; none of the pairs sought is lost."""
    rng = random.Random(4)
    often = [f"c{k}" for k in range(40)]
    texts = {i: " ".join(rng.sample(often, 14)) for i in range(300)}
    rows = neardup._rows(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    count = {}
    for orders in (1, 3):
        plan = replace(neardup.QUESTION, orders=orders)
        classes, rare = setjoin._sketch(rows, plan)
        prefixes = setjoin._prefix_rows(rows, plan, classes, rare).withColumns({"sig": F.lit(0).cast("long"), "sig2": F.lit(0).cast("long")})
        count[orders] = setjoin._candidates(prefixes, plan, False).count()
    assert count[3] < count[1]


def test_hot_key_join(spark):
    left, right = spark.range(50).selectExpr("id AS l", "if(id < 40, 1, id) AS k"), spark.range(60).selectExpr("id AS r", "if(id % 2 = 0, 1, id) AS k")
    got = sorted(map(tuple, common.spread_join(left, right, "k", "l", hot=4).select("k", "l", "r").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "l", "r").collect())) and len(got) > 1000


def test_defined_cases(spark):
    same = "one two three four"
    rows = [(1, None), (2, ""), (3, " ?! "), (4, same), (4, same), (5, "FOUR three, two one"), (6, "Straße 5"), (7, "straße 5."), (None, same), (8, "w " * 5000 + " ".join(f"x{k}" for k in range(9000))), (9, " ".join(f"x{k}" for k in range(9000)))]
    frame = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS side", "'x' AS hashes", "2 AS id_a")
    assert {tuple(r) for r in neardup.near_pairs(frame, "id", "text", neardup.QUESTION).collect()} == {(4, 5), (6, 7), (8, 9)}
    classes = {r.id: r for r in neardup.near_classes(frame, "id", "text", neardup.QUESTION).collect()}
    assert {i: r.class_id for i, r in classes.items()} == {4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8} and classes[8].n_links == 1 and classes[4].n_links == 0
    assert neardup.near_pairs(frame.limit(0), "id", "text").count() == 0
    assert neardup.near_classes(frame.limit(0), "id", "text").count() == 0


def test_cross_split(spark):
    base = " ".join(f"word{k}" for k in range(18))
    rows = [
        (1, base, "and an answer", " c1 ", "train"), (2, base, "and an answer", "C1", "val"), (3, base, "And another answer", None, "test"), (3, base, "And another answer", None, "test"),
        (4, base, None, None, "train"), (5, "other question", None, "c2", "train"), (6, "something else", "entirely", "C2 ", "test"), (7, base, "and an answer", "c9", "dev"), (8, None, None, None, "val"), (9, None, "", None, "train"),
    ]
    df = spark.createDataFrame(rows, "record_seq long, question string, answer string, chunk_id string, split_name string").selectExpr("*", "'doc' AS source_doc", "0 AS side")
    got = {(r.train_seq, r.eval_seq): (r.same_chunk, r.near_text) for r in overlaps.cross_split_pairs(df).collect()}
    assert got == {(1, 2): (True, True), (1, 3): (False, True), (4, 2): (False, True), (4, 3): (False, True), (5, 6): (True, False)}
    report = {r.split_name: r for r in overlaps.overlap_report(df, overlaps.cross_split_pairs(df)).collect()}
    assert report["test"].n_records == 2 and report["test"].n_pairs == 3 and report["val"].n_same_chunk == 1
    assert overlaps.cross_split_pairs(df.limit(0)).count() == 0


def test_hot_copies_stay_one_entity(spark):
    frame = spark.range(3000).selectExpr("id", "CASE WHEN id < 1000 THEN 'the same old question about a road' ELSE concat('question ', id, ' of ', id * 7, ' at ', id * 13) END AS text")
    members, pairs = setjoin.similar_sets(neardup._rows(frame, "id", "text"), neardup.QUESTION)
    assert members.count() == 3000 and pairs.count() == 0
    assert Counter(r["count"] for r in members.groupBy("set").count().collect())[1000] == 1


def test_prefix_rows_go_in_parts(spark, monkeypatch):
    """At no time are more than some of the prefix rows on their way; every row is in one part, and the pairs are those of brute force."""
    texts = corpus(3, 30)
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    emit, sent, read = setjoin._prefix_rows, [], []

    def counted(rows, plan, classes, rare, *parts):
        out = emit(rows, plan, classes, rare, *parts)
        sent.append(out.count())
        read.append((emit(rows, plan, classes, rare).count(), rows.columns))
        return out

    monkeypatch.setattr(setjoin, "_prefix_rows", counted)
    got = {tuple(r) for r in neardup.near_pairs(frame, "id", "text", neardup.CHUNK).collect()}
    assert got == brute(texts, neardup.CHUNK) and got
    assert sum(sent) == read[0][0] and max(sent) < 0.5 * sum(sent)
    assert all(columns == ["id", "side", "tokens"] for _, columns in read)  # texts are not hashed again
