import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirework.llm import splits
from quirework.llm.components import connected_components


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(170)]
    pairs += [(f"z{k:03}", f"z{k + 1:03}") for k in range(60)] + [("hot", f"leaf{k}") for k in range(100)] + [("solo", "solo")]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*pairs, *pairs[:9], (None, "a")], "src string, dst string")).collect()}
    assert got == roots(pairs)
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


SAME = [
    "Tall-Bridge_Survey vol3.pdf", "tall bridge survey_vol3.PDF", "inbox/Tall-Bridge-Survey-vol3(2).pdf", "C:\\in\\Tall Bridge Survey_vol3.pdf",
    "Tall%20Bridge%20Survey%20vol3.pdf", "scans%2F2031%2FTall_Bridge_Survey_vol3.docx", "Tall_Bridge_Survey_vol3 - Copy.pdf", "Tall_Bridge_Survey_vol3 - Copy (2).pdf",
    "Copy of Tall_Bridge_Survey_vol3.pdf", "Tall_Bridge_Survey_vol3 (1)", "  TALL_BRIDGE_SURVEY_VOL3.pdf ", "Tall_Bridge_Survey_vol3_copy.pdf", "Tall_Bridge_Survey_vol3.pdf (1)",
]
OTHER = ["Tall_Bridge_Survey_vol4.pdf", "Tall_Bridge_Survey.pdf", "100%.pdf", "", ".pdf", "Copybook.pdf"]


def test_document_key(spark):
    df = spark.createDataFrame([(s,) for s in [*SAME, *OTHER, None]], "s string").select("s", splits.document_key(F.col("s")).alias("k"))
    got = {r.s: r.k for r in df.collect()}
    assert len({got[s] for s in SAME}) == 1 and got[None] is None
    assert len({got[s] for s in OTHER} | {got[SAME[0]]}) == len(OTHER) + 1


@pytest.mark.parametrize(
    "field, keys",
    [
        ("S. Badenas; T.  TEPIRUD", {"badenas s", "t tepirud"}),
        ("Badenas, S.", {"badenas s"}),
        ("M. Sibip & Didof, J. & R.  Mofev / B. Bek", {"m sibip", "didof j", "mofev r", "b bek"}),
        ("Kim, A., Lee, B.", {"a kim", "b lee"}),
        ("Anna Kim, Bo Lee", {"anna kim", "bo lee"}),
        ("n/a", set()), ("-", set()), (" Unknown  Author ", set()), ("", set()), (None, set()), ("unknown; S. Kim", {"kim s"}),
    ],
)
def test_persons(spark, field, keys):
    assert set(spark.createDataFrame([(field,)], "a string").select(splits.persons(F.col("a"))).first()[0]) == keys


def docs_frame(spark, rows):
    return spark.createDataFrame([(k, f"/in/{d}", d, a, e) for k, (d, a, e) in enumerate(rows)], "doc_seq int, path string, source_doc string, author string, entity string")


DOCS = [
    ("a.pdf", "S. Kim", None), ("b.pdf", "KIM, S.", "Road Office"), ("c.pdf", None, "road  office "), ("mid.pdf", "T. Lo", "Road Office"), ("d.pdf", "Lo, T.; X. Yu", "n/a"),
    ("e.pdf", "unknown", "n/a"), ("f.pdf", "unknown", ""), ("f.pdf", "unknown", ""), (None, None, None),
]


def test_groups_through_chains(spark):
    records = spark.createDataFrame([(k, d) for k, d in enumerate(["A.pdf", "b.pdf", "x/B (1).PDF", "c.pdf", "d.pdf", "e.pdf", "f.pdf", "g.pdf", None, "c.pdf"])], "record_seq long, source_doc string").withColumn("group_doc", F.lit("clash"))
    got = {tuple(r) for r in splits.group_documents(records, splits.update_components(splits.link_edges(docs_frame(spark, DOCS)))).collect()}
    assert got == {("A.pdf", s) for s in ("b.pdf", "x/B (1).PDF", "c.pdf", "d.pdf")}
    empty = splits.link_edges(docs_frame(spark, DOCS).limit(0))
    assert {tuple(r) for r in splits.group_documents(records, splits.update_components(empty)).collect()} == {("b.pdf", "x/B (1).PDF")}


def test_incremental_splits(spark):
    records = spark.createDataFrame([(k, f"{'abcdefghij'[k % 10]}.pdf") for k in range(400)] + [(0, "a.pdf"), (900, None)], "record_seq long, source_doc string")
    first = splits.assign_splits(records, docs_frame(spark, [("a.pdf", "P. One", None), ("b.pdf", "P. One", None), ("c.pdf", "Q. Two", None)]))
    one = {r.node: r for r in first.collect()}
    assert one["d:a"].split == one["d:b"].split and all(r.status == "new" for r in one.values())
    placed = {r.record_seq: r for r in splits.place_records(records, first).collect()}
    assert len(placed) == 401 and placed[900].status == "no_document"
    sizes = Counter(r.split for r in placed.values() if r.split)
    assert abs(sizes["train"] - 320) <= 40 and min(sizes.values()) >= 20
    other = next(n[2:] for n, r in one.items() if n.startswith("d:") and r.split not in (None, one["d:a"].split))
    grown = docs_frame(spark, [("new.pdf", "P. One", None), ("free.pdf", "Z. New", None), ("join.pdf", "Q. Two; W. Both", None), (f"{other}.pdf", "V. Link", None), ("a.pdf", "V. Link", None)])
    two = {r.node: r for r in splits.assign_splits(records, grown, state=first).collect()}
    assert two["d:a"].status == two[f"d:{other}"].status == "quarantined" and two["d:a"].split is None and two["d:new"].root == two["d:a"].root
    assert two["d:join"].split == one["d:c"].split or two["d:c"].status == "quarantined"
    assert two["d:free"].status == "new" and two["d:free"].split
    kept = [n for n in one if two[n].status == "kept"]
    assert kept and all(two[n].split == one[n].split for n in kept)
    by_root = defaultdict(set)
    for r in two.values():
        by_root[r.root].add((r.split, r.status))
    assert all(len(v) == 1 for v in by_root.values())


def test_state_is_held_under_a_path(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert splits.load_state(spark, path) is None
    records = spark.createDataFrame([(k, f"{'abcdefghij'[k % 10]}.pdf") for k in range(400)], "record_seq long, source_doc string")
    batches = [docs_frame(spark, [("a.pdf", "P. One", None), ("b.pdf", "P. One", None)]), docs_frame(spark, [("new.pdf", "P. One", None), ("free.pdf", "Z. New", None)]), docs_frame(spark, [("c.pdf", "Z. New", None)])]
    state = None
    for k, batch in enumerate(batches):
        state = splits.assign_splits(records, batch, state=state)
        held = splits.add_batch(records, batch, path)
        assert {tuple(r) for r in held.collect()} == {tuple(r) for r in splits.load_state(spark, path).collect()} == {tuple(r) for r in state.collect()}
        (tmp_path / "state" / f"v-{10 + 2 * k}").mkdir()  # a version that was not written to its end
    assert {r.status for r in held.where("node IN ('d:a', 'd:new')").collect()} == {"kept"}
    assert len(list((tmp_path / "state").glob("v-*/_SUCCESS"))) == 2


def test_query_runs_over_arrivals(spark, sf_dir, monkeypatch):
    seen, whole = [], splits.update_components
    monkeypatch.setattr(splits, "update_components", lambda edges, state=None: seen.append(state and state.count()) or whole(edges, state))
    docs = spark.read.parquet(f"{sf_dir}/source_docs.parquet")
    assert sum(b.count() for b in splits.arrivals(docs)) == docs.count() and all(b.count() == 0 for b in splits.arrivals(docs.limit(0)))
    splits.p1_found(spark, sf_dir)
    assert len(seen) == 2 and seen[0] is None and seen[1] > 0


def test_query_against_brute_force(spark, sf_dir):
    records, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("validated_records", "source_docs"))
    edges = [tuple(r) for r in splits.link_edges(docs).collect()]
    spellings = {r[0]: f"d:{r[1]}" for r in records.select("source_doc", splits.document_key(F.col("source_doc"))).distinct().collect() if r[0] is not None}
    root = roots([*edges, *((k, k) for k in spellings.values())])
    groups = defaultdict(list)
    for s, k in spellings.items():
        groups[root[k]].append(s)
    assert {tuple(r) for r in splits.p1_found(spark, sf_dir).collect()} == {(min(g), s) for g in groups.values() for s in g if s != min(g)}
