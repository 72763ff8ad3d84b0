"""Problem 1: splits that keep related records together.

Documents, persons and entities are nodes; a document is linked to each of its persons and entities. The
components of this graph, held in a persisted table, are the units that get a split. The table is updated
incrementally: a batch only brings its own edges, whose ends are first replaced by the roots that the
table already has, and pointer jumping merges what they link. A component keeps the split it has; a new
one fills the deficit of a split; a merge of components with different splits is quarantined.

Defined cases: null, blank and placeholder persons and entities link nothing; a null ``source_doc`` belongs to no
document and its records get the status ``no_document``; repeated rows count once; empty tables give empty
tables; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.components import connected_components
from quirework.session import cut_lineage, run_dir

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
#: A new component with more than this share of all records is placed by itself; there are at most
#: 1 / LARGE_SHARE of them, which bounds what the driver sees.
LARGE_SHARE = 0.002

#: What stands for an unknown person or entity, after lower-casing and joining blanks.
PLACEHOLDERS = [
    "", "-", "--", "---", "?", "??", ".", "/", "n/a", "n.a.", "n. a.", "na", "n.n.", "n. n.", "nn", "none", "nil", "null", "nan", "unknown",
    "unknown author", "author unknown", "unknown entity", "entity unknown", "unknown issuer", "not known", "not available", "not given",
    "not specified", "unspecified", "undefined", "anonymous", "anon", "anon.", "various", "various authors", "several", "tbd", "tba", "to be determined", "to be confirmed",
    "no author", "no entity", "author", "entity", "(none)", "(unknown)", "[unknown]", "<unknown>", "unbekannt", "keine angabe", "k.a.", "k. a.",
    "inconnu", "inconnue", "anonyme", "desconocido", "desconocida", "anónimo", "sin autor", "sans auteur", "ohne autor", "x", "xx", "xxx", "...", "…", "_", "*",
]

BLANK = r"(?U)[\s\x{00a0}\x{200b}\x{feff}]+"


def tidy(value: Column) -> Column:
    """Lower case, runs of blanks as one, none outside."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), BLANK, " "))


def document_key(spelling: Column) -> Column:
    """What the spellings of one document have in common; null for a null spelling.

    Percent-encoding, folder, case, copy marks, file extension, separators and blanks go. A spelling of
    which nothing is left stands for itself.
    """
    raw = F.lower(spelling)
    name = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    name = F.regexp_replace(tidy(name), r"^.*[/\\](?=[^/\\])", "")
    copy = r"(?:[\s_\-.]*[(\[{]\s*(?:copy|kopie|copie|copia)?\s*\d*\s*[)\]}]|[\s_\-.]+(?:copy|kopie|copie|copia|duplicate)(?:[\s_\-.]*\d+)?)+$"
    name = F.regexp_replace(F.trim(name), copy, "")
    name = F.regexp_replace(F.trim(name), r"(?<=.)\.(?!v\d|vol)[a-z][a-z0-9]{1,4}$", "")
    name = F.regexp_replace(F.trim(name), copy, "")
    name = F.regexp_replace(name, r"^(?:copy|kopie|copie|copia)[\s_\-]*(?:\(?\d+\)?)?[\s_\-]+(?:of|von|de|di)[\s_\-]+", "")
    key = F.regexp_replace(name, r"(?U)[\s_\-.+~,\p{Pd}\p{Pc}\p{Z}]+", "")
    return F.when(spelling.isNotNull(), F.when(key != "", key).otherwise(F.coalesce(F.nullif(tidy(spelling), F.lit("")), spelling)))


def name_key(value: Column) -> Column:
    """A person or entity regardless of case, blanks and the order of name parts; null for placeholders."""
    text = tidy(value)
    parts = F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}'’\-]+"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    key = F.array_join(F.array_sort(parts), " ")
    return F.when(~text.isin(PLACEHOLDERS) & (F.length(key) > 1) & ~key.isin(PLACEHOLDERS), key)


def persons(author: Column) -> Column:
    """Keys of the persons that an author field lists, by whatever separator."""
    text = F.regexp_replace(F.coalesce(author, F.lit("")), BLANK, " ")
    text = F.regexp_replace(text, r"([^,;/&|]+,\s*(?:\p{L}\.[\s\-]?)+)\s*,", "$1;")
    hard = F.split(text, r"(?i)\s*[;/&|•]\s*|\s+(?:and|und|et|y|e|with|mit)\s+")

    def by_comma(piece: Column) -> Column:
        sides = F.split(piece, r"\s*,\s*")
        count = lambda s: F.size(F.split(F.trim(s), " "))
        one_person = (F.size(sides) == 2) & ((count(sides[0]) == 1) | (count(sides[1]) == 1) | sides[1].rlike(r"^(?:\p{L}\.[\s\-]*)+$"))
        return F.when(one_person | (F.size(sides) == 1), F.array(piece)).otherwise(sides)

    pieces = F.when(tidy(author).isin(PLACEHOLDERS), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hard, by_comma)))
    return F.array_distinct(F.filter(F.transform(pieces, name_key), lambda k: k.isNotNull()))


def link_edges(source_docs: DataFrame) -> DataFrame:
    """``src, dst`` between each document and each of its persons and entities. A document without
    either gets a loop, so that it is a node."""
    doc = F.concat(F.lit("d:"), document_key(F.coalesce("source_doc", "path")))
    people = F.transform(persons(F.col("author")), lambda k: F.concat(F.lit("p:"), k))
    entity = F.concat(F.lit("e:"), name_key(F.col("entity")))
    ends = F.array_compact(F.array_append(F.concat(people, F.array(entity)), doc))
    return source_docs.select(doc.alias("src"), F.explode(ends).alias("dst")).where("src IS NOT NULL").distinct()


def update_components(edges: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``node, root, old_root`` after ``edges``; ``state`` is the persisted table ``node, root``.

    Only edges of the batch are walked: their ends are replaced by the roots of ``state`` first.
    ``old_root`` is null for nodes that are new.
    """
    if state is None:
        return connected_components(edges).withColumn("old_root", F.lit(None).cast("string"))
    held = lambda c: state.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
    lifted = edges.join(held("src"), "src", "left").join(held("dst"), "dst", "left")
    own = connected_components(lifted.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")))
    old = state.join(own.select(F.col("node").alias("root"), F.col("root").alias("__to")), "root", "left")
    old = old.select("node", F.coalesce("__to", "root").alias("root"), F.col("root").alias("old_root"))
    new = own.join(state.select("node"), "node", "left_anti").withColumn("old_root", F.lit(None).cast("string"))
    return cut_lineage(old.unionByName(new))


def _fill(new: DataFrame, held: dict[str, int], ratios: dict[str, float], total: int) -> DataFrame:
    """``root, split`` of new components (``root, weight``): large ones one by one into the largest deficit,
    all others by a hash of their root in proportion to the deficits that remain."""
    names = list(ratios)
    deficit = {s: ratios[s] * total - held.get(s, 0) for s in names}
    bound = max(1.0, LARGE_SHARE * total)
    large = new.where(F.col("weight") > bound).orderBy(F.desc("weight"), "root").limit(int(1 / LARGE_SHARE) + 1).collect()
    placed = {}
    for row in large:
        best = max(names, key=lambda s: (deficit[s], -names.index(s)))
        placed[row["root"]] = best
        deficit[best] -= row["weight"]
    open_ = {s: max(0.0, d) for s, d in deficit.items()}
    scale = sum(open_.values())
    shares = {s: (open_[s] / scale if scale else ratios[s]) for s in names}
    point = F.pmod(F.xxhash64("root"), F.lit(1_000_003)) / 1_000_003.0
    bounds, start = [], 0.0
    for s in names:
        bounds.append((s, start + shares[s]))
        start += shares[s]
    rule = F.lit(max(names, key=lambda s: shares[s]))
    for s, stop in reversed(bounds):
        rule = F.when(point < stop, F.lit(s)).otherwise(rule)
    spark = new.sparkSession
    fixed = spark.createDataFrame(list(placed.items()), "root string, __fixed string")
    return new.join(F.broadcast(fixed), "root", "left").select("root", F.coalesce("__fixed", rule).alias("split"))


def assign_splits(records: DataFrame, source_docs: DataFrame, *, state: DataFrame | None = None, ratios: dict[str, float] | None = None) -> DataFrame:
    """The persisted table after a batch: ``node, root, split, status, weight``.

    ``records`` are the records of the batch (``record_seq, source_doc``) and ``source_docs`` its documents; ``state`` is
    the table that the last call returned, whose ``weight`` holds the records that were counted before. A record
    delivered twice counts once within a batch. ``status`` is ``kept``, ``new`` or ``quarantined`` (then ``split`` is null).

    Links are walked, and records counted, for the batch alone. Of the table, the nodes that the batch names are looked
    up and its rows are carried over in one pass.
    """
    ratios = ratios or RATIOS
    docs = records.where("source_doc IS NOT NULL").select("record_seq", F.concat(F.lit("d:"), document_key(F.col("source_doc"))).alias("node"))
    counted = cut_lineage(docs.distinct().groupBy("node").agg(F.count("*").alias("__added")))
    named = counted.select("node") if state is None else counted.select("node").join(state.select("node"), "node", "left_anti")
    edges = link_edges(source_docs).unionByName(named.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    nodes = update_components(edges, None if state is None else state.select("node", "root"))
    if state is not None:
        old = state.groupBy(F.col("root").alias("old_root")).agg(F.max("split").alias("__split"), F.max((F.col("status") == "quarantined").cast("int")).alias("__bad"))
        nodes = nodes.join(old, "old_root", "left").join(state.select("node", F.col("weight").alias("__held")), "node", "left")
    else:
        nodes = nodes.withColumns({"__split": F.lit(None).cast("string"), "__bad": F.lit(0), "__held": F.lit(0).cast("long")})
    weighed = nodes.join(counted, "node", "left").withColumn("weight", F.coalesce("__held", F.lit(0)) + F.coalesce("__added", F.lit(0)))
    weighed = cut_lineage(weighed.select("node", "root", "__split", "__bad", "weight"))
    roots = cut_lineage(
        weighed.groupBy("root").agg(
            F.sum("weight").alias("weight"), F.min("__split").alias("low"), F.max("__split").alias("high"), F.coalesce(F.max("__bad"), F.lit(0)).alias("bad")
        )
    )
    conflict = (F.col("bad") == 1) | (F.col("low") != F.col("high"))
    totals = {r["low"]: r["weight"] for r in roots.where(~F.coalesce(conflict, F.lit(False))).groupBy("low").agg(F.sum("weight").alias("weight")).collect()}
    total = sum(totals.values())
    held = {s: totals.get(s, 0) for s in ratios}
    filled = _fill(roots.where("low IS NULL AND bad = 0").select("root", "weight"), held, ratios, total)
    status = F.when(F.coalesce(conflict, F.lit(False)), "quarantined").when(F.col("low").isNotNull(), "kept").otherwise("new")
    placed = roots.join(filled, "root", "left").select("root", F.when(~F.coalesce(conflict, F.lit(False)), F.coalesce("low", "split")).alias("split"), status.alias("status"))
    return weighed.select("node", "root", "weight").join(placed, "root").select("node", "root", "split", "status", "weight")


def _versions(spark, path: str) -> tuple:
    """The file system of ``path``, its ``Path`` class, and the numbers of all and of the complete versions there."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = of(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    every = sorted(int(n[2:]) for n in names if n.startswith("v-"))
    return fs, of, every, [n for n in every if fs.exists(of(f"{path}/v-{n}/_SUCCESS"))]


def load_state(spark, path: str) -> DataFrame | None:
    """The table that ``save_state`` last wrote completely to ``path``; None before the first."""
    complete = _versions(spark, path)[3]
    return spark.read.parquet(f"{path}/v-{complete[-1]}") if complete else None


def save_state(table: DataFrame, path: str) -> DataFrame:
    """Write the next version of the table to ``path`` and go on from it. ``table`` may come from the version
    before, which is kept; older ones are deleted."""
    fs, of, every, complete = _versions(table.sparkSession, path)
    table.write.option("compression", "zstd").parquet(f"{path}/v-{(every or [0])[-1] + 1}")
    for n in every:
        if n not in complete[-1:]:
            fs.delete(of(f"{path}/v-{n}"), True)
    return load_state(table.sparkSession, path)


def add_documents(source_docs: DataFrame, path: str) -> DataFrame:
    """``node, root`` after a batch of documents; the table is held under ``path``."""
    return save_state(update_components(link_edges(source_docs), load_state(source_docs.sparkSession, path)).select("node", "root"), path)


def add_batch(records: DataFrame, source_docs: DataFrame, path: str, *, ratios: dict[str, float] | None = None) -> DataFrame:
    """``assign_splits`` with the table held under ``path``."""
    return save_state(assign_splits(records, source_docs, state=load_state(records.sparkSession, path), ratios=ratios), path)


def arrivals(source_docs: DataFrame) -> list[DataFrame]:
    """The documents in two batches, by the time they were received; without one they come last."""
    middle = source_docs.agg(F.percentile_approx(F.unix_micros("received_at"), 0.5)).first()[0]
    early = F.coalesce(F.unix_micros("received_at") <= F.lit(middle).cast("long"), F.lit(False))
    return [source_docs.where(early), source_docs.where(~early)]


def place_records(records: DataFrame, table: DataFrame) -> DataFrame:
    """``record_seq, split, status`` of each record; delivered twice, it counts once."""
    keyed = records.select("record_seq", F.concat(F.lit("d:"), document_key(F.col("source_doc"))).alias("node")).distinct()
    return keyed.join(table.select("node", "split", "status"), "node", "left").select("record_seq", "split", F.coalesce("status", F.lit("no_document")).alias("status"))


def group_documents(spellings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``group_doc, source_doc``: each spelling (column ``source_doc``) that is not the smallest of its group."""
    keyed = spellings.where("source_doc IS NOT NULL").select("source_doc").distinct().withColumn("node", F.concat(F.lit("d:"), document_key(F.col("source_doc"))))
    keyed = cut_lineage(keyed.join(nodes.select("node", "root"), "node", "left").select("source_doc", F.coalesce("root", "node").alias("root")))
    first = keyed.groupBy("root").agg(F.min("source_doc").alias("group_doc"))
    return keyed.join(first, "root").where("source_doc <> group_doc").select("group_doc", "source_doc")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/validated_records.parquet"), spark.read.parquet(f"{sf_dir}/source_docs.parquet")


def p1_found(spark, sf_dir: str) -> DataFrame:
    records, docs = _tables(spark, sf_dir)
    path = f"{run_dir(spark)}/components-{uuid.uuid4().hex}"
    for batch in arrivals(docs):
        nodes = add_documents(batch, path)
    return group_documents(records, nodes)


def p1_splits(spark, sf_dir: str) -> DataFrame:
    records, docs = _tables(spark, sf_dir)
    return place_records(records, assign_splits(records, docs))


def p1_check(spark, sf_dir: str) -> DataFrame:
    """``name, ok``: whether every record of a document has a split, no group of ``p1_found`` is in two of them, and the share of each is
    within the largest group's share, or 0.02, of what is wanted."""
    records, docs = _tables(spark, sf_dir)
    placed = cut_lineage(place_records(records, assign_splits(records, docs)))
    groups = p1_found(spark, sf_dir)
    named = records.select("record_seq", "source_doc").distinct().join(placed, "record_seq").join(groups, "source_doc", "left").withColumn("group", F.coalesce("group_doc", "source_doc"))
    whole = named.where("group IS NOT NULL").groupBy("group").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"))
    torn = whole.agg((F.coalesce(F.max("splits"), F.lit(1)) <= 1).alias("ok"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    shares = placed.where("split IS NOT NULL").groupBy().pivot("split", list(RATIOS)).count().crossJoin(F.broadcast(torn))
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in RATIOS), F.lit(0))
    near = F.lit(True)
    for s, ratio in RATIOS.items():
        near = near & (F.abs(F.coalesce(F.col(s), F.lit(0)) / total - ratio) <= F.greatest(F.lit(0.02), F.col("largest") / total))
    lost = placed.where("split IS NULL AND status <> 'no_document'").agg((F.count("*") == 0).alias("ok"))
    found = [torn.select(F.lit("groups_whole").alias("name"), "ok"), shares.select(F.lit("shares_near").alias("name"), near.alias("ok")), lost.select(F.lit("all_placed").alias("name"), "ok")]
    return found[0].unionByName(found[1]).unionByName(found[2])


P1_CHECK_SQL = "SELECT name, true AS ok FROM (VALUES ('groups_whole'), ('shares_near'), ('all_placed')) v(name)"
