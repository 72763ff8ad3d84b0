"""Exact set-similarity join on word or shingle sets: prefix filter, length and position filters, verification.

Tokens are ordered from rare to frequent by a frequency sketch of fixed size that counts every token of every
row. Two sets whose Jaccard similarity reaches the threshold share at least ``depth`` tokens within
their prefixes; so they share a rare token there, or ``depth`` frequent ones. Rare tokens are join keys by
themselves; frequent ones only in combinations of ``depth`` tokens, and only between a longer set's prefix
and the (much shorter) prefix that a shorter set needs. This keeps frequent tokens from joining everything
with everything, and loses nothing: any token order and any rarity bound give the same result.

Under every further global order (``Plan.orders``) a similar pair has to meet within its prefixes as well. The candidates
are the intersection: rows of short sets carry a bit map of their prefix under each further order, by which
the join itself drops pairs; what is left meets the exact prefixes, which are sent for candidates alone. Token sets
move only for pairs that meet under all orders.

A frequent token may be in a third of all sets. Keys that the sketch counts more than ``Plan.hot`` times are salted: the
rows of longer sets take one salt by their set, those of shorter sets are repeated for every salt.

Texts are hashed once, into a written table of token sets (``_token_sets``). A set's prefix rows take several times the room of its
text, and in an exchange of many partitions hardly compress, so they meet in parts of the key space (``Plan.parts``), one after the
other: every key belongs to one part, and what pairs share is summed over the parts.

Rows with equal sets are joined once, through the key of their set; a group of copies, however large, is
one entity until the caller expands it. Set keys are 64-bit hashes; tokens are compared by 48
bits of their hash in the search and by 40 within a candidate pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import NOT_WORD
from quirework.session import collect_once, cut_lineage, discard

#: Cells of the frequency sketch, and cells of a block of it. Its size is fixed (16 MB), whatever the corpus; what
#: shares a cell by chance shifts all counts alike, so that frequent tokens stand out at every size.
CELLS = 1 << 22
BLOCK = 1 << 13
#: Set keys that a task remembers in order to send copies of a set only once.
REMEMBERED = 1_000_000
#: Bits of the map of candidate sets that is broadcast (16 MB, whatever the corpus). Sets that share a bit with a
#: candidate are sent for nothing.
MAP_BITS = 27
#: Salts of a hot key at most.
SALTS = 64

#: Bytes of a token in the table of sets, and those that go into verification.
STORED = 6
PACKED = 5

LOW48 = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixer of 64-bit numbers; another seed gives another order."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Plan:
    """Parameters of one join."""

    threshold: Fraction
    shingle: int = 1
    depth: int = 2  # frequent tokens in a join key
    orders: int = 1  # global token orders whose prefixes have to meet
    combined_up_to: int = 80  # sets of more tokens use single frequent tokens as keys instead of combinations
    hot: int = 1 << 16  # sets of one key beyond which it is salted; no token counted more often is rare
    parts: int = 4  # parts of the key space whose prefix rows are on disk one after the other

    def overlap(self, a, b):
        """The least intersection of sets of ``a`` and ``b`` tokens that reaches the threshold."""
        num, den = self.threshold.numerator, self.threshold.numerator + self.threshold.denominator
        return (num * (a + b) + den - 1) // den

    def long_prefix(self, n, depth):
        """Positions that a set needs against shorter sets, down to the shortest that can be similar."""
        shortest = -(-n * self.threshold.numerator // self.threshold.denominator)
        return n - self.overlap(n, shortest) + depth

    def short_prefix(self, n, depth):
        """Positions that a set needs against sets at least as long."""
        return n - self.overlap(n, n) + depth


#: The hash of the empty string, which splitting leaves at the ends of a text.
EMPTY_WORD = -7444071767201028348


def hashed_words(text: Column) -> Column:
    """Hashes of the words of a text, and ``EMPTY_WORD`` where it begins or ends with something else."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: F.xxhash64(w))


class Sets:
    """The sets of one batch: sorted distinct tokens, flat, with the set of each. The third column has hashes of words, or the
    tokens of a set as ``_token_sets`` packs them."""

    def __init__(self, batch: pa.RecordBatch, plan: Plan, classes: np.ndarray | None):
        self.id = batch.column(0)
        self.side = batch.column(1).to_numpy(zero_copy_only=False)
        if pa.types.is_binary(batch.column(2).type):
            raw, size = _flat(batch.column(2), STORED)
            token = np.zeros((len(raw), 8), np.uint8)
            token[:, :STORED] = raw
            token, owner = token.view(np.uint64).ravel(), np.repeat(np.arange(len(size)), size)
        else:
            token, owner, size = self._hashed(batch.column(2), plan)
        if classes is not None:
            token |= classes[(token % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(48)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).tolist()
        for a, b in zip(bounds, bounds[1:]):  # many small sorts in place are faster than one of everything
            token[a:b].sort()
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, self.owner = token[first], owner[first]
        self.cell = (self.token % np.uint64(CELLS)).astype(np.int64)
        self.size = np.bincount(self.owner, minlength=len(size))
        self.start = np.cumsum(self.size) - self.size
        self.position = np.arange(len(self.token)) - np.repeat(self.start, self.size) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.token & LOW48, 7), dtype=np.uint64)])
        self.key = mix(sums[self.start + self.size] - sums[self.start], 11).view(np.int64)

    @staticmethod
    def _hashed(lists: pa.ListArray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of lists of word hashes, the set of each, and the length of each list."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        owner = np.repeat(np.arange(len(size)), size)
        word = values != EMPTY_WORD
        values, owner = values[word], owner[word]
        token = mix(values.view(np.uint64))
        for k in range(1, plan.shingle):
            shifted = mix(values[k:].view(np.uint64), k)
            token = mix(token[: len(shifted)] * np.uint64(31) + shifted)
        if plan.shingle > 1 and len(token):
            last = plan.shingle - 1
            whole = owner[:-last] == owner[last:] if len(owner) > last else np.zeros(0, bool)
            token, owner = token[: len(whole)][whole], owner[: len(whole)][whole]
        return token & LOW48, owner, size

    def head(self, order: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        """16 bits of each token in the prefix under a further global order, in that order, and the set of each."""
        key = self.owner.astype(np.uint64) << np.uint64(48) | mix(self.token & LOW48, 100 + order) & LOW48
        key.sort()
        first = self.position <= plan.long_prefix(self.size[self.owner], 1)
        return key[first].astype(np.uint16), self.owner[first]


def _token_sets(rows: DataFrame, plan: Plan) -> DataFrame:
    """``id, side, tokens`` of every row whose set is not empty; its tokens in order, ``STORED`` bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = Sets(batch, plan, None)
            some = sets.size > 0
            tokens = _packed(sets.token.view(np.uint8).reshape(-1, 8)[:, :STORED], sets.owner, some)
            yield pa.RecordBatch.from_arrays([sets.id, pa.array(sets.side.astype(np.int8)), tokens], ["id", "side", "tokens"]).filter(pa.array(some))

    return rows.mapInArrow(pack, "id long, side byte, tokens binary")


def _sketch(rows: DataFrame, plan: Plan) -> tuple[np.ndarray, int]:
    """The rarity class of each cell, and the class up to which a token is rare. All rows are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            total += np.bincount(Sets(batch, plan, None).cell, minlength=CELLS).astype(np.uint32)
        blocks = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "cells"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for cells in table.column("cells"):
            total += np.frombuffer(cells.as_py(), np.uint16)
        packed = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([packed], pa.binary())})

    schema = "block int, cells binary"
    total = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for row in collect_once(rows.mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema)):
        total[row["block"]] = np.frombuffer(row["cells"], np.uint32)
    total = total.ravel()
    rare = min(4 * int(np.median(total[total > 0])) + 16, plan.hot) if (total > 0).any() else 0
    scale = lambda n: np.minimum(32767, 256 * np.log2(1 + n)).astype(np.int16)
    return scale(total), int(scale(np.array([rare]))[0])


def _salted(sets: Sets, plan: Plan, role: int, key: np.ndarray, owner: np.ndarray, position: np.ndarray, token: np.ndarray):
    """Keys with their salt; ``token`` is the rarest token of each key, whose count bounds that of the key."""
    count = np.exp2((token >> np.uint64(48)).astype(np.float64) / 256)
    salts = np.clip(np.ceil(count / plan.hot), 1, SALTS).astype(np.int64)
    if role == 1:
        salt = (sets.key[owner].view(np.uint64) % salts.view(np.uint64)).astype(np.int64)
    else:
        again = np.repeat(np.arange(len(key)), salts)
        salt = np.arange(len(again)) - np.repeat(np.cumsum(salts) - salts, salts)
        key, owner, position = key[again], owner[again], position[again]
    return role, mix(key + salt.astype(np.uint64) * np.uint64(0x9E3779B1), 3), owner, position


def _keys(sets: Sets, plan: Plan, rare: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``role, join key, set, position`` of the prefixes. Roles: 0 rare, 1 frequent in the prefix of a longer
    set, 2 frequent in the prefix of a shorter set."""
    n = sets.size[sets.owner]
    use = fresh[sets.owner]
    mixed = n * plan.threshold.denominator > plan.combined_up_to * plan.threshold.numerator
    take = use & (rare | (n <= 2)) & (sets.position <= plan.long_prefix(n, np.where(n <= plan.combined_up_to, plan.depth, 1)))
    yield 0, sets.token[take], sets.owner[take], sets.position[take]
    for role, prefix in ((1, plan.long_prefix), (2, plan.short_prefix)):
        single = use & ~rare & (sets.position <= prefix(n, 1))
        if plan.depth > 1:
            single &= mixed
        yield _salted(sets, plan, role, sets.token[single], sets.owner[single], sets.position[single], sets.token[single])
        if plan.depth > 1:
            both = np.flatnonzero(use & ~rare & (n <= plan.combined_up_to) & (sets.position <= prefix(n, plan.depth)))
            token, owner, position = sets.token[both], sets.owner[both], sets.position[both]
            for gap in range(1, len(token)):
                same = owner[gap:] == owner[:-gap]
                if not same.any():
                    break
                yield _salted(sets, plan, role, mix(mix(token[:-gap][same], 5) + token[gap:][same], 9), owner[gap:][same], position[gap:][same], token[:-gap][same])


def _signatures(sets: Sets, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits each of two halves of each set's frequent tokens, which their hash tells apart and places."""
    code = mix(sets.token, 21)
    found = []
    for half in (0, 1):
        at = np.flatnonzero(~rare & (code & np.uint64(1) == half))
        out = np.zeros(len(sets.size), np.uint64)
        if len(at):
            owner = sets.owner[at]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] = np.bitwise_or.reduceat(np.uint64(1) << ((code[at] >> np.uint64(1)) & np.uint64(63)), first)
        found.append(out.view(np.int64))
    return found[0], found[1]


def _marks(sets: Sets, plan: Plan) -> list[np.ndarray]:
    """64 bits of each set's prefix under each further order."""
    found = []
    for order in range(1, plan.orders):
        bits, owner = sets.head(order, plan)
        out = np.zeros(len(sets.size), np.uint64)
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint16(63)).astype(np.uint64), first)
        found.append(out.view(np.int64))
    return found


def _marked(plan: Plan) -> list[str]:
    """The columns of ``_marks``. Prefixes of large sets (plans of depth 1) would fill the bits; their rows have none."""
    return [f"mark{k}" for k in range(1, plan.orders)] if plan.depth > 1 else []


def _prefix_rows(rows: DataFrame, plan: Plan, classes, rare_class: int, part: int = 0, parts: int = 1) -> DataFrame:
    """One row for each join key of each set: its set, signatures, marks, and packed into two numbers its size and position (``at``)
    and its frequent tokens, role and side (``kind``). Only keys of ``part``, of ``parts`` that share them out.

    Keys of several tokens leave few candidates, so with them (depth over 1) rows carry less: no second signature,
    and none where the key is a rare token. An empty signature rules nothing out.
    """
    sent = rows.sparkSession.sparkContext.broadcast(classes)
    names = ["key", "set", "at", "kind", "sig", "sig2", *_marked(plan)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sets = Sets(batch, plan, sent.value)
            fresh = np.zeros(len(sets.key), bool)
            for k, pair in enumerate(zip(sets.key.tolist(), sets.side.tolist())):
                if pair not in seen:
                    fresh[k] = True
                    seen.add(pair)
            if len(seen) > REMEMBERED:
                seen.clear()
            rare = (sets.token >> np.uint64(48)).astype(np.int64) <= rare_class
            frequent = np.bincount(sets.owner, ~rare, minlength=len(sets.size)).astype(np.int32)
            one, two = _signatures(sets, rare)
            marks = _marks(sets, plan) if plan.depth > 1 else []
            for role, key, owner, position in _keys(sets, plan, rare, fresh):
                if parts > 1:
                    own = (key & LOW48) % np.uint64(parts) == part
                    key, owner, position = key[own], owner[own], position[own]
                if len(key):
                    at, kind = sets.size[owner] << 32 | position, frequent[owner].astype(np.int64) << 8 | role << 4 | sets.side[owner].astype(np.int64)
                    columns = [
                        pa.array((key & LOW48).view(np.int64)), pa.array(sets.key[owner]), pa.array(at), pa.array(kind), pa.array(one[owner] * np.int64(role > 0 or plan.depth == 1)), pa.array(two[owner] * np.int64(role > 0 and plan.depth == 1)),
                        *(pa.array(m[owner]) for m in marks),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(emit, "key long, set long, at long, kind long, sig long, sig2 long" + "".join(f", {m} long" for m in _marked(plan)))


def _meetings(prefixes: DataFrame, plan: Plan, two_sides: bool) -> DataFrame:
    """``a, b, met, need``: distinct pairs of set keys that pass prefix, length, position, signature and mark filter, how many keys
    they meet at, and how many they need. With two sides ``a`` is of side 0 and ``b`` of side 1, else ``a < b``.

    A pair shares at most as many frequent tokens as either has, less the bits of its signatures that the other
    lacks. What is then missing to the least overlap has to be shared rare tokens: pairs that share any meet at
    each of them (role 0), so their number is counted; all other pairs (roles 1 and 2) must miss nothing.
    """
    num, den = plan.threshold.numerator, plan.threshold.denominator
    columns = ["key", "set", "at", "kind", "sig", "sig2", *_marked(plan)]
    role, part = F.shiftright("kind", 4).bitwiseAND(15), F.col("kind").bitwiseAND(255)
    # One exchange that is read once for either end of the join: the random term keeps the filters above it. Keys of roles
    # and sides that do not meet differ, so that one join serves all.
    code = (role + F.col("kind").bitwiseAND(15)) % 2 if two_sides else F.lit(0)
    shuffled = prefixes.withColumn("key", F.xxhash64("key", F.when(role == 0, -1).otherwise(code))).repartition("key")
    shuffled = shuffled.withColumn("part", part + (F.rand(1) * 0).cast("int"))

    def end(*parts: tuple[int, int]) -> DataFrame:
        """Copies of a set that several tasks sent become one here, on the partitioning that the join needs."""
        return shuffled.where(F.col("part").isin([role * 16 + side for role, side in parts])).dropDuplicates(["key", "set"]).select(*columns)

    n, pos, freq = (lambda s, f=f: f.replace("$", s) for f in ("shiftright($.at, 32)", "($.at & 4294967295)", "shiftright($.kind, 8)"))
    rare = "(shiftright(x.kind, 4) & 15) = 0"
    least = f"((({num} * ({n('x')} + {n('y')}) + {num + den - 1}) div {num + den}))"
    depth = f"(CASE WHEN {n('x')} > {plan.combined_up_to} OR {n('y')} > {plan.combined_up_to} THEN 1 ELSE {plan.depth} END)"
    lacks = lambda s, t: f"({freq(s)} - bit_count({s}.sig & ~{t}.sig) - bit_count({s}.sig2 & ~{t}.sig2))"
    beyond = lambda s: f"greatest(0, {least} - {depth} - {freq(s)})"  # rare tokens after the prefix of this pair
    need = f"{least} - least({lacks('x', 'y')}, {lacks('y', 'x')})"
    near = f"{n('x')} * {num} <= {n('y')} * {den} AND {n('y')} * {num} <= {n('x')} * {den} AND least({n('x')} - {pos('x')}, {n('y')} - {pos('y')}) + {depth} >= {least} AND x.set <> y.set"
    near += "".join(f" AND (x.{m} & y.{m}) <> 0" for m in _marked(plan))
    near += f" AND ({n('x')} >= {n('y')}{f' OR {rare}' if two_sides else ''}) AND ({rare} OR {need} <= 0)"
    if two_sides:
        left, right = end((0, 0), (1, 0), (1, 1)), end((0, 1), (2, 1), (2, 0))
        ends = [F.expr("if(side = 0, s, t)").alias("a"), F.expr("if(side = 0, t, s)").alias("b")]
    else:
        left, right = end((0, 0), (1, 0)), end((0, 0), (2, 0))
        ends = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
    joined = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr(near))
    asked = f"CASE WHEN NOT {rare} THEN 0 ELSE CAST(least({need} - {beyond('x')} - {beyond('y')}, 1000000) AS INT) END"
    pairs = joined.select(F.col("x.set").alias("s"), F.col("y.set").alias("t"), F.expr("x.kind & 15").alias("side"), F.expr(asked).alias("need"))
    # Sets of equal size meet twice at a token, which only makes the count a weaker bound.
    return pairs.groupBy(*ends).agg(F.count("*").alias("met"), F.min("need").alias("need"))


def _candidates(prefixes: DataFrame, plan: Plan, two_sides: bool) -> DataFrame:
    """``a, b`` of the pairs that meet at as many keys as they need."""
    return _meetings(prefixes, plan, two_sides).where("met >= need").select("a", "b")


def _candidates_by_parts(sets: DataFrame, plan: Plan, two_sides: bool) -> DataFrame:
    """``_candidates`` of all keys, written. The prefix rows of a part are deleted before those of the next are made."""
    classes, rare_class = _sketch(sets, plan)
    prefixes = lambda part: _prefix_rows(sets, plan, classes, rare_class, part, plan.parts)
    if plan.parts == 1:
        return cut_lineage(_candidates(prefixes(0), plan, two_sides))
    met = [cut_lineage(_meetings(prefixes(part), plan, two_sides)) for part in range(plan.parts)]
    summed = reduce(DataFrame.unionByName, met).groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
    made = cut_lineage(summed.where("met >= need").select("a", "b"))
    discard(*met)
    return made


def _candidate_map(candidates: DataFrame) -> np.ndarray:
    """A bit for each slot of set keys that holds a candidate, as bytes; its size is fixed."""
    slots = candidates.select(F.explode(F.array("a", "b")).alias("set")).select((F.shiftrightunsigned("set", 64 - MAP_BITS) + 1).alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((1 << MAP_BITS - 15, 4096), np.uint8)
    for row in collect_once(bits):
        out[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _packed(values: np.ndarray, owner: np.ndarray, asked: np.ndarray) -> pa.Array:
    """The bytes of ``values`` (2-dimensional) of each set as one binary; null where it is not asked."""
    width = values.shape[1]
    bounds = np.concatenate([[0], np.cumsum(np.where(asked, np.bincount(owner, minlength=len(asked)), 0)) * width])
    kept = np.ascontiguousarray(values[asked[owner]]).tobytes()
    valid = np.packbits(asked, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(asked), [pa.py_buffer(valid), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(kept)]).cast(pa.binary())


def _members(rows: DataFrame, plan: Plan, wanted: np.ndarray) -> DataFrame:
    """``id, side, set, tokens, head1, ...``: the set of every row; its tokens and its prefixes under the further orders only
    where the map ``wanted`` has the set and the task has not sent them yet."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    heads = _heads(plan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        seen: set[int] = set()
        for batch in batches:
            sets = Sets(batch, plan, None)
            slot = (sets.key.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            asked = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            for k in np.flatnonzero(asked):
                if int(sets.key[k]) in seen:
                    asked[k] = False
                seen.add(int(sets.key[k]))
            if len(seen) > REMEMBERED:
                seen.clear()
            columns = [sets.id, pa.array(sets.side.astype(np.int8)), pa.array(sets.key), pa.array(sets.size.astype(np.int32)), _packed(sets.token.view(np.uint8).reshape(-1, 8)[:, :PACKED], sets.owner, asked)]
            for order in range(1, plan.orders):
                head, owner = sets.head(order, plan)
                columns.append(_packed(head.view(np.uint8).reshape(-1, 2), owner, asked))
            yield pa.RecordBatch.from_arrays(columns, ["id", "side", "set", "n", "tokens", *heads]).filter(pa.array(sets.size > 0))

    return rows.mapInArrow(emit, "id long, side byte, set long, n int, tokens binary" + "".join(f", {h} binary" for h in heads))


def _heads(plan: Plan) -> list[str]:
    return [f"head{k}" for k in range(1, plan.orders)]


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in rows of ``width``, and how many rows each value has."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if data and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw.reshape(-1, width), np.diff(bounds) // width


def _meet_heads(pairs: DataFrame, plan: Plan) -> DataFrame:
    """``a, b`` of the pairs (``a, b, n, m, x1, y1, ...``) whose prefixes meet under every further order. Tokens are told by 16
    bits here, so that a few pairs pass that should not; none is lost."""
    sides = [c for k in range(1, plan.orders) for c in (f"x{k}", f"y{k}")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1 << 14) for whole in batches for k in range(0, whole.num_rows, 1 << 14)):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            least, alive = plan.overlap(n, m), np.ones(batch.num_rows, bool)
            for k in range(plan.orders - 1):
                keys = []
                for side, (total, column) in enumerate(((n, 4 + 2 * k), (m, 5 + 2 * k))):
                    raw, size = _flat(batch.column(column), 2)
                    owner = np.repeat(np.arange(len(size)), size)
                    rank = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                    inside = rank <= (total - least)[owner]
                    keys.append((owner[inside] << 17).astype(np.uint32) | raw.copy().view(np.uint16).ravel()[inside].astype(np.uint32) << np.uint32(1) | np.uint32(side))
                both = np.concatenate(keys)  # row, token and side make one sort key; neighbours that differ by the side alone meet
                both.sort()
                met = np.zeros(len(alive), bool)
                met[both[1:][both[1:] ^ both[:-1] == 1] >> np.uint32(17)] = True
                alive &= met
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alive))

    return pairs.select("a", "b", "n", "m", *sides).mapInArrow(meet, "a long, b long")


def _verify(pairs: DataFrame, plan: Plan) -> DataFrame:
    """``a, b`` of the pairs (``a, b, x, y`` with packed tokens) that reach the threshold."""
    num, den = plan.threshold.numerator, plan.threshold.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1 << 16) for whole in batches for k in range(0, whole.num_rows, 1 << 16)):
            keys, sizes = [], []
            for column in (2, 3):
                packed, size = _flat(batch.column(column), PACKED)
                raw = np.zeros((len(packed), 8), np.uint8)
                raw[:, :PACKED] = packed
                keys.append(np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(48) | raw.view(np.uint64).ravel())
                sizes.append(size)
            key = np.concatenate(keys)  # row and token make one sort key
            key.sort()
            common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64), minlength=batch.num_rows)
            good = pa.array(common * den >= num * (sizes[0] + sizes[1] - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    return pairs.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def similar_sets(rows: DataFrame, plan: Plan, *, two_sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)`` of ``rows (id long, side byte, hashes array<long>)``.

    ``members (id, side, set)`` has each row with a set that is not empty; ``pairs (a, b)`` the pairs of
    different sets that reach the threshold (of side 0 and side 1, if there are two sides).
    """
    sets = cut_lineage(_token_sets(rows, plan))
    candidates = _candidates_by_parts(sets, plan, two_sides)
    made = cut_lineage(_members(sets, plan, _candidate_map(candidates)))
    discard(sets)
    once = lambda *columns: made.where("tokens IS NOT NULL").select("set", *columns).dropDuplicates(["set"])

    def joined(pairs: DataFrame, sets: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
        """``pairs`` with columns of both their sets; ``names``: a column and what it is called at either end."""
        for k, end in enumerate(("a", "b")):
            pairs = pairs.join(sets.select(F.col("set").alias(end), *[F.col(c).alias(to[k]) for c, to in names.items()]), end)
        return pairs

    if plan.orders > 1:
        heads = {"n": ("n", "m")} | {h: (f"x{k}", f"y{k}") for k, h in enumerate(_heads(plan), 1)}
        first, candidates = candidates, cut_lineage(_meet_heads(joined(candidates, once("n", *_heads(plan)), heads), plan))
        discard(first)
    verified = cut_lineage(_verify(joined(candidates, once("tokens"), {"tokens": ("x", "y")}), plan))
    discard(candidates)
    return made.select("id", "side", "set").distinct(), verified
