"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

A document's n-grams are 64-bit hashes, and hash order is the global n-gram order.  Fragments are ranges of that
order.  Documents with equal sets are one node, named by a fingerprint of the set, so copies multiply nothing.

Candidates.  A linked set shares at least percent of its own n-grams with its partner, so at least as many of its
n-grams are held by other sets too.  Each fragment counts, for every set, the n-grams in it that others hold; the
counts are summed per set, and sets below the threshold go.  What is left is few sets unless many are alike.  Tasks
send each n-gram of a fragment once a run of sets, in packed form, however many sets of the run hold it; fragments are
as many as keep one within a task's memory.

The rest send their prefix: linked sets of s n-grams share one of the first s - ceil(s * percent / 100) + 1 in any
common order, and n-grams go from rare to frequent among the sets that are left.

Verification.  Sets that agree on an n-gram are not paired with each other, but with one hub of the bucket (the set
with most agreement overall).  Overlaps are counted fragment by fragment and summed per pair.

The rest, exactly.  By the triangle inequality of the Jaccard distance, linked sets are both near their hub or both
far from it.  Those near it are seen from a set in their midst, the centre.  Sets that link to it are joined by it; two
of which one does not can only link if they share n-grams in which they differ from it: with M and E the n-grams a set
misses of the centre's and has beyond them, the pair's overlap is |centre| - |M1| - |M2| + shared differences, so the
threshold demands a number of shared differences, at least one.  A prefix join over the differences, rarest first,
finds those pairs; how early the first shared one must come is judged for each pair, by what both differ.  Sets far from the hub of a bucket that holds several such are the next round's sets: they
are counted, ordered and given hubs anew, among themselves.  What ROUNDS rounds leave is joined by its prefixes and
verified in the same way.  So near copies of one text cost one pair each, whatever the group's size, and no link
between different sets is lost.

Null and empty texts have no n-grams and link with nothing; a text of fewer than n words is one n-gram of all of them.
Rows without an id link with nothing and get no component.  Rows of equal id and text are one; equal ids with different
texts are linked as their texts are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.llm.components import components
from roomweave.llm.storage import checkpointed
from roomweave.llm.wordhash import U, Words, mix, slices, window_hashes

COUNTED = 8  # fragments in which overlaps of pairs are counted
NEAR = 0.5
ROUNDS = 2
FRAGMENT = 1 << 20  # n-grams in a fragment of all sets, as long as there are at most MANY fragments
MANY = 1 << 14  # beyond, fragments and what they hold both grow with the root of the input
RUN_GRAMS, RUN_SETS = 1 << 21, 60_000  # a run of sets that a task sends at once
OF_MANY = 0xFFFF  # stands for the holder of an n-gram that several sets of a run hold
KEY = 5  # bytes of an n-gram within its fragment; equal ones of different n-grams only leave a set in too long


def _sets(batch: pa.RecordBatch, n: int):
    """The sorted n-gram set of each row."""
    words = Words(batch.column("text"), lower=True)
    grams, first = window_hashes(words.hashes, n), words.first
    for i in range(batch.num_rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield window_hashes(words.hashes[a:b], b - a)
        else:
            yield grams[:0]


def _name(grams: np.ndarray) -> int | None:
    """A fingerprint of a set; None for the empty one."""
    if not len(grams):
        return None
    return int(mix(np.array([mix(grams + U(1)).sum(dtype=U) + U(len(grams))], dtype=U)).view(np.int64)[0])


def _batches(schema: list[tuple[str, pa.DataType]], rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(rows, schema)], names=[n for n, _ in schema])


def digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_id) of rows (doc_id, text); set_id is null for an empty set."""
    schema = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64())]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield _batches(schema, [part.column("doc_id"), *zip(*((len(s), _name(s)) for s in _sets(part, n)))])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long")


def with_set_ids(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """All columns of docs in a struct ``row``, and set_id; null for an empty set."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = rows.select("row", F.lit(None).cast("long").alias("set_id")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([_name(s) for s in _sets(part, n)], type=pa.int64())], names=["row", "set_id"])

    return rows.mapInArrow(run, schema)


def _n_fragments(n_grams: int) -> int:
    wanted = max(COUNTED, n_grams // FRAGMENT)
    return wanted if wanted <= MANY else int((MANY * wanted) ** 0.5)


def _send(sets: list[np.ndarray], n_fragments: int):
    """(fragment, keys, holders) of a run of sets for each fragment, and how many n-grams of each set the run holds twice."""
    sizes = np.array([len(s) for s in sets])
    grams, holder = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams)
    grams, holder = grams[order], holder[order]
    new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    times = np.diff(np.r_[new, len(grams)])
    twice = np.bincount(holder[np.repeat(times > 1, times)], minlength=len(sets))
    grams, holder = grams[new], np.where(times > 1, OF_MANY, holder[new]).astype("<u2")
    cuts = np.searchsorted(((grams >> U(32)) * U(n_fragments)) >> U(32), np.arange(n_fragments + 1).astype(U))
    keys = np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY])
    return [(f, keys[a:b].tobytes(), holder[a:b].tobytes()) for f, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b], twice


def _held_by_others(runs: list[int], keys: list[bytes], holders: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place, count): of each set, how many n-grams of a fragment are in another run too."""
    packed = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :KEY] = packed
    grams, holder = wide.view("<u8").ravel(), np.frombuffer(b"".join(holders), "<u2").astype(np.int64)
    run = np.repeat(np.arange(len(runs)), [len(h) // 2 for h in holders])
    order = np.argsort(grams)
    grams = grams[order]
    again = np.r_[False, grams[1:] == grams[:-1]]
    shared = order[again | np.r_[again[1:], False]] if len(order) else order
    found, count = np.unique((run * (OF_MANY + 1) + holder)[shared][holder[shared] < OF_MANY], return_counts=True)
    return np.array(runs, dtype=np.int64)[found // (OF_MANY + 1)], found % (OF_MANY + 1), count


def alike(docs: DataFrame, n: int, percent: int, n_grams: int) -> DataFrame:
    """The set_id of sets of which other sets hold at least percent of the n-grams, counted by fragments."""
    n_fragments = _n_fragments(n_grams)
    sent = [("fragment", pa.int64()), ("run", pa.int64()), ("keys", pa.binary()), ("holders", pa.binary()), ("names", pa.binary()), ("sizes", pa.binary()), ("twice", pa.binary())]

    def send(batches):
        task, n_runs, seen, sets, names = TaskContext.get().partitionId(), 0, set(), [], []

        def flush():
            nonlocal n_runs, sets, names
            run = (task << 32) + n_runs
            rows, twice = _send(sets, n_fragments)
            rows = [(f, run, keys, holders, None, None, None) for f, keys, holders in rows]
            columns = np.array(names, "<i8"), np.array([len(s) for s in sets], "<i8"), twice.astype("<i8")
            rows.append((-1 - run, run, None, None, *(c.tobytes() for c in columns)))  # a group of its own: what the places in the run stand for
            n_runs, sets, names = n_runs + 1, [], []
            return _batches(sent, list(zip(*rows)))

        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for grams in _sets(part, n):
                    name = _name(grams)
                    if name is None or name in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(name)
                    sets.append(grams)
                    names.append(name)
                    total += len(grams)
                    if total >= RUN_GRAMS or len(sets) >= RUN_SETS:
                        yield flush()
                        total = 0
        if sets:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        if table.column("names")[0].as_py() is not None:
            return table.select(["run", "names", "sizes", "twice"]).append_column("places", pa.nulls(1, pa.binary())).append_column("counts", pa.nulls(1, pa.binary()))
        run, place, k = _held_by_others(*(table.column(c).to_pylist() for c in ("run", "keys", "holders")))
        cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]) if len(run) else np.zeros(1, int)
        rows = [(run[a], None, None, None, place[a:b].astype("<u2").tobytes(), k[a:b].astype("<i4").tobytes()) for a, b in zip(cuts, cuts[1:])]
        return pa.Table.from_batches([_batches(partial, list(zip(*rows)) if rows else [[]] * len(partial))])

    def add(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        names, sizes, total = (np.frombuffer(next(r for r in parts if r["names"] is not None)[c], "<i8") for c in ("names", "sizes", "twice"))
        total = total.copy()
        for r in parts:
            if r["places"] is not None:
                total[np.frombuffer(r["places"], "<u2")] += np.frombuffer(r["counts"], "<i4")
        return pa.table({"set_id": names[100 * total >= percent * sizes]})

    partial = [("run", pa.int64()), *((c, pa.binary()) for c in ("names", "sizes", "twice", "places", "counts"))]
    spoken = docs.mapInArrow(send, "fragment long, run long, keys binary, holders binary, names binary, sizes binary, twice binary")
    counted = spoken.groupBy("fragment").applyInArrow(count, "run long, names binary, sizes binary, twice binary, places binary, counts binary")
    return counted.groupBy("run").applyInArrow(add, "set_id long").distinct()


def fragments(docs: DataFrame, n: int) -> DataFrame:
    """(set_id, n, frag, grams): wanted sets in COUNTED ranges of the n-gram order, from rows (texts, wanted)."""
    schema = [("set_id", pa.int64()), ("n", pa.int64()), ("frag", pa.int32()), ("grams", pa.list_(pa.int64()))]

    def run(batches):
        for batch in batches:
            for texts, wanted in zip(batch.column("texts").to_pylist(), batch.column("wanted").to_pylist()):
                rows, left = [], set(wanted)
                for grams in _sets(pa.record_batch({"text": pa.array(texts, pa.string())}), n):
                    name = _name(grams)
                    if name not in left:
                        continue
                    left.remove(name)
                    cuts = np.searchsorted((grams >> U(32)) * U(COUNTED) >> U(32), np.arange(COUNTED + 1).astype(U))
                    rows += [(name, len(grams), k, grams[cuts[k] : cuts[k + 1]].view(np.int64)) for k in range(COUNTED)]
                if rows:
                    yield _batches(schema, list(zip(*rows)))

    return docs.mapInArrow(run, "set_id long, n long, frag int, grams array<long>")


def _beside(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """(hub, set, frag, held, extra, missing): pairs (hub, set) fragment by fragment, with the n-grams in which they differ."""
    mine = frags.join(pairs.select("hub", F.col("set").alias("set_id")), "set_id").select("hub", F.col("set_id").alias("set"), "frag", F.col("grams").alias("mine"))
    hubs = frags.join(pairs.select(F.col("hub").alias("set_id")).distinct(), "set_id").select(F.col("set_id").alias("hub"), "frag", F.col("grams").alias("hubs"))
    return mine.join(hubs, ["hub", "frag"]).select(
        "hub", "set", "frag", F.size("mine").alias("held"), F.array_except("mine", "hubs").alias("extra"), F.array_except("hubs", "mine").alias("missing"))


def _overlaps(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """pairs (hub, set) with both, n_missing and n_extra: partial counts, summed per pair."""
    return _beside(pairs, frags).groupBy("hub", "set").agg(
        F.sum(F.col("held") - F.size("extra")).alias("both"), F.sum(F.size("missing")).alias("n_missing"), F.sum(F.size("extra")).alias("n_extra"))


def _rarest_first(rows: DataFrame) -> DataFrame:
    """rows (hub, zone, set, items, ...) with an item a row, its place pos by frequency around the hub; n items in all.
    Items of one set only are left out, but count for the places of others."""
    around = W.partitionBy("hub", "zone", "set").orderBy("freq", "item")
    items = rows.withColumn("n", F.size("items")).withColumn("item", F.explode("items")).drop("items")
    freq = items.groupBy("hub", "zone", "item").agg(F.count("*").alias("freq"))
    return items.join(freq, ["hub", "zone", "item"]).withColumn("pos", F.row_number().over(around)).where("freq > 1").drop("freq")


def _rest(items: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, set1, set2) of sets around one hub that may link, from items (hub, zone, set, item, pos, n, cost, room):
    they share at least (cost1 + cost2 - room) / (100 + percent) items, and one's cost is above the room.

    The first item that they share leaves no less than that from its place on in each.  So the set of less cost, whose
    partner costs no less, only sends items up to an early place, and of all matches of a pair few fit."""
    top = 100 + percent
    names = ("set", "cost", "pos", "n")
    one = items.where(f"cost > room AND pos <= n - ceil((cost - room) / 100) + 1").select("hub", "zone", "item", *(F.col(c).alias(f"{c}1") for c in names), "room")
    least = f"greatest(ceil((2 * cost - room) / {top}), floor(cost / {top}) + 1)"
    two = items.where(f"pos <= n - {least} + 1").select("hub", "zone", "item", *(F.col(c).alias(f"{c}2") for c in names))
    fits = F.expr(f"(cost2 < cost1 OR cost2 = cost1 AND set2 < set1) AND (1 + least(n1 - pos1, n2 - pos2)) * {top} >= cost1 + cost2 - room")
    found = one.join(two, ["hub", "zone", "item"]).where(fits)
    return found.select("hub", "set1", "set2").distinct()


def _judged(sums: DataFrame, percent: int) -> DataFrame:
    """sums of _overlaps with linked, jaccard, and what a set's differences from its hub cost against what links may cost."""
    return sums.selectExpr(
        "*", f"100 * both >= {percent} * (both + n_missing + n_extra) AS linked", "both / (both + n_missing + n_extra) AS jaccard",
        f"100 * n_missing + {percent} * n_extra AS cost", f"{100 - percent} * (both + n_missing) AS room")


def _near(met: DataFrame, frags: DataFrame, percent: int) -> DataFrame:
    """(hub, set, missing, extra, size) from rows of _judged: the differences of sets near their hub, and the hub's n-grams.
    Only hubs with two sets, not both linked to them, can have left a link out."""
    open_hubs = met.groupBy("hub").agg(F.count("*").alias("sets"), F.count_if(~F.col("linked")).alias("open")).where("sets > 1 AND open > 0").select("hub")
    around = met.where(f"jaccard >= {NEAR - (100 - percent) / 200}").join(open_hubs, "hub", "left_semi").select("hub", "set", (F.col("both") + F.col("n_missing")).alias("size"))
    both = (F.flatten(F.collect_list(c)).alias(c) for c in ("missing", "extra"))
    return around.join(_beside(around.select("hub", "set"), frags).groupBy("hub", "set").agg(*both), ["hub", "set"])


def _centred(near: DataFrame, percent: int) -> DataFrame:
    """(hub, centre, set, items, cost, room): near, with the differences not from the hub, but from a set amid those around it.

    An unlike hub leaves all sets around it open, however alike they are.  The centre is the set that differs least from
    what most of the sets hold; the hub itself, if no other does better."""
    items = near.select("hub", "set", F.explode(F.concat("missing", "extra")).alias("item"))
    most = items.groupBy("hub", "item").agg(F.count("*").alias("freq")).join(near.groupBy("hub").agg(F.count("*").alias("sets")), "hub").where("2 * freq > sets").select("hub", "item")
    held = items.join(most, ["hub", "item"]).groupBy("hub", "set").agg(F.count("*").alias("held"))
    score = near.join(held, ["hub", "set"]).select("hub", "set", (F.size("missing") + F.size("extra") - 2 * F.col("held")).alias("score")).where("score < 0")
    best = score.groupBy("hub").agg(F.min(F.struct("score", "set")).alias("best")).select("hub", F.col("best.set").alias("set"))
    centres = near.join(best, ["hub", "set"]).select("hub", F.col("set").alias("centre"), F.col("missing").alias("less"), F.col("extra").alias("more"))
    none = F.array().cast("array<long>")
    seen = near.join(centres, "hub", "left").where("centre IS NULL OR set <> centre").withColumns({"less": F.coalesce("less", none), "more": F.coalesce("more", none)}).select(
        "hub", F.coalesce("centre", "hub").alias("centre"), "set", (F.col("size") - F.size("less") + F.size("more")).alias("size"),
        F.concat(F.array_except("missing", "less"), F.array_except("more", "extra")).alias("missing"), F.concat(F.array_except("extra", "more"), F.array_except("less", "missing")).alias("extra"))
    return seen.selectExpr("hub", "centre", "set", "concat(missing, extra) AS items", f"100L * size(missing) + {percent} * size(extra) AS cost", f"{100 - percent} * size AS room")


def _close(near: DataFrame, percent: int) -> DataFrame:
    """Links (hub, set) that join sets near one hub, from rows of _centred: to their centre, and between two of which
    not both link to it.  The differences that two sets share give their overlap."""
    some = near.join(near.where("cost > room").select("hub").distinct(), "hub", "left_semi").drop("centre")
    one, two = (some.select("hub", F.col("set").alias(f"set{k}"), F.col("items").alias(f"items{k}"), F.col("cost").alias(f"cost{k}"), *(["room"] if k == 1 else [])) for k in (1, 2))
    both = _rest(_rarest_first(some.withColumn("zone", F.lit("near"))), percent).join(one, ["hub", "set1"]).join(two, ["hub", "set2"])
    fits = f"{100 + percent} * size(array_intersect(items1, items2)) >= cost1 + cost2 - room"
    return near.where("cost <= room").select(F.col("centre").alias("hub"), "set").unionByName(both.where(fits).select(F.col("set1").alias("hub"), F.col("set2").alias("set")))


def _placed(frags: DataFrame, percent: int) -> DataFrame:
    """(set, item, pos, n): n-grams that several of the sets hold, with their place in their set from rare to frequent; only
    those up to which one of a linked set's must come."""
    items = frags.select(F.col("set_id").alias("set"), "n", F.explode("grams").alias("item"))
    freq = items.groupBy("item").agg(F.count("*").alias("freq")).where("freq > 1")
    own = W.partitionBy("set")
    shared = items.join(freq, "item").withColumns({"rank": F.row_number().over(own.orderBy("freq", "item")), "shared": F.count("*").over(own)})
    return shared.selectExpr("set", "item", "n - shared + rank AS pos", "n").where(f"100 * (pos - 1) <= {100 - percent} * n")


def _linked(sums: DataFrame, percent: int) -> DataFrame:
    return sums.where(f"100 * both >= {percent} * (both + n_missing + n_extra)").select("hub", "set")


def linked_sets(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (hub, set) between different sets that join all that are linked; sets: digests(docs)."""
    named = sets.where("set_id IS NOT NULL")
    n_grams = named.agg(F.sum("n_shingles")).first()[0] or 0
    some = checkpointed(alike(docs, n, percent, n_grams))
    holders = named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(some, "set_id").groupBy("doc_id").agg(F.collect_set("set_id").alias("wanted"))
    texts = docs.join(holders, "doc_id").groupBy("doc_id").agg(F.collect_set("text").alias("texts"), F.first("wanted").alias("wanted"))
    frags = checkpointed(fragments(texts.select("texts", "wanted"), n))

    margin, rounds, left, apart = (100 - percent) / 200, [], frags, None
    for _ in range(ROUNDS):
        members = checkpointed(_placed(left, percent).select(F.col("item").alias("sig"), "set"))
        members = members.join(members.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "sig")
        score = members.groupBy("set").agg(F.sum("size").alias("score"))
        hubs = members.join(score, "set").groupBy("sig").agg(F.max(F.struct("score", "set")).alias("best")).select("sig", F.col("best.set").alias("hub"))
        met = checkpointed(members.join(hubs, "sig").where("set <> hub").select("sig", "size", "hub", "set"))
        # Sets that link must share a bucket, so two sets beside one hub only matter if both met it in company of others.
        pairs = met.groupBy("hub", "set").agg(F.max("size").alias("company"))
        rounds.append(checkpointed(_judged(_overlaps(pairs.select("hub", "set"), frags), percent).join(pairs, ["hub", "set"])))
        far = met.where("size > 2").join(rounds[-1].where(f"jaccard <= {NEAR + margin}").select("hub", "set"), ["hub", "set"])
        several = far.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1").select("sig")
        lone = checkpointed(far.join(several, "sig", "left_semi").select(F.col("set").alias("set_id")).distinct())
        if lone.isEmpty():
            break
        left = frags.join(lone, "set_id")
    else:
        items = _placed(left, percent).selectExpr("0L AS hub", "'far' AS zone", "set", "item", "pos", "n", f"{percent} * n AS cost", "0L AS room")
        apart = checkpointed(_rest(items, percent).select(F.col("set1").alias("hub"), F.col("set2").alias("set")))
    links = some.limit(0).selectExpr("set_id AS hub", "set_id AS set")
    if rounds:
        counted = reduce(DataFrame.unionByName, rounds)
        near = checkpointed(_near(counted.where("company > 2").drop("company").dropDuplicates(["hub", "set"]), frags, percent))
        near = checkpointed(_centred(near, percent))
        links = links.unionByName(counted.where("linked").select("hub", "set")).unionByName(_close(near, percent))
    return links if apart is None else links.unionByName(_linked(_overlaps(apart, frags), percent))


def join_ngrams(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, group_id, component_id) of each row: links hold where 100 * intersection >= percent * union,
    for 50 <= percent < 100; group_id names the sets that links join; component_id is the smallest doc_id that they reach,
    itself included, and can be that of several groups where an id has different texts."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named_docs = docs.where("doc_id IS NOT NULL")
    sets = checkpointed(digests(docs, n).withColumn("set_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id"))))
    named = components(linked_sets(named_docs, sets, n, percent), "hub", "set").select(F.col("node").alias("set_id"), F.col("component").alias("named"))
    rows = sets.join(named, "set_id", "left").withColumn("named", F.coalesce("named", "set_id"))
    least = rows.where("named IS NOT NULL").groupBy("named").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "named", "left").select("doc_id", "n_shingles", "set_id", F.col("named").alias("group_id"), F.coalesce("least", "doc_id").alias("component_id"))
