"""MinHash near-duplicate detection with sequential Bayesian verification (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.llm.common import BROADCAST_ROWS, WordHasher, released, shingles, small_or_shuffled, text_slices, utf8
from logwarden.llm.components import TASK_SETS, components, gathered
from logwarden.session import cut_lineage

#: Departures that a task gives out at once at most: members are few or many by how long and how different their texts are.
BATCH_DEPARTURES = 1 << 16


@dataclass(frozen=True)
class NearDups:
    """Parameters: a link is ``100 * |A & B| >= percent * |A | B|`` on sets of word shingles.

    ``rows`` hashes make a band; the number of bands follows from ``miss``, the
    probability that no band of a pair at the threshold agrees.  ``prune`` is the
    posterior probability of a link below which a candidate is given up.  Members apart from their
    hub ask up to ``asks`` partners each in up to ``rounds`` rounds before the rest is searched whole.
    """

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-7
    prune: float = 1e-7
    asks: int = 4
    rounds: int = 8
    seed: int = 7

    @property
    def bands(self) -> int:
        return int(-(-log(self.miss) // log(1 - (self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest that must agree) after each batch of four bands.

        With a uniform prior and m of n hashes equal, the similarity is Beta(m+1, n-m+1), whose
        tail above t is the probability of at most m successes in n + 1 draws of chance t.
        """
        t, out = self.percent / 100, []
        for n in sorted({*range(4 * self.rows, self.hashes, 4 * self.rows), self.hashes}):
            below, m = 0.0, 0
            while m <= n:
                below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if below >= self.prune:
                    break
                m += 1
            out.append((n, m))
        return out


def signatures(docs: DataFrame, p: NearDups, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """Per row: key, text_key, n_shingles, a 64-bit fingerprint ``fp`` of its shingle set, and ``sig`` (or with ``full`` the set)."""
    schema = f"doc_id long, text_key long, n_shingles long, fp long, {'items' if full else 'sig'} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rng = WordHasher(), np.random.default_rng(p.seed)
        flips = rng.integers(0, 2**32, p.hashes, dtype=np.uint32)
        factors = rng.integers(0, 2**31, p.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for part in (s for batch in batches for s in text_slices(batch, 2, 1 << 18)):
            words, at = hasher(utf8(part.column(2)))
            sets = [np.unique(shingles(words[i:j], p.shingle)) for i, j in zip(at[:-1], at[1:])]
            prints = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
            out = [s.tobytes() if len(s) else None for s in sets] if full else minima(sets, flips, factors)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "fp", "items" if full else "sig"])

    return docs.select(F.col(key).cast("long"), F.xxhash64(text), F.col(text).cast("string")).mapInArrow(run, schema)


def minima(sets: list[np.ndarray], flips: np.ndarray, factors: np.ndarray, block: int = 1 << 16) -> list[bytes | None]:
    """The least value of each hash function over each set, as bytes; null for empty sets."""
    out: list[bytes | None] = []
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= block):
            size += len(sets[j])
            j += 1
        part = [s for s in sets[i:j] if len(s)]
        if part:
            values = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0] + [len(s) for s in part[:-1]])
            least = np.empty((len(flips), len(part)), np.uint32)
            for f, (flip, factor) in enumerate(zip(flips, factors)):
                least[f] = np.minimum.reduceat((values ^ flip) * factor, starts)
            rows = iter(np.ascontiguousarray(least.T))
        out += [next(rows).tobytes() if len(s) else None for s in sets[i:j]]
        i = j
    return out


def bucket_keys(classes: DataFrame, p: NearDups) -> DataFrame:
    """One row per class and band: (key, fp)."""
    schema = "key long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed + 1)
        weights = rng.integers(0, 2**63, (p.bands, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in released(batches):
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, p.bands, p.rows)
                keys = (sigs * weights).sum(axis=2, dtype=np.uint64)
                keys ^= keys >> np.uint64(31)
                fps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), p.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(fps)], names=["key", "fp"])

    return classes.select("fp", "sig").mapInArrow(run, schema)


def plausible(pairs: DataFrame, classes: DataFrame, p: NearDups) -> DataFrame:
    """Keep the pairs whose signatures, compared batch by batch, leave a link probable enough."""
    steps = p.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
            alive, equal, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                equal = equal + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, equal, done = alive[equal >= least], equal[equal >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(alive))

    both = with_both(pairs, classes.select("fp", "sig"), "sig", "a", "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def shingle_sets(fps: DataFrame, classes: DataFrame, docs: DataFrame, p: NearDups, text: str) -> DataFrame:
    """(fp, items) for the classes in ``fps``: their whole shingle sets, made anew from one text of each."""
    keys = cut_lineage(classes.join(small_or_shuffled(fps), "fp", "left_semi").select("text_key"), "near-need")
    texts = (docs.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
             .join(small_or_shuffled(keys), "text_key", "left_semi").dropDuplicates(["text_key"]))
    texts = gathered(texts, keys.count(), TASK_SETS)
    held = signatures(texts.withColumn("doc_id", F.lit(0)), p, full=True).select("fp", "items")
    return cut_lineage(held.where("fp is not null"), "near-sets")


def with_both(pairs: DataFrame, of: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """``pairs`` with the ``value`` that ``of`` has for both ends, as <value>_a and <value>_b.

    Pairs that are few enough travel to the values, and only values of their first ends are shuffled, into as many tasks as the pairs need.
    """
    n = pairs.count()
    few = n <= BROADCAST_ROWS
    first = pairs.select(F.col(a).alias("fp"))
    first = F.broadcast(first) if few else small_or_shuffled(first.distinct())
    both = ((F.broadcast(pairs) if few else pairs).join(of.select(F.col("fp").alias(b), F.col(value).alias(f"{value}_b")), b)
            .join(of.join(first, "fp", "left_semi").select(F.col("fp").alias(a), F.col(value).alias(f"{value}_a")), a))
    return gathered(both, n, TASK_SETS)


def confirmed(pairs: DataFrame, held: DataFrame, p: NearDups) -> DataFrame:
    """The pairs that are links on their full shingle sets ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            links = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= p.percent * (len(left) + len(right) - common):
                    links.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(links, pa.int64()))

    both = with_both(pairs, held, "items", "a", "b")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def departures(members: DataFrame, held: DataFrame) -> DataFrame:
    """How members differ from their hub: a row per shingle that one of the two has and the other not.

    Columns: hub, token, fp, c, odd (not in the hub's component), size and hub_size of the sets, n such shingles.
    """
    schema = "hub long, token long, fp long, c long, odd boolean, size long, hub_size long, n long"

    names = schema.replace(" long", "").replace(" boolean", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]

            def rows(parts: list[tuple[int, np.ndarray, int, int, int]]) -> pa.RecordBatch:
                at, found, *facts = zip(*parts)
                times = [len(d) for d in found]
                hub, fp, c, main = (np.repeat(x[list(at)], times) for x in ids)
                size, hub_size, n = (np.repeat(x, times) for x in facts)
                return pa.RecordBatch.from_arrays([pa.array(v) for v in (hub, np.concatenate(found), fp, c, c != main, size, hub_size, n)], names=names)

            parts, held_rows = [], 0
            for i in range(batch.num_rows):
                h, x = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                found = np.setxor1d(h, x, assume_unique=True).view(np.int64)
                for begin in range(0, len(found), BATCH_DEPARTURES):
                    part = found[begin : begin + BATCH_DEPARTURES]
                    if parts and held_rows + len(part) > BATCH_DEPARTURES:
                        yield rows(parts)
                        parts, held_rows = [], 0
                    parts.append((i, part, len(x), len(h), len(found)))
                    held_rows += len(part)
            if parts:
                yield rows(parts)

    both = with_both(members, held, "items", "hub", "fp")
    return both.select("hub", "fp", "c", "main", "items_a", "items_b").mapInArrow(run, schema)


def prefixes(tokens: DataFrame, p: NearDups) -> DataFrame:
    """(hub, token, fp, size, n, place, any): the prefixes of departures by which members of a hub can find each other.

    Let D(x) be the shingles in which x differs from hub h.  A link of x and y leaves them at most
    R = r (|x| + |y|) differences, r = (100 - percent) / (100 + percent), so D(x) and D(y) share at least
    (|D(x)| + |D(y)| - R) / 2.  One of them, x, is not linked with h and so has more than
    r (|x| + |h|) departures: the two share more than (|D(y)| + r (|h| - |y|)) / 2.  As |D(x)| and |D(y)|
    differ by R at most, they also share at least |D(x)| - R and |D(y)| - R.  Hence, with departures
    ordered by how few members have them, the first |D| + 1 less that number of each hold a common one,
    the first of all common ones, and enough must follow it in both.  ``any`` marks the prefix that serves y, the others
    serve only members out of the hub's component.
    """
    r = (100 - p.percent) / (100 + p.percent)
    counts = tokens.groupBy("hub", "token").agg(F.count("*").alias("among"), F.max("odd").alias("sought"))
    # Shingles that only one member has come first; there are n less the others, and they need no place of their own.
    mine = Window.partitionBy("hub", "fp")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("among", "token"))
    ranked = tokens.join(counts.where("among > 1"), ["hub", "token"]).withColumn("place", place).where("sought")
    widest = F.col("n") - r * F.col("size") * (1 + 100 / p.percent)
    as_any = F.col("n") - F.floor(F.greatest((F.col("n") + r * (F.col("hub_size") - F.col("size"))) / 2, widest) - 1e-6)
    as_odd = F.col("n") - F.floor(F.greatest(F.lit(0.0), widest) - 1e-6)
    ranked = ranked.withColumn("any", F.col("place") <= as_any).where(F.col("any") | (F.col("odd") & (F.col("place") <= as_odd)))
    return ranked.select("hub", "token", "fp", "size", "n", "place", "any", (F.col("odd") & (F.col("place") <= as_odd)).alias("asks"))


def sides(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes of all open members, and of those out of their hub's component (columns with _x), by the components of ``state``."""
    now = rows.join(small_or_shuffled(state.select("hub", "fp", "c", (F.col("c") != F.col("main")).alias("odd"))), ["hub", "fp"])
    names = ("fp", "c", "size", "n", "place")
    return (now.where("any").select("hub", "token", *names),
            now.where("odd and asks").select("hub", "token", *[F.col(v).alias(f"{v}_x") for v in names]))


def fits(p: NearDups) -> Column:
    """Whether two members of different components that share a token can be linked."""
    r = (100 - p.percent) / (100 + p.percent)
    # If this shingle is their first common one, no more than what follows in either can be common.
    after = 1 + F.least(F.col("n") - F.col("place"), F.col("n_x") - F.col("place_x"))
    return ((F.col("c") != F.col("c_x")) & (100 * F.least("size", "size_x") >= p.percent * F.greatest("size", "size_x"))
            & (F.abs(F.col("n") - F.col("n_x")) <= r * (F.col("size") + F.col("size_x")) + 1e-6)
            & (2 * after >= F.col("n") + F.col("n_x") - r * (F.col("size") + F.col("size_x")) - 1e-6))


def partners(rows: DataFrame, state: DataFrame, p: NearDups, turn: int) -> DataFrame:
    """Up to ``p.asks`` pairs (a, b) per open member: it and the members it meets under most tokens.

    Only ``p.asks`` members of each token's bucket are met, others each turn, so meetings are in proportion to prefix rows.
    """
    index, probe = sides(rows, state)
    names = [c for c in probe.columns if c.endswith("_x")]
    drawn = [F.min(F.struct(F.xxhash64("fp_x", F.lit(turn * p.asks + i)).alias("h"), *names)).alias(f"m{i}") for i in range(p.asks)]
    each = F.array_distinct(F.array(*[F.struct(*[F.col(f"m{i}.{c}") for c in names]) for i in range(p.asks)]))
    met = probe.groupBy("hub", "token").agg(*drawn).select("hub", "token", F.inline(each))
    meetings = index.join(met, ["hub", "token"]).where(fits(p)).select("fp", "fp_x").repartition("fp").groupBy("fp", "fp_x").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("times"), "fp_x"))
    best = meetings.withColumn("place", place).where(F.col("place") <= p.asks)
    best = best.select(F.least("fp", "fp_x").alias("a"), F.greatest("fp", "fp_x").alias("b")).distinct()
    return gathered(best, p.asks * state.count())


def across(rows: DataFrame, state: DataFrame, p: NearDups) -> DataFrame:
    """All pairs (a, b) of members of one hub in different components that can be linked, by their :func:`prefixes`."""
    index, probe = sides(rows, state)
    return index.join(probe, ["hub", "token"]).where(fits(p)).select(F.least("fp", "fp_x").alias("a"), F.greatest("fp", "fp_x").alias("b")).distinct()


def still_open(state: DataFrame, label: DataFrame, node: str, hub: str) -> DataFrame:
    """Members (hub, fp, c, main) whose hubs still hold several components; c and main are the labels of ``node`` and ``hub``.

    Members are labelled once and written, so that the search for open hubs does not label them again.
    """
    label = small_or_shuffled(label)
    named = cut_lineage(
        state.withColumn("__c", F.col(node)).withColumn("__m", F.col(hub)).select("hub", "fp", "__c", "__m")
        .join(label.select(F.col("node").alias("__c"), F.col("label").alias("c")), "__c", "left")
        .join(label.select(F.col("node").alias("__m"), F.col("label").alias("main")), "__m", "left")
        .select("hub", "fp", F.coalesce("c", "__c").alias("c"), F.coalesce("main", "__m").alias("main")), "near-labelled")
    # A hub with one member, or with all members in its component, leaves nothing to compare.
    open_ = (gathered(named, named.count()).groupBy("hub").agg(F.count("*").alias("n"), F.max((F.col("c") != F.col("main")).cast("int")).alias("odd"))
             .where("n > 1 and odd = 1").select("hub"))
    return cut_lineage(named.join(small_or_shuffled(open_), "hub", "left_semi"), "near-open")


def merged(state: DataFrame, more: DataFrame) -> DataFrame:
    """What is open of ``state`` when the components that the links ``more`` join are one."""
    at = gathered(state.select("fp", "c"), state.count()).distinct()
    more = small_or_shuffled(more)
    joined = more.join(at.select(F.col("fp").alias("a"), F.col("c").alias("ca")), "a").join(at.select(F.col("fp").alias("b"), F.col("c").alias("cb")), "b")
    return still_open(state, components(joined, "ca", "cb"), "c", "main")


def links(classes: DataFrame, docs: DataFrame, p: NearDups, text: str) -> DataFrame:
    """Confirmed links (a, b) between classes that have the same components as all links of candidates.

    The members of a bucket are first compared with one hub of it, the least.  Two members in one
    component need no comparison.  Members that are not in their hub's component then ask
    a few partners each (:func:`partners`), and components merge, round by round while many are links, so that a group of
    near copies is nearly one component before its pairs are made.  What is apart then is
    searched among all members of its hub by :func:`across`, which misses no link.
    """
    members = cut_lineage(bucket_keys(classes, p), "near-buckets")
    hubs = members.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("hub")).where("n > 1").select("key", "hub")
    star = cut_lineage(members.join(hubs, "key").where("fp != hub").select("hub", "fp").distinct(), "near-star")
    # All that is compared below are members and hubs of the star, so their sets are made once.
    ends = star.select(F.explode(F.array("hub", "fp")).alias("fp")).distinct()
    held = shingle_sets(cut_lineage(gathered(ends, 2 * star.count()), "near-ends"), classes, docs, p, text)

    def verify(pairs: DataFrame) -> DataFrame:
        apart = cut_lineage(plausible(pairs, classes, p), "near-likely")
        return cut_lineage(confirmed(apart, held, p), "near-links")

    found = verify(star.select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    state = still_open(star, components(found), "fp", "hub")
    rows = cut_lineage(prefixes(cut_lineage(departures(state, held), "near-departures"), p), "near-prefixes")
    for turn in range(p.rounds):
        asked = cut_lineage(partners(rows, state, p, turn), "near-asked")
        more = verify(asked)
        n_asked, n_more = asked.count(), more.count()
        if not n_more:
            break
        found, state = found.unionByName(more), merged(state, more)
        if 8 * n_more < n_asked:
            break  # what is left to merge is little, so one whole search costs less than more rounds
    return found.unionByName(verify(cut_lineage(across(rows, state, p), "near-pairs")))


def near_duplicates(docs: DataFrame, p: NearDups = NearDups(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept.

    Rows with the same shingle set are one class; the whole corpus is compared by classes.
    ``component_id`` is the smallest doc_id of all rows reachable by links, and
    ``kept`` holds on the rows that bear it.  A row without words (null, empty or white space)
    has 0 shingles and is linked with nothing; its component is its own doc_id.  A row without doc_id
    names no component: it gets its component's smallest doc_id, or null if there is
    none, and is kept only then.  Repeated rows share one result.  An empty table gives none.
    """
    rows = cut_lineage(signatures(docs, p, text, key), "near-rows")
    classes = rows.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("doc"), F.first("text_key").alias("text_key"), F.first("sig").alias("sig"))
    classes = cut_lineage(gathered(classes, rows.count(), TASK_SETS), "near-classes")
    found = links(classes, docs, p, text)
    label = components(found).withColumnRenamed("node", "fp")
    of = classes.join(label, "fp", "left").select("fp", "doc", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = cut_lineage(gathered(of.join(least, "label").select("fp", "component_id"), classes.count()), "near-named")
    out = rows.drop("sig").join(named, "fp", "left").withColumn(
        "component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, p: NearDups = NearDups(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their components, with all their columns.

    A row goes if its doc_id and text are those of a row that is not kept.
    """
    gone = near_duplicates(docs, p, text, key).where("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct()
    gone = cut_lineage(gone, "near-gone")
    match = F.col(key).cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_key"))
    return docs.join(small_or_shuffled(gone), match, "left_anti")
