"""MinHash near-deduplication: b-bit signatures, banded candidates, exact confirmation, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import connected_components, forget, pieces, release, small_enough, stored, text_batches, unused

#: Words of a shingle; bands and minima of a band; low bits kept of each minimum.
WIDTH, BANDS, ROWS, BITS = 5, 32, 5, 2
#: 64-bit words of one bit plane of a signature.
PLANE = -(-BANDS * ROWS // 64)
#: A pair is confirmed on full sets if its estimate is no further below the threshold than so many standard errors.
ERRORS = 6.0

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_power: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, of: np.uint64 = _BASE) -> np.ndarray:
    """The first n powers of an odd number mod 2^64, kept for the next call."""
    if len(_power.get(int(of), ())) < n:
        _power[int(of)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), of))])
    return _power[int(of)][:n]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of other than space and \\x09-\\x0D, A-Z in lower case; texts of fewer than width words are one
    shingle; without words there is none. A shingle's hash is a polynomial over its bytes, words one space apart.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    body = np.frombuffer(b" ".join(words), np.uint8)
    n = len(body)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[body] * _powers(n))])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = max(1, len(words) - width + 1)
    a, b = starts[:count], ends[-count:]
    return np.unique(_mixed((sums[b] - sums[a]) * _powers(n, _UNBASE)[a] + (b - a).astype(np.uint64)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set that isn't empty."""
    least = np.full(len(_MULTIPLY), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 512):
        x = hashes[at : at + 512]
        least = np.minimum(least, (_MULTIPLY[:, None] * (x >> np.uint64(1))[None, :] + _ADD[:, None] ^ (x >> np.uint64(32))[None, :]).min(axis=1))
    return least


def packed(least: np.ndarray) -> list[int]:
    """The BITS low bits (of the mixed minima), plane by plane, in signed 64-bit words padded with zeros."""
    low, out = _mixed(least), []
    for bit in range(BITS):
        plane = np.zeros(PLANE * 64, np.uint8)
        plane[: len(low)] = (low >> np.uint64(bit)) & np.uint64(1)
        out += np.packbits(plane).view(">i8").astype(np.int64).tolist()
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in (part for whole in batches for part in pieces(whole)):
        n, key, sig, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            n.append(len(found))
            if len(found):
                least = signature(found)
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sig.append(packed(least))
                bands.append(band_keys(least))
            else:
                key.append(None), sig.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "set_key", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            hashes = pa.array([shingles(t).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), hashes], ["node", "hashes"])


def estimate(a: str, b: str) -> Column:
    """Similarity from the bit planes in the array columns a and b: the share of minima whose kept bits all agree,
    less what different minima agree by chance (2^-BITS)."""
    words = (" | ".join(f"({a}[{plane * PLANE + k}] ^ {b}[{plane * PLANE + k}])" for plane in range(BITS)) for k in range(PLANE))
    differ = F.expr(" + ".join(f"bit_count({w})" for w in words))
    chance = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    """The estimate below which a pair at the threshold is ERRORS standard errors away."""
    chance = 2.0**-BITS
    agree = similarity + (1 - similarity) * chance
    return similarity - ERRORS * (agree * (1 - agree) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, hashes: the whole shingle set of each class in nodes, from the text of its representative."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    named = stored(wanted)
    wanted = small_enough(named, 500_000)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    sets = stored(texts.select("node", "text").mapInArrow(_sets, "node binary, hashes array<bigint>"))
    forget(named)
    return sets


def similar(x: str, y: str, percent: int) -> Column:
    """Whether two sets in array columns have 100 * intersection >= percent * union; sizes are compared first."""
    x, y = F.col(x), F.col(y)
    both = F.size(F.array_intersect(x, y))
    sizes = F.least(F.size(x), F.size(y)) * 100 >= F.greatest(F.size(x), F.size(y)) * percent
    return sizes & (both * 100 >= (F.size(x) + F.size(y) - both) * percent)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar on full sets. A set is made once, and travels once for each pair."""
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), classes, docs)
    near = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    out = stored(near.where(similar("x", "y", percent)).select("a", "b"))
    forget(sets)
    return out


def confirmed_within(open_members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, enough: float) -> DataFrame:
    """Similar pairs (a, b) of different components within buckets, in open_members (key, node, sig, c).

    Members are compared inside the join, by estimate, then once in the first bucket that a pair shares, then on full
    sets: only links come out of it, however large a bucket is.
    """
    sets = full_sets(open_members.select("node").distinct(), classes, docs)
    full = open_members.join(sets, "node").join(classes.select("node", "bands"), "node").select("key", "node", "sig", "c", "hashes", "bands")
    x, y = full.alias("x"), full.alias("y")  # both sides alike, so that one exchange serves both
    first = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key")
    compare = F.when(F.col("x.c") == F.col("y.c"), False).when(F.col("x.node") <= F.col("y.node"), False).when(estimate("x.sig", "y.sig") < enough, False).when(~first, False).otherwise(similar("x.hashes", "y.hashes", percent))
    out = stored(x.join(y, (F.col("x.key") == F.col("y.key")) & compare).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")))
    forget(sets)
    return out


#: Members of a bucket that all others are compared with before any other pairs are: one at first, then so many more.
HUBS = 3


def hubs_of(members: DataFrame, more: int = 0) -> DataFrame:
    """key, a, x, d: hubs of each bucket in members (key, node, sig, degree, c), with node, signature and component.

    The member that is in most buckets, or, of the members outside its component, those that come first in each of so
    many orders by hash. All are grouped minima, combined before they are shuffled, so that no bucket meets in one task;
    where there are more open buckets than a broadcast may have rows, the later hubs' members are shuffled by bucket
    first, in a join that adaptive execution can split. The result is stored, so that the join of members with it can
    split a bucket.
    """
    a = F.struct(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("c").alias("d"))
    chief = members.groupBy("key").agg(F.min_by(a, F.struct(-F.col("degree"), "node")).alias("hub"))
    if not more:
        return stored(chief.select("key", "hub.*"))
    lead = F.min_by("c", F.struct(-F.col("degree"), "node")).alias("_lead")
    leads = stored(members.groupBy("key").agg(lead))
    rest = members.join(small_enough(leads), "key").where("c <> _lead")
    each = rest.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(a, F.struct(F.xxhash64("node", F.lit(k)), "node")) for k in range(more)])).alias("hubs"))
    out = stored(each.select("key", F.explode("hubs").alias("hub")).select("key", "hub.*"))
    forget(leads)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id, kept, component (a key of the group, null without words).

    Two documents are linked if 100 * intersection >= percent * union of their distinct word shingles; component_id is
    the smallest doc_id reachable over links. Documents with equal sets are one class from the start, so copies are
    never paired. Classes meet in buckets of equal band keys; of two at the threshold about 7 in 10^9 meet in none.
    Each bucket compares its members with the one that is in most buckets, then, where components remain, with up to
    HUBS outside the component of that one; last, what is still in different components of a bucket is compared inside a join that emits links only.
    Pairs that the b-bit estimate rules out are not confirmed; ERRORS bounds what that loses.

    Null and empty texts have no shingles, are linked with nothing and are kept; texts are read whole, however long. Rows
    that share an id but not a text are documents of their own; repeated rows each give a row, all of them kept if one
    is. Ids that are null take no part in the smallest; where a component has no other, it is null. An empty table gives
    no rows; other columns of docs, whatever their names, have no part. Ties can't occur: ids and set keys are ordered.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    base = stored(docs.mapInArrow(_sign, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, sig array<bigint>, bands array<bigint>"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id")
    classes = base.where("set_key is not null").groupBy("set_key").agg(F.min_by(F.struct("doc_id", "text_hash", "sig", "bands"), first).alias("r"))
    classes = stored(classes.select(F.col("set_key").alias("node"), "r.*"))
    placed = classes.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(placed.join(shared, "key"))
    degrees = members.groupBy("node").agg(F.count("*").alias("degree"))
    met = stored(members.join(degrees, "node").join(classes.select("node", "sig"), "node").select("key", "node", "sig", "degree"))
    forget(members)
    enough = least_estimate(percent / 100)
    links, labels, done = None, None, []
    for turn in range(3):
        if labels is None:
            now = met.withColumn("c", F.col("node"))
        else:
            now = met.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
            open_keys = stored(now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
            now = stored(now.select("key", "node", "sig", "degree", "c").join(open_keys, "key", "left_semi"))
            forget(open_keys)
            if not now.limit(1).count():
                break
        if turn < 2:
            hubs = hubs_of(now, turn * HUBS)
            pairs = now.join(hubs, "key").where(F.col("c") != F.col("d")).where(estimate("x", "sig") >= enough)
            pairs = stored(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
            found = confirmed(pairs, classes, docs, percent)
            forget(pairs, hubs)
        else:
            found = confirmed_within(now.select("key", "node", "sig", "c"), classes, docs, percent, enough)
        done.append(found)
        links = found if links is None else links.unionByName(found)
        forget(now, labels)
        labels = connected_components(links)
    forget(met, *done)
    linked = labels.join(classes.select("node", "doc_id"), "node")
    least = small_enough(stored(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))), 200_000)
    grouped = labels.join(least, "component")
    of_class = classes.select("node", "doc_id").join(grouped, "node", "left")
    smallest = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    of_class = of_class.select(F.col("node").alias("_key"), smallest.alias("component_id"), F.coalesce("component", "node").alias("component"))
    of_class = stored(of_class)  # by itself, so that the copies of one text can be split in the join
    out = base.select("doc_id", "text_hash", "n_shingles", "set_key").join(of_class, F.col("set_key") == F.col("_key"), "left")
    smallest = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", smallest.alias("component_id"), smallest.eqNullSafe(F.col("doc_id")).alias("kept"), "component")


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest doc_id, null being the largest.

    Of several texts of that id in one group, the one with the smaller hash stays. Null and empty texts are in no group
    and stay. Repeated rows stay once. The whole texts move only for rows that are repeated, and where more documents go
    than a broadcast may have rows.
    """
    d, h, own = unused("_d", docs), unused("_h", docs), unused("_text_hash", docs)
    found = stored(near_duplicates(docs, percent).groupBy("doc_id", "text_hash", "component").agg(F.count("*").alias("n")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("best")
    each = found.where("component is not null").groupBy(F.col("component").alias("_of")).agg(best, F.count("*").alias("members"))
    each = stored(each.where("members > 1").select("_of", "best"))
    chosen = small_enough(each, 200_000)  # stored apart from the join, so that rows of a large group can be split
    stays = F.expr("best is null or (doc_id <=> best.doc_id and text_hash = best.text_hash)")
    states = stored(found.join(chosen, F.col("component") == F.col("_of"), "left").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), "n", stays.alias("stays")))
    forget(found, each)
    same = lambda other: F.col("doc_id").eqNullSafe(other[d]) & (F.col(own) == other[h])
    rows = docs.withColumn(own, F.xxhash64("text"))
    apart = small_enough(states.where("not stays or n > 1"), 200_000)
    out = rows.join(apart, same(apart), "left_anti")
    repeated = states.where("stays and n > 1")
    if repeated.limit(1).count():
        repeated = small_enough(repeated, 200_000)
        out = out.unionByName(rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", own]))
    return out.select(*docs.columns)
