"""Point lookups beyond the end, byte-wise prefixes, wide symbols, code tables, deep and wide trees, skewed orders, a stream."""

import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.functions import blobs, entropy_codes
from symweave.operators import dictionary, ordered, pairs, sequence, transforms, tree
from symweave.streaming.entropy import windowed_counts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=120).map(sorted), st.lists(st.binary(max_size=5), min_size=1, max_size=50, unique=True).map(sorted), st.integers(1, 9))
def test_lookups_of_one_place(numbers, strings, size):
    a, b = blobs.pack_deltas(numbers, size), blobs.pack_strings(strings, size)
    assert [blobs.delta_at(a, i) for i in range(len(numbers))] == numbers and [blobs.string_at(b, i) for i in range(len(strings))] == strings
    assert blobs.header(a, "deltas") == {"count": len(numbers), "block": size} and blobs.header(b, "strings")["bucket"] == size
    for bad in (lambda: blobs.delta_at(a, len(numbers)), lambda: blobs.string_at(b, len(strings)), lambda: blobs.delta_at(a, -1)):
        with pytest.raises(IndexError):
            bad()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=1, max_size=60), st.binary(min_size=1, max_size=80))
def test_wide_symbols(symbols, block):
    assert transforms.symbols_from_front(transforms.symbols_to_front(symbols)) == symbols
    assert bytes(transforms.symbols_to_front(list(block), 256)) == transforms.move_to_front(block)
    freqs = [symbols.count(s) for s in range(max(symbols) + 257)]
    lengths = entropy_codes.huffman_lengths(freqs, 24)
    assert entropy_codes.huffman_decode(entropy_codes.huffman_encode(symbols, lengths), lengths, len(symbols)) == symbols
    f = entropy_codes.quantise(freqs, 12)
    assert entropy_codes.rans_decode(entropy_codes.rans_encode(symbols, f), f, len(symbols)) == symbols


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=2, max_size=60))
def test_codes_cost_the_least_and_are_canonical(freqs):
    heap, cost = sorted(freqs), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    lengths = entropy_codes.huffman_lengths(freqs, 60)
    assert sum(n * f for n, f in zip(lengths, freqs)) == cost
    codes = entropy_codes.canonical_codes(lengths)
    written = sorted(format(c, f"0{n}b") for c, n in zip(codes, lengths))
    assert all(not b.startswith(a) for a, b in zip(written, written[1:])) and [int(w, 2) for w in written] == [c for _, c in sorted((n, c) for n, c in zip(lengths, codes))]


def test_leb128_columns(spark):
    good = [0, 1, 127, 128, 300, 624485, 2**62, 2**63 - 1]
    rows = [(blobs.leb128(v).hex().upper(), v) for v in good] + [(x, None) for x in ("", "80", "8080", "0000", "E58E26FF", "E58E2680", "FF" * 9 + "01", "8000", "1")]
    found = spark.createDataFrame(rows, "e string, v bigint").select("e", "v", ordered.leb128_value(F.col("e")).alias("found")).collect()
    assert all(r.found == r.v for r in found), found
    assert blobs.is_leb128(b"\xe5\x8e\x26") and not blobs.is_leb128(b"\x80\x00") and not blobs.is_leb128(b"\x80")


def test_deep_and_wide_trees(spark):
    n = 50_000
    path = tree.tree_index(spark.range(n).select(F.col("id").alias("node"), (F.col("id") < n - 1).cast("long").alias("degree")))
    depth, size = tree.depth_and_size(tree.parents(path))
    assert depth.where("depth <> node").count() == 0 and size.where(f"subtree_size <> {n} - node").count() == 0
    rng = random.Random(5)
    degrees, waiting = [], 1
    while waiting and len(degrees) < 400:
        degrees.append(rng.choice([0, 0, 1, 2, 60]) if len(degrees) < 200 else 0)
        degrees[0] = max(degrees[0], 1)
        waiting += degrees[-1] - 1
    degrees += [0] * (sum(degrees) + 1 - len(degrees))
    up, next_child = {0: None}, 1
    for node, d in enumerate(degrees):
        up.update((k, node) for k in range(next_child, next_child + d))
        next_child += d
    index = tree.tree_index(spark.createDataFrame(list(enumerate(degrees)), "node bigint, degree bigint"))
    assert {r.node: r.parent for r in tree.parents(index).collect()} == up
    for r in tree.siblings(index).collect():
        same = [k for k, p in up.items() if p == up[r.node] and p is not None]
        assert (r.prev_sibling, r.next_sibling) == tuple(k if k in same else None for k in (r.node - 1, r.node + 1)), r
    above = {}
    for k in up:
        above[k] = [k] if up[k] is None else [k, *above[up[k]]]
    depth, size = tree.depth_and_size(tree.parents(index))
    assert {r.node: r.depth for r in depth.collect()} == {k: len(v) - 1 for k, v in above.items()}
    assert {r.node: r.subtree_size for r in size.collect()} == {k: sum(k in v for v in above.values()) for k in up}


def test_strings_with_one_beginning_are_dealt(spark):
    rows = spark.range(5000).select(F.format_string("Customer#%09d", F.col("id")).alias("s"))
    dealt = sequence.with_range(rows, "s").groupBy("_range").count().collect()
    assert len(dealt) > 32 and max(r["count"] for r in dealt) < 500
    index = dictionary.string_index(rows, "s")
    assert index.where("s <> format_string('Customer#%09d', idx)").count() == 0
    words = ["é", "éa", "è", "漢字", "漢", "a", "ab", "", "abc"]
    found = {r.s: (r.shared, r.suffix) for r in dictionary.front_coded_bytes(dictionary.string_index(spark.createDataFrame([(w,) for w in words], "s string"), "s"), 100).collect()}
    before = b""
    for w in sorted(w.encode() for w in words):
        shared = next((i for i, (x, y) in enumerate(zip(before, w)) if x != y), min(len(before), len(w)))
        assert found[w.decode()] == (shared, w[shared:].hex().upper())
        before = w


def test_merges_like_plain_counting(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aab") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "a", "é"]
    found = pairs.learn_merges(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 6)
    rows, wanted = [list((t or "").encode()) for t in texts], []
    for k in range(6):
        counts = {}
        for r in rows:
            for p in zip(r, r[1:]):
                counts[p] = counts.get(p, 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p))
        wanted.append((*best, 256 + k))
        rows = [pairs.apply_merges(bytes(0), []) if not r else _one(r, *wanted[-1]) for r in rows]
    assert found == wanted


def _one(tokens, left, right, token):
    out, at = [], 0
    while at < len(tokens):
        hit = tokens[at] == left and at + 1 < len(tokens) and tokens[at + 1] == right
        out.append(token if hit else tokens[at])
        at += 1 + hit
    return out


def test_a_stream_of_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 00:50:00", "b"), ("2024-01-01 03:00:00", "a"), ("2024-01-01 00:30:00", "late")]
    schema = "ts timestamp, sym string"
    for i, part in enumerate((rows[:3], rows[3:4], [("2024-01-01 03:01:00", "a")], rows[4:], [("2024-01-01 09:00:00", "b")], [("2024-01-01 09:01:00", "b")])):
        frame = spark.createDataFrame(part, "ts string, sym string").selectExpr("cast(ts as timestamp) as ts", "sym")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "part=*"))
    run = windowed_counts(stream, "ts", "sym").writeStream.format("memory").queryName("sw_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {(r.start.hour, r.sym): r.n for r in spark.table("sw_windows").collect()}
    assert found == {(0, "a"): 2, (0, "b"): 1, (3, "a"): 2}  # what came after the watermark had passed is left out; the last window is still open
