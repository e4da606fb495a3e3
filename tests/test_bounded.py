"""What Python workers hold does not grow with their Arrow batches."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from symweave.functions import blobs
from symweave.operators import batches, sequence, transforms
from symweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def worker(monkeypatch, frame, make):
    """The function that make() has Spark run on Arrow batches of a frame like this one."""
    found, plain = [], type(frame).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda df, fn, *a, **b: found.append(fn) or plain(df, fn, *a, **b))
        make()
    return found[0]


def peak(fn, batch):
    """MB that fn takes for a batch, and the rows of each batch that it gives."""
    tracemalloc.start()
    rows = [x.num_rows for x in fn(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, rows


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_gram_counts_take_little_memory(spark, monkeypatch, size):
    frame = spark.createDataFrame([("a", "x")], "lang string, text string")
    fn = worker(monkeypatch, frame, lambda: sequence.gram_counts(frame, "lang", "text", size))
    texts = ["".join(random.Random(i).choices("abcdef", k=2000)) * 2 for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b"] * 500), pa.array(texts)], ["grp", "body"])
    assert peak(fn, batch)[0] < 40  # 6 MB of text


def test_gram_counts_of_pieces(spark, monkeypatch):
    texts = [("a", "abcabc" * 9), (None, "né"), ("b", ""), ("a", None), ("b", "ab"), ("c", "a")] * 7
    frame = spark.createDataFrame(texts, "lang string, text string")
    monkeypatch.setattr(sequence, "PIECE", 5)  # long texts are cut, but no gram is lost at a cut
    for size in (1, 2, 5):
        wanted = Counter((k, int.from_bytes(b[i : i + size])) for k, t in texts for b in [(t or "").encode()] for i in range(len(b) - size + 1))
        assert {(r["lang"], r["gram"]): r["n"] for r in sequence.gram_counts(frame, "lang", "text", size).collect()} == wanted


@pytest.mark.parametrize("kept", [1, 300, 10**6])
def test_tallies_are_whole(kept):
    rnd = random.Random(kept)
    numbers = [(rnd.choice("abc"), [rnd.randrange(40) for _ in range(rnd.randrange(1, 20))]) for _ in range(500)]
    found = Counter()
    for keys, places, values, n in batches.tallied(((k, pa.array(v).to_numpy()) for k, v in numbers), 100, kept):
        for place, value, times in zip(places, values, n, strict=True):
            found[keys[place], int(value)] += int(times)
    assert found == Counter((k, x) for k, v in numbers for x in v)


def test_blocks_take_little_memory(spark, monkeypatch):
    frame = spark.createDataFrame([(1, [1])], "block bigint, items array<bigint>")
    fn = worker(monkeypatch, frame, lambda: transforms.map_blocks(frame, "items", {"twice": "array<bigint>"}, lambda x: ([2 * v for v in x],)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([list(range(i, i + 1024)) for i in range(500)])], ["block", "items"])
    most, rows = peak(fn, batch)
    assert most < 8 and sum(rows) == 500  # 4 MB of blocks


@pytest.mark.parametrize(("name", "steps"), [("blob_bit_vector", 1), ("blob_sorted", 1), ("blob_deltas", 1), ("blob_strings", 1), ("blob_symbols", 1), ("blob_tree", 1), ("blob_delta_get", 1), ("blob_string_get", 1), ("blob_headers", 4), ("blob_validate", 3)])
def test_blocks_take_one_worker_a_task(spark, name, steps):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == steps  # one for each kind of blob


def test_symbol_bits_without_a_row_a_character(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequence, "PIECE", 3)
    rnd = random.Random(1)
    points = [0, 1, 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF, *(rnd.choice([x for x in (rnd.randrange(1 << k),) if not 0xD800 <= x < 0xE000] or [65]) for k in range(1, 21))]
    texts = [(f"{p}", "".join(map(chr, [*(rnd.choices([x for x in points if x <= p], k=9)), p]))) for p in points]
    rows = [*texts, (None, "é"), ("null", None), ("empty", ""), ("two", "a"), ("two", "€")]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["detect_symbol_bits"](spark, str(tmp_path))
    assert {r["lang"]: r["bits"] for r in found.collect()} == {f"{p}": max(1, p.bit_length()) for p in points} | {None: 8, "two": 14}
    assert [sequence._top_code_point(sequence.np.frombuffer(t.encode(), "u1")) for _, t in texts] == points
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_single_numbers_are_read_at_once(monkeypatch):
    rnd = random.Random(3)
    steps = [0, 1, 126, 127, 128, 129, 16383, 16384, 2**40]
    for pool in (steps, steps[:4], steps[:1], [*steps[:4]] * 20 + [128]):
        values = [5]
        for step in rnd.choices(pool, k=300):
            values.append(values[-1] + step)
        blob = blobs.pack_deltas(values)
        assert [blobs.delta_at(blob, i) for i in range(len(values))] == values == blobs.read_deltas(blob)
        for cut in (blob[:-1], blob[:-1] + b"\x80", blob[:-1] + b"\xff" * 10):
            assert not blobs.valid(blobs.read_deltas, cut)
            with pytest.raises(ValueError):
                blobs.delta_at(cut, len(values) - 1)
    monkeypatch.setattr(blobs, "read_leb128", None)  # a number a step takes minutes over larger tables
    blob = blobs.pack_deltas(range(0, 12700, 127))
    assert [blobs.delta_at(blob, i) for i in range(100)] == list(range(0, 12700, 127))
