"""Further queries of the catalogue: point lookups, comparisons, validators, code tables, wide symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from symweave.functions import blobs, entropy_codes, fixed
from symweave.functions import sql as sql_functions_of
from symweave.operators import bitvector, blocks, dictionary, ordered, stats, transforms, tree
from symweave.operators.sequence import gram_counts
from symweave.plans.catalog import _BITS, _FRONT, _GRAMS, _ROT, _SORTED, _TREE, query
from symweave.sources.tables import bfs_tree, distinct_words, order_bits, table


@query("WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(l_quantity * 65536 AS BIGINT) AS a, CAST(l_discount * 65536 AS BIGINT) * 300 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, sign(a - b)::INT AS compared, (((a - b * 1000 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS difference, -a AS negated, abs(a - b) AS absolute, l_linenumber * 65536 AS whole, CASE WHEN l_linenumber <> 3 THEN (l_orderkey % 1000) * 65536 // (l_linenumber - 3) END AS ratio FROM r WHERE l_linenumber >= 3 UNION ALL SELECT l_orderkey, l_linenumber, sign(a - b)::INT, (((a - b * 1000 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648, -a, abs(a - b), l_linenumber * 65536, -((l_orderkey % 1000) * 65536 // (3 - l_linenumber)) FROM r WHERE l_linenumber < 3")
def fixed_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "cast(rint(l_quantity * 65536) as bigint) as a", "cast(rint(l_discount * 65536) as bigint) * 300 as b", "l_orderkey % 1000 as n", "cast(l_linenumber as bigint) - 3 as d")
    a, b = F.col("a"), F.col("b")
    return rows.select("l_orderkey", "l_linenumber", fixed.compare(a, b).alias("compared"), fixed.sub(a, b * 1000).alias("difference"), fixed.negate(a).alias("negated"), fixed.absolute(a - b).alias("absolute"), fixed.from_int(F.col("l_linenumber")).alias("whole"), fixed.from_fraction("n", "d").alias("ratio"))


@query("SELECT o_orderkey AS v, o_orderkey AS decoded, false AS cut_is_valid, false AS longer_is_valid, true AS valid FROM orders")
def leb128_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), ordered.leb128_hex(F.col("o_orderkey")).alias("e"))
    cut, longer = F.expr("substring(e, 1, length(e) - 2)"), F.concat("e", F.lit("80"))
    value = lambda e: ordered.leb128_value(e)
    return rows.select("v", value(F.col("e")).alias("decoded"), value(cut).isNotNull().alias("cut_is_valid"), value(longer).isNotNull().alias("longer_is_valid"), value(F.col("e")).isNotNull().alias("valid"))


@query(f"{_SORTED} SELECT idx, v FROM v")
def blob_delta_get(spark, sf_dir):
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    each = blocks.in_blocks(index, "idx", "v", 512)
    back = blocks.served(each, blobs.pack_deltas, {"values": "array<bigint>"}, lambda b: ([blobs.delta_at(b, i) for i in range(blobs.header(b, "deltas")["count"])],))
    return back.select("block", F.posexplode("values").alias("i", "v")).select((F.col("block") * 512 + F.col("i")).alias("idx"), "v")


@query(f"{_FRONT} SELECT idx, s FROM i")
def blob_string_get(spark, sf_dir):
    index = dictionary.string_index(table(spark, sf_dir, "customer"), "c_name")
    each = blocks.in_blocks(index, "idx", "s", 256)
    back = blocks.served(each, lambda items: blobs.pack_strings([s.encode() for s in items]), {"strings": "array<string>"}, lambda b: ([blobs.string_at(b, i).decode() for i in range(blobs.header(b, "strings")["count"])],))
    return back.select("block", F.posexplode("strings").alias("i", "s")).select((F.col("block") * 256 + F.col("i")).alias("idx"), "s")


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS s FROM documents), i AS (SELECT s, hex(encode(s)) AS h, row_number() OVER (ORDER BY s) - 1 AS idx FROM w WHERE s <> ''), b AS (SELECT *, idx // 16 AS bucket, coalesce(lag(h) OVER (PARTITION BY idx // 16 ORDER BY idx), '') AS prev FROM i), f AS (SELECT *, (SELECT coalesce(max(n), 0) FROM range(1, length(h) // 2 + 1) t(n) WHERE 2 * n <= length(prev) AND h[1:2 * n] = prev[1:2 * n])::BIGINT AS shared FROM b) SELECT idx, s, bucket, shared, h[2 * shared + 1:] AS suffix FROM f")
def front_code_bytes(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("s")).where("s <> ''")
    return dictionary.front_coded_bytes(dictionary.string_index(words, "s"))


@query()
def huffman_codes(spark, sf_dir):
    """(lang, sym, length, code) of the bytes of each language's documents, lengths up to 15."""
    counts = gram_counts(table(spark, sf_dir, "documents"), "lang", "text", 1)
    lists = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("m"))
    dense = lists.select("lang", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("freqs"))

    def fn(freqs: list[int]) -> tuple:
        lengths = entropy_codes.huffman_lengths(freqs)
        return lengths, entropy_codes.canonical_codes(lengths)

    made = transforms.map_blocks(dense, "freqs", {"lengths": "array<bigint>", "codes": "array<bigint>"}, fn)
    rows = made.select("lang", F.posexplode(F.arrays_zip("lengths", "codes")).alias("sym", "x"))
    return rows.select("lang", F.col("sym").cast("long").alias("sym"), F.col("x.lengths").alias("length"), F.col("x.codes").alias("code")).where("length > 0")


@query(f"{_GRAMS} SELECT lang, count(DISTINCT p2 || p1) AS contexts FROM g WHERE p2 IS NOT NULL GROUP BY lang")
def context_counts(spark, sf_dir):
    return stats.context_counts(stats.context_model(table(spark, sf_dir, "documents"), "lang", "text", 2), "lang")


@query(f"{_GRAMS}, f AS (SELECT lang, ('0x' || sym)::BIGINT AS c, count(*) AS n FROM g GROUP BY ALL) SELECT l.lang, 0::BIGINT AS context, p.sym, coalesce((SELECT sum(n) FROM f WHERE f.lang = l.lang AND f.c < p.sym), 0)::BIGINT AS cum_freq FROM (SELECT DISTINCT lang FROM f) l, range(0, 256) p(sym)")
def context_cumulative(spark, sf_dir):
    model = stats.context_model(table(spark, sf_dir, "documents"), "lang", "text", 0)
    symbols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("sym")
    return stats.cumulative_frequency(model, "lang", model.select("lang").distinct().select("lang", F.lit(0).cast("long").alias("context"), symbols))


@query(f"{_TREE}, c AS (SELECT parent, node AS child, row_number() OVER (PARTITION BY parent ORDER BY node) - 1 AS k FROM n WHERE parent IS NOT NULL) SELECT n.node, t.k, c.child FROM n CROSS JOIN range(0, 7) t(k) LEFT JOIN c ON c.parent = n.node AND c.k = t.k")
def tree_child_at(spark, sf_dir):
    index = tree.tree_index(bfs_tree(spark, sf_dir))
    found = [tree.child_at(index, k).select("node", F.lit(k).cast("long").alias("k"), "child") for k in range(7)]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@query("WITH w AS (SELECT DISTINCT n_name AS s FROM nation), p AS (SELECT DISTINCT s[1:k] || e AS probe FROM w, range(1, 30) t(k), (VALUES (''), ('Z')) x(e) WHERE k <= length(s)) SELECT probe, EXISTS (SELECT 1 FROM w WHERE starts_with(s, probe)) AS found FROM p")
def blob_prefix(spark, sf_dir):
    def fn(items: list[str]) -> tuple:
        words = sorted(s.encode() for s in items)
        compact = blobs.read_automaton(blobs.pack_automaton(blobs.automaton(words), True), True)
        probes = sorted({w[:k] + e for w in words for k in range(1, len(w) + 1) for e in (b"", b"Z")})
        return [p.decode() for p in probes], [int(blobs.follow(compact, p) is not None) for p in probes]

    by_lead = table(spark, sf_dir, "nation").groupBy(F.substring("n_name", 1, 1).alias("lead")).agg(F.collect_set("n_name").alias("items"))
    rows = transforms.map_blocks(by_lead, "items", {"probe": "array<string>", "found": "array<bigint>"}, fn)
    return rows.select(F.explode(F.arrays_zip("probe", "found")).alias("x")).select("x.probe", (F.col("x.found") == 1).alias("found"))


@query(f"{_SORTED} SELECT 'deltas' AS kind, idx // 1000 AS block, count(*) AS n, 64::BIGINT AS size FROM v GROUP BY ALL UNION ALL SELECT 'strings', idx // 200, count(*), 16 FROM (SELECT row_number() OVER (ORDER BY s) - 1 AS idx FROM (SELECT DISTINCT c_name AS s FROM customer)) GROUP BY ALL UNION ALL SELECT 'tree', 0, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1, 0 UNION ALL SELECT 'rotations', n_nationkey, length(n_name), 0 FROM nation")
def blob_headers(spark, sf_dir):
    def of(kind, frame, at, value, size, pack, field):
        fn = lambda b: (blobs.header(b, kind)["count"], blobs.header(b, kind).get(field, 0))
        return blocks.served(blocks.in_blocks(frame, at, value, size), pack, {"n": "bigint", "size": "bigint"}, fn).select(F.lit(kind).alias("kind"), "block", "n", "size")

    deltas = of("deltas", ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey"), "idx", "v", 1000, blobs.pack_deltas, "block")
    strings = of("strings", dictionary.string_index(table(spark, sf_dir, "customer"), "c_name"), "idx", "s", 200, lambda x: blobs.pack_strings([s.encode() for s in x]), "bucket")
    whole = bfs_tree(spark, sf_dir)
    nodes = of("tree", whole, "node", "degree", whole.count(), blobs.pack_tree, "")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    turned = of("rotations", names, "n_nationkey", "n_name", 1, lambda x: blobs.pack_rotations(*transforms.sort_rotations(x[0].encode())), "")
    return deltas.unionByName(strings).unionByName(nodes).unionByName(turned)


@query(f"{_SORTED}, k AS (SELECT 'sorted' AS kind, idx // 1024 AS block FROM v UNION SELECT 'deltas', idx // 1024 FROM v UNION SELECT 'strings', idx // 256 FROM (SELECT row_number() OVER (ORDER BY s) - 1 AS idx FROM (SELECT DISTINCT c_name AS s FROM customer))) SELECT kind, block, damage, damage = 'none' AS valid FROM k, (VALUES ('none'), ('short'), ('long'), ('count'), ('empty')) d(damage)")
def blob_validate(spark, sf_dir):
    hurt = {"none": lambda b: b, "short": lambda b: b[:-1], "long": lambda b: b + bytes(1), "count": lambda b: bytes([b[0] ^ 1]) + b[1:], "empty": lambda b: b""}
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    names = dictionary.string_index(table(spark, sf_dir, "customer"), "c_name")
    out = None
    for kind, frame, value, size, pack, read in (("sorted", index, "v", 1024, blobs.pack_sorted, blobs.read_sorted), ("deltas", index, "v", 1024, blobs.pack_deltas, blobs.read_deltas), ("strings", names, "s", 256, lambda x: blobs.pack_strings([s.encode() for s in x]), blobs.read_strings)):
        fn = lambda b, read=read: (list(hurt), [int(blobs.valid(read, h(bytes(b)))) for h in hurt.values()])
        done = blocks.served(blocks.in_blocks(frame, "idx", value, size), pack, {"damage": "array<string>", "ok": "array<bigint>"}, fn)
        rows = done.select(F.lit(kind).alias("kind"), "block", F.explode(F.arrays_zip("damage", "ok")).alias("x"))
        rows = rows.select("kind", "block", "x.damage", (F.col("x.ok") == 1).alias("valid"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{_BITS} SELECT pos AS start, pos + 100 AS stop, sum(bit) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)::BIGINT AS ones FROM b")
def bits_range_count(spark, sf_dir):
    index = bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")
    return bitvector.ones_between(index, index.select(F.col("pos").alias("start"), (F.col("pos") + 100).alias("stop")))


@query("SELECT item_id, length(text)::BIGINT AS n, true AS mtf, true AS huffman, true AS rans, true AS tans FROM benchmark")
def wide_symbols(spark, sf_dir):
    """Transforms and coders over code points, an alphabet of up to 16 bits."""

    def fn(block: bytes) -> tuple:
        symbols = [ord(c) for c in block.decode()]
        freqs = [0] * max(257, max(symbols, default=0) + 1)
        for s in symbols:
            freqs[s] += 1
        lengths = entropy_codes.huffman_lengths(freqs, 24)
        a = entropy_codes.huffman_decode(entropy_codes.huffman_encode(symbols, lengths), lengths, len(symbols))
        f, g = entropy_codes.quantise(freqs, 12), entropy_codes.quantise(freqs, 11)
        b = entropy_codes.rans_decode(entropy_codes.rans_encode(symbols, f, 12), f, len(symbols))
        c = entropy_codes.tans_decode(*entropy_codes.tans_encode(symbols, g, 11), g, 11, len(symbols))
        return len(symbols), transforms.symbols_from_front(transforms.symbols_to_front(symbols)) == symbols, a == symbols, b == symbols, c == symbols

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return transforms.map_blocks(rows, "text", {"n": "bigint", "mtf": "boolean", "huffman": "boolean", "rans": "boolean", "tans": "boolean"}, fn)


@query(f"{_ROT} SELECT n_nationkey, string_agg(rot[n:n], '' ORDER BY place) AS last_column, min(row) FILTER (i = 0) AS original_index, any_value(n_name) AS again FROM k JOIN nation USING (n_nationkey) GROUP BY n_nationkey")
def sql_functions(spark, sf_dir):
    sql_functions_of.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("sw_nation")
    return spark.sql("SELECT n_nationkey, decode(last, 'UTF-8') AS last_column, row AS original_index, decode(sw_bwt_inverse(sw_mtf_inverse(sw_mtf(last)), row), 'UTF-8') AS again FROM (SELECT n_nationkey, sw_bwt_last(encode(n_name, 'UTF-8')) AS last, sw_bwt_row(encode(n_name, 'UTF-8')) AS row FROM sw_nation)")


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS s FROM benchmark) SELECT count(*) AS strings, sum(strlen(s))::BIGINT AS bytes FROM w WHERE s <> ''")
def string_header(spark, sf_dir):
    return distinct_words(spark, sf_dir).agg(F.count("*").alias("strings"), F.sum(F.octet_length("s")).alias("bytes"))
