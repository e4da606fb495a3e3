"""All queries of the sequence operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.functions import bits, blobs, entropy_codes, fixed
from symweave.operators import bitvector, blocks, dictionary, ordered, pairs, stats, transforms, tree
from symweave.operators.sequence import top_code_points
from symweave.sources.tables import bfs_tree, distinct_words, order_bits, table
from symweave.streaming.entropy import windowed_counts, windowed_entropy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that DuckDB gives the same rows for."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_BYTES = "WITH l AS (SELECT doc_id, lang, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents), s AS (SELECT doc_id, lang, unnest(b) AS sym, unnest(range(1, len(b) + 1)) AS i FROM l)"
_GRAMS = _BYTES + ", g AS (SELECT lang, sym, lag(sym, 1) OVER w AS p1, lag(sym, 2) OVER w AS p2, lag(sym, 3) OVER w AS p3, lag(sym, 4) OVER w AS p4 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))"


def _h(cols: str, where: str) -> str:
    return f"SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, {cols}, count(*) AS n FROM g WHERE {where} GROUP BY ALL) GROUP BY lang"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.round("h", 6) + 0.0)


@query(f"{_GRAMS} SELECT lang, round(h, 6) AS h FROM ({_h('sym', 'true')})")
def entropy_h0_by_lang(spark, sf_dir):
    return _rounded(stats.entropy(table(spark, sf_dir, "documents"), "lang", "text", 0))


_H1 = "SELECT lang, sum(n * log2(c / n)) / sum(n) AS h FROM (SELECT lang, p1, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang, p1) AS c FROM g WHERE p1 IS NOT NULL GROUP BY lang, p1, sym) GROUP BY lang"


@query(f"{_GRAMS} SELECT lang, round(h, 6) AS h FROM ({_H1})")
def entropy_h1_by_lang(spark, sf_dir):
    return _rounded(stats.entropy(table(spark, sf_dir, "documents"), "lang", "text", 1))


@query(f"{_GRAMS} SELECT lang, round(a.h - b.h, 6) AS h FROM ({_h('p2, p1, sym', 'p2 IS NOT NULL')}) a JOIN ({_h('p1, sym', 'p1 IS NOT NULL')}) b USING (lang)")
def entropy_h2_by_lang(spark, sf_dir):
    return _rounded(stats.entropy(table(spark, sf_dir, "documents"), "lang", "text", 2))


@query(f"{_GRAMS} SELECT lang, round(a.h, 6) AS h0, round(b.h, 6) AS h1, t AS total_symbols, u AS unique_symbols, ceil(round(a.h * t / 8, 6))::BIGINT AS theoretical_min_bytes FROM ({_h('sym', 'true')}) a JOIN ({_H1}) b USING (lang) JOIN (SELECT lang, count(*) AS t, count(DISTINCT sym) AS u FROM g GROUP BY lang) USING (lang)")
def entropy_report(spark, sf_dir):
    out = stats.entropy_report(table(spark, sf_dir, "documents"), "lang", "text")
    return out.select("lang", F.round("h0", 6).alias("h0"), F.round("h1", 6).alias("h1"), "total_symbols", "unique_symbols", "theoretical_min_bytes")


@query("WITH l AS (SELECT regexp_extract_all(hex(encode(p_name)), '..') AS b FROM part), s AS (SELECT unnest(b) AS sym, unnest(range(0, len(b))) AS position FROM l) SELECT position, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS h FROM (SELECT position, sym, count(*) AS n FROM s GROUP BY ALL) GROUP BY position")
def entropy_per_position(spark, sf_dir):
    return _rounded(stats.per_position_entropy(table(spark, sf_dir, "part"), "p_name"))


def _context_sql(order: int) -> str:
    digits = [f"('0x' || p{k})::BIGINT * {256 ** (k - 1)}" for k in range(1, order + 1)]
    context = " + ".join(digits) or "0::BIGINT"
    where = f"p{order} IS NOT NULL" if order else "true"
    return f"{_GRAMS} SELECT *, freq * 65536 // total AS prob_raw FROM (SELECT lang, {context} AS context, ('0x' || sym)::BIGINT AS sym, count(*) AS freq, (sum(count(*)) OVER (PARTITION BY lang, context))::BIGINT AS total, coalesce(sum(count(*)) OVER (PARTITION BY lang, context ORDER BY ('0x' || sym)::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum_freq FROM g WHERE {where} GROUP BY lang, {context}, g.sym) "


def _register_contexts() -> None:
    for order in range(5):
        def run(spark, sf_dir, order=order):
            return stats.context_model(table(spark, sf_dir, "documents"), "lang", "text", order)

        QUERIES[f"context_model_{order}"] = run
        ORACLES[f"context_model_{order}"] = _context_sql(order).replace("PARTITION BY lang, context", f"PARTITION BY lang, {' + '.join(f'''('0x' || p{k})::BIGINT * {256 ** (k - 1)}''' for k in range(1, order + 1)) or '0'}")


_register_contexts()


@query("SELECT lang, greatest(1, length(bin(max(unicode(sym)))))::BIGINT AS bits FROM (SELECT lang, unnest(string_split(text, '')) AS sym FROM documents) GROUP BY lang")
def detect_symbol_bits(spark, sf_dir):
    return top_code_points(table(spark, sf_dir, "documents"), "lang", "text").groupBy("lang").agg(stats.symbol_bits(F.col("code")).alias("bits"))


_BITS = "WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (o_orderstatus = 'F')::INT AS bit FROM orders), r AS (SELECT pos, bit, coalesce(sum(bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM b)"


@query(f"{_BITS} SELECT pos, bit, rank1, pos - rank1 AS rank0 FROM r")
def bits_rank(spark, sf_dir):
    return bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")


@query(f"{_BITS} SELECT p.k * 7 AS probe, coalesce(rank1, (SELECT sum(bit) FROM b))::BIGINT AS rank1, coalesce(pos - rank1, (SELECT count(*) - sum(bit) FROM b))::BIGINT AS rank0 FROM range(0, 3000) p(k) LEFT JOIN r ON r.pos = p.k * 7")
def bits_rank_at(spark, sf_dir):
    index = bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")
    return bitvector.rank_at(index, spark.range(0, 21000, 7).toDF("probe"), "probe").select("probe", "rank1", "rank0")


@query(f"{_BITS} SELECT pos AS probe, rank1, pos - rank1 AS rank0 FROM r UNION ALL SELECT count(*), coalesce(sum(bit), 0)::BIGINT, (count(*) - coalesce(sum(bit), 0))::BIGINT FROM b")
def bits_rank_at_all(spark, sf_dir):
    index = bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")
    return bitvector.rank_at(index, spark.range(0, index.count() + 1).toDF("probe"), "probe").select("probe", "rank1", "rank0")


for _bit, _name in ((1, "bits_select1"), (0, "bits_select0")):
    def _select(spark, sf_dir, bit=_bit):
        index = bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")
        return bitvector.select_at(index, spark.range(0, 21000, 7).toDF("probe"), "probe", bit)

    QUERIES[_name] = _select
    ORACLES[_name] = f"{_BITS} SELECT p.k * 7 AS probe, coalesce(pos, (SELECT count(*) FROM b)) AS pos FROM range(0, 3000) p(k) LEFT JOIN (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i FROM b WHERE bit = {_bit}) ON i = p.k * 7"


for _bit, _name in ((1, "bits_select1_all"), (0, "bits_select0_all")):
    def _select_all(spark, sf_dir, bit=_bit):
        index = bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey")
        return bitvector.select_at(index, spark.range(0, index.where(F.col("bit") == bit).count() + 1).toDF("probe"), "probe", bit)

    QUERIES[_name] = _select_all
    ORACLES[_name] = f"{_BITS} SELECT row_number() OVER (ORDER BY pos) - 1 AS probe, pos FROM b WHERE bit = {_bit} UNION ALL SELECT count(*) FILTER (bit = {_bit}), count(*) FROM b"


@query(f"{_BITS} SELECT count(*) AS total_bits, sum(bit)::BIGINT AS total_ones FROM b")
def bits_totals(spark, sf_dir):
    return order_bits(spark, sf_dir).agg(F.count("*").alias("total_bits"), F.sum("bit").alias("total_ones"))


_WAVE = "WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_type AS sym FROM events), o AS (SELECT pos, sym, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS occ FROM s)"


def _events(spark, sf_dir):
    return bitvector.symbol_index(table(spark, sf_dir, "events"), "event_id", "event_type")


@query(f"{_WAVE} SELECT * FROM o")
def symbol_access(spark, sf_dir):
    return _events(spark, sf_dir)


@query(f"{_WAVE} SELECT p.sym, k * 13 AS \"at\", (SELECT count(*) FROM s WHERE s.sym = p.sym AND s.pos < k * 13) AS rank FROM (SELECT DISTINCT sym FROM s) p, range(0, 200) t(k)")
def symbol_rank(spark, sf_dir):
    index = _events(spark, sf_dir)
    symbols = index.select("sym").distinct()
    return bitvector.symbol_rank(index, symbols.select("sym", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2587).cast("long"), F.lit(13).cast("long"))).alias("at")))


@query(f"{_WAVE} SELECT p.sym, k * 11 AS i, coalesce(o.pos, (SELECT count(*) FROM s)) AS pos FROM (SELECT DISTINCT sym FROM s) p CROSS JOIN range(0, 200) t(k) LEFT JOIN o ON o.sym = p.sym AND o.occ = k * 11")
def symbol_select(spark, sf_dir):
    index = _events(spark, sf_dir)
    symbols = index.select("sym").distinct()
    return bitvector.symbol_select(index, symbols.select("sym", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2189).cast("long"), F.lit(11).cast("long"))).alias("i")))


@query(f"{_WAVE} SELECT p.sym, s.pos AS \"at\", count(*) FILTER (s.sym = p.sym) OVER (PARTITION BY p.sym ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank FROM s CROSS JOIN (SELECT DISTINCT sym FROM s) p UNION ALL SELECT sym, (SELECT count(*) FROM s), count(*) FROM s GROUP BY sym")
def symbol_rank_all(spark, sf_dir):
    index = _events(spark, sf_dir)
    places = spark.range(0, index.count() + 1).toDF("at")
    return bitvector.symbol_rank(index, places.crossJoin(F.broadcast(index.select("sym").distinct())).select("sym", "at"))


@query(f"{_WAVE} SELECT sym, occ AS i, pos FROM o UNION ALL SELECT sym, count(*), (SELECT count(*) FROM s) FROM s GROUP BY sym")
def symbol_select_all(spark, sf_dir):
    index = _events(spark, sf_dir)
    ends = index.groupBy("sym").agg(F.count("*").alias("i"))
    return bitvector.symbol_select(index, index.select("sym", F.col("occ").alias("i")).unionByName(ends))


@query("SELECT event_type AS sym, count(*) AS n FROM events GROUP BY ALL")
def symbol_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sym")).agg(F.count("*").alias("n"))


_SORTED = "WITH v AS (SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)"


@query(f"{_SORTED} SELECT idx, v FROM v")
def sorted_get(spark, sf_dir):
    return ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")


@query(f"{_SORTED}, p AS (SELECT DISTINCT l_partkey AS probe FROM lineitem) SELECT probe, (SELECT count(*) FROM v WHERE v < probe) AS successor, coalesce((SELECT nullif(count(*), 0) - 1 FROM v WHERE v <= probe), (SELECT count(*) FROM v)) AS predecessor FROM p")
def sorted_as_of(spark, sf_dir):
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    return ordered.as_of(index, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("probe")))


@query("SELECT DISTINCT l_partkey AS probe FROM lineitem WHERE l_partkey IN (SELECT o_orderkey FROM orders)")
def sorted_contains(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("probe")).distinct().join(values, "probe", "left_semi")


@query(f"{_SORTED}, u AS (SELECT (max(v) + 1) // count(*) AS q FROM v), w AS (SELECT CASE WHEN q <= 1 THEN 0 ELSE length(bin(q)) - 1 END AS w FROM u) SELECT idx, v, v & ((1::BIGINT << w) - 1) AS low, (v >> w) + idx AS high_pos FROM v, w")
def sorted_split(spark, sf_dir):
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    n, largest = index.agg(F.count("*"), F.coalesce(F.max("v"), F.lit(0))).first()
    return ordered.split_parts(index, ordered.low_bits(n, largest))


_DELTA = f"{_SORTED}, d AS (SELECT idx, v, idx // 64 AS block, first(v) OVER w AS anchor, v - lag(v) OVER w AS delta FROM v WINDOW w AS (PARTITION BY idx // 64 ORDER BY idx))"


@query(f"{_DELTA} SELECT * FROM d")
def delta_encode(spark, sf_dir):
    return ordered.deltas(ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey"))


@query(f"{_SORTED} SELECT idx, v FROM v")
def delta_decode(spark, sf_dir):
    return ordered.restored(ordered.deltas(ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")))


@query("SELECT o_orderkey AS v, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::BIGINT AS bytes, array_to_string(list_transform(range(0, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::BIGINT), lambda i: right('0' || hex(((o_orderkey >> (7 * i)::BIGINT) & 127) + CASE WHEN (o_orderkey >> (7 * i + 7)::BIGINT) > 0 THEN 128 ELSE 0 END), 2)), '') AS encoded FROM orders")
def leb128(spark, sf_dir):
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(v.alias("v"), ordered.leb128_length(v).alias("bytes"), ordered.leb128_hex(v).alias("encoded"))


_WORDS = "WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS s FROM benchmark), k AS (SELECT s FROM w WHERE s <> ''), p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS probe FROM part UNION SELECT 'th' UNION SELECT s FROM k WHERE length(s) < 5)"


def _probes(spark, sf_dir):
    words = distinct_words(spark, sf_dir)
    some = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("probe"))
    return some.unionByName(spark.createDataFrame([("th",)], "probe string")).unionByName(words.where("length(s) < 5").select(F.col("s").alias("probe"))).distinct()


@query(f"{_WORDS} SELECT probe, probe IN (SELECT s FROM k) AS found FROM p")
def dict_contains(spark, sf_dir):
    return dictionary.contains(distinct_words(spark, sf_dir), _probes(spark, sf_dir))


@query(f"{_WORDS} SELECT probe, probe = '' OR EXISTS (SELECT 1 FROM k WHERE starts_with(s, probe)) AS found FROM p")
def dict_prefix(spark, sf_dir):
    return dictionary.has_prefix(distinct_words(spark, sf_dir), _probes(spark, sf_dir))


@query(f"{_WORDS}, i AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS idx FROM k) SELECT probe, idx FROM p LEFT JOIN i ON s = probe")
def dict_find(spark, sf_dir):
    return dictionary.find(dictionary.string_index(distinct_words(spark, sf_dir), "s"), _probes(spark, sf_dir))


@query(f"{_WORDS}, h AS (SELECT hex(encode(s)) AS h FROM k), x AS (SELECT DISTINCT h[1:2 * n] AS q FROM (SELECT h, unnest(range(0, length(h) // 2 + 1)) AS n FROM h)) SELECT count(*) AS states, count(*) - 1 AS edges FROM x")
def dict_trie_counts(spark, sf_dir):
    return dictionary.trie_counts(distinct_words(spark, sf_dir))


@query()
def dict_minimal_counts(spark, sf_dir):
    return dictionary.minimal_counts(table(spark, sf_dir, "nation").select(F.col("n_name").alias("s")))


_FRONT = "WITH i AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS idx FROM (SELECT DISTINCT c_name AS s FROM customer)), b AS (SELECT *, idx // 16 AS bucket, coalesce(lag(s) OVER (PARTITION BY idx // 16 ORDER BY idx), '') AS prev FROM i), f AS (SELECT *, (SELECT coalesce(max(n), 0) FROM range(1, length(s) + 1) t(n) WHERE n <= length(prev) AND s[1:n] = prev[1:n])::BIGINT AS shared FROM b)"


@query(f"{_FRONT} SELECT idx, s, bucket, shared, s[shared + 1:] AS suffix FROM f")
def front_code(spark, sf_dir):
    return dictionary.front_coded(dictionary.string_index(table(spark, sf_dir, "customer"), "c_name"))


@query(f"{_FRONT} SELECT idx, s FROM i")
def front_decode(spark, sf_dir):
    return dictionary.front_restored(dictionary.front_coded(dictionary.string_index(table(spark, sf_dir, "customer"), "c_name")))


_TREE = "WITH RECURSIVE n AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS parent UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey) - 1, 0 FROM region UNION ALL SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_regionkey, n_nationkey), 1 + r FROM (SELECT n_regionkey, n_nationkey, (SELECT count(*) FROM region WHERE r_regionkey < n_regionkey) AS r FROM nation)), d AS (SELECT node, parent, (SELECT count(*) FROM n c WHERE c.parent = n.node) AS degree FROM n)"


@query(f"{_TREE} SELECT node, degree, (SELECT min(node) FROM n c WHERE c.parent = d.node) AS first_child, (SELECT max(node) FROM n c WHERE c.parent = d.node) AS last_child, degree = 0 AS is_leaf FROM d")
def tree_children(spark, sf_dir):
    return tree.tree_index(bfs_tree(spark, sf_dir))


@query(f"{_TREE} SELECT node, parent FROM n")
def tree_parent(spark, sf_dir):
    return tree.parents(tree.tree_index(bfs_tree(spark, sf_dir)))


@query(f"{_TREE} SELECT node, CASE WHEN parent IS NOT NULL THEN lead(node) OVER w END AS next_sibling, CASE WHEN parent IS NOT NULL THEN lag(node) OVER w END AS prev_sibling FROM n WINDOW w AS (PARTITION BY parent ORDER BY node)")
def tree_siblings(spark, sf_dir):
    return tree.siblings(tree.tree_index(bfs_tree(spark, sf_dir)))


@query(f"{_TREE}, u AS (SELECT node, node AS above, parent AS up FROM n UNION ALL SELECT u.node, u.up, n.parent FROM u JOIN n ON n.node = u.up) SELECT node, (SELECT count(*) - 1 FROM u x WHERE x.node = n.node) AS depth, (SELECT count(*) FROM u x WHERE x.above = n.node) AS subtree_size FROM n")
def tree_depth_and_size(spark, sf_dir):
    depth, size = tree.depth_and_size(tree.parents(tree.tree_index(bfs_tree(spark, sf_dir))))
    return depth.join(size, "node")


@query("WITH r AS (SELECT CAST(l_quantity * 65536 AS BIGINT) AS a, CAST(l_discount * 65536 AS BIGINT) AS b, l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, a * b >> 16 AS product, CASE WHEN b <> 0 THEN a * 65536 // b END AS quotient, (((a + b * 1000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS wrapped, CASE WHEN a + b * 1000000 BETWEEN -2147483648 AND 2147483647 THEN a + b * 1000000 END AS checked, a >> 16 AS whole, a & 65535 AS part, b / 65536.0 AS as_float FROM r")
def fixed_point(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "cast(rint(l_quantity * 65536) as bigint) as a", "cast(rint(l_discount * 65536) as bigint) as b")
    a, b = F.col("a"), F.col("b")
    return rows.select("l_orderkey", "l_linenumber", fixed.mul(a, b).alias("product"), fixed.div("a", "b").alias("quotient"), fixed.add(a, b * 1000000).alias("wrapped"), fixed.checked(a + b * 1000000).alias("checked"), fixed.to_int(a).alias("whole"), fixed.fraction(a).alias("part"), fixed.to_float(b).alias("as_float"))


_ROT = "WITH t AS (SELECT n_nationkey, n_name AS s, length(n_name) AS n FROM nation), r AS (SELECT n_nationkey, n, i, (s || s)[i + 1:i + n] AS rot FROM t, range(0, 30) x(i) WHERE i < n), k AS (SELECT *, rank() OVER (PARTITION BY n_nationkey ORDER BY rot, 0) - 1 AS row, row_number() OVER (PARTITION BY n_nationkey ORDER BY rot, i) AS place FROM r)"


@query(f"{_ROT} SELECT n_nationkey, string_agg(rot[n:n], '' ORDER BY place) AS last_column, min(row) FILTER (i = 0) AS original_index FROM k GROUP BY n_nationkey")
def bwt_forward(spark, sf_dir):
    def fn(block: bytes) -> tuple:
        last, row = transforms.sort_rotations(block)
        return last.decode("latin-1"), row

    return transforms.map_blocks(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", {"last_column": "string", "original_index": "bigint"}, fn)


@query("SELECT item_id, text FROM benchmark")
def bwt_mtf_round_trip(spark, sf_dir):
    def fn(block: bytes) -> tuple:
        last, row = transforms.sort_rotations(block)
        return (transforms.unsort_rotations(transforms.move_from_front(transforms.move_to_front(last)), row).decode(),)

    return transforms.map_blocks(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("body")), "body", {"text": "string"}, fn)


@query("WITH s AS (SELECT n_nationkey AS id, unnest(range(1, length(n_name) + 1)) AS i, n_name FROM nation), x AS (SELECT id, i, ascii(n_name[i:i]) AS sym FROM s), j AS (SELECT *, lag(i) OVER (PARTITION BY id, sym ORDER BY i) AS j FROM x) SELECT id::BIGINT AS id, i AS pos, (CASE WHEN j IS NOT NULL THEN (SELECT count(DISTINCT k.sym) FROM x k WHERE k.id = j.id AND k.i > j.j AND k.i < j.i) ELSE sym + (SELECT count(DISTINCT k.sym) FROM x k WHERE k.id = j.id AND k.i < j.i AND k.sym > j.sym) END)::BIGINT AS place FROM j")
def mtf_forward(spark, sf_dir):
    rows = transforms.map_blocks(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name"), "n_name", {"places": "binary"}, lambda b: (transforms.move_to_front(b),))
    each = F.posexplode(F.regexp_extract_all(F.hex("places"), F.lit("(..)"))).alias("pos", "h")
    return rows.select("id", each).select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.conv("h", 16, 10).cast("long").alias("place"))


@query("SELECT item_id, sha256(text) AS text_sha256, true AS huffman, true AS rans, true AS tans FROM benchmark")
def coder_round_trips(spark, sf_dir):
    def fn(block: bytes) -> tuple:
        counts = [block.count(bytes([s])) for s in range(256)]
        lengths = entropy_codes.huffman_lengths(counts)
        a = entropy_codes.huffman_decode(entropy_codes.huffman_encode(block, lengths), lengths, len(block))
        f = entropy_codes.quantise(counts, 12)
        b = entropy_codes.rans_decode(entropy_codes.rans_encode(block, f, 12), f, len(block))
        g = entropy_codes.quantise(counts, 10)
        c = entropy_codes.tans_decode(*entropy_codes.tans_encode(block, g, 10), g, 10, len(block))
        return a == block, b == block, c == block

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("text_sha256"), "text")
    return transforms.map_blocks(rows, "text", {"huffman": "boolean", "rans": "boolean", "tans": "boolean"}, fn)


@query("WITH c AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS sym, count(*) AS freq FROM events GROUP BY event_type), q AS (SELECT sym, freq, greatest(1, (freq * 4096 + (SELECT sum(freq) FROM c) // 2) // (SELECT sum(freq) FROM c)) AS q FROM c) SELECT sym, freq, (q + CASE WHEN sym = (SELECT sym FROM c ORDER BY freq DESC, sym LIMIT 1) THEN greatest(0, 4096 - (SELECT sum(q) FROM q)) ELSE 0 END - CASE WHEN sym = (SELECT sym FROM q ORDER BY q DESC, sym LIMIT 1) THEN greatest(0, (SELECT sum(q) FROM q) - 4096) ELSE 0 END)::BIGINT AS quantised FROM q")
def ans_quantise(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("freq"))
    coded = counts.select((F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long").alias("sym"), "freq")
    return stats.quantised_frequencies(coded, 12)


@query("WITH l AS (SELECT regexp_extract_all(hex(encode(text)), '..') AS b FROM benchmark), s AS (SELECT b[i] AS l, b[i + 1] AS r FROM l, range(1, 2000) t(i) WHERE i < len(b)) SELECT ('0x' || l)::BIGINT AS l, ('0x' || r)::BIGINT AS r, 256::BIGINT AS token FROM s GROUP BY ALL ORDER BY count(*) DESC, 1, 2 LIMIT 1")
def merge_first(spark, sf_dir):
    return spark.createDataFrame(pairs.learn_merges(table(spark, sf_dir, "benchmark"), "text", 1), "l bigint, r bigint, token bigint")


@query()
def merge_table(spark, sf_dir):
    return spark.createDataFrame(pairs.learn_merges(table(spark, sf_dir, "benchmark"), "text", 8), "l bigint, r bigint, token bigint")


@query("SELECT start, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS h FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY start")
def windowed_event_entropy(spark, sf_dir):
    return _rounded(windowed_entropy(windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")))


@query("SELECT n_nationkey, printf('%06X', n_nationkey * 262144 + n_regionkey * 16384 + length(n_name) * 4) AS encoded, n_nationkey::BIGINT AS f6, n_regionkey::BIGINT AS f4, length(n_name)::BIGINT AS f12 FROM nation")
def bits_packed(spark, sf_dir):
    fields = bits.packed([(F.col("n_nationkey"), 6), (F.col("n_regionkey"), 4), (F.length("n_name"), 12)])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fields.alias("b"))
    return rows.select("n_nationkey", F.hex("b").alias("encoded"), *(bits.field(F.col("b"), at, n).alias(f"f{n}") for at, n in ((0, 6), (6, 4), (10, 12))))


def _vector_size(n: str) -> str:
    return f"(12 + ceil({n} / 8.0) + 4 * ceil({n} / 256.0) + ceil({n} / 64.0))"


@query(f"{_BITS} SELECT pos // 4096 AS block, count(*) AS n_bits, sum(bit)::BIGINT AS ones, {_vector_size('count(*)')}::BIGINT AS bytes, true AS valid, coalesce(max(pos % 4096) FILTER (bit = 1), -1)::BIGINT AS last_one FROM b GROUP BY block")
def blob_bit_vector(spark, sf_dir):
    def fn(blob: bytes) -> tuple:
        n = int.from_bytes(blob[:4], "little")
        ones = blobs.rank_in(blob, n)
        return n, ones, len(blob), blobs.select_in(blob, ones - 1) if ones else -1

    each = blocks.in_blocks(bitvector.bit_index(order_bits(spark, sf_dir), "o_orderkey"), "pos", "bit", 4096)
    return blocks.served(each, blobs.pack_bit_vector, {"n_bits": "bigint", "ones": "bigint", "bytes": "bigint", "last_one": "bigint"}, fn, blobs.read_bit_vector)


_RUNS = f"{_SORTED}, g AS (SELECT idx // 1024 AS block, count(*) AS n, max(v) AS m, sum(v)::BIGINT AS total FROM v GROUP BY block), w AS (SELECT *, CASE WHEN (m + 1) // n <= 1 THEN 0 ELSE length(bin((m + 1) // n)) - 1 END AS l FROM g)"


@query(f"{_RUNS} SELECT block, total, (13 + ceil(n * l / 8.0) + {_vector_size('(n + (m >> l) + 1)')})::BIGINT AS bytes, true AS valid FROM w")
def blob_sorted(spark, sf_dir):
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    each = blocks.in_blocks(index, "idx", "v", 1024)
    return blocks.served(each, blobs.pack_sorted, {"total": "bigint", "bytes": "bigint"}, lambda b: (int(blobs.read_sorted(b).sum()), len(b)), blobs.read_sorted)


@query(f"{_DELTA} SELECT idx // 1024 AS block, sum(v)::BIGINT AS total, (6 + 12 * count(DISTINCT block) + coalesce(sum(greatest(1, ceil(length(bin(delta)) / 7.0))) FILTER (delta IS NOT NULL), 0))::BIGINT AS bytes, true AS valid FROM d GROUP BY 1")
def blob_deltas(spark, sf_dir):
    index = ordered.sorted_index(table(spark, sf_dir, "orders"), "o_orderkey")
    each = blocks.in_blocks(index, "idx", "v", 1024)
    return blocks.served(each, blobs.pack_deltas, {"total": "bigint", "bytes": "bigint"}, lambda b: (sum(blobs.read_deltas(b)), len(b)), blobs.read_deltas)


@query(f"{_FRONT} SELECT idx, s, true AS valid FROM i")
def blob_strings(spark, sf_dir):
    index = dictionary.string_index(table(spark, sf_dir, "customer"), "c_name")
    each = blocks.in_blocks(index, "idx", "s", 256)
    back = blocks.served(each, lambda items: blobs.pack_strings([s.encode() for s in items]), {"strings": "array<string>"}, lambda b: ([s.decode() for s in blobs.read_strings(b)],), blobs.read_strings)
    return back.select("block", "valid", F.posexplode("strings").alias("i", "s")).select((F.col("block") * 256 + F.col("i")).alias("idx"), "s", "valid")


@query(f"{_WAVE} SELECT pos, length(sym)::BIGINT AS sym, true AS valid FROM s")
def blob_symbols(spark, sf_dir):
    index = _events(spark, sf_dir).select("pos", F.length("sym").alias("n"))
    each = blocks.in_blocks(index, "pos", "n", 4096)
    back = blocks.served(each, blobs.pack_symbols, {"symbols": "array<bigint>"}, lambda b: (blobs.read_symbols(b).tolist(),), blobs.read_symbols)
    return back.select("block", "valid", F.posexplode("symbols").alias("i", "sym")).select((F.col("block") * 4096 + F.col("i")).alias("pos"), "sym", "valid")


@query(f"{_TREE} SELECT node, degree, true AS valid, (SELECT 4 + {_vector_size('(2 * count(*) + 1)')} FROM d)::BIGINT AS bytes FROM d")
def blob_tree(spark, sf_dir):
    nodes = bfs_tree(spark, sf_dir)  # one tree is one blob, whatever its size
    each = blocks.in_blocks(nodes, "node", "degree", max(1, nodes.count()))
    back = blocks.served(each, blobs.pack_tree, {"degrees": "array<bigint>", "bytes": "bigint"}, lambda b: (blobs.read_tree(b).tolist(), len(b)), blobs.read_tree)
    return back.select("valid", "bytes", F.posexplode("degrees").alias("node", "degree")).select(F.col("node").cast("long").alias("node"), "degree", "valid", "bytes")


@query("WITH w AS (SELECT DISTINCT n_name AS s FROM nation), p AS (SELECT DISTINCT s[1:k] AS probe FROM w, range(1, 30) t(k) WHERE k <= length(s)) SELECT probe, probe IN (SELECT s FROM w) AS plain, probe IN (SELECT s FROM w) AS compact FROM p")
def blob_automaton(spark, sf_dir):
    def fn(items: list[str]) -> tuple:
        words = sorted(s.encode() for s in items)
        found = blobs.automaton(words)
        plain, compact = (blobs.read_automaton(blobs.pack_automaton(found, kind), kind) for kind in (False, True))
        probes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)})
        return [p.decode() for p in probes], *([int(blobs.accepts(s, p)) for p in probes] for s in (plain, compact))

    by_lead = table(spark, sf_dir, "nation").groupBy(F.substring("n_name", 1, 1).alias("lead")).agg(F.collect_set("n_name").alias("items"))
    done = transforms.map_blocks(by_lead, "items", {"probe": "array<string>", "plain": "array<bigint>", "compact": "array<bigint>"}, fn)
    rows = done.select(F.explode(F.arrays_zip("probe", "plain", "compact")).alias("x"))
    return rows.select("x.probe", (F.col("x.plain") == 1).alias("plain"), (F.col("x.compact") == 1).alias("compact"))


@query("SELECT item_id, true AS lengths, true AS rans, true AS tans, true AS rotations FROM benchmark")
def blob_coders(spark, sf_dir):
    def fn(block: bytes) -> tuple:
        counts = [block.count(bytes([s])) for s in range(256)]
        lengths = entropy_codes.huffman_lengths(counts)
        ranged = blobs.read_rans(blobs.pack_rans(block, entropy_codes.quantise(counts, 12)), len(block))
        tabled = blobs.read_tans(blobs.pack_tans(block, entropy_codes.quantise(counts, 10)), len(block))
        turned = transforms.unsort_rotations(*blobs.read_rotations(blobs.pack_rotations(*transforms.sort_rotations(block))))
        return blobs.read_lengths(blobs.pack_lengths(lengths)) == lengths, ranged == block, tabled == block, turned == block

    return transforms.map_blocks(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", {k: "boolean" for k in ("lengths", "rans", "tans", "rotations")}, fn)


@query("SELECT item_id, text, true AS shorter FROM benchmark")
def merge_round_trip(spark, sf_dir):
    learned = pairs.learn_merges(table(spark, sf_dir, "benchmark"), "text", 6)
    merges = [(left, right, 256 + i) for i, (left, right) in enumerate(blobs.read_merges(blobs.pack_merges([m[:2] for m in learned])))]

    def fn(block: bytes) -> tuple:
        tokens = pairs.apply_merges(block, merges)
        return pairs.expand_tokens(tokens, merges).decode(), len(tokens) < len(block)

    return transforms.map_blocks(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("body")), "body", {"text": "string", "shorter": "boolean"}, fn)


@query("SELECT count(*) AS n, length(bin(max(length(event_type))))::BIGINT AS depth, max(length(event_type)) + 1 AS sigma, count(DISTINCT event_type) AS alphabet FROM events")
def symbol_header(spark, sf_dir):
    n = F.length("event_type").cast("long")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.length(F.bin(F.max(n)))).cast("long").alias("depth"), (F.max(n) + 1).alias("sigma"), F.count_distinct("event_type").alias("alphabet"))


@query("SELECT count(*) AS n, max(o_orderkey) + 1 AS universe FROM orders")
def sorted_header(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("o_orderkey").alias("n"), (F.max("o_orderkey") + 1).alias("universe"))


@query("SELECT o_orderkey AS v, bit_count(o_orderkey)::BIGINT AS ones, CASE WHEN o_orderkey < 1 THEN 0 ELSE length(bin(o_orderkey)) - 1 END::BIGINT AS log2_floor FROM orders")
def bit_counts(spark, sf_dir):
    v = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(v.alias("v"), F.bit_count(v).cast("long").alias("ones"), F.when(v < 1, 0).otherwise(F.length(F.bin(v)) - 1).cast("long").alias("log2_floor"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(l_quantity * 4294967296 AS HUGEINT) AS a, CAST(l_discount * 100 AS HUGEINT) * 42949673 - 214748365 AS b FROM lineitem), p AS (SELECT *, a * b AS p FROM r) SELECT l_orderkey, l_linenumber, ((p - ((p % 4294967296 + 4294967296) % 4294967296)) // 4294967296)::BIGINT AS product, (a * 4294967296 // nullif(b, 0))::BIGINT AS quotient, ((a * 40000000 + b + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS wrapped FROM p")
def fixed_point_wide(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "cast(rint(l_quantity * 4294967296) as bigint) as a", "cast(rint(l_discount * 100) as bigint) * 42949673 - 214748365 as b")
    return rows.select("l_orderkey", "l_linenumber", fixed.wide_mul("a", "b").alias("product"), fixed.wide_div("a", "b").alias("quotient"), fixed.wide_add("a * 40000000", "b").alias("wrapped"))
