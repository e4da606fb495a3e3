"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per Python worker."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from symweave.llm.common import held, text_batches

#: Distinct words whose ids a worker remembers, twice at most (this and the last generation): memory against time only.
REMEMBERED = 500_000
#: Bytes of words that one recursive query encodes, and tokens that one query decodes.
AT_ONCE, DECODED_AT_ONCE = 200_000, 100_000
#: Bytes that one row of words has at most; longer words are cut and joined again where the cut is no token boundary.
PIECE = 48
#: Rows and text bytes that are encoded and given out at once.
ROWS_OUT, BYTES_OUT = 1024, 4_000_000

#: Token-position rows (with the place and token that follow) join the merge table; each word's leftmost pair of minimum
#: rank is contracted until no row joins. best packs rank, place and the place after it in one number, so that its
#: minimum is that pair; gone is the second row of it, whose successor the first one takes over.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT w, pos, tok, next_pos, next_tok, false AS done FROM token_rows
    UNION ALL
    SELECT s.w, s.pos, CASE WHEN s.pos = g.at THEN g.merged ELSE s.tok END, CASE WHEN s.pos = g.at THEN g.next_pos ELSE s.next_pos END,
        CASE WHEN s.pos = g.at THEN g.next_tok WHEN s.next_pos = g.at THEN g.merged ELSE s.next_tok END, g.w IS NULL
    FROM state s LEFT JOIN (
        SELECT gone.w, best.packed >> 40 AS merged, (best.packed >> 20) & 1048575 AS at, gone.pos AS gone_pos, gone.next_pos, gone.next_tok
        FROM (
            SELECT p.w, min((m.merged << 40) | (p.pos::BIGINT << 20) | p.next_pos) AS packed
            FROM state p JOIN merges m ON m.pair = p.tok * 4294967296 + p.next_tok WHERE NOT p.done GROUP BY p.w
        ) best JOIN state gone ON gone.w = best.w AND gone.pos = (best.packed & 1048575)
    ) g ON g.w = s.w
    WHERE NOT s.done AND (g.w IS NULL OR s.pos <> g.gone_pos)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY w ORDER BY w
"""
#: The same for joined pieces, which may be long runs: where the merged token is in no pair of a smaller rank ("lone"),
#: nothing can come between the occurrences of that rank, so all of them that don't overlap, from the left, are
#: contracted in one round. tests/llm holds both queries against each other on the same words.
ENCODE_RUNS = """
WITH RECURSIVE state AS (
    SELECT w, pos, tok, false AS done FROM token_rows
    UNION ALL
    SELECT w, pos, tok, done FROM (
        SELECT w, pos, hit, least_rank IS NULL AS done, CASE WHEN hit THEN merged ELSE tok END AS tok,
            lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (
            SELECT *, CASE WHEN merged IS NULL OR merged <> least_rank THEN false
                WHEN lone THEN (nth - run_start) % 2 = 0 ELSE pos = first_pos END AS hit
            FROM (
                SELECT *, min(pos) FILTER (merged = least_rank) OVER (PARTITION BY w) AS first_pos,
                    max(CASE WHEN merged IS NOT DISTINCT FROM least_rank THEN NULL ELSE nth END) OVER (PARTITION BY w ORDER BY pos) + 1 AS run_start0,
                    coalesce(run_start0, 1) AS run_start
                FROM (
                    SELECT p.w, p.pos, p.tok, p.nth, m.merged, m.lone, min(m.merged) OVER (PARTITION BY p.w) AS least_rank
                    FROM (
                        SELECT w, pos, tok, lead(tok) OVER word AS next_tok, row_number() OVER word AS nth
                        FROM state WHERE NOT done WINDOW word AS (PARTITION BY w ORDER BY pos)
                    ) p LEFT JOIN merges m ON m.pair = p.tok * 4294967296 + p.next_tok
                )
            )
        )
    ) WHERE NOT gone
)
SELECT w, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY w ORDER BY w
"""
#: Ordered aggregation of the tokens' bytes (as the characters of these numbers, which join like text) over runs of ids.
DECODE = "SELECT string_agg(v.piece, '' ORDER BY t.pos) AS body FROM token_rows t JOIN vocabulary v ON v.tok = t.tok"


def parsed_ranks(body: bytes) -> list[tuple[bytes, int]]:
    """The (token bytes, rank) pairs in the content of a tiktoken file."""
    return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in body.splitlines() if line.strip())]


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """The (token bytes, rank) pairs of a tiktoken file, read on the driver; the vocabulary bounds their number."""
    with open(path, "rb") as file:
        return parsed_ranks(file.read())


class Codec:
    """A vocabulary in DuckDB tables (merges, vocabulary) and the words encoded so far."""

    def __init__(self, pairs: list[tuple[bytes, int]], pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.rank = dict(pairs)
        self.pattern = regex.compile(pattern)
        self.single = np.full(256, -1, np.int32)
        for token, r in pairs:
            if len(token) == 1:
                self.single[token[0]] = r
        left, right, merged = [], [], []
        for token, r in pairs:
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(r)
        self.spelled = {r: token for token, r in pairs}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "allocator_flush_threshold": "4MB"})  # nothing goes to a local disk; free memory goes back
        self.db.register("given", pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT l * 4294967296 + r AS pair, merged, coalesce(least >= merged, true) AS lone FROM given LEFT JOIN (SELECT tok, min(m) AS least FROM (SELECT l AS tok, merged AS m FROM given UNION ALL SELECT r, merged FROM given) GROUP BY tok) ON tok = merged")
        self.db.unregister("given")
        self.db.register("words", pa.table({"tok": pa.array([r for _, r in pairs], pa.int32()), "piece": [t.decode("latin-1") for t, _ in pairs]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.db.unregister("words")
        self.sizes = np.full(max((r for _, r in pairs), default=-1) + 1, -1, np.int32)
        self.sizes[[r for _, r in pairs]] = [len(t) for t, _ in pairs]
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _rows(self, query: str, **columns: np.ndarray) -> pa.Table:
        self.db.register("token_rows", pa.table({k: v.astype(np.int32) for k, v in columns.items()}))
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister("token_rows")
        return out

    def encode_words(self, words: list[bytes], query: str = ENCODE) -> list[np.ndarray]:
        """The ids of each word, by merges alone, of one query over all of them."""
        if not words:
            return []
        n = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (tok < 0).any():
            raise ValueError("words that ids can't be decoded to: the vocabulary lacks a single byte")
        start = np.cumsum(n) - n
        pos = np.arange(len(tok)) - np.repeat(start, n)
        follows = np.append(tok[1:], -1)
        follows[start + n - 1] = -1
        table = self._rows(query, w=np.repeat(np.arange(len(words)), n), pos=pos, tok=tok, next_pos=pos + 1, next_tok=follows)
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return np.split(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))[:-1])

    def _in_turns(self, words: list[bytes], query: str = ENCODE) -> list[np.ndarray]:
        """encode_words() by queries of a bounded size."""
        group = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)] if words else []
        return [x for at, stop in zip(cuts, cuts[1:]) for x in self.encode_words(words[at:stop], query)]

    def encode_long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, of any length: of pieces first, then of what adjoining pieces make together.

        Ids one after another are those of their bytes if and only if each two neighbours by themselves are the ids of
        their bytes, for the first contraction across a boundary would happen among the two as well. So a cut between
        pieces stands if the ids on its sides stay as they are together; else both pieces are joined and encoded anew.
        """
        parts = [[word[i : i + PIECE] for i in range(0, len(word), PIECE)] for word in words]
        flat = iter(self._in_turns([p for each in parts for p in each]))
        ids = [[next(flat) for _ in each] for each in parts]
        stays: dict[tuple[int, int], bool] = {}
        while True:
            met = {(int(a[-1]), int(b[0])) for each in ids for a, b in zip(each, each[1:])}
            unseen = sorted(met.difference(stays))
            for pair, found in zip(unseen, self._in_turns([self.spelled[a] + self.spelled[b] for a, b in unseen])):
                stays[pair] = found.tolist() == list(pair)
            again: list[tuple[int, int]] = []
            for k, each in enumerate(ids):
                i, kept, bodies = 0, [], []
                while i < len(each):
                    joins = i + 1 < len(each) and not stays[int(each[i][-1]), int(each[i + 1][0])]
                    if joins:
                        again.append((k, len(kept)))
                    kept.append(each[i])
                    bodies.append(b"".join(parts[k][i : i + 1 + joins]))
                    i += 1 + joins
                ids[k], parts[k] = kept, bodies
            if not again:
                return [np.concatenate(each) for each in ids]
            for (k, i), found in zip(again, self._in_turns([parts[k][i] for k, i in again], ENCODE_RUNS)):
                ids[k][i] = found

    def decode(self, tok: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; ends as from encode_words. Unknown ids raise ValueError.

        The ids are decoded in parts of a fixed size, whatever the runs, and the bytes cut by the sizes of the tokens.
        """
        if len(tok) and (tok.min() < 0 or tok.max() >= len(self.sizes) or self.sizes[tok].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        body = []
        for at in range(0, len(tok), DECODED_AT_ONCE):
            part = tok[at : at + DECODED_AT_ONCE]
            body.append(self._rows(DECODE, pos=np.arange(len(part)), tok=part).column("body")[0].as_py().encode("latin-1"))
        whole = b"".join(body)
        cuts = np.concatenate([[0], np.cumsum(self.sizes[tok], dtype=np.int64)])[ends].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: set[str]) -> None:
        """Encodes new words in bounded queries."""
        if len(self.ids) > self.remembered:
            self.old, self.ids = self.ids, {}
        unseen = words.difference(self.ids)
        for word in unseen.intersection(self.old):
            self.ids[word] = self.old[word]
        names, bodies = [], []
        for word in unseen.difference(self.old):
            body = word.encode()
            rank = self.rank.get(body)
            if rank is None:
                names.append(word), bodies.append(body)
            else:  # a word that is a token stays whole, which the tokeniser's rule puts before merges
                self.ids[word] = np.int32(rank).tobytes()
        short = [i for i, body in enumerate(bodies) if len(body) <= PIECE]
        long = [i for i, body in enumerate(bodies) if len(body) > PIECE]
        for places, found in ((short, self._in_turns([bodies[i] for i in short])), (long, self.encode_long([bodies[i] for i in long]))):
            self.ids.update((names[i], ids.tobytes()) for i, ids in zip(places, found, strict=True))

    def texts(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Of each text, the ids (int32 bytes), those of its words in order, and the bytes that these ids decode to."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        ids = [b"".join(map(self.ids.__getitem__, s)) for s in split]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return ids, self.decode(np.frombuffer(b"".join(ids), np.int32), ends)


def _cuts(sizes: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        stop, total = at, 0
        while stop < len(sizes) and stop - at < rows and (stop == at or total + sizes[stop] <= most):
            total += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", remembered: int = REMEMBERED, part_bytes: int = BYTES_OUT) -> DataFrame:
    """docs without the text column, with ids (array<int>) and decoded (binary, the bytes that the ids decode to).

    Encodes whole texts, however long, each match of pattern by itself and without special tokens. Text that pattern
    leaves out is not encoded. ranks is the path of a tiktoken file, read on the driver. Distinct words are encoded once
    per worker and remembered up to a bound: those that are a token by lookup, all others by recursive queries, words of
    any length by pieces (encode_long). A text's ids are those of its words in order; its bytes come from these ids, of
    each row, by ordered aggregation in parts of a fixed size. Nothing is shuffled. Parts of part_bytes of text are
    encoded and given out at once.

    Null and empty texts have no ids and decode to no bytes. Repeated rows each give a row; nulls in other columns and
    the order of rows have no part in it, so there are no ties. An empty table gives no rows. Columns of docs that are
    called ids or decoded are replaced; all others stay.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    with open(ranks, "rb") as file:
        body = file.read()  # as it is in the file, which takes less of a worker's memory than the pairs
    shared = docs.sparkSession.sparkContext.broadcast(body)
    key = ("bpe", hashlib.sha256(body).digest(), pattern, remembered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or held(key, lambda: Codec(parsed_ranks(shared.value), pattern, remembered))
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            for at, stop in _cuts(sizes, ROWS_OUT, part_bytes):
                part = batch.slice(at, stop - at)
                ids, decoded = codec.texts(part.column(text).to_pylist())
                names = [n for n in batch.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), _lists(ids), pa.array(decoded, pa.binary())], [*names, "ids", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, ", ".join(x for x in (fields, "ids array<int>, decoded binary") if x))


def decode_ids(df: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), from a column of ids alone; null gives empty, unknown or null ids raise ValueError.

    A column of df that is called decoded is replaced. Repeated rows each give a row; an empty table gives none.
    """
    df = df.drop("decoded")
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(df.sparkSession, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value, r"\X")
            lists = [x or [] for x in batch.column(ids).to_pylist()]
            for at, stop in _cuts([len(x) for x in lists], 4096, DECODED_AT_ONCE):
                part = lists[at:stop]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
                body = codec.decode(np.array([-1 if i is None else i for x in part for i in x], np.int32), ends)
                cut = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(body, pa.binary())], [*cut.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, decoded binary")
