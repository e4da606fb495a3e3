"""Secret scans: plain credentials by pattern, and weak candidates by linking the parts of a credential."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import pieces, release, small_enough, stored, text_batches, unused

KINDS = ("assign", "access", "hex", "linked")
BASE = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),  # a run is found whole, as by [0-9a-f]+ with shorter ones dropped
}
#: Parts that are weak evidence alone: who asks, with what, and where.
IDENTIFIER = re.compile(r"""(?ai)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})|\b(?:AKIA|ASIA)[A-Z0-9]{12,}""")
ENDPOINT = re.compile(r"""(?ai)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?)""")
SECRET = re.compile(r"(?a)(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-])")  # runs of any length, each read once
#: What comes before the host of a URL that holds a user or a password: these are no part of the endpoint.
USERINFO = re.compile(r"(?ai)[a-z][a-z0-9+.-]{1,15}://(?:[^\s/?#@]*|[^\s/?#@:]+:(?!\d+/)[^\s?#@]+)@")
#: Code points within which parts belong to one scope.
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found = [(m.start(), m.end(), 0) for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in BASE["access"].finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in BASE["hex"].finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def looks_random(value: str) -> bool:
    """Mixed character classes and an entropy of 3.5 bits a character: a weak candidate for a secret."""
    classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
    n = len(value)
    return classes == 3 and -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.5


def weak_parts(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, part) of identifiers, endpoints and weak secrets outside the spans already taken."""
    secrets, at, reached = [], 0, 0
    for m in SECRET.finditer(text):  # both lists ascend: reached is how far the spans that begin before m's end go
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][1])
            at += 1
        if reached <= m.start() and looks_random(m.group()):
            secrets.append(m.span())
    if not secrets:
        return []
    out = [(a, b, "secret") for a, b in secrets]
    out += [(*m.span(), "identifier") for m in IDENTIFIER.finditer(text)]
    for m in ENDPOINT.finditer(text):
        user = USERINFO.match(text, m.start(), m.end())
        out.append((user.end() if user else m.start(), m.end(), "endpoint"))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    part = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
    for batch in (part for whole in batches for part in pieces(whole)):
        base, weak = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            base.append([{"start": a, "stop": b, "kind": k} for a, b, k in spans])
            weak.append([{"start": a, "stop": b, "kind": k} for a, b, k in weak_parts(text or "", spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(base, part), pa.array(weak, part)], ["doc_id", "text_hash", "base", "weak"])


def linked_secrets(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak secrets with a complementary part within scope that doesn't overlap them: the key columns, start, stop.

    parts: key columns, start, stop, kind. An interval join: each part falls in the bucket of its position, a secret
    looks into its own bucket and both neighbours, and the gap is then tested. Buckets hold one scope of one text, so
    neither long texts nor texts with many parts gather anywhere.
    """
    keys = [c for c in parts.columns if c not in ("start", "stop", "kind")]
    first, last = F.floor((F.col("start") - scope) / scope), F.floor((F.col("stop") + scope) / scope)
    secrets = parts.where("kind = 'secret'").withColumn("_bucket", F.explode(F.sequence(first, last)))
    others = parts.where("kind <> 'secret'").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope))).alias("_other"))
    same = F.col("_bucket") == F.col("_other")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    apart = (F.col("_stop") <= F.col("start")) | (F.col("_start") >= F.col("stop"))
    near = (F.col("_start") <= F.col("stop") + scope) & (F.col("_stop") >= F.col("start") - scope)
    return secrets.join(others, same & near & apart, "left_semi").select(*keys, "start", "stop").distinct()


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs: doc_id, text_hash, spans (array of start, stop, kind by start, then kind as listed).

    Base spans are always there; spans of kind linked are weak secrets with an identifier or endpoint in scope that
    doesn't overlap them. Null and empty texts have no spans. Rows are told apart by doc_id and text, so repeated rows
    have equal results and nothing is shared between different texts of one id. Whole texts are read, however long.
    Spans that begin together are ordered by kind. An empty table gives no rows; other columns of docs, whatever their
    names, have no part.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    span = "array<struct<start:bigint,stop:bigint,kind:string>>"
    found = stored(rows.mapInArrow(_scan, f"doc_id bigint, text_hash bigint, base {span}, weak {span}"))
    parts = found.where("size(weak) > 0").select("doc_id", "text_hash", F.explode("weak").alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    linked = linked_secrets(parts, scope)
    more = linked.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_list(F.struct("start", "stop", F.lit("linked").alias("kind"))).alias("more"))
    out = found.join(more, F.expr("doc_id <=> _d and text_hash = _h"), "left")
    place = F.create_map(*(x for k, v in enumerate(KINDS) for x in (F.lit(v), F.lit(k))))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.transform(F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s.start, F.element_at(place, s.kind), s.stop, s.kind).cast("struct<start:bigint,place:int,stop:bigint,kind:string>"))), lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), s.kind.alias("kind"))))
    return out.select("doc_id", "text_hash", spans.alias("spans"))


def _mask(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in pieces(whole)):
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
            if spans:
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if s["stop"] > at:
                        out += [text[at : s["start"]], "[secret]"] if s["start"] >= at else []
                        at = s["stop"]
                text = "".join([*out, text[at:]])
            texts.append(text)
        names = [n for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def redact_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with "[secret]" in place of each span (overlapping ones together); n_chars, if there, is counted anew.

    Every row and column stays: null and empty texts as they are, repeated rows each, columns of any name.
    """
    d, h, spans = (unused(name, docs) for name in ("_d", "_h", "_spans"))
    found = scan_secrets(docs, scope).where("size(spans) > 0")
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("spans").alias(spans)).dropDuplicates([d, h])
    found = small_enough(stored(found), 200_000)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    out = joined.select(*(docs[c] for c in docs.columns), spans).mapInArrow(lambda batches: _mask(batches, spans), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
