"""Language ID: Bayesian fusion of text, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import small_enough, stored
from symweave.llm.url_filter import url_host

#: Labelled texts of each language that a model is fitted on, in the mean; languages with fewer give all.
SAMPLE = 400
#: Size of the table that byte trigrams are hashed into.
TABLE = 1 << 16
#: A text counts as so many independent trigrams at most: neighbouring ones say much the same.
EVIDENCE = 60.0
#: Weight, in pages, of the level above when counts are smoothed.
STRENGTH = 5.0

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")


@dataclass
class TextModel:
    """languages by name; log likelihood of each trigram bucket by language."""

    languages: list[str]
    table: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, digits and white space folded."""
    b = np.frombuffer(re.sub(r"[\s\d]+", " ", text).lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(2654435761) ^ b[1:-1] * np.uint32(40503) * np.uint32(257) ^ b[2:] * np.uint32(2246822519)) >> np.uint32(7)) % np.uint32(TABLE)


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): about sample different texts of each language, or all if there are fewer, chosen by hash.

    A text is taken if the hash of its id and content is below sample shares of its language's rows: no order, and so no
    language's rows in one place. Repeated rows count once.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "text", "doc_id")
    counts = small_enough(stored(rows.groupBy("lang").agg(F.count("*").alias("_n"))), 100_000)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = rows.join(counts, "lang").where(chance * F.col("_n") < sample)
    return chosen.dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text")


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            sums.setdefault(lang, np.zeros(TABLE, np.int64))
            sums[lang] += np.bincount(trigrams(text), minlength=TABLE)
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1), pa.string()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([0, *counts[used].tolist()], pa.int64())], ["lang", "bucket", "n"])


def train_language(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """A text model from docs (doc_id, text, lang): trigram counts of whole texts, of about sample texts of each language.

    Rows with nulls are left out, empty texts count nothing; without rows the model knows no language. Texts are read
    where they are: only the counts, at most TABLE of a language, come to the driver. Other columns have no part.
    """
    counted = training_texts(docs, sample).mapInArrow(_trigram_counts, "lang string, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    counts = np.full((len(languages), TABLE), 0.02)
    seen = rows[rows["bucket"] >= 0]
    counts[seen["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64), seen["bucket"].to_numpy(np.int64)] += seen["n"].to_numpy(np.float64)
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(pages: DataFrame, model: TextModel, html: str | None = "html", text: str | None = None) -> DataFrame:
    """pages without the body column (html, or text), with declared (language code in the markup or "") and evidence (log
    likelihood by language). Columns of pages that are called declared or evidence are replaced; all others stay."""
    pages = pages.drop("declared", "evidence")
    shared = pages.sparkSession.sparkContext.broadcast(model)
    column = html or text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            declared, evidence = [], []
            for body in batch.column(column).to_pylist():
                body = body or ""
                if html:
                    found = _LANG.search(body)
                    declared.append(found[1].lower() if found else "")
                    body = _DROP.sub(" ", body)
                else:
                    declared.append("")
                t = trigrams(body)
                total = known.table[:, t].sum(axis=1, dtype=np.float64) if len(t) else np.zeros(len(known.languages))
                evidence.append(total * min(1.0, EVIDENCE / max(len(t), 1)))
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(declared, pa.string()), pa.array(evidence, pa.list_(pa.float64()))], [*names, "declared", "evidence"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name != column)
    return pages.mapInArrow(run, f"{fields}declared string, evidence array<double>")


def _posterior(logs: Column) -> Column:
    """Probabilities from unnormalised logs."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    whole = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / whole)


def _sums(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Of each key, the summed text posteriors by language: partial sums come first, whatever the number of pages."""
    found = rows.groupBy(key).agg(*(F.sum(F.col("posterior")[i]).alias(f"s{i}") for i in range(size)))
    return found.select(F.col(key).alias(f"_{key}"), F.array(*(F.round(f"s{i}", 6) for i in range(size))).alias(f"{key}_sum"))


def identify_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Per page: page_id, url, declared, lang, probability.

    pages: page_id, url, html. The log posterior adds up the text's likelihood, that of the declared language and of
    the address suffix (last label of the host) given the language, and the host's prior. Grouped aggregates of the
    text posteriors estimate these; the prior of a host is smoothed towards that of its domain (last two labels), that
    towards all pages', each page's own share taken out. Ties go to the first language by name. Null or empty html and
    null urls are no evidence; html is read whole, however long. Without a trained language, lang is null. Repeated rows
    are pages of their own, and count in the priors as such. An empty table gives no rows; other columns of pages,
    whatever their names, have no part.
    """
    names, size = model.languages, len(model.languages)
    if not size:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    rows = text_evidence(pages.select("page_id", "url", "html"), model)
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    rows = stored(rows.withColumn("posterior", _posterior(F.col("evidence"))))
    whole = rows.agg(*(F.coalesce(F.sum(F.col("posterior")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(size))).first()
    count = sum(whole)
    share = [(whole[i] + 1) / (count + size) for i in range(size)]
    out = rows
    for key in ("host", "domain", "suffix", "declared"):
        out = out.join(small_enough(stored(_sums(rows, key, size)), 200_000), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")

    def log_prior(i: int) -> Column:
        own = F.col("posterior")[i]
        less = lambda key: F.greatest(F.col(f"{key}_sum")[i] - own, F.lit(0.0))
        pages_of = lambda key: F.greatest(F.aggregate(f"{key}_sum", F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))
        domain = (less("domain") + STRENGTH * share[i]) / (pages_of("domain") + STRENGTH)
        return F.log((less("host") + STRENGTH * domain) / (pages_of("host") + STRENGTH))

    def log_given(key: str, i: int) -> Column:
        """Of what is seen at key, given the language; no evidence where nothing is."""
        of_language = F.greatest(F.col(f"{key}_sum")[i] - F.col("posterior")[i], F.lit(0.0))
        overall = F.aggregate(f"{key}_sum", F.lit(0.0), lambda a, x: a + x) / max(count, 1.0)
        return F.when(F.col(key) == "", 0.0).otherwise(F.log((of_language + STRENGTH * overall) / (max(whole[i], 0.0) + STRENGTH)))

    logs = F.array(*(F.col("evidence")[i] + log_prior(i) + log_given("suffix", i) + log_given("declared", i) for i in range(size)))
    out = out.withColumn("p", _posterior(logs)).withColumn("probability", F.array_max("p"))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.col("probability")).cast("int"))
    return out.select("page_id", "url", "declared", best.alias("lang"), F.round("probability", 6).alias("probability"))
