"""The rows of every stage of the pipeline against plain loops, over documents with nulls, repeats and clashing columns."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_brute_force import plain_redacted, plain_spans  # noqa: E402
from test_small_fixtures import shingle_set  # noqa: E402

from symweave.llm import quality  # noqa: E402
from symweave.llm.queries import GOOD  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with rows and columns that a real table may have."""
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(31)
    rows = docs.orderBy("doc_id").collect()
    good = [r for r in rows if r.text and len(r.text) > 400][:40]
    near = [(9000 + i, r.text + " one more", r.lang, r.source, len(r.text) + 9) for i, r in enumerate(good[:12])]
    words = good[20].text.split()
    for i, at in enumerate(range(0, min(len(words), 400), 7)):
        near.append((9100 + i, " ".join(words[:at] + ["other"] + words[at + 1 :]), "en", "s", 1))
    weak = "".join(rng.choice("abcXYZ0123456789qwRT") for _ in range(24))
    near += [(9300 + i, f"{r.text} user = bob, {weak}{i} password={weak}", r.lang, r.source, 5) for i, r in enumerate(good[12:18])]
    more = [(None, None, None, None, None), (7000, None, "en", "s", None), (7001, "", "en", "s", 0), (None, good[3].text + " x", "en", "s", 1), *[tuple(r) for r in good[5:8]]]
    whole = docs.unionByName(spark.createDataFrame(near + more, docs.schema))
    whole = whole.withColumns({"score": F.lit("mine"), "_d": F.lit(1), "_h": F.lit(2), "_spans": F.lit(3), "ids": F.lit("x"), "decoded": F.lit(4), "component": F.lit(5), "_text_hash": F.lit(6)})
    whole.write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def loop_score(net, body):
    padded = np.frombuffer(body + bytes(quality.SPAN), np.uint8)
    sums = sum(net.tables[k][padded[k : k + len(body)]] for k in range(quality.SPAN))
    blocks = (len(body) + quality.SPAN - 1) // quality.BLOCK + 1
    active = []
    for c in range(max(1, -(-(blocks - quality.CHUNK) // quality.STEP) + 1)):
        inside = sums[c * quality.STEP * quality.BLOCK : min(blocks, c * quality.STEP + quality.CHUNK) * quality.BLOCK]
        active.append(np.maximum((inside.max(axis=0) if len(inside) else np.full(quality.FILTERS, -1e9)) + net.bias, 0))
    hidden = np.maximum(np.hstack([np.mean(active, axis=0), np.max(active, axis=0)]) @ net.w1 + net.b1, 0)
    return 1 / (1 + math.exp(-float(np.clip(hidden @ net.w2 + net.b2, -30, 30)[0])))


def test_every_stage(spark, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = docs.collect()
    net = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = stages["quality"](spark, docs, sf_dir)
    kept = out.collect()
    scores = [(loop_score(net, (r.text or "").encode()), r) for r in given]
    assert all(abs(s - GOOD) > 1e-4 for s, _ in scores)
    assert sorted(map(str, kept)) == sorted(str(r) for s, r in scores if s >= GOOD) and 0 < len(kept) < len(given)
    assert out.columns == docs.columns and {r.score for r in kept} == {"mine"}

    # from here on with every document, so that nulls, empties and copies are there whatever the classifier says
    out = stages["near_dedup"](spark, docs, sf_dir)
    kept = out.collect()
    rows = sorted({(r.doc_id, r.text) for r in given}, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    sets = [shingle_set(t) for _, t in rows]
    of: dict[int, int] = {}

    def root(i):
        while of.get(i, i) != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    wanted = [rows[i] for i in range(len(rows)) if root(i) == i]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(wanted, key=str) and len(wanted) < len(rows) - 50
    assert out.columns == docs.columns and {(r.score, r._d, r._h, r.component) for r in kept} == {("mine", 1, 2, 5)}

    out = stages["decontamination"](spark, docs, sf_dir)
    runs = lambda t: (lambda w: {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower()))
    items = [runs(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r for r in given if not any(i and len(i & runs(r.text)) >= 0.8 * len(i) for i in items)]
    assert sorted(map(str, out.collect())) == sorted(map(str, clean)) and len(clean) < len(given)

    out = stages["secrets"](spark, docs, sf_dir)
    wanted = []
    for r in given:
        text = None if r.text is None else plain_redacted(r.text, plain_spans(r.text))
        wanted.append(str({**r.asDict(), "text": text, "n_chars": r.n_chars if text is None else len(text)}))
    assert sorted(str(r.asDict()) for r in out.collect()) == sorted(wanted) and sum("[secret]" in w for w in wanted) > 5

    ranks = {k: v for k, v in ((__import__("base64").b64decode(a), int(b)) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stages["bpe"](spark, docs, sf_dir).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert sorted(str((r.doc_id, r.ids)) for r in out) == sorted(str((r.doc_id, library.encode_ordinary(r.text or ""))) for r in given)


def test_stages_follow_each_other(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole, step = corpus_pipeline.run(spark, sf_dir).collect(), docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir)
    assert sorted(map(str, step.collect())) == sorted(map(str, whole)) and 0 < len(whole) < docs.count()
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and (name == "bpe" or none.columns == docs.columns)
