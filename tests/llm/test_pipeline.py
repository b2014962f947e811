"""The pipeline's stages, each on its own input, against plain versions, with repeated
rows, null ids, null and empty texts, other columns and empty tables."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import _brute_words
from tramline.llm import jaccard, language, quality
from tramline.llm.queries import tokenizer_path
from tramline.llm.shared import materialize
from tramline.llm.units import library_tokenizer

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest documents, and rows that repeat them, share ids or have none."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own = [tuple(x) for x in docs.orderBy("doc_id").collect()]
    junk = next(x for x in own if x[1] and len(x[1]) > 300)
    text = own[3][1]
    rows = own + [own[3], own[3], own[5]]
    rows += [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None), (None, junk[1], "en", "s", 1), (900001, "", "en", "s", 0), (900002, None, "en", "s", 0), (900003, "123 !!", "en", "s", 6), (900004, "слово дело речь", "en", "s", 15)]
    return materialize(spark.createDataFrame(rows, docs.schema).withColumn("c0", F.lit("other")).repartition(5), "documents")


def test_columns_named_like_the_stages_own(spark, documents):
    """Other columns stay as they are, whatever their names."""
    names = ["removed_words", "removed", "found", "_foundfoundfound", "c0", "c1", "h", "n"]
    docs = documents.drop("c0").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in list(STAGES.items())[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns
        rows = got.where("doc_id is not null").select("doc_id", *names).collect()
        assert rows and all(x[n] == f"{n}{x['doc_id']}" for x in rows for n in names), name


def _rows(df):
    return collections.Counter(tuple(x) for x in df.collect())


def test_names():
    assert list(STAGES) == ["language_id", "quality_classifier", "line_dedup", "jaccard_join", "best_fit_packing"]


def test_empty_tables(spark, documents):
    for name, stage in STAGES.items():
        got = stage(spark, documents.limit(0), FOLDER)
        assert got.count() == 0
        assert name == "best_fit_packing" or got.columns == documents.columns


def test_language_stage(spark, documents):
    model = language.train(documents)
    labeller = language._Labeller(model)
    want = collections.Counter()
    for row, n in _rows(documents).items():
        lang, score, _ = labeller.predict([row[1] or ""], False)[0]
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            want[row] += n
    got = _rows(STAGES["language_id"](spark, documents, FOLDER))
    assert got == want
    texts = {row[1] for row in got}
    assert not texts & {None, "", "123 !!", "слово дело речь"} and len(texts) > 150


def test_quality_stage(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(documents, labels)
    rows = list(_rows(documents).items())
    weights = {}
    for row, _ in rows:
        buckets = quality._features(next(iter(quality._units().texts([row[1] or ""]))))
        weights[row] = quality.log_weight(float(model.ratio[buckets].sum()), len(buckets))
    keys = {row: weights[row] + quality.gumbel(7, -(1 << 63) if row[0] is None else row[0], row[1] or "") for row, _ in rows}
    k = sum(n for row, n in rows if weights[row] >= model.boundary)
    cut = sorted((keys[row] for row, n in rows for _ in range(n)), reverse=True)[k - 1]
    want = collections.Counter({row: n for row, n in rows if keys[row] >= cut})
    assert math.isfinite(model.boundary) and 0 < k < sum(n for _, n in rows)
    assert _rows(STAGES["quality_classifier"](spark, documents, FOLDER)) == want


def _components(rows):
    """Component number of every row, None without words."""
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for row in rows:
        words = (row[1] or "").translate(fold).split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [x if s else None for x, s in zip(label, sets)]


def test_jaccard_stage(spark, documents):
    rows = sorted(_rows(documents).elements(), key=str)
    groups = collections.defaultdict(list)
    for row, c in zip(rows, _components(rows)):
        if c is not None:
            groups[c].append(row)
    alone = [row for row, c in zip(rows, _components(rows)) if c is None]
    got = list(_rows(STAGES["jaccard_join"](spark, documents, FOLDER)).elements())
    assert len(got) == len(groups) + len(alone)
    left = collections.Counter(got)
    for members in groups.values():
        ids = [x[0] for x in members if x[0] is not None]
        least = [x for x in members if x[0] == (min(ids) if ids else None)]
        assert sum(min(left[x], 1) for x in set(least)) == 1 and sum(left[x] for x in set(members)) == 1
    assert all(left[x] for x in alone)
    assert jaccard.keep_one_of_each(documents.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_line_stage(spark, documents):
    rows = sorted((x for x in _rows(documents.where("doc_id < 900000")) if x[0] is not None), key=lambda x: x[0])
    docs = materialize(spark.createDataFrame(rows, documents.schema).repartition(3), "documents")
    got = {x["doc_id"]: x for x in STAGES["line_dedup"](spark, docs, FOLDER).collect()}
    want = _brute_words([x[1] or "" for x in rows], 50)
    right = 0
    for row, words in zip(rows, want):
        if row[0] not in got:
            assert not words  # nothing of it is left
            right += 1
            continue
        x = got[row[0]]
        right += (x["text"] or "").split() == words
        assert (x["n_chars"] == len(x["text"])) if x["text"] != row[1] else x["n_chars"] == row[4]
    assert right >= 0.98 * len(rows)


def test_packing_stage(spark, documents):
    tok = library_tokenizer(tokenizer_path("word_bpe_49k.json"))
    got = _rows(STAGES["best_fit_packing"](spark, documents, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32"))
    want = collections.Counter()
    for row, n in _rows(documents).items():
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want[(row[0], k, at, len(part), zlib.crc32(part.tobytes()))] += n
    assert got == want


def test_whole_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER), name)
    got = corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset")
    again = STAGES["best_fit_packing"](spark, docs, FOLDER).drop("sequence_id", "offset")
    assert _rows(got) == _rows(again) and got.count() > 100
