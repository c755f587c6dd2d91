"""The pipeline's stages, each against a plain definition of what it keeps."""

import math
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusloom.llm import mixing, sharding, toxicity  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_contracts import AWKWARD, SF  # noqa: E402

BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of awkward rows: nulls, empties, repeats, a long text, clashing columns."""
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [(t, s) for _, t, s in AWKWARD] + [(BENCH[0][1] + " and some more words here", "q"), ("you utter blockhead go away", "q"), ("you utter b l o c k h e a d go away now", "q")]
    rows = [(None if i == 2 else i, t, None, s, -1, "clash", 7) for i, (t, s) in enumerate(texts)]
    rows += [rows[5]] * 3 + [(6, "other text with this id", "en", "q", 0, None, None)] + [(100 + i, "ga lu me ti so far away blockhead" if i % 3 == 0 else f"ga lu me ti so far away {'la' * (i % 17)} {i}", "en", "r", 0, "x", 1) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, None, None), (100, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(rows):
    return Counter(tuple(map(str, r)) for r in rows)


def check_stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{path}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, path)
        docs = docs.cache()
        after = docs.collect()
        if name != "shards":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(spark.createDataFrame(before, docs.schema), labels)
            bad = model.score([r["text"] for r in before]) >= 0.5
            assert plain(after) == plain(r for r, x in zip(before, bad) if not x)
        if name == "near_copies":
            roots = brute.components([(i, brute.fingerprint(r["text"])) for i, r in enumerate(before)])
            groups = defaultdict(list)
            for r, root in zip(before, roots):
                groups[root].append(r)
            assert len(groups) == len(after)
            for own in groups.values():
                ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
                assert [r["doc_id"] for r in after if r in own] == [min(ids, default=None)]
        if name == "benchmark":
            assert plain(after) == plain(r for r in before if not brute.contamination(r["text"], items)[-1])
        if name == "mixture":
            sizes, taken = defaultdict(int), Counter()
            for r in before:
                sizes[r["source"]] += len(brute.SPACE_WORDS.findall(r["text"] or ""))
            want = brute.mix_targets(sizes)
            for r, n in plain(after).items():
                taken[r] = n
            for r, n in plain(before).items():
                source = next(x["source"] for x in before if tuple(map(str, x)) == r)
                rate = want[source] / sizes[source] if sizes[source] else 0.0
                assert n * math.floor(rate) <= taken[r] <= n * math.ceil(rate)
            assert not taken.keys() - plain(before).keys()
        if name == "shards":
            assert plain(r[: len(columns)] for r in after) == plain(before)
    return docs


def test_stages_on_awkward_rows(spark, folder):
    out = check_stages(spark, folder)
    assert out.columns[-2:] == ["shard", "slot"]
    slots = defaultdict(list)
    for r in out.collect():
        slots[r[-2]].append(r[-1])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(0 <= s < 40 for s in slots)


def test_stages_on_the_smallest_table(spark):
    check_stages(spark, SF)


def test_toxic_rows_go_and_clean_ones_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    assert "you utter blockhead go away" not in kept and None in kept and "" in kept
    assert sum(t is not None and t.startswith("ga lu") for t in kept) >= 90


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert mixing.plan_mix(docs.select("doc_id", "text", "source")).count() == sharding.shard_rows(docs.select("doc_id", "text")).count() == 0
