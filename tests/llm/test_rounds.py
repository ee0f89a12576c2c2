"""What the driver holds of a run: few jobs for small link tables, parts of the counted strings.  What executors start: few files."""

from contextlib import contextmanager
from pathlib import Path

import numpy as np
from tessera.llm import common, graph, simhash, toxicity
from tests.llm.test_operators import _components


def _found(spark, links, **options):
    return {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(8), **options).collect()}


def test_small_tables_need_no_rounds(spark):
    """A chain's links lie in one part, so nothing is left for rounds of joins, whose jobs and tasks the driver keeps books on."""
    spark.sparkContext.setJobGroup("chain", "")
    try:
        found = _found(spark, [(i, i + 1) for i in range(2000)])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == dict.fromkeys(range(2001), 0) and len(jobs) <= 12


def test_rounds_join_what_parts_leave(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = _found(spark, links, chunk=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = _components({(a, b) for a, b in links if a != b}, {x for a, b in links if a != b for x in (a, b)})
    assert found == whole


def test_no_links(spark):
    assert _found(spark, []) == {} and _found(spark, [(3, 3)]) == {}


def test_strings_are_counted_in_parts():
    """No part's table holds more than about its share; all parts together are the whole count."""
    rng = np.random.default_rng(5)
    rows = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(40)]
    tables = [toxicity._frequencies(rows, 5, p) for p in range(toxicity.PARTS)]
    codes = np.concatenate([np.unique(toxicity._codes(r, 5)) for r in rows])
    want, n = np.unique(codes, return_counts=True)
    got = np.concatenate([t[0] for t in tables])
    order = np.argsort(got)
    assert np.array_equal(got[order], want) and np.array_equal(np.concatenate([t[1] for t in tables])[order], n)
    assert max(len(t[0]) for t in tables) < 1.3 * len(want) / toxicity.PARTS


@contextmanager
def _apart(spark, n):
    """Shuffles make n parts, which stay apart."""
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(spark):
    return {str(x) for x in Path(common.shared_dir(spark).removeprefix("file:")).glob("tessera-*/part-*")}


def test_links_in_many_parts_need_no_rounds(spark):
    """Parts that stay apart contract little each: what they leave fits one task."""
    before = _files(spark)
    spark.sparkContext.setJobGroup("apart", "")
    try:
        with _apart(spark, 40):
            found = _found(spark, [(i, i + 1) for i in range(2000)])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("apart")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == dict.fromkeys(range(2001), 0) and len(jobs) <= 12 and len(_files(spark) - before) <= 41


def test_small_tables_lie_in_few_files(spark):
    """Each file costs its executor processes: small tables of op 5 have no file for each part of a shuffle."""
    docs = spark.createDataFrame([(i, f"{'a b c d e f g h i j' if i % 3 else 'k l m n o'} {i}") for i in range(300)], "doc_id long, text string").repartition(2)
    want = {tuple(r) for r in simhash.simhash_components(docs).collect()}
    before = _files(spark)
    with _apart(spark, 40):
        out = simhash.simhash_components(docs)
        assert out.rdd.getNumPartitions() == 1 and {tuple(r) for r in out.collect()} == want
    assert len({r[0] for r in want}) == 300 and len(_files(spark) - before) <= 10
