import corpus_pipeline
from tessera.llm import leaks, registry


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert 0.6 * docs.count() < new.count() <= docs.count(), name
        docs = new
    clean = spark.read.parquet(str(tmp_path / "decontamination"))
    assert leaks.find_leaks(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert docs.where("taken > 3 * size").count() == 0


def test_stages_take_odd_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= docs.count()
        assert stage(spark, empty, sf).count() == 0


def test_names():
    names = list(registry.queries())
    assert names[-1] == "pipeline" and [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark):
    """Planted cases, stage by stage, against plain code."""
    import numpy as np

    from tessera.llm import mixing, pii
    from tests.llm.test_operators import _base, _changed, _components, _edits, near_pairs

    rng = np.random.default_rng(12)
    word = lambda: f"{chr(97 + rng.integers(26))}{rng.integers(10**6)}x"
    texts = []
    for i in range(40):
        w = [word() for _ in range(int(rng.integers(60, 300)))]
        texts.append(w)
        if i % 4 == 0:  # a part added, cut or moved, or some words changed
            texts.append([w + w[: len(w) // 8], w[: -(len(w) // 9)], w[len(w) // 2 :] + w[: len(w) // 2], _changed(rng, w, 3, word)][i // 4 % 4])
    passage = " ".join(word() for _ in range(30))
    lines = [" ".join(w) for w in texts]
    lines += [f"{lines[1]} {passage} tail", lines[2] + " " + passage.replace("x ", " x ", 2), "", None, "call (212) 555-0147 or a@b.org", "server 10.1.2.3 and card 4111 1111 1111 1111"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")

    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    group = _components(near_pairs(lines), range(len(lines)))
    assert set(kept) == set(group.values()) and all(kept[i] == lines[i] for i in kept)

    clean = {r["doc_id"] for r in leaks.drop_leaky(docs, bench).collect()}
    p = leaks.squeezed(passage)
    most = min(int(len(p) * leaks.EDITS), len(p) // leaks.Q - 1)
    assert clean == {i for i, t in enumerate(lines) if not t or _edits(p, leaks.squeezed(t)) > most} and len(clean) == len(lines) - 2

    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.private(spark, docs, "").collect()}
    for i, t in enumerate(lines):
        assert (masked[i] is None) == (t is None) and not _base(masked[i] or "") and (bool(_base(t or "")) <= ("[" in (masked[i] or "")))
        if t and not pii._spans([t], pii.trained())[1][0]:
            assert masked[i] == t
    assert masked[len(lines) - 2] == "call [PHONE] or [EMAIL]"

    mix = corpus_pipeline.mixed(spark, docs, "").collect()
    sizes: dict[str, int] = {}
    for _, t, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((t or "").split())
    want = mixing.targets(sorted(sizes.items()))
    for source, n in want.items():
        assert abs(sum(r["taken"] for r in mix if r["source"] == source) - n) <= 0.02 * n + 1
