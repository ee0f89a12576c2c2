"""Each operator against brute force on a small table with odd rows, and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from tessera.llm import graph, leaks, mixing, pii, quality, simhash, suffix, tokens, toxicity, urls, versions

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def got(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def labels(spark, rows):
    toxic = lambda t: int("idiot" in (t or "") or "moron" in (t or ""))
    data = [(i, int(len(t or "") > 30), toxic(t)) for i, t, *_ in rows] + [(None, 1, 1), (3, None, None), (999_999, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, labels, empty, rows):
    out = got(toxicity.score_toxicity(docs, labels))
    assert set(out) == {r[0] for r in rows}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = got(toxicity.score_toxicity(docs, labels.limit(0)))
    assert {r["score"] for r in none.values()} == {0.0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_toxicity_held_out(spark):
    """Held-out figures over all rows, and by language (58 English, 18 French, 15 German and 6 Spanish toxic rows; the Spanish ones aren't found)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [(r["predicted"], y[r["doc_id"]], lang[r["doc_id"]]) for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in y]
    share = lambda want, rows: sum(p == t for p, t, _ in rows if t == want) / sum(t == want for _, t, _ in rows)
    assert share(0, held) >= 0.98 and share(1, held) >= 0.75, (share(0, held), share(1, held))
    for code, ordinary, toxic in (("en", 0.99, 0.8), ("de", 0.97, 0.7), ("fr", 0.9, 0.8), ("es", 0.97, 0.0)):
        own = [x for x in held if x[2] == code]
        assert share(0, own) >= ordinary and share(1, own) >= toxic, (code, share(0, own), share(1, own))


def test_toxicity_lengths():
    """Window lengths are those that zstandard gives for one window alone."""
    import numpy as np
    import zstandard

    rows = [(f"plain words about the {w} and the weather of the day", 0) for w in ("sea", "sky", "sun", "tree", "road", "rain")] * 20
    rows += [(f"plain words about the {w} you worthless idiot of the day", 1) for w in ("sea", "sky", "sun", "tree")] * 20
    model = toxicity.learn(rows, {0: 120, 1: 80})
    texts = [toxicity.folded(t) for t, _ in rows[::7]] + [b"x", b"worthless idiot " * 3]
    size = np.array([min(len(t), toxicity.WINDOW) for t in texts])
    start = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    got = model.known.lengths(np.frombuffer(b"".join(texts), np.uint8), start, size)
    for content, lengths in zip(model.known.content, got, strict=True):
        p = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, min_match=5, target_length=16, search_log=4, chain_log=15, hash_log=15, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        assert [len(c.compress(model.known.lead + t[:n])) for t, n in zip(texts, size, strict=True)] == lengths.tolist()
    assert (got[0] - got[1])[-1] > 0
    assert [p >= 0.5 for p in model.scores(["so the worthless idiot came", "a plain day by the sea"])] == [True, False]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "plain text a@b.cd"), ("b", None), ("a", "plain text a@b.cd"), (None, "")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 0, 1), ("b", 1, 0)], "doc_id string, toxic int, quality int")
    for out in (toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels), pii.find_pii(docs), leaks.find_leaks(docs, spark.createDataFrame([("i", "plain text a@b.cd")], "item_id string, text string"))):
        assert {r["doc_id"] for r in out.collect()} <= {"a", "b", None} and out.count() in (2, 4)


def test_quality(spark, docs, labels, empty, rows):
    out = got(quality.score_quality(docs, labels))
    assert set(out) == {r[0] for r in rows}
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 1 and r["keep"] == (r["tail_probability"] >= 0.5) for r in out.values())
    assert quality.score_quality(empty, labels).count() == 0
    m = quality.learn([("low low text", 0), ("mid mid text", 1), ("high high text", 2)] * 20, {0: 20, 1: 20, 2: 20})
    tails = m.tails(m.scores(["low low text", "mid mid text", "high high text"]))
    assert (m.cuts[1:] > m.cuts[:-1]).all() and tails[0, 0] < 0.5 < tails[1, 0] and tails[1, 1] < 0.5 < tails[2, 1]


def test_quality_optimum():
    """The fitted cuts and the scale of the weights are where a plain search over them ends too."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12, p=p)), y) for y, p in enumerate(([0.55, 0.15, 0.15, 0.15], [0.25, 0.25, 0.25, 0.25], [0.15, 0.15, 0.15, 0.55])) for _ in range(60)]
    m = quality.learn(rows, {0: 60, 1: 60, 2: 60})
    s, y = m.scores([t for t, _ in rows]), np.array([v for _, v in rows])

    def loss(scale, first, step):
        p = 1 / (1 + np.exp(-(scale * s[:, None] - np.array([first, first + step]))))
        wide = np.concatenate((np.ones((len(y), 1)), p, np.zeros((len(y), 1))), axis=1)
        at = np.arange(len(y))
        return -np.log(np.maximum(wide[at, y] - wide[at, y + 1], 1e-9)).mean()

    found = loss(1.0, m.cuts[0], m.cuts[1] - m.cuts[0])
    best = min(loss(a, m.cuts[0] + b, (m.cuts[1] - m.cuts[0]) * c) for a in (0.9, 1, 1.1) for b in (-0.2, -0.05, 0, 0.05, 0.2) for c in (0.9, 1, 1.1))
    assert found < 0.8 * np.log(3) and found - best < 0.01


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["keep"], y[r["doc_id"]]) for r in quality.score_quality(docs, labels).collect() if r["held_out"] and r["doc_id"] in y]
    assert sum(k for k, v in held if v) >= 0.95 * sum(v for _, v in held)
    assert sum(k for k, v in held if not v) <= 0.3 * sum(not v for _, v in held)


def test_token_counts(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = got(tokens.token_counts(docs, path))
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert tokens.token_counts(empty, path).count() == 0
    other = public_tokenizers.path("word_bpe_49k.json")  # a tokenizer of another kind goes through the library
    library = Tokenizer.from_file(other)
    out = got(tokens.token_counts(docs, other))
    assert all(out[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    import sentencepiece

    pieces = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    out = got(tokens.token_counts(docs, pieces))
    assert all(out[i]["n_tokens"] == len(library.encode(t or "")) for i, t, *_ in rows)


def test_leaks(spark, docs, empty, rows):
    items = [(1, "The quick brown fox, jumps over the lazy dog and then it runs away home."), (2, None), (3, "..."), (4, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, "so the quick brown fox jumped over the lazy dog and then it runs away home ok"), (2, "the quick brown fox went home"), (3, "a TINY-thing"), (4, None), (5, items[0][1])]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.find_leaks(more, bench).collect()}
    assert found == {(1, 1): 2, (5, 1): 0, (3, 4): 0}
    assert [r["doc_id"] for r in leaks.drop_leaky(more, bench).orderBy("doc_id").collect()] == [2, 4]
    assert leaks.drop_leaky(docs, bench).columns == docs.columns
    assert leaks.find_leaks(empty, bench).count() == 0 and leaks.find_leaks(docs, bench.limit(0)).count() == 0


def _edits(p, s):
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(s, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_leak_kernel():
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    items = [(i, " ".join(rng.sample(words, 20))) for i in range(6)]
    index = leaks.Index.of(items)
    for i, t in items:
        s = list(t)
        for _ in range(12):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], ["z"], [s[k], "y"]])
        doc = " ".join(rng.sample(words, 30)) + "".join(s) + " ".join(rng.sample(words, 5))
        n = _edits(leaks.squeezed(t), leaks.squeezed(doc))
        assert [d for _, j, d in leaks.leaks([doc], index) if j == i] == ([n] if n <= index.edits[i] else [])


def test_leak_hits_in_slices(monkeypatch):
    """Hits counted a few at a time give what they give at once, on repeated strings too."""
    import random

    rng = random.Random(5)
    items = [(1, "abcdefgh" * 12), (2, "".join(rng.choice("abc") for _ in range(90))), (3, "x" * 60)]
    index = leaks.Index.of(items)
    texts = ["abcdefgh" * 30, "x" * 300, "".join(rng.choice("abc") for _ in range(400)) + items[1][1][:45] + "zz" + items[1][1][45:], "q" + items[0][1][:-3]]
    whole = leaks.leaks(texts, index)
    monkeypatch.setattr(leaks, "HITS", 7)
    assert sorted(leaks.leaks(texts, index)) == sorted(whole) and {(0, 0), (1, 2), (2, 1), (3, 0)} <= {(i, j) for i, j, _ in whole}
    assert all(d == _edits(leaks.squeezed(items[j][1]), leaks.squeezed(texts[i])) for i, j, d in whole)


def test_leaks_of_short_items():
    index = leaks.Index.of([(1, "a"), (2, "tiny"), (3, "abc de"), (4, "")])
    assert sorted(leaks.leaks(["a TINY thing", "destiny", "so abc, de!", "abcde"], index)) == [(0, 0, 0), (2, 1, 0)]


def _fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("split", [20_000, 3])
def test_simhash(docs, empty, rows, split):
    f = {i: _fingerprint(t) for i, t, *_ in rows}
    want = _components([(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 4], f)
    out = got(simhash.simhash_components(docs, split=split))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{f[i]:016x}", want[i]) for i in f}
    assert simhash.simhash_components(empty).count() == 0


def test_trie_dense():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.unique((rng.integers(0, 2, (3000, 52)) * (rng.random((3000, 52)) < 0.06)) @ (1 << np.arange(52, dtype=np.uint64)).astype(np.uint64)).astype(np.uint64)
    want = np.arange(len(x))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    simhash._union(want, a, b)
    for held in (100, 1 << 20):
        assert np.array_equal(simhash.trie_forest(np.zeros(len(x), np.int64), x, 4, held), want)


def test_near_duplicates(spark, docs, empty, rows):
    out = {r["doc_id"]: r["keeper"] for r in simhash.near_duplicates(docs).collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := SPACE.findall((t or "").lower())) else {""} for i, t, *_ in rows}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a in sets:
        for b in sets:
            if a < b and near(a, b) >= 0.9:
                assert out[a] == out[b]
        assert out[a] == a or max(near(a, b) for b in sets if b != a and out[b] == out[a]) > 0.4
    kept = simhash.keep_one(docs.union(docs.where("doc_id = 5")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(out.values()))
    assert kept.columns == docs.columns and simhash.keep_one(empty).count() == 0


def _groups(texts, least=0.8):
    """Smallest id of each text's group of near copies, by all pairs of whole sets of five-word shingles."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return _components([(a, b) for a in range(len(sets)) for b in range(a) if near(a, b) >= least], range(len(sets)))


def near_pairs(texts, least=0.8):
    """All pairs whose five-word shingles are `least` alike, without any sketch: rare shingles first, a pair must share one of the first few of each."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (SPACE.findall((t or "").lower()) for t in texts)]
    often = Counter(x for s in sets for x in s)
    held, out = defaultdict(list), []
    for b, s in enumerate(sets):
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]
        for a in {a for x in first for a in held[x]}:
            both = len(s & sets[a])
            if both >= least * (len(s) + len(sets[a]) - both):
                out.append((a, b))
        for x in first:
            held[x].append(b)
    return out


def test_near_duplicates_recall(spark):
    """Every near pair of the driver's documents is in one group, and groups are what near pairs join."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    pairs = [(rows[a][0], rows[b][0]) for a, b in near_pairs([t for _, t in rows])]
    out = {r["doc_id"]: r["keeper"] for r in simhash.near_duplicates(docs).collect()}
    assert len(pairs) > 100 and sum(out[a] == out[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = _components(pairs, list(out))
    assert sum(out[i] == want[i] for i in out) >= 0.99 * len(out)


def test_trie_chain(spark):
    """Prints 0, 0x0f, 0xff are one component, though the first and the last differ in eight bits; as texts, no link goes beyond a near pair."""
    import numpy as np

    assert simhash.trie_forest(np.zeros(3, np.int64), np.array([0, 0x0F, 0xFF], np.uint64)).tolist() == [0, 0, 0]
    rng = np.random.default_rng(8)
    word = lambda: f"c{rng.integers(10**9)}"
    base = [word() for _ in range(400)]
    other = [word() for _ in range(400)]
    texts = [" ".join(x) for x in (other, base, _changed(rng, base, 4, word))]
    assert _keepers(spark, texts) == {0: 0, 1: 1, 2: 1}


def _keepers(spark, texts):
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    return {r["doc_id"]: r["keeper"] for r in out.collect()}


def _changed(rng, words, n, new):
    for at in rng.choice(len(words), n, replace=False):
        words = [*words[:at], new(), *words[at + 1 :]]
    return words


def test_near_duplicates_of_shared_words(spark):
    """Texts over one vocabulary, two copies of each: nothing but their order tells them apart."""
    import numpy as np

    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(300)}"
    base = [[word() for _ in range(5000)] for _ in range(8)]
    texts = [" ".join(w) for b in base for w in (b, _changed(rng, b, 30, word), _changed(rng, b, 30, word))]
    assert _keepers(spark, texts) == _groups(texts) == {i: i - i % 3 for i in range(24)}


def test_near_duplicates_of_large_groups(spark):
    """More copies than are paired at once, some of them near a few of the others only."""
    import numpy as np

    rng = np.random.default_rng(4)
    word = lambda: f"x{rng.integers(10**9)}"
    base = [word() for _ in range(300)]
    far = [_changed(rng, base, 18, word) for _ in range(20)]
    texts = [" ".join(w) for w in [*(_changed(rng, base, int(rng.integers(1, 12)), word) for _ in range(120)), *far, *(_changed(rng, f, 2, word) for f in far)]]
    assert _keepers(spark, texts) == _groups(texts, simhash.NEAR)


def test_near_duplicates_with_block_edits(spark):
    """A part added, cut or moved leaves many words different: four prints over distinct words missed most of such copies."""
    import numpy as np

    rng = np.random.default_rng(5)
    texts = []
    for i in range(120):
        n = int(rng.integers(60, 800))
        word = (lambda: f"z{rng.zipf(1.3) % 20_000}") if i % 2 else (lambda: f"u{rng.integers(20_000)}")
        w = [f"t{i}", *(word() for _ in range(n))]
        more = [word() for _ in range(n // 5)]
        texts += [" ".join(w), " ".join([w + more, w + more[: n // 10], w[: n - n // 7], w[n // 2 :] + w[: n // 2]][i % 4])]
    want = _groups(texts)
    assert sum(want[i] != i for i in want) >= 100
    assert _keepers(spark, texts) == want


def test_near_duplicates_are_near(spark):
    """Texts that share 0.6 to 0.8 stay apart, unless a copy between them is near both."""
    import numpy as np

    rng = np.random.default_rng(6)
    word = lambda: f"v{rng.integers(10**9)}"
    texts = []
    for i in range(40):
        w = [word() for _ in range(400)]
        v = w.copy()
        for at in range(5, 5 + 14 * 20, 20):  # 14 edits: 326 of 466 shingles
            v[at] = word()
        half = [*v[:145], *w[145:]]
        texts += [" ".join(x) for x in ((w, v) if i % 2 else (w, v, half))]
    want = _groups(texts)
    assert sorted(Counter(want.values()).values()) == [1] * 40 + [3] * 20
    assert _keepers(spark, texts) == want


def test_components(spark):
    import random

    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 400)]
    nodes = {x for p in links for x in p if p[0] != p[1]}
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == _components(links, nodes)


def _removed(texts, length, first_stays):
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(raw[i][k : k + length] for i in raw for k in range(len(raw[i]) - length + 1))
    met, out = set(), {}
    for i in sorted(raw):
        gone = [False] * len(raw[i])
        for k in range(len(raw[i]) - length + 1):
            s = raw[i][k : k + length]
            if s in met if first_stays else seen[s] > 1:
                gone[k : k + length] = [True] * length
            met.add(s)
        kept = bytes(c for c, g in zip(raw[i], gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw[i]), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,key,first,crowd", [(200, 50, False, 3000), (200, 32, True, 3000), (40, 12, False, 2), (40, 12, True, 2)])
def test_repeats(docs, empty, rows, length, key, first, crowd):
    want = _removed([(i, t) for i, t, *_ in rows], length, first)
    out = got(suffix.remove_repeats(docs, length, key, first, crowd))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, r in out.items()} == want
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5], [None, 2, 3, 4, 5], [1, 1, 3, 4, 4], [None, None, 3, None, 3], [7, 7, 7, 7, 7]])
def test_repeats_of_odd_ids(spark, ids):
    """Null ids, ids on several texts and repeated rows, each against brute force over rows."""
    import random

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    a, b = text(60), text(90)
    texts = [text(40) + a + text(30) + b, a + text(50) + b + text(10), b + text(20), text(80), None]
    rows = list(zip(ids, texts, strict=True)) + [(ids[3], texts[3])]
    want = _removed(list(enumerate(t for _, t in rows)), 200, False)
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted((str(i), *want[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("first", [False, True])
def test_repeats_of_a_common_line(spark, first):
    """One line among many others: its anchors' groups are dealt again and again."""
    import random

    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    lines = [text(48), text(90)]
    rows = [(i, text(rng.randrange(60)) + lines[i % 2] + text(rng.randrange(60))) for i in range(120)]
    want = _removed(rows, 40, first)
    out = got(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 40, 12, first, 5))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, r in out.items()} == want


def test_long_text(spark):
    """A text of two megabytes goes whole through every operator by rows."""
    import random

    import public_tokenizers

    rng = random.Random(11)
    part = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(1000))
    long = "".join(f"{part} {i} call (212) 555-0147 or a{i}@b.org. " for i in range(380))
    docs = spark.createDataFrame([(1, long), (2, long + "x"), (3, part)], "doc_id long, text string")
    out = got(suffix.remove_repeats(docs))
    assert out[1]["n_bytes"] == len(long) > 2_000_000 and out[1]["n_removed"] == len(long) and out[3]["n_removed"] == len(part)
    found = got(pii.find_pii(docs))
    assert found[1]["n_email"] == 380 and len(re.findall("phone:", found[1]["spans"])) == 380
    f = got(versions.fingerprints(docs))
    assert f[1]["n_chars"] == len(long) and f[1]["near_next"] > 0.99
    assert got(tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")))[1]["n_tokens"] > 400_000
    bench = spark.createDataFrame([(1, part[:400])], "item_id long, text string")
    assert {r["doc_id"] for r in leaks.find_leaks(docs, bench).collect()} == {1, 2, 3}
    assert {r["keeper"] for r in simhash.near_duplicates(docs).collect()} == {1, 3}


def test_mixing(spark, docs, empty, rows):
    out = got(mixing.mix(docs))
    size = {i: len(SPACE.findall(t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for i, r in out.items():
        assert r["size"] == size[i] and r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
        total[source[i]] += size[i]
        taken[source[i]] += r["taken"]
    want = mixing.targets(list(total.items()))
    assert abs(sum(want.values()) - sum(total.values())) < 1e-6
    for s in total:
        r = next(r for i, r in out.items() if source[i] == s)
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(want[s]) and want[s] <= 3 * total[s] + 1e-9
        sums = {0}
        for i in (i for i in size if source[i] == s):
            sums |= {x + size[i] for x in sums}
        whole = min(3, int(want[s] // total[s])) if total[s] else 0
        assert abs(taken[s] - want[s]) <= 1 + min(abs(x + whole * total[s] - want[s]) for x in sums)
    again = got(mixing.mix(docs.repartition(3)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in out.items()}
    assert mixing.mix(empty).count() == 0


def test_mixing_hot_length(spark):
    data = [(i, "a b c", "x" if i % 3 else "y", "en", 0) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.mix(docs).collect()
    assert sum(r["taken"] for r in out if r["source"] == "x") == 900 and sum(r["taken"] for r in out if r["source"] == "y") == 1800


def test_targets_and_fitting():
    import numpy as np

    assert mixing.targets([("a", 10), ("b", 10), ("c", 100), (None, 0)]) == {"a": 22.5, "b": 30.0, "c": 67.5, None: 0.0}
    rng = np.random.default_rng(2)
    for _ in range(60):
        length, count = rng.integers(0, 30, 6), rng.integers(1, 5, 6)
        length = np.unique(length)
        count = count[: len(length)]
        sums = {0}
        for s, n in zip(length, count, strict=True):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        budget = int(rng.integers(0, (length * count).sum() + 1))
        take = mixing.fitted(length, count, budget)
        assert (take <= count).all() and (take >= 0).all()
        share = sum(int(n) * budget // max(1, int((length * count).sum())) * int(s) for s, n in zip(length, count, strict=True))
        assert share <= (take * length).sum()
        assert abs((take * length).sum() - budget) <= min(abs(x - budget) for x in sums) + length.max(initial=0)


def test_fingerprints(docs, empty, rows):
    order = sorted(rows)
    out = got(versions.fingerprints(docs))
    sets = lambda t: set(versions.digests(t or "").tolist())
    like = lambda a, b: 1 - len(sets(a) ^ sets(b)) / n if (n := len(sets(a)) + len(sets(b))) else 1.0
    for (i, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(t, edited), like(t, n)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (sets(t) == sets(edited))
    assert versions.fingerprints(empty).count() == 0 and got(versions.fingerprints(docs.where("doc_id = 3")))[3]["near_next"] == 1.0


def test_fingerprint_buckets(spark, docs, rows):
    order = sorted(r[0] for r in rows)
    seen = defaultdict(list)
    for part in versions.with_next(docs, per_bucket=10).select("bucket", "doc_id", "head").rdd.glom().collect():
        for r in part:
            seen[r["bucket"]].append((r["doc_id"], r["head"]))
    follows = {a: b for x in seen.values() for (a, h), (b, _) in zip(x, x[1:], strict=False) if not h}
    assert follows == dict(zip(order, order[1:] + order[:1], strict=True)) and len(seen) > 5


def _base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(spark, docs, empty, rows):
    out = got(pii.find_pii(docs))
    for i, t, *_ in rows:
        want = _base(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(pii.listed(want).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in want) for j in range(4)]
        assert set(pii.listed(want).split(",")) <= set(out[i]["spans"].split(","))
    assert pii.find_pii(empty).count() == 0
    new = pii.mask_pii(docs)
    assert new.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in new.collect()}
    assert text[10_013] == ("[EMAIL] [PHONE]", 15) and text[10_000] == (None, None)


def test_pii_kernel():
    import random

    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("a.@+- 019(4)é%_") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == _base(t), t
    words, tags = pii._labelled()
    found = pii.viterbi([pii.features(w) for w in words], pii.trained())
    assert sum(list(a) == b for a, b in zip(found, tags, strict=True)) >= 0.95 * len(tags)
    extra = pii._spans(["please call (555) 867-5309 now"], pii.trained())
    assert extra == ([[]], [[(12, 3, 26)]])
    assert pii._spans(["1" * 50_000 + "@" * 10 + "+" * 50_000 + "a" * 100_000], pii.trained())[0] == [[]]


def test_pii_decoding():
    """Viterbi against all label sequences."""
    import itertools

    import numpy as np

    w, t = pii.trained()
    for words in (["call", "(212)", "555-0147", "now"], ["a", "dot", "b"], ["10.0.0.1"], ["mail", "x", "[at]", "y.org"]):
        e = w[np.array(pii.features(words))].sum(axis=1)
        score = lambda y: e[np.arange(len(y)), list(y)].sum() + sum(t[a, b] for a, b in itertools.pairwise(y)) if pii._allowed[0][y[0]] else -1e9  # noqa: E731, B023
        best = max(itertools.product(range(pii.LABELS), repeat=len(words)), key=score)
        assert pii.viterbi([pii.features(words)], (w, t))[0].tolist() == list(best)


def test_pii_long_windows():
    """A span is found wherever it stands in a long run of hints."""
    text = " ".join(f"{i % 7} words and" for i in range(800))
    for at in (180, 199, 200, 201, 700):
        parts = text.split(" ")
        parts[at:at] = ["call", "(212)", "555-0147", "now"]
        line = " ".join(parts)
        s = line.index("(212)")
        assert pii._spans([line], pii.trained())[1] == [[(s, 3, s + 14)]]


def test_urls(spark):
    data = [
        (1, "HTTP://WWW.Example.COM/en/7?x"), (2, "http://example.com/en/1"), (3, "https://a.example.net/de/8#t"), (4, "https://b.net/de/1"), (5, "http://x.org/es/"), (6, "http://x.org/ES/"),
        (7, None), (8, ""), (9, "no scheme/en/"), (10, "://"), (11, "http://com/en/"), (12, "http://notcom.fr/en/"), (13, "http://x.example.com?u=http://y.org/es/"), (14, "a" * 5000 + "://b.com/fr/é"), (14, "http://x.org/es/"),
    ]
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in data], "page_id long, url string, html string, host string")
    out = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()]

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fit, key=lambda r: len(r.name)) if fit else None

    assert len(out) == len(data)
    for i, u in data:
        h, p, r = plain(u)
        assert any(o[:4] == (i, h, p, r and r.name) and o[4] in ({r.verdict} if r else {"allow", "block"}) for o in out), (i, u)
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, [urls.Rule("block", "org", "/es/")]).where("rule is null").collect()} == {"allow"}
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
