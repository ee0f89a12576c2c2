"""12: the trie against plain code over whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tessera.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k int, k1 string"


def plain(rows):
    """Nodes as (conv_id, depth): the other columns."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + v[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(built):
        seq = tuple(built[c])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    leaves, saved, out = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) if kids[key] else 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        up = members[key[:-1]][0] if key else None
        digest = hashlib.sha256(",".join(map(str, ends.get(key, []))).encode()).hexdigest()
        out[members[key][0], len(key)] = (up, len(members[key]), len(kids[key]), leaves[key], saved[key], digest)
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, copies, ids without a base, ties, nulls, repeated rows, rows without an id."""
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 60), 103, 104, 1_000_003, 1_000_004]:
        for t in range(rng.randint(1, 12)):
            same = rng.random() < 0.6
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]) if not same else "user", f"turn {t} é" if same else rng.choice([None, "", "x", f"own {c} {t}"]), 1, 2, "z"))
    rows += [(200 + i, t, "user", f"copy {t}", 1, 2, "z") for i in range(25) for t in range(10)]
    return rows + rows[:10] + [(None, 1, "user", "lost", 1, 2, "z")] * 3


@pytest.mark.parametrize("chunk", [tries.CHUNK, 3])
def test_trie(spark, talks, chunk):
    assert found(tries.conversation_trie(spark.createDataFrame(talks, SCHEMA).repartition(5), chunk)) == plain(talks)


def test_long_conversation(spark):
    """One conversation of many turns, and one that leaves it halfway; its parts lie in several tasks."""
    rows = [(0, t, "user", f"t{t}", 0, 0, "") for t in range(5000)] + [(7, t, "user", f"t{t}" if t < 2500 else "other", 0, 0, "") for t in range(2600)] + [(8, 0, "user", "t0", 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = found(tries.conversation_trie(df, 512))
    want = plain_chain(rows)
    assert {k: got[k][1:5] for k in want} == want and len(got) == len(want)


def plain_chain(rows):
    """As plain(), for conversations whose sequences are too long to be keys: by digests of prefixes."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        own[c].append((t, role, text))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, last, up, kids = defaultdict(list), {}, {}, defaultdict(set)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        key = ("", 0)
        members[key].append(c)
        for d, x in enumerate(turns.get(c - c % 5, [])[:h] + turns[c][h:], 1):
            new = (hashlib.sha256(repr((key, x)).encode()).hexdigest(), d)
            up[new], last[new] = key, x
            kids[key].add(new)
            members[new].append(c)
            key = new
    leaves, saved = {}, {}
    for key in sorted(members, key=lambda k: -k[1]):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * (len(last[key][1].encode()) if key in last else 0)
    return {(members[k][0], k[1]): (len(members[k]), len(kids[k]), leaves[k], saved[k]) for k in members}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.conversation_trie(empty).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "a", 0, 0, "")], SCHEMA)
    assert tries.conversation_trie(lost).count() == 0
    one = [(3, None, None, None, 0, 0, "")]
    assert found(tries.conversation_trie(spark.createDataFrame(one, SCHEMA))) == plain(one)
