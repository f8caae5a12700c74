import collections
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import SF

from terralake.llm import prefixes, radix

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]


def _trie(convs):
    """{prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, members that end there)}"""
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return {p: (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]) if p in kids else 0, leaves[p], saved[p], sorted(ends[p])) for p, m in members.items()}


def _conversations(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(turns)) for c, turns in convs.items()}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 5 for x in b)), max_size=60) | st.lists(st.binary(min_size=1, max_size=2), max_size=400))
def test_the_tree_holds_its_keys_in_order(keys):
    tree = radix.Tree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    found = {}
    stack = [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        here = at + node.path
        if node.value >= 0:
            found[here] = node.value
        below = list(node.branches())
        assert [b for b, _ in below] == sorted({b for b, _ in below}) and all(node.child(b) is n for b, n in below)
        assert len(below) <= node.layout and (node.layout == radix.FOUR or len(below) > {16: 4, 48: 16, 256: 48}[node.layout])
        assert node.value >= 0 or len(below) > 1 or node is tree.root
        stack += [(n, here + bytes([b])) for b, n in below]
    assert found == {key: number for number, key in enumerate(keys)}


def _rows():
    """Copies in plenty, a first turn that most share, one that begins another, long ones, and ids below zero."""
    rng = random.Random(5)
    rows = []
    for c in range(-20, 300):
        if c % 3 == 0:
            turns = ["hot"] * 3
        elif c % 50 == 1:
            turns = ["hot"] + [f"deep {k} {c % 100}" for k in range(120)]
        else:
            turns = [rng.choice(["hot", "hot", "hé🙂", "c"])] + [rng.choice("abc") for _ in range(rng.randrange(4))]
        rows += [(c, k, rng.choice(["user", "user", None]) if c % 7 == 0 else "user", t) for k, t in enumerate(turns)]
    return rows + [(500, None, "user", "hot"), (500, 0, None, None), (500, 1, "x", ""), (None, 0, "user", "none"), (501, 0, "user", "same"), (501, 0, "user", "same")]


def _check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, node string, n_convs string")
    want = sorted((*v[:7], len(v[7])) if v[2] is not None else (*v[:2], -1, *v[3:7], len(v[7])) for v in _trie(_conversations([r for r in rows if r[0] is not None])).values())
    found = prefixes.prefix_trie(df)
    got = sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in found.select(COLUMNS).collect())
    assert got == want
    return df, found


def test_trie_over_one_range_and_over_many(spark, monkeypatch):
    rows = _rows()
    _check(spark, rows)
    monkeypatch.setattr(prefixes, "RANGE_KEYS", 6)
    df, found = _check(spark, rows)
    parents = {bytes(r.node): r.parent for r in found.collect()}
    assert sum(p is None for p in parents.values()) == 1 and all(p is None or bytes(p) in parents for p in parents.values())
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    keys = prefixes.keyed(prefixes.sequences(df))
    got = collections.Counter(r.ends_sha256 for r in prefixes.ends_digests(keys).collect())
    assert got == collections.Counter(hashlib.sha256(",".join(map(str, v[7])).encode()).hexdigest() for v in _trie(_conversations(r for r in rows if r[0] is not None)).values() if v[7])


def test_no_conversations(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).count() == 0


def test_rebuilt_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(200, 0, "user", "x"), (205, 0, "user", "y"), (333, 0, "user", "alone"), (-30, 0, "user", "below")]
    convs = _conversations(rows)
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        want[c] = convs.get(base, ())[:h] + turns[h:]
    assert any(not t for t in want.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefixes.nodes(prefixes.keyed(prefixes.rebuilt(prefixes.sequences(df))))
    expected = _trie(want)
    key = lambda v: tuple(-1 if x is None else x for x in v)
    assert sorted(key(tuple(r[c] for c in COLUMNS)) for r in found.collect()) == sorted(key((*v[:7], len(v[7]))) for v in expected.values())
