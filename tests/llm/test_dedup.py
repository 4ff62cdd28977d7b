"""The de-duplicating operators against brute force, on odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeeper.llm.lines import line_dedup
from tablekeeper.llm.minhash import components, link_group, near_duplicates, union_estimate
from tablekeeper.llm.substring import substring_dedup
from tablekeeper.llm.suffix_array import byte_dedup, earlier_windows, induced_sort

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df):
    big = 1 << 62
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (big if r[0] is None else r[0], r[1]))


def words_left(rows, window):
    first, big = {}, 1 << 62
    key = lambda d: big if d is None else d
    words = [SPLIT.findall(x) for _, x in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            t = tuple(w[i:i + window])
            first[t] = min(first.get(t, big), key(d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < key(d):
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def as_set(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("group", [1 << 21, 40])       # 40 entries: prefixes are split at whole depth
def test_substring_dedup(documents, clashing, group):
    for docs in (documents, clashing):
        got = as_set(substring_dedup(docs, window=13, group=group), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == collections.Counter(words_left(rows_of(docs), 13))


def test_substring_texts(documents):
    r = {x["doc_id"]: x for x in substring_dedup(documents).where("doc_id in (3, 95, 101)").collect()}
    assert r[95]["kept"] == "" and r[95]["n_removed"] == r[95]["n_words"] > 0
    assert r[101]["kept"] == "one" and sha(r[3]["kept"]) == r[3]["kept_sha256"]


def test_empty(nothing):
    assert substring_dedup(nothing).count() == 0
    assert near_duplicates(nothing).count() == 0
    assert byte_dedup(nothing).count() == 0
    assert line_dedup(nothing).count() == 0


def bytes_left(rows, length):
    seen, out = set(), []
    for d, x in rows:
        b = x.encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(b[i:i + length])
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((d, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return out


@pytest.mark.parametrize("length,gram", [(100, 16), (24, 9)])
def test_byte_dedup(documents, length, gram):
    got = as_set(byte_dedup(documents, length=length, gram=gram, shard=1 << 14, block_bytes=1 << 14), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == collections.Counter(bytes_left(rows_of(documents), length))


def test_byte_dedup_null_id(clashing):
    r = byte_dedup(clashing).where("doc_id IS NULL").collect()
    assert len(r) == 1 and r[0]["n_removed"] == r[0]["n_bytes"]


def test_induced_sort():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, a = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        t = np.append(rng.integers(1, a + 1, n), 0).astype(np.uint16)
        assert induced_sort(t, 258, 1 << 20).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_earlier_windows():
    got = [x.tolist() for x in earlier_windows([b"abcdefgh" * 2, b"xbcdefgha", b"abcdefg"], 8)]
    assert got == [[False] * 8 + [True], [False, True], []]


def sets_of(rows, k):
    out = {}
    for d, x in rows:
        w = SPLIT.findall(low(x))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def groups(sets):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if d is not None)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("limits", [{}, {"SHORT": 2, "MIN_LONG": 1}])     # short lists of 2: near copies are gathered by long lists
def test_near_duplicates(documents, monkeypatch, limits):
    import tablekeeper.llm.minhash as m
    for k, v in limits.items():
        monkeypatch.setattr(m, k, v)
    sets = sets_of(rows_of(documents), 4)
    want = groups(sets)
    got = near_duplicates(documents, shingle=4, percent=80, chunk=700).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        (d, len(s), want[d], want[d] == d) for d, s in sets.items()}
    assert len(got) == documents.count() and len(set(want.values())) < len(want) - 10


def test_near_duplicates_null_id(clashing):
    r = near_duplicates(clashing, shingle=4).where("doc_id IS NULL").collect()
    assert [(x["component_id"], x["kept"]) for x in r] == [(None, True)]


def test_near_duplicates_small_sets(spark):
    """Sets of four and five shingles with similarity 0.8, whichever shingle is the odd one."""
    w = "a b c d e f g h".split()
    rows = [(1, " ".join(w)), (2, " ".join(w[1:])), (3, " ".join(w[:-1])), (4, "p q r"), (5, "P q r"), (6, "p q")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 470)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_union_estimate_whole_sets():
    a, b = np.arange(10, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)
    assert union_estimate(a, 10, b, 10, 64) == (8 / 12, 12)


def test_estimate_keeps_pairs_five_errors_low(spark):
    from tablekeeper.llm.minhash import _estimated
    for shared, kept in ((35, 1), (30, 0)):                 # of the union's 64; the bound is 51.2, an error 3.2
        own = (64 - shared) // 2
        common = np.arange(1000, 1000 + shared)
        sides = [np.sort(np.concatenate([common, np.arange(x, x + own), np.arange(5000, 5064 - shared - own)])) for x in (100, 500)]
        rows = [(i, 1000, bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(sides)]
        classes = spark.createDataFrame(rows, "class long, n long, sketch binary")
        pairs = spark.createDataFrame([(0, 1)], "a long, b long")
        assert _estimated(pairs, classes, 64, 80).count() == kept


def test_link_group_spans_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = []
    for i in range(60):
        s = base.copy()
        s[rng.choice(100, int(rng.integers(0, 25)), replace=False)] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    ids = np.arange(60)
    want = groups({int(i): set(s.tolist()) for i, s in zip(ids, sets)})
    links = link_group(ids, sets, np.zeros(60, int), 80)
    assert groups_of(links, 60) == want and len(links) == 60 - len(set(want.values()))


def test_links_of_short_documents_in_long_lists(spark):
    """Stars of a short text and copies with one word more: all links lie in lists of more than SHORT classes."""
    rows, want = [], {}
    for n in range(4, 13):
        base = [f"w{n}x{j}" for j in range(n + 4)]          # n five-word shingles
        for i in range(220):
            rows.append((1000 * n + i, " ".join([*base, f"own{i}"])))
            want[1000 * n + i] = 1000 * n
        rows.append((1000 * n + 999, " ".join(base)))
        want[1000 * n + 999] = 1000 * n
    base = [f"t{j}" for j in range(8)]                      # without the text itself the copies are 4/6 alike
    for i in range(220):
        rows.append((50000 + i, " ".join([*base, f"own{i}"])))
        want[50000 + i] = 50000 + i
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want


def groups_of(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in range(n)}


def alike(a, b):
    if a == b:
        return len(a) >= 4
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_line_dedup(spark, documents):
    more = spark.createDataFrame([
        (200, "x x y z a b c d\nx q y z a b c d\nx x y z a b c d e\nx x y z a b c", "en", "s", 1),
        (201, "X x y z a b c D\n\n  \na b c d\na b c d\na b c\na b c", "en", "s", 1)], documents.schema)
    docs = documents.dropDuplicates(["doc_id"]).unionAll(more)
    rows = rows_of(docs)
    lines = [(d, k, tuple(SPLIT.findall(low(x)))) for d, t in rows for k, x in enumerate(t.split("\n"))]
    gone = {(d, k) for i, (d, k, w) in enumerate(lines) if len(w) >= 4 and any(alike(v, w) for _, _, v in lines[:i])}
    want = []
    for d, t in rows:
        each = t.split("\n")
        n, m = sum(bool(SPLIT.search(x)) for x in each), sum((d, k) in gone for k in range(len(each)))
        want.append((d, n, m, sha("\n".join(x for k, x in enumerate(each) if (d, k) not in gone)), n > 0 and n == m))
    got = line_dedup(docs)
    assert as_set(got, "doc_id", "n_lines", "n_removed", "kept_sha256", "emptied") == collections.Counter(want)
    assert sum(w[2] for w in want) > 20


def test_line_dedup_null_id_and_repeated_rows(clashing):
    r = {(x["doc_id"], x["emptied"]) for x in line_dedup(clashing).where("doc_id IS NULL OR doc_id = 7").collect()}
    assert (None, True) in r and (7, True) in r          # the second row of 7 loses its lines to the first


def test_substrings_with_many_continuations_of_one_beginning(spark):
    """60,000 windows that share their first eight words and differ in the last five: none repeats."""
    docs = spark.range(60000).selectExpr("id AS doc_id", "concat('a b c d e f g h i', id % 40, ' j', id % 43, ' k', id, ' l', id % 7, ' m') AS text")
    out = substring_dedup(docs, window=13, texts=False)
    assert out.agg(F.sum("n_removed"), F.count("*")).first() == (0, 60000)
